"""Pages written by hand, of kinds that no generator made. Blocks of the article carry the attribute data-m, which no feature
looks at."""

PAGES = (
    """<!doctype html><html><head><title>Harbour bridge reopens</title><style>.x{color:red}</style></head><body>
<div id="cookie-consent" role="dialog"><p>We value your privacy. Accept all cookies or manage your choices.</p><button>Accept</button></div>
<header class="site-header"><a href="/">The Daily Tide</a><nav class="main-nav"><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/opinion">Opinion</a></li></ul></nav></header>
<main><article class="story"><h1 data-m>Harbour bridge reopens after two years of repairs</h1>
<p data-m>Traffic began to cross the old harbour bridge again on Monday morning, two years after inspectors found cracks in its main girders.</p>
<div class="ad-slot"><p>Advertisement</p></div>
<p data-m>The city paid <a href="/cost">most of the cost</a>, with the rest coming from a state fund for historic structures.</p>
<h2 data-m>What has changed</h2><ul><li data-m>A separate lane for bicycles</li><li data-m>New lamps along both footways</li></ul>
<blockquote data-m>&ldquo;It feels lighter than before,&rdquo; said one of the first drivers to cross.</blockquote>
<p data-m>A second phase, planned for the spring, will repaint the towers.</p></article></main>
<aside class="related"><h3>Related stories</h3><ul><li><a href="/1">Ferry fares to rise in June</a></li><li><a href="/2">Old pier to be torn down</a></li></ul></aside>
<section id="comments"><h3>Comments (2)</h3><p>About time, it was a nightmare to drive round.</p><p>Looks great!</p></section>
<footer><p>&copy; 2024 The Daily Tide. All rights reserved.</p><ul><li><a href="/terms">Terms</a></li><li><a href="/privacy">Privacy</a></li></ul></footer></body></html>""",
    """<html><body class=blog><div id=wrapper><div id=topbar><a href=/>Notes from a small kitchen</a> | <a href=/about>About me</a></div>
<div id=content><div class=post><h1 data-m>Bread that needs no kneading</h1><div class="post-body"><p data-m>Mix flour, salt, yeast and water in a bowl until nothing dry is left, cover it and go to bed.</p>
<p data-m>In the morning the dough will have doubled. Fold it over twice on a floured board.<p data-m>Heat an iron pot for half an hour at the highest setting your oven has.
<h3 data-m>Baking</h3><p data-m>Thirty minutes with the lid, fifteen without. Let it cool, however hard that is.</div></div>
<div class="share-buttons"><a href=#>Tweet</a> <a href=#>Share</a> <a href=#>Pin</a></div></div>
<div id=sidebar><div class=widget><h3>Popular posts</h3><ul><li><a href=/p1>Soup of the week</a><li><a href=/p2>How to keep herbs</a></ul></div><div class=widget><h3>Subscribe</h3><form action=/s><p>Get new recipes by mail</p><input name=mail></form></div></div>
<div id=footer>Powered by flour. All text may be shared.</div></div></body></html>""",
    """<html lang=de><body><div class="banner notice">Wir verwenden Cookies, um unsere Seite zu verbessern. <a href=#>Mehr erfahren</a></div><nav><a href=/>Start</a> <a href=/politik>Politik</a> <a href=/kultur>Kultur</a></nav>
<article><header><h1 data-m>Museum zeigt verschollene Karten</h1></header><p data-m>Drei Seekarten aus dem siebzehnten Jahrhundert sind seit gestern im Stadtmuseum zu sehen. Sie galten seit dem Krieg als verloren.</p>
<div class="promo newsletter"><p>Jeden Morgen das Wichtigste: Newsletter bestellen!</p></div>
<p data-m>Gefunden wurden sie bei der R&auml;umung eines Dachbodens. &bdquo;Wir wollten die Kiste schon wegwerfen&ldquo;, sagt die Finderin.</p><p data-m>Die Ausstellung l&auml;uft bis Ende M&auml;rz.</p></article>
<aside><p>Anzeige: Jetzt Segelkurs buchen.</p></aside><footer>Impressum | Datenschutz | Kontakt</footer></body></html>""",
    """<html><body><nav class="breadcrumb"><a href=/docs>Docs</a> / <a href=/docs/io>Input</a></nav><div class="navigation"><ul><li><a href=a>Install</a></li><li><a href=b>First steps</a></li><li><a href=c>Reading files</a></li><li><a href=d>Writing files</a></li></ul></div>
<main class="page-content"><h1 data-m>Reading files</h1><p data-m>Files are read lazily: nothing is opened before the first row is asked for.</p><h2 data-m>Options</h2>
<table><tr><td data-m>header</td><td data-m>whether the first line names the columns</td></tr><tr><td data-m>quote</td><td data-m>the character that encloses a value</td></tr></table>
<pre data-m>rows = read("a.csv", header=True)</pre><p data-m>Lines that cannot be read are reported at the end, with their numbers.</p></main>
<div class="pagination"><a href=b>Previous: First steps</a> <a href=d>Next: Writing files</a></div><footer><p>Built with care. Last updated in May.</p></footer></body></html>""",
    """<html><body><header id="header"><form action="/search"><p>Search the archive</p><input name=q></form><ul class="menu"><li><a href=/>Home</a><li><a href=/issues>Issues</a><li><a href=/authors>Authors</a></ul></header>
<section class="entry-content"><h1 data-m>The lighthouse keeper</h1><p data-m>Nobody had lived on the rock for eleven years when the letter came.</p><p data-m>It was addressed to the keeper, by name, and it asked whether the lamp would be lit on the ninth.</p><p data-m>"There is no lamp," said the postman.</p><p data-m>"No," I said.</p><p data-m>But we rowed out on the ninth all the same, and sat in the dark beneath the tower, and waited.</p></section>
<div class="author-bio meta"><p>M. Varga writes about islands. This is her third story in the archive.</p></div><section class="replies discussion"><ol><li>I cried at the end.</li><li>The postman is the best character you have written so far, please do more of him.</li></ol></section>
<div class="footer"><p>Archive of Small Stories</p></div></body></html>""",
    """<html><body><div style="display:none"><p>You need to enable scripts to use this site. Contact us if the problem goes on.</p></div><div class="topbar links"><a href=1>Weather</a><a href=2>Traffic</a></div>
<main><article class="post"><h1 data-m>Snow closes three passes</h1><p data-m>Heavy snow has closed three mountain passes, and the road service does not expect them to open before Thursday.</p><p data-m>Drivers are asked to use the tunnel instead.</p><section class="sponsored"><p>Sponsored: winter tyres from 49 a piece, fitted while you wait.</p></section><p data-m>More snow is forecast for the night.</p></article></main>
<div class="recommended"><h3>You may also like</h3><p><a href=3>How to drive on ice</a></p><p><a href=4>The coldest village in the country</a></p></div><div id="disqus"><p>First! Stay safe everyone.</p></div><footer class=f>Contact the newsroom</footer></body></html>""",
)
