"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between two starts or ends of block-level elements. Each block is described by
its own tag, its ancestors' tags and class words, its length, marks, share of linked text, and its place. A chain with
two labels (main text or not), trained by conditional likelihood on labelled pages, is decoded by Viterbi. The labelled
pages come from a generator in this module, which lays out invented text in many ways and knows what belongs to the
article; training takes place once per process on the driver, and its weights are sent to the executors.

Scripts, styles, templates, the head and comments never become text. Character references are decoded; white space
inside a block becomes one space, and blocks are joined in page order by one line feed. Nothing is capped.

Tags are read by the rules of HTML: a quote within an unquoted value is part of it, one in front of a value opens it. Work is in
proportion to the length of a page however deep its elements are nested: what is open is counted, not walked through, and of
class words only those are kept that the model has weights for.

Defined results: null or empty html gives an empty text; an element that never ends is read to the end of the page, and so is a
quoted value; a ``<`` that starts no tag is text; repeated rows are extracted each on its own; columns whose names clash with the
added ones, in whatever case, are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import named, others, prepare, slices, spare, text_of

#: Fixed values of HTML: elements that start and end blocks, that have no end, and whose content is no text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "template", "title", "noscript", "head", "textarea", "iframe", "svg")
#: Start tags that end an open element of the same kind.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</(?![a-zA-Z])[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+{_VALUE}?+)?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"'][^\s>]*+))?+)?+""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that do not keep an item or paragraph from ending the one before it.
_LOOSE = ("p", "li")


class Block:
    """``tag``: the innermost block element; ``tags``, ``names``: block elements around it, and words of the classes, ids and roles of
    all that is open; ``linked``: characters within links."""

    __slots__ = ("text", "linked", "tag", "tags", "names")

    def __init__(self, text: str, linked: int, tag: str, tags: frozenset[str], names: frozenset[str]):
        self.text, self.linked, self.tag, self.tags, self.names = text, linked, tag, tags, names


def _names(attributes: str) -> tuple[str, ...]:
    found: list[str] = []
    for a in _ATTRIBUTE.finditer(attributes):
        name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if name in ("class", "id", "role"):
            found += _WORD.findall(value.lower())
        elif name == "hidden" or name == "style" and _HIDDEN.search(value):
            found.append("hidden")
    return tuple(found)


class _Open:
    """The open elements: a stack, and for what is asked of it the places at which each tag, block and barrier stands."""

    def __init__(self, known: frozenset[str] | None):
        self.known, self.stack, self.at = known, [], {}
        self.blocks: list[int] = []
        self.barriers: list[int] = []
        self.names: dict[str, int] = {}
        self.around: tuple[str, frozenset, frozenset] | None = None

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        if self.known is not None:
            names = tuple(w for w in names if w in self.known)
        n = len(self.stack)
        self.stack.append((tag, names))
        self.at.setdefault(tag, []).append(n)
        if tag in BLOCKS:
            self.blocks.append(n)
            if tag not in _LOOSE:
                self.barriers.append(n)
        for w in names:
            self.names[w] = self.names.get(w, 0) + 1
        if names or tag in BLOCKS:
            self.around = None

    def cut(self, n: int) -> None:
        """Ends all elements from place ``n`` on."""
        while len(self.stack) > n:
            tag, names = self.stack.pop()
            self.at[tag].pop()
            for places in (self.blocks, self.barriers):
                if places and places[-1] == len(self.stack):
                    places.pop()
            for w in names:
                self.names[w] -= 1
                if not self.names[w]:
                    del self.names[w]
            if names or tag in BLOCKS:
                self.around = None

    def about(self) -> tuple[str, frozenset, frozenset]:
        """Innermost block, blocks around it, names: the same objects until something changes."""
        if self.around is None:
            own = self.stack[self.blocks[-1]][0] if self.blocks else "none"
            tags = frozenset(t for t, places in self.at.items() if t in BLOCKS and len(places) > (t == own))
            self.around = own, tags, frozenset(self.names)
        return self.around


def blocks_of(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks with text, in page order; with ``known`` only those names are kept."""
    out: list[Block] = []
    opened, parts = _Open(known), []
    linked, at, n = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, *opened.about()))
            parts.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if opened.at.get("a"):
            linked += len(raw.strip())

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        block = tag in BLOCKS
        if m[1]:
            if block:
                flush()
            place = opened.last(tag)
            # An inline end does not reach over the block that it stands in.
            if place >= 0 and (block or not opened.blocks or place > opened.blocks[-1]):
                opened.cut(place)
            continue
        if block:
            flush()
            place = max(map(opened.last, CLOSES.get(tag, ())), default=-1)
            if place >= 0 and (not opened.barriers or place >= opened.barriers[-1]):
                opened.cut(place)
        elif tag == "br":
            parts.append(" ")
        if tag in SILENT:
            if tag == "svg" and m[3].endswith("/"):
                continue
            end = _end_of(tag).search(page, at)
            at = end.end() if end else n if tag != "head" else at
            continue
        if tag not in VOID:
            opened.push(tag, _names(m[3]) if m[3] else ())
    flush()
    return out


@lru_cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+>?", re.I)


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(blocks):
        own = b.tag if b.tag not in ("html", "body") else "none"
        words = b.text.count(" ") + 1
        size = min(int(math.log2(words)), 7)
        links = min(int(4 * b.linked / max(len(b.text), 1)), 4)
        f = ["one", f"tag:{own}", f"size:{size}", f"links:{links}", f"size:{size}:links:{links}", f"tag:{own}:links:{links}"]
        f += [f"in:{t}" for t in b.tags if t not in ("html", "body")]
        f += [f"name:{w}" for w in b.names]
        if own in ("article", "main") or "article" in b.tags or "main" in b.tags:
            f += [f"within:{own}", f"within:size:{size}"]
        f.append("stop" if b.text[-1] in ".!?:\"”»" else "nostop")
        f.append("first" if i == 0 else "last" if i == len(blocks) - 1 else "middle")
        out.append(f)
    return out


class Chain:
    """Label 1 is main text. ``weights`` score label 1 against 0; ``steps[a][b]`` scores b after a, ``start[b]`` b in front."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.known: frozenset[str] = frozenset()
        self.start, self.steps = [0.0, 0.0], [[0.0, 0.0], [0.0, 0.0]]

    def unary(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in r]) for r in rows]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi; of equal paths the one with more zeros at the end."""
        if not rows:
            return []
        score, back = None, []
        for u in self.unary(rows):
            if score is None:
                score = (self.start[0], self.start[1] + u)
                continue
            s, (a, b) = self.steps, score
            to0, to1 = (a + s[0][0], b + s[1][0]), (a + s[0][1], b + s[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            score = (max(to0), max(to1) + u)
        y = [int(score[1] > score[0])]
        for step in reversed(back):
            y.append(step[y[-1]])
        return y[::-1]

    def step(self, rows: list[list[str]], labels: list[int], rate: float, squares: dict, penalty: float) -> None:
        """One gradient step on the conditional likelihood of a page, by forward and backward sums."""
        u = self.unary(rows)
        n = len(u)
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        s = self.steps
        ahead = [(self.start[0], self.start[1] + u[0])]
        for x in u[1:]:
            a, b = ahead[-1]
            ahead.append((add(a + s[0][0], b + s[1][0]), add(a + s[0][1], b + s[1][1]) + x))
        behind = [(0.0, 0.0)]
        for x in u[:0:-1]:
            a, b = behind[-1]
            behind.append((add(s[0][0] + a, s[0][1] + x + b), add(s[1][0] + a, s[1][1] + x + b)))
        behind.reverse()
        total = add(*ahead[-1])
        gradient: dict = {}
        for t in range(n):
            p = math.exp(ahead[t][1] + behind[t][1] - total)
            for f in rows[t]:
                gradient[f] = gradient.get(f, 0.0) + labels[t] - p
            if t == 0:
                gradient["start", 1] = labels[0] - p
                gradient["start", 0] = p - labels[0]
            else:
                for a in (0, 1):
                    for b in (0, 1):
                        q = math.exp(ahead[t - 1][a] + s[a][b] + (u[t] if b else 0.0) + behind[t][b] - total)
                        gradient[a, b] = gradient.get((a, b), 0.0) + (labels[t - 1] == a and labels[t] == b) - q
        for f, g in gradient.items():
            old = self.weights.get(f, 0.0) if isinstance(f, str) else self.start[f[1]] if f[0] == "start" else s[f[0]][f[1]]
            g -= penalty * old
            squares[f] = squares.get(f, 0.0) + g * g
            new = old + rate * g / math.sqrt(squares[f] + 1e-8)
            if isinstance(f, str):
                self.weights[f] = new
            elif f[0] == "start":
                self.start[f[1]] = new
            else:
                s[f[0]][f[1]] = new


def fit(pages: list[tuple[str, list[int]]], passes: int = 6, rate: float = 0.3, penalty: float = 0.01, seed: int = 4) -> Chain:
    """From (html, label of each leaf block)."""
    chain, squares, order = Chain(), {}, random.Random(seed)
    rows = [(features(blocks_of(page)), labels) for page, labels in pages]
    rows = [(f, y) for f, y in rows if f and len(f) == len(y)]
    for _ in range(passes):
        order.shuffle(rows)
        for f, y in rows:
            chain.step(f, y, rate, squares, penalty)
    chain.known = frozenset(f.removeprefix("name:") for f in chain.weights if f.startswith("name:"))
    return chain


#: What the generator calls the parts of a page that are not the article.
_ASIDE = ("sidebar", "widget", "related", "recommended", "popular", "trending", "promo", "newsletter", "subscribe", "share", "social", "tags", "breadcrumb", "pagination", "author bio", "meta")
_NOTICE = ("cookie notice", "notice", "consent", "banner", "alert", "gdpr", "popup", "modal", "disclaimer", "warning")
_ADVERT = ("ad", "ads", "advert", "advertisement", "sponsored", "ad slot", "adbox", "promo ad", "sponsor")
_REPLY = ("comments", "comment", "comment list", "replies", "discussion", "responses", "reader comments", "disqus")
_MENU = ("menu", "navbar", "nav", "topbar", "navigation", "links", "site nav")
_MAIN = ("content", "post", "entry content", "article body", "story", "main", "post content", "text", "body", "page content")


def labelled_pages(number: int = 260, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages of invented text in many layouts, with the label of each leaf block."""
    return [_page(random.Random(seed * 100_003 + i)) for i in range(number)]


def _page(r: random.Random) -> tuple[str, list[int]]:
    labels: list[int] = []
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9)))
    sentence = lambda a, b: (" ".join(word() for _ in range(r.randint(a, b)))).capitalize() + r.choice(("", ".", ".", ".", "!", "?"))
    prose = lambda: " ".join(sentence(1, 16) for _ in range(r.choice((1, 1, 1, 2, 4, 8))))
    pick = lambda names: r.choice((f' class="{r.choice(names)}"', f' id="{r.choice(names).split()[0]}"'))

    def block(tag: str, text: str, main: int, extra: str = "") -> str:
        labels.append(main)
        return f"<{tag}{extra}>{text}</{tag}>"

    def menu() -> str:
        items = "".join(block("li", f'<a href="/{word()}">{sentence(1, 3)}</a>', 0) for _ in range(r.randint(2, 8)))
        return r.choice(("<nav>{}</nav>", f"<div{pick(_MENU)}>{{}}</div>", "<nav class='menu'>{}</nav>", "<header>{}</header>")).format(f"<ul>{items}</ul>")

    def aside() -> str:
        inner = "".join(r.choice((lambda: block("p", prose(), 0), lambda: block("li", f"<a href=x>{sentence(2, 8)}</a>", 0), lambda: block("h3", sentence(1, 5), 0)))() for _ in range(r.randint(1, 4)))
        return r.choice((f"<aside>{inner}</aside>", f"<div{pick(_ASIDE)}>{inner}</div>", f"<section{pick(_ASIDE)}>{inner}</section>", f"<aside{pick(_ASIDE)}>{inner}</aside>"))

    def small(names: tuple, deep: bool) -> str:
        tag = r.choice(("div", "div", "section", "p"))
        if r.random() < 0.15:
            names = tuple(f'{x}" {y}="' for x in names for y in ("hidden style", 'style="display:none" data-x'))
        if deep and tag != "p":
            return f"<{tag}{pick(names)}>" + "".join(block("p", prose(), 0) for _ in range(r.randint(1, 3))) + f"</{tag}>"
        return block(tag, prose() if r.random() < 0.7 else sentence(1, 6), 0, pick(names))

    def form() -> str:
        return "<form action=/s>" + block(r.choice(("p", "div", "label")), sentence(1, 6), 0).replace("<label>", "<div>").replace("</label>", "</div>") + "<input name=q></form>"

    def replies() -> str:
        tag = r.choice(("section", "div", "ol"))
        head = block(r.choice(("h2", "h3")), sentence(1, 3), 0) if r.random() < 0.5 else ""
        inner = "".join(block(r.choice(("p", "div", "li")), prose(), 0) for _ in range(r.randint(1, 5)))
        return f"<{tag}{pick(_REPLY)}>{head}{inner}</{tag}>"

    def article() -> str:
        out = []
        title = block("h1", sentence(1, 10), 1) if r.random() < 0.85 else ""
        if title and r.random() < 0.3:
            title = f"<header>{title}</header>"
        out.append(title)
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            k = r.random()
            if k < 0.66:
                out.append(block("p", prose(), 1))
            elif k < 0.72:
                labels.append(1)
                out.append(f"<p><b>{sentence(1, 12)}<br>")
            elif k < 0.78:
                out.append(block(r.choice(("h2", "h3", "h4")), sentence(1, 7), 1))
            elif k < 0.83:
                out.append(block("blockquote", prose(), 1))
            elif k < 0.88:
                out.append("<ul>" + "".join(block("li", sentence(1, 12), 1) for _ in range(r.randint(1, 4))) + "</ul>")
            elif k < 0.90:
                out.append("<table><tr>" + "".join(block("td", sentence(1, 3), 1) for _ in range(3)) + "</tr></table>")
            elif k < 0.92:
                out.append(block("pre", sentence(2, 12), 1))
            elif k < 0.95:
                out.append(small(_ADVERT, r.random() < 0.3))
            elif k < 0.97:
                out.append(aside())
            else:
                out.append(block("p", f"{sentence(2, 8)} <a href=x>{sentence(1, 4)}</a> {sentence(2, 8)}", 1))
        inner = "".join(out)
        return r.choice(("<article>{}</article>",) * 4 + ("<main>{}</main>", "<main><article>{}</article></main>", f"<div{pick(_MAIN)}>{{}}</div>", f"<article{pick(_MAIN)}>{{}}</article>", f"<section{pick(_MAIN)}>{{}}</section>")).format(inner)

    def footer() -> str:
        tag = r.choice(("footer", "footer", "div class='footer'"))
        if r.random() < 0.5:
            return block(tag.split()[0], "&copy; " + sentence(1, 9), 0, tag[len(tag.split()[0]) :])
        return f"<{tag}>" + block("p", "&copy; " + sentence(1, 9), 0) + block("p", f"<a href=x>{sentence(1, 3)}</a>", 0) + f"</{tag.split()[0]}>"

    parts = []
    for chance, make in (
        (0.4, lambda: small(_NOTICE, r.random() < 0.4)), (0.3, lambda: f"<header>{block('p', sentence(1, 5), 0)}</header>"), (0.85, menu), (0.2, form), (0.6, lambda: small(_ADVERT, r.random() < 0.3)), (0.3, aside),
        (1.0, article), (0.4, replies), (0.3, aside), (0.2, form), (0.3, lambda: small(_ADVERT, r.random() < 0.3)), (0.2, lambda: small(_NOTICE, r.random() < 0.4)), (0.9, footer),
    ):
        if r.random() < chance:
            parts.append(make())
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>", labels


@lru_cache
def trained() -> Chain:
    return fit(labelled_pages())


def main_text(page: str, chain: Chain) -> str:
    found = blocks_of(page, chain.known)
    return "\n".join(b.text for b, y in zip(found, chain.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, html: str = "html", chain: Chain | None = None) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` (its code points)."""
    prepare(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(chain or trained())  # some hundred weights
    own = others(pages, html, "text", "n_chars")
    rows = pages.select(*map(named, own), text_of(html).alias(spare(pages, "_html")))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, 256):
            texts = [main_text(t, sent.value) for t in x.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns[: len(own)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*own, "text", "n_chars"])

    return rows.mapInArrow(go, T.StructType(rows.schema.fields[:-1]).add("text", "string").add("n_chars", "long"))
