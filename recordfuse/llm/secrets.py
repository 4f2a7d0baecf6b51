"""Secret scans with DataFrame functions alone.

Base kinds, each matched leftmost and without overlap in the whole text, in code points:
``assign`` (a key word, a colon or equals sign, a value of 6 characters or more), ``access`` (access key ids of 20 or
more), ``hex`` (24 or more hexadecimal digits).

The method adds ``random``: tokens of 16 characters or more that pass as random in the encoding they seem to be in.

* Tokens: an equals sign ends a token, and belongs to it only as padding. A token that no encoding fits mixes the signs
  of base64 with those of base64url; its parts between the ones, between the others and between all of them are tested
  each. Picked parts that overlap are listed as one span.
* Encoding: hex, base32, base36, base62, base64 or base64url, by the characters used, when letters and digits mix.
* Battery under the hypothesis "drawn at random from that alphabet": chi-squared uniformity of the symbols (with the
  exact mean and variance for that length), Wald-Wolfowitz runs above and below the alphabet's middle, and serial
  correlation at lag 1. The smallest of the three p-values, times three, is the battery's p.
* False discoveries: the hypothesis to refute is "an ordinary token". The likelihood ratio of the random alphabet against a
  chain of character classes as ordinary tokens have them has mean 1 under that hypothesis, so it is an e-value; times
  min(1, p / ``ALPHA``), which takes evidence away where the battery says that the token is not random either, it still is one
  (it only became smaller). It can only become large in long tokens. Within each range of lengths the e-BH rule picks tokens among
  all that were tested there, whatever the battery said of them, which bounds the share of ordinary tokens among those picked by
  ``FDR`` under any dependence. The bound is as good as the chain (``ORDINARY``, a fixed parameter) is a model of ordinary
  tokens. The rule's thresholds come from counts by length range and evidence over all rows (a fixed number of cells).

Random tokens inside a base span are not listed again. Texts are scanned once: spans and candidates are written to the
shared folder, the thresholds counted from them. Nothing is shuffled but those counts.

Defined results: null text counts as empty (no spans); repeated rows give their spans each; an empty table gives an
empty table; columns whose names clash with the added ones, in whatever case, are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .runtime import named, others, spare, text_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
_TOKEN = "A-Za-z0-9+/_-"
TOKEN = f"(?<![{_TOKEN}])[{_TOKEN}]{{16,}}+(?:=++(?![{_TOKEN}]))?+"
#: Parts of a token with signs of both kinds: as base64url, as base64, and without signs.
PARTS = ("[A-Za-z0-9_-]{16,}+=*+", "[A-Za-z0-9+/]{16,}+=*+", "[A-Za-z0-9]{16,}+=*+")

FDR, ALPHA = 0.01, 0.001

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: name, what the token without padding looks like, alphabet. The first that fits is taken.
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^(?:[a-z0-9]+|[A-Z0-9]+)$", _DIGITS + _LOWER),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)

#: How ordinary tokens go from one class of characters to the next: lower, upper, digit, sign (rows: from).
ORDINARY = (
    (0.90, 0.04, 0.03, 0.03),
    (0.65, 0.30, 0.03, 0.02),
    (0.05, 0.04, 0.85, 0.06),
    (0.50, 0.25, 0.20, 0.05),
)
#: Lower ends of the length ranges within which false discoveries are controlled.
LENGTHS = (16, 20, 24, 32, 48, 64, 128)
_LOW, _HIGH, _STEP = -20.0, 60.0, 0.25
_BLOCK = 256


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of all matches. What lies between matches comes from ``split``, so lengths add
    up to positions. Sums run over blocks of 256 matches and within a block, never over all matches for each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(text.rlike(pattern), _placed(found, gaps)).otherwise(empty)


def _placed(found: Column, gaps: Column) -> Column:
    def with_steps(s: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(s.steps) - 1) / _BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(s.steps, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x),
        )
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.transform(F.array(before), lambda p: _starts(s, p))[0]

    one = F.struct(found.alias("found"), gaps.alias("gaps"), F.zip_with(found, gaps, lambda m, g: F.length(m) + g).alias("steps"))
    # zip_with pads the last gap, which follows all matches, with a null step.
    one = F.transform(F.array(one), lambda s: F.struct(s.found.alias("found"), s.gaps.alias("gaps"), F.slice(s.steps, 1, F.size(s.found)).alias("steps")))
    return F.transform(one, with_steps)[0]


def _starts(s: Column, before: Column) -> Column:
    def at(m: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        inside = F.aggregate(F.slice(s.steps, block * _BLOCK + 1, i % _BLOCK), F.lit(0), lambda a, x: a + x)
        start = F.element_at(before, block + 1) + inside + F.element_at(s.gaps, i + 1)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"))

    return F.transform(s.found, at)


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind>> (kind: place in ``KINDS``), by start, then kind."""

    def of(k: int, pattern: str, fits) -> Column:
        return F.transform(F.filter(spans_of(text, pattern), lambda m: fits(m.text)), lambda m: F.struct(m.start.alias("start"), F.lit(k).alias("kind"), m.end.alias("end")))

    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    # A match of 24 digits is where its 24th digit is: shorter runs, which are everywhere, need no place.
    hexes = F.when(text.rlike("[0-9a-f]{24}"), of(2, HEX_LONG, lambda m: F.length(m) >= 24)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return F.array_sort(F.concat(of(0, ASSIGN, value), of(1, ACCESS, lambda m: F.length(m) >= 20), hexes))


#: The maximal runs of 24 or more, as ``HEX`` finds them and the length rule keeps them.
HEX_LONG = "(?<![0-9a-f])[0-9a-f]{24,}+"


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (a rational approximation, within 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(c: Column) -> Column:
    """Of struct<body, encoding, k, values>: the smallest of the three p-values, times three."""
    n = F.size(c["values"]).cast("double")
    k = c["k"].cast("double")
    state = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("squares"))

    def count(a: Column, v: Column) -> Column:
        run = F.when(a["last"] == v, a["run"] + 1).otherwise(F.lit(1))
        # A run of r adds r squared: 2r - 1 with each of its members.
        return F.struct(v.alias("last"), run.alias("run"), (a["squares"] + 2.0 * run - 1.0).alias("squares"))

    squares = F.aggregate(F.array_sort(c["values"]), state, count)["squares"]
    chi = k / n * squares - n
    p_chi = _upper_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))

    high = F.size(F.filter(c["values"], lambda v: v * 2 >= c["k"])).cast("double")
    pairs = F.zip_with(c["values"], F.slice(c["values"], 2, F.greatest(F.size(c["values"]) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = 1.0 + F.size(F.filter(pairs, lambda p: (p.a * 2 >= c["k"]) != (p.b * 2 >= c["k"])))
    mean = 2 * high * (n - high) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(spread > 0, 2 * _upper_tail(F.abs(runs - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9))))).otherwise(F.pow(F.lit(2.0), 1 - n))

    centre = F.aggregate(c["values"], F.lit(0.0), lambda a, v: a + v) / n
    total = F.aggregate(c["values"], F.lit(0.0), lambda a, v: a + (v - centre) * (v - centre))
    lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce((p.a - centre) * (p.b - centre), F.lit(0.0)))
    p_serial = F.when(total > 0, 2 * _upper_tail(F.abs(lagged / F.greatest(total, F.lit(1e-9)) * F.sqrt(n) + 1 / F.sqrt(n)))).otherwise(F.pow(F.lit(2.0), 1 - n))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def _log_ratios() -> list[float]:
    """By encoding, class before and class: log of its probability at random over that in ordinary tokens. A last
    row for each encoding, with no class before, takes the stationary shares of ordinary tokens."""
    shares = [0.25] * 4
    for _ in range(200):
        shares = [sum(shares[a] * ORDINARY[a][b] for a in range(4)) for b in range(4)]
    out = []
    for _, _, alphabet in ENCODINGS:
        random = [sum(map(test, alphabet)) / len(alphabet) for test in (str.islower, str.isupper, str.isdigit, lambda x: not x.isalnum())]
        for row in (*ORDINARY, shares):
            out += [math.log(r / p) if r else -50.0 for r, p in zip(random, row, strict=True)]
    return out


def candidates(text: Column) -> Column:
    """array<struct<start, end, evidence>>: tokens in one of the encodings and the logarithm of their e-value."""
    mixed = lambda m: m.text.rlike("[0-9]") & m.text.rlike("[A-Za-z]")
    body = lambda m: F.regexp_replace(m.text, "=+$", "")

    def infer(m: Column) -> Column:
        e = F.lit(None).cast("int")
        for i, (_, shape, _) in reversed(list(enumerate(ENCODINGS))):
            e = F.when(body(m).rlike(shape), F.lit(i)).otherwise(e)
        return F.struct(m.start.alias("start"), m.end.alias("end"), body(m).alias("body"), e.alias("encoding"))

    def parts(m: Column) -> Column:
        inner = F.flatten(F.array(*[spans_of(m.text, p) for p in PARTS]))
        moved = F.transform(inner, lambda x: F.struct((m.start + x.start).alias("start"), (m.start + x.end).alias("end"), x.text.alias("text")))
        return F.when(m.text.rlike("[+/]") & m.text.rlike("[_-]"), F.array_distinct(moved)).otherwise(F.array(m))

    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
    ratios = F.array(*[F.lit(x) for x in _log_ratios()])
    classes = lambda t: F.translate(t, _LOWER + _UPPER + _DIGITS + "+/_=-", "0" * 26 + "1" * 26 + "2" * 10 + "33333")

    def numbered(t: Column) -> Column:
        alphabet = F.element_at(alphabets, t.encoding + 1)
        plain = F.when(t.encoding.isin(0, 2), F.lower(t.body)).otherwise(t.body)
        return F.struct(
            t.start.alias("start"), t.end.alias("end"), t.encoding.alias("encoding"), F.length(alphabet).alias("k"),
            F.transform(F.split(plain, ""), lambda x: F.instr(alphabet, x) - 1).alias("values"),
            F.transform(F.split(classes(t.body), ""), lambda x: x.cast("int")).alias("classes"),
        )

    def scored(t: Column) -> Column:
        first = F.struct(F.lit(4).alias("before"), F.lit(0.0).alias("sum"))
        ratio = F.aggregate(t.classes, first, lambda a, x: F.struct(x.alias("before"), (a["sum"] + F.element_at(ratios, t.encoding * 20 + a["before"] * 4 + x + 1)).alias("sum")))["sum"]
        trust = F.log(F.greatest(F.least(F.lit(1.0), _battery(t) / ALPHA), F.lit(1e-300)))
        return F.struct(t.start.alias("start"), t.end.alias("end"), (ratio + trust).alias("evidence"))

    found = F.filter(F.flatten(F.transform(F.filter(spans_of(text, TOKEN), mixed), parts)), mixed)
    tokens = F.filter(F.transform(found, infer), lambda t: t.encoding.isNotNull() & (F.length(t.body) >= LENGTHS[0]))
    return F.transform(F.transform(tokens, numbered), scored)


def _length_range(n: Column) -> Column:
    r = F.lit(0)
    for i, least in enumerate(LENGTHS):
        r = F.when(n >= least, F.lit(i)).otherwise(r)
    return r


def _cell(evidence: Column) -> Column:
    return F.floor(F.least(F.greatest(evidence, F.lit(_LOW)), F.lit(_HIGH)) / _STEP).cast("int")


def thresholds(found: DataFrame, column: str, fdr: float = FDR) -> list[int | None]:
    """By length range the least cell of evidence that the e-BH rule picks among all tokens tested (None: it picks none)."""
    tokens = found.select(F.explode(column).alias("t"))
    cells = tokens.groupBy(_length_range(F.col("t.end") - F.col("t.start")).alias("length"), _cell(F.col("t.evidence")).alias("cell")).count().collect()
    out: list[int | None] = [None] * len(LENGTHS)
    for r in range(len(LENGTHS)):
        own = sorted(((c["cell"], c["count"]) for c in cells if c["length"] == r), reverse=True)
        total, above = sum(n for _, n in own), 0
        for cell, n in own:
            above += n
            if cell * _STEP >= math.log(total / (fdr * above)):
                out[r] = cell
    return out


def _union(spans: Column) -> Column:
    """array<struct<start, end>>: those that overlap made one, by start."""

    def add(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s.end).alias("end"))))
        return F.when((F.size(a) > 0) & (s.start < last["end"]), joined).otherwise(F.concat(a, F.array(s)))

    plain = F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end")))
    return F.when(F.size(spans) > 1, F.aggregate(F.array_sort(plain), F.array().cast("array<struct<start:int,end:int>>"), add)).otherwise(plain)


def _spans(docs: DataFrame, text: str, keep: list[str], base: str, every: str, limits: list[int | None] | None) -> DataFrame:
    """The columns ``keep``, and the two arrays of ``find`` under the names given."""
    own, found = [named(c) for c in keep], spare(docs, "_found")
    scanned = written(docs.select(*own, base_spans(text_of(text)).alias(base), candidates(text_of(text)).alias(found)), "secrets-scanned")
    limits = thresholds(scanned, found) if limits is None else limits
    bound = F.array(*[F.lit(math.inf if x is None else float(x)) for x in limits])
    picked = F.filter(found, lambda t: _cell(t.evidence) >= F.element_at(bound, _length_range(t.end - t.start) + 1))
    new = F.filter(picked, lambda t: ~F.exists(base, lambda b: (b.start <= t.start) & (t.end <= b.end)))
    random = F.transform(_union(new), lambda t: F.struct(t.start.alias("start"), F.lit(3).alias("kind"), t.end.alias("end")))
    return scanned.select(*own, base, F.array_sort(F.concat(base, random)).alias(every))


def find(docs: DataFrame, text: str = "text", limits: list[int | None] | None = None) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: array<struct<start, kind, end>>, by start, then kind. ``limits`` as ``thresholds``
    gives them; without them those of the rows at hand."""
    return _spans(docs, text, others(docs, "base_spans", "all_spans"), "base_spans", "all_spans", limits)


def listed(spans: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: list[int | None] | None = None) -> DataFrame:
    """Per row ``key``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_random``."""
    found = _spans(docs.select(named(key), named(text)), text, [key], "_base_spans", "_all_spans", limits)
    number = lambda k, of: F.size(F.filter(of, lambda s: s.kind == k)).cast("long")
    return found.select(
        named(key), *(number(i, "_base_spans").alias(f"n_{KINDS[i]}") for i in range(3)),
        F.sha2(listed("_base_spans"), 256).alias("base_sha256"), listed("_all_spans").alias("spans"), number(3, "_all_spans").alias("n_random"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", limits: list[int | None] | None = None) -> DataFrame:
    """``docs``, all of its columns, with every span of the text replaced by ``mark``, spans that touch or overlap by one. Null texts
    stay null."""
    base, every, cover = (spare(docs, n) for n in ("_base_spans", "_all_spans", "_cover"))
    found = _spans(docs, text, docs.columns, base, every, limits)
    start = F.array().cast("array<struct<start:int,end:int>>")

    def merge(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s.end).alias("end"))))
        return F.when((F.size(a) > 0) & (s.start <= last["end"]), joined).otherwise(F.concat(a, F.array(F.struct(s.start.alias("start"), s.end.alias("end")))))

    merged = found.withColumn(cover, F.aggregate(every, start, merge))
    whole, n = named(text), F.size(cover)
    part = lambda i: F.substring(whole, F.when(i == 0, 1).otherwise(F.try_element_at(F.col(cover), i)["end"] + 1), F.when(i == n, F.length(whole)).otherwise(F.try_element_at(F.col(cover), i + 1)["start"]) - F.when(i == 0, 0).otherwise(F.try_element_at(F.col(cover), i)["end"]))
    clean = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n), part), mark)).otherwise(whole)
    return merged.select(*(clean.alias(c) if c.lower() == text.lower() else named(c) for c in docs.columns))
