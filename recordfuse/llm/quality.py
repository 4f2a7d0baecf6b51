"""Quality rules by distribution divergence.

A document's character-class histogram and its histogram of common words are compared with references of its language
by Jensen-Shannon distance (base 2, so 0 to 1). The references are parameters of the method, not of a run: ``fit`` takes the mean
histogram of the good documents of a labelled table, each counting once whatever its length, and ``REFERENCES`` is what it gave
for four fifths of the labelled rows of the sample tables. So a document's verdict depends on the document alone.

A text is rejected when its characters are far off, or when characters and words are both off. Short texts scatter
around any reference: the limits for a text of n draws grow by a share of the scatter that n draws from the reference
itself would show. Guards: a text with fewer words than ``MIN_WORDS`` is not judged by its histograms, nor one whose
language has no reference; such texts are judged by the base rules alone.

Defined results: null text counts as empty (no words; the base rules reject it), null language as unknown, repeated
rows are judged each on its own, an empty table gives an empty table, columns whose names clash with the added ones, in
whatever case, are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import made, named, others, prepare, slices, spare, text_of

#: Common words of the languages that are judged.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on are as with he be at by this had not but from they or an which you were".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un une du dans est que qui pour par sur au il plus ne pas se avec ce son sont ou mais elle".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ya es son entre".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r"

#: What ``fit`` gave on labelled good rows (fold 1 to 4) of the sample tables: shares of the classes, and of the common words with
#: all other words last.
REFERENCES = {
    "en": (
        (0.7938, 0.0144, 0.0009, 0.1664, 0.0243, 0.0, 0.0),
        (0.0639, 0.0368, 0.0269, 0.0205, 0.0141, 0.0157, 0.0117, 0.0105, 0.0097, 0.0084, 0.0081, 0.0073, 0.0051, 0.006, 0.0066, 0.0031, 0.0054, 0.0046, 0.0056, 0.0052, 0.0, 0.0, 0.0, 0.0042, 0.0, 0.0026, 0.0038, 0.0, 0.0, 0.0, 0.7142),
    ),
    "de": (
        (0.7719, 0.0126, 0.0007, 0.1544, 0.0221, 0.0, 0.0382),
        (0.0626, 0.0362, 0.0266, 0.0203, 0.0163, 0.0136, 0.0109, 0.0107, 0.009, 0.0081, 0.0076, 0.0073, 0.0066, 0.0055, 0.0059, 0.0057, 0.0054, 0.005, 0.0048, 0.0043, 0.0001, 0.0, 0.0, 0.0, 0.0, 0.004, 0.0, 0.0, 0.0, 0.0, 0.7234),
    ),
    "fr": (
        (0.7067, 0.011, 0.0018, 0.1663, 0.0244, 0.0001, 0.0897),
        (0.062, 0.0374, 0.0251, 0.0208, 0.0164, 0.0142, 0.0133, 0.011, 0.0077, 0.0095, 0.0057, 0.007, 0.0077, 0.0058, 0.0074, 0.0054, 0.0051, 0.0049, 0.0, 0.0, 0.0, 0.0049, 0.0, 0.0044, 0.0, 0.0, 0.0, 0.0035, 0.0, 0.0023, 0.7186),
    ),
    "es": (
        (0.7234, 0.0127, 0.001, 0.1615, 0.0237, 0.0, 0.0776),
        (0.0637, 0.0357, 0.0252, 0.02, 0.0167, 0.0137, 0.0001, 0.0113, 0.0091, 0.0094, 0.0102, 0.0074, 0.008, 0.0057, 0.0067, 0.0065, 0.0055, 0.0057, 0.0046, 0.0042, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0001, 0.0, 0.0047, 0.0, 0.0, 0.7259),
    ),
}

#: A text is rejected over FAR_CLASS by characters alone, or over both NEAR_CLASS and NEAR_WORD; SCATTER is the share of
#: the expected scatter by which the limits of short texts grow. Set on the rows that the references are fitted on.
FAR_CLASS, NEAR_CLASS, NEAR_WORD, SCATTER = 0.33, 0.17, 0.25, 0.6
MIN_WORDS = 50
FOLDS = 5


def _class_table() -> np.ndarray:
    t = np.full(129, 5, np.uint8)
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" " + SPACES, 3), (".,;:!?'\"()-", 4)):
        t[[ord(c) for c in chars]] = k
    t[128] = 6
    return t


_CLASS = _class_table()
_LOOKUP = {lang: {w: k for k, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}


def words_of(text: str) -> list[str]:
    """Runs of characters other than space and U+0009 to U+000D."""
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _numbered(words: list[str]) -> tuple[dict[str, int], np.ndarray]:
    seen: dict[str, int] = {}
    put = seen.setdefault
    return seen, np.array([put(w, len(seen)) for w in words], np.int64)


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a window of three that the text has twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * kinds + ids[1:]
    if kinds > 2_000_000:  # three numbers would not fit
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : len(ids) - 2 + k] |= twice
    return int(hit.sum())


def measure(text: str) -> tuple:
    """``BASE_COLUMNS`` of a text."""
    words = words_of(text)
    seen, ids = _numbered(words)
    lines = [x for x in text.split("\n") if x.strip(" " + SPACES)]
    repeated = repeated_words(ids, len(seen))
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(words) < 50 or 100 * repeated > 50 * len(words),
    )


def histograms(text: str, lang: str | None) -> tuple[list[int], list[int]]:
    """Counts by character class, and of the language's common words with all other words as the last count (empty
    for a language without a list). Words are compared in lower case without sentence marks around them."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    classes = np.bincount(_CLASS[np.minimum(codes, 128)], minlength=len(CLASSES)).tolist()
    lookup = _LOOKUP.get(lang)
    if lookup is None:
        return classes, []
    words = words_of(text)
    common, get = [0] * len(lookup), lookup.get
    for w in words:
        if len(w) < 12:
            k = get(w)
            if k is None:
                k = get(w.lower().strip(".,;:!?'\"()-"))
            if k is not None:
                common[k] += 1
    return classes, [*common, len(words) - sum(common)]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, between histograms along the last axis; 0 where one is empty."""
    p, q = (x / np.maximum(x.sum(-1, keepdims=True), 1e-300) for x in (np.asarray(p, float), np.asarray(q, float)))
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
    d = np.sqrt(np.maximum((part(p) + part(q)) / 2, 0))
    return np.where((p.sum(-1) > 0) & (q.sum(-1) > 0), d, 0.0)


def limit(base: float, kinds: int, draws) -> np.ndarray:
    """``base``, widened by the divergence that so many draws from the reference itself would show."""
    return np.sqrt(base**2 + SCATTER * (kinds - 1) / (8 * math.log(2) * np.maximum(draws, 1)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality") -> dict[str, tuple]:
    """References of the languages with a word list, as in ``REFERENCES``, from the documents labelled 1 whose crc32 of the id as text is
    not 0 modulo ``FOLDS`` and that the base rules pass. One aggregate of a fixed number of sums reaches the driver."""
    prepare(docs.sparkSession)
    wide = max(map(len, COMMON_WORDS.values())) + 1
    good = labels.filter(named(label) == 1).select(named(key)).distinct()
    rows = docs.join(good, key, "left_semi").filter((F.crc32(named(key).cast("string").cast("binary")) % FOLDS != 0) & named(lang).isin(*COMMON_WORDS))
    kind = pa.list_(pa.float64())
    schema = pa.schema([("lang", pa.string()), ("classes", kind), ("words", kind)])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not measure(t)[-1]:
                    c, w = (np.array(x, float) for x in histograms(t, g))
                    out.append((g, c / c.sum(), np.append(w / w.sum(), np.zeros(wide - len(w)))))
            yield made(out, schema)

    found = rows.select(named(lang).cast("string").alias("lang"), text_of(text).alias("text")).mapInArrow(shares, "lang string, classes array<double>, words array<double>")
    sizes = {"classes": len(CLASSES), "words": wide}
    means = found.groupBy("lang").agg(*(F.avg(F.col(k)[i]).alias(f"{k}{i}") for k, n in sizes.items() for i in range(n))).collect()
    cells = lambda r, k, n: tuple(round(r[f"{k}{i}"], 4) for i in range(n))
    return {r["lang"]: (cells(r, "classes", len(CLASSES)), cells(r, "words", len(COMMON_WORDS[r["lang"]]) + 1)) for r in means}


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", refs: dict | None = None) -> DataFrame:
    """``docs`` with ``BASE_COLUMNS``, ``class_distance``, ``word_distance`` and ``kept``, by ``refs`` as in ``REFERENCES``. One pass
    over the rows; no row is shuffled."""
    known = {g: (np.array(c), np.array(w)) for g, (c, w) in (REFERENCES if refs is None else refs).items()}
    prepare(docs.sparkSession)
    kinds = {**dict.fromkeys(BASE_COLUMNS[:5], "long"), "base_failed": "boolean", "class_distance": "double", "word_distance": "double", "kept": "boolean"}
    own = others(docs, *kinds)
    rows = docs.select(*map(named, own), text_of(text).alias(spare(docs, "_judged_text")), named(lang).cast("string").alias(spare(docs, "_judged_lang")))
    added = pa.schema([(c, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[k]) for c, k in kinds.items()])

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [verdict(t, g, known) for t, g in zip(b.column(len(own)).to_pylist(), b.column(len(own) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *made(out, added).columns], [*own, *kinds])

    schema = T.StructType(rows.schema.fields[:-2])
    for c, k in kinds.items():
        schema = schema.add(c, k)
    return rows.mapInArrow(verdicts, schema)


def verdict(text: str, lang: str | None, refs: dict) -> tuple:
    base = measure(text)
    ref, by_class, by_word = refs.get(lang), 0.0, 0.0
    kept = not base[-1]
    if ref is not None and base[0] >= MIN_WORDS:
        classes, words = histograms(text, lang)
        by_class, by_word = float(js_distance(np.array(classes), ref[0])), float(js_distance(np.array(words), ref[1]))
        near = by_class > limit(NEAR_CLASS, len(classes), sum(classes)) and by_word > limit(NEAR_WORD, len(words), base[0])
        kept = kept and not near and by_class <= limit(FAR_CLASS, len(classes), sum(classes))
    return *base, by_class, by_word, bool(kept)
