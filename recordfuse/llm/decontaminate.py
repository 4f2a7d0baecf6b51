"""Benchmark decontamination by spaced-seed hashing.

A mask marks which positions of a window of tokens count; the others are ignored. Windows of test items and of training
texts that agree on all marked positions of one mask have the same hash, so a passage with some tokens substituted still
shares a window as long as the substitutions fall on ignored positions of some mask. Around every such hit the test
item is laid along the text on the hit's diagonal and compared token by token; a run of the item of ``MIN_TOKENS`` tokens
or more (or the whole item, if that is shorter) in which ``MIN_SHARE`` of the tokens agree counts as contamination.

The masks miss nothing at these limits: every placing of the substitutions in runs of 13 to 25 tokens leaves a window of some
mask whole (a test goes through them all), and a longer run always has a part of 13 to 25 tokens that is as much alike. Items
of 5 to 12 tokens have shorter masks, for which the same holds; those of up to 4 tokens have to occur as they are. Limits
below these (``min_tokens``, ``share``) may miss some.

There are two ways to look seeds up, with the same seeds and the same verification, hence the same result. The hashes of the
test items are sent to every executor while their number stays under ``BROADCAST_HASHES``, which is checked; the texts are
then read once and nothing is shuffled. Beyond it, seeds of the texts that a bitmap of fixed size lets through are joined
with those of the items, seeds that many texts hold split over tasks, and each text and item that share any are verified.

Defined results: tokens are lower-case runs of letters, digits and underscores; null text counts as empty and is clean;
items without tokens match nothing; every row of the texts and every row of the items stand for themselves, whatever ids they
have, so repeated rows give their hits each; of equally long overlaps of a pair that with the first start counts, then that
with most equal tokens; empty tables give empty results; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread_join, written
from .runtime import made, named, prepare, slices, spare, text_of

MIN_TOKENS, MIN_SHARE = 13, 0.8
#: Fixed masks by the least number of tokens of the items that they are for: 1 counts, 0 is ignored.
MASKS = {
    13: ("1111011", "11001000111", "11010100011", "111111"),
    5: ("111", "1101"),
    4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",),
}
BROADCAST_HASHES = 2_000_000
CACHED_WORDS = 300_000
#: Bits of the bitmap, as a power of two: 32 MB.
BITMAP = 28

_TOKEN = re.compile(r"\w+")
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64) for i in range(max(len(m) for k in MASKS.values() for m in k))], np.uint64)


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Hashes:
    """64-bit hashes of tokens; those met before are kept, up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _put(self, w: str) -> int:
        import xxhash

        h = self.known[w] = xxhash.xxh64_intdigest(w.encode()) or 1
        return h

    def of(self, text: str, keep: bool = False) -> np.ndarray:
        if len(self.known) > CACHED_WORDS and not keep:
            self.known.clear()
        get, put = self.known.get, self._put
        return np.array([get(w) or put(w) for w in tokens_of(text)], np.uint64)


def kind_of(n: int) -> int:
    """Which masks an item of so many tokens has (0: none)."""
    return max((k for k in MASKS if k <= n), default=0)


def windows(h: np.ndarray, kind: int, mask: int) -> np.ndarray:
    """The hash of the window of a mask at every position where it fits."""
    shape = MASKS[kind][mask]
    n = len(h) - len(shape) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, kind * 8 + mask + 1, np.uint64)
    for i, x in enumerate(shape):
        if x == "1":
            out += h[i : i + n] * _FACTORS[i]
            out ^= out >> np.uint64(29)
    return out


def item_seeds(h: np.ndarray) -> list[np.ndarray]:
    """By mask the hashes of an item's windows."""
    kind = kind_of(len(h))
    return [windows(h, kind, m) for m in range(len(MASKS[kind]))] if kind else []


def _bit(seeds: np.ndarray) -> np.ndarray:
    return ((seeds * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP)).astype(np.int64)


def best_run(same: np.ndarray, least: int, share: float) -> tuple[int, int]:
    """The longest stretch with at least ``share`` of true values, ends true: (start, end), or (0, 0) if it is shorter
    than ``least``."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    # true values minus share times length, as prefix sums; a stretch qualifies if it does not fall over it
    level = np.concatenate([[0.0], np.cumsum(same - share)])
    low = np.minimum.accumulate(level)  # falls from left to right, so the first start that will do is found by search
    best = (0, 0)
    for e in (at + 1)[::-1].tolist():
        if e < best[1] - best[0]:
            break
        s = int(np.searchsorted(-low, -level[e] - 1e-9))
        while s < e and not same[s]:
            s += 1
        if e - s >= best[1] - best[0] and level[e] - level[s] >= -1e-9:  # of equal ones the first
            best = (s, e)
    return best if best[1] - best[0] >= least else (0, 0)


def best_overlap(item: np.ndarray, text: np.ndarray, diagonals: set[int], min_tokens: int, share: float) -> tuple | None:
    """(tokens of the item, start and end in the text, tokens that agree) of the longest overlap on the diagonals, each of which
    says where in the text the item's first token would lie."""
    best = None
    for d in diagonals:
        a, b = max(0, -d), min(len(item), len(text) - d)
        if b <= a:
            continue
        same = item[a:b] == text[a + d : b + d]
        s, e = best_run(same, min(min_tokens, len(item)), share)
        if e:
            found = (e - s, -(a + d + s), int(same[s:e].sum()))
            best = found if best is None else max(best, found)
    return best and (len(item), -best[1], best[0] - best[1], best[2])


class Items:
    """Test items in memory: sorted seed hashes with their item and position."""

    def __init__(self, ids: list, hashes: list[np.ndarray], min_tokens: int, share: float, vocabulary: dict[str, int]):
        self.ids, self.hashes, self.min_tokens, self.share, self.vocabulary = ids, hashes, min_tokens, share, vocabulary
        parts = [(x, k) for k, h in enumerate(hashes) for x in item_seeds(h)]
        keys = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in parts)])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.concatenate([np.zeros(0, np.int32), *(np.full(len(x), k, np.int32) for x, k in parts)])[order]
        self.at = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(x), dtype=np.int32) for x, _ in parts)])[order]
        self.kinds = sorted({kind_of(len(h)) for h in hashes} - {0})
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift] = True

    def batch(self, texts: list[str]) -> Iterator[tuple[int, list[tuple]]]:
        """(place in the list, overlaps) of the texts that have any. Tokens that no item has get the hash 0, which
        agrees with nothing; the texts' tokens lie in one array, and windows that reach into the next text do not count."""
        get = self.vocabulary.get
        parts = [np.array([get(w, 0) for w in tokens_of(t)], np.uint64) for t in texts]
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        ends = np.cumsum([len(x) for x in parts])
        found: dict[tuple[int, int], set[int]] = {}
        for kind in self.kinds:
            for m, mask in enumerate(MASKS[kind]):
                w = windows(h, kind, m)
                at = np.flatnonzero(self.filter[(w * np.uint64(0x9E3779B97F4A7C15)) >> self.shift])
                text = np.searchsorted(ends, at, "right")
                inside = at + len(mask) <= ends[text]
                self._look(w[at[inside]], at[inside], text[inside], ends, parts, found)
        out: dict[int, list[tuple]] = {}
        for (i, k), diagonals in sorted(found.items()):
            if got := best_overlap(self.hashes[k], parts[i], diagonals, self.min_tokens, self.share):
                out.setdefault(i, []).append((self.ids[k], *got))
        yield from out.items()

    def _look(self, w: np.ndarray, at: np.ndarray, text: np.ndarray, ends: np.ndarray, parts: list, found: dict) -> None:
        """Adds the diagonals of the seeds that a text shares with an item to the set of the two."""
        low, high = np.searchsorted(self.keys, w, "left"), np.searchsorted(self.keys, w, "right")
        for i in np.flatnonzero(high > low).tolist():
            k = int(text[i])
            own = int(at[i] - (ends[k] - len(parts[k])))
            for j in range(low[i], high[i]):
                found.setdefault((k, int(self.item[j])), set()).add(own - int(self.at[j]))


def _collected(items: DataFrame, key: str, text: str, min_tokens: int, share: float) -> Items:
    rows = sorted(items.select(named(key).cast("long"), text_of(text)).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    hashes = Hashes()
    return Items([r[0] for r in rows], [hashes.of(r[1], keep=True) for r in rows], min_tokens, share, hashes.known)


_FOUND = "item_id bigint, item_tokens bigint, start_token bigint, end_token bigint, same_tokens bigint"


def _schema(*first: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in (*first, *(x.split()[0] for x in _FOUND.split(", ")))])


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_tokens: int = MIN_TOKENS, share: float = MIN_SHARE, most: int = BROADCAST_HASHES) -> DataFrame:
    """A row (``key``, item_id, item_tokens, start_token, end_token, same_tokens) for every text and test item that
    overlap; the longest overlap of each pair."""
    prepare(docs.sparkSession)
    rows = docs.select(named(key).cast("long").alias(key), text_of(text).alias("_text"))
    if _seed_count(items, item_text) <= most:
        return _scan(rows, key, _collected(items, item_key, item_text, min_tokens, share))
    return _joined(rows, items, key, item_key, item_text, min_tokens, share)


def _seed_count(items: DataFrame, text: str) -> int:
    """About so many seeds do the items have: one small aggregate."""
    n = items.agg(F.sum(F.size(F.split(text_of(text), r"[^\p{L}\p{N}_]+")))).first()[0]
    return (n or 0) * len(MASKS[13])


def _scan(rows: DataFrame, key: str, items: Items) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(items)
    schema = _schema(key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            keys = x.column(0).to_pylist()
            yield made([(keys[i], *o) for i, got in sent.value.batch(x.column(1).to_pylist()) for o in got], schema)

    return rows.mapInArrow(scan, f"`{key}` bigint, {_FOUND}")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit for each value of the seeds' upper bits: a fixed number of rows of 4 KB reach the driver."""
    bit = F.col("bit")
    parts = seeds.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m"))
    out = np.zeros((1 << BITMAP) // 8, np.uint8)
    for r in parts.toLocalIterator():
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def _joined(rows: DataFrame, items: DataFrame, key: str, item_key: str, item_text: str, min_tokens: int, share: float) -> DataFrame:
    """The way for more seeds than may be sent."""
    spark = rows.sparkSession
    texts = written(rows.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-texts")
    tests = items.select(named(item_key).cast("long").alias("item_id"), text_of(item_text).alias("_item"), F.monotonically_increasing_id().alias("_n"))
    tests = written(tests, "decontaminate-items")
    seeded, seed_schema = pa.schema([("id", pa.int64()), ("seed", pa.int64()), ("at", pa.int64()), ("bit", pa.int64()), ("kind", pa.int64())]), "id bigint, seed bigint, at bigint, bit bigint, kind bigint"

    def batch(k: int, kind: int, found: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        n = len(found)
        columns = (np.full(n, k), found.view(np.int64), at, _bit(found) + 1, np.full(n, kind))  # Spark numbers bits from 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=seeded)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for x in slices(batches):
            for k, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                h = hashes.of(t)
                for w in item_seeds(h):
                    yield batch(k, kind_of(len(h)), w, np.arange(len(w)))

    theirs = written(tests.select("_n", "_item").mapInArrow(of_items, seed_schema), "decontaminate-seeds")
    kinds = [r[0] for r in theirs.select("kind").distinct().collect()]  # one for each entry of MASKS at most
    sent = spark.sparkContext.broadcast(_bitmap(theirs))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for x in slices(batches):
            for k, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                h = hashes.of(t)
                for kind in kinds:
                    for m in range(len(MASKS[kind])):
                        w = windows(h, kind, m)
                        bit = _bit(w)
                        at = np.flatnonzero(sent.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                        if len(at):
                            yield batch(k, kind, w[at], at)

    ours = written(texts.select("_row", "_text").mapInArrow(of_texts, seed_schema).select(F.col("id").alias("_row"), "seed", "at"), "decontaminate-hits")
    count = lambda x, c: x.groupBy(c).agg(F.count("*").alias("n"))
    shared = count(ours, "seed").join(theirs.select("seed").distinct(), "seed")
    # Only seeds of both sides meet, and those that many texts hold do so in pieces.
    both = spread_join(ours, theirs.select("seed", F.col("id").alias("_n"), F.col("at").alias("i")), "seed", ["_row"], counts=shared)
    pairs = written(both.groupBy("_row", "_n").agg(F.collect_set(F.col("at") - F.col("i")).alias("d")), "decontaminate-pairs")
    schema = _schema(key)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for x in slices(batches):
            out = []
            for k, item_id, item, text, d in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if got := best_overlap(hashes.of(item), hashes.of(text), set(d), min_tokens, share):
                    out.append((k, item_id, *got))
            yield made(out, schema)

    with_items = spread_join(pairs, tests, "_n", ["_row"], counts=count(pairs, "_n"))
    return with_items.join(texts, "_row").select(named(key), "item_id", "_item", "_text", "d").mapInArrow(verify, f"`{key}` bigint, {_FOUND}")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", min_tokens: int = MIN_TOKENS, share: float = MIN_SHARE, most: int = BROADCAST_HASHES) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no test item, with their columns."""
    prepare(docs.sparkSession)
    columns = docs.columns
    if _seed_count(items, item_text) > most:
        own = spare(docs, "_own")
        numbered = written(docs.withColumn(own, F.monotonically_increasing_id()), "decontaminate-docs")
        bad = overlaps(numbered, items, own, text, item_key, item_text, min_tokens, share, most).select(own).distinct()
        return numbered.join(bad, own, "left_anti").select(*map(named, columns))
    sent = docs.sparkSession.sparkContext.broadcast(_collected(items, item_key, item_text, min_tokens, share))
    at = [c.lower() for c in columns].index(text.lower())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            good = np.ones(x.num_rows, bool)
            good[[i for i, _ in sent.value.batch([t or "" for t in x.column(at).to_pylist()])]] = False
            yield x.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
