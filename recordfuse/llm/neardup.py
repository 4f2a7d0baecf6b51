"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass gives every document its shingle set's key (128-bit hash), size and signature (``HASHES`` minimum hashes, a
   byte of each). Documents with equal sets form a class; from here on a class counts once.
2. ``BANDS`` bands of the signature bucket the classes. At similarity 0.8 a pair shares no bucket with a probability of
   about 1e-7. Of each bucket two members are leaders; every member is a candidate with each leader.
3. A candidate's signatures are compared batch by batch. After a batch the posterior of the similarity, from a uniform
   prior, is a beta distribution: the pair is dropped once it puts less than ``MISS`` on the threshold or more.
4. Survivors, the best few of every class, are verified on their full sets; components follow.
5. Buckets that now hold members of several components are gone through once more, this time completely: the
   signatures of all members against those outside the bucket's largest component. What survives is verified on full
   sets, so no link between different components is left out; nothing is capped. Both steps stream rows past blocks
   of bounded size, and hot buckets are cut into many such pieces.

Pairs inside one component are not looked for: they change no result. No group is gathered anywhere: classes, buckets
and components are aggregated before they are shuffled. What is known of a group is joined back to its rows by plain inner
joins, whose large partitions adaptive execution splits, and where rows of a group have to meet, in pieces of bounded size.

Defined results: null text counts as empty; a document without words has an empty set, links with nothing and keeps its
own id; with fewer words than the shingle length the whole sequence is the only shingle; each row is judged by its own text,
so rows that repeat an id may differ; a row without an id gets the smallest id that its text reaches (null if there is none)
and is not kept; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import star_labels
from ..storage import settled, spread_join, written
from .runtime import named, prepare, slices, spare, text_of

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
BATCH = 20
MISS = 1e-6
TOP = 4
#: Queries held by a task at once, and rows that it reads for them.
BLOCK, RUN = 128, 512
CACHED_WORDS = 300_000

_LOWER = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_MASK = (1 << 64) - 1


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 1 << 31, HASHES).astype(np.uint32) * 2 + 1, r.integers(0, 1 << 32, HASHES).astype(np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of 64-bit shingle hashes; keeps the hashes of words met before, up to a bound."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}
        self.factors = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(words)], np.uint64)

    def _hash(self, w: bytes) -> int:
        import xxhash

        h = self.known[w] = xxhash.xxh64_intdigest(w)
        return h

    def of(self, text: str) -> np.ndarray:
        """Sorted and distinct."""
        words = [w for w in text.encode().translate(_LOWER).split(b" ") if w]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        get, put = self.known.get, self._hash
        h = np.array([get(w) or put(w) for w in words], np.uint64)
        if not len(h):
            return h
        k = min(self.words, len(h))
        s = np.full(len(h) - k + 1, k * 0x632BE59BD9B4E019 & _MASK, np.uint64)
        for i in range(k):
            s = _mixed(s ^ (h[i : len(h) - k + 1 + i] * self.factors[i]))
        return np.unique(s)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The lowest byte of the minimum of each hash. (The minimum itself is small, so its high bytes say little.)"""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        h = x[i : i + 2048, None] * a
        h += b
        h ^= h >> np.uint32(15)
        np.minimum(low, h.min(0), out=low)
    return low.astype(np.uint8).tobytes()


@lru_cache
def least_matches(threshold: float = 0.8, miss: float = MISS) -> tuple[int, ...]:
    """After 1, 2, ... batches, the fewest matches with which the posterior of a uniform prior still puts ``miss`` on a
    similarity of the threshold or more. With n compared and m matching that tail is P(Binomial(n + 1, threshold) <= m).
    Bytes that match by chance only make a pair look closer."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of signature bytes: which pairs survive all batches, and the matches of those that do."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    return alive, matches[alive]


def _place(key: str | Column, text: Column) -> list[Column]:
    """What tells rows apart: the id and a hash of the text."""
    return [(named(key) if isinstance(key, str) else key).cast("long").alias("id"), F.xxhash64(text).alias("h")]


def _place_key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("h").cast("string"))


def _signed(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, h, n, set_key, signature) of every row; the last two null for empty sets."""
    rows = docs.select(*_place(key, text_of(text)), text_of(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, (a, b) = Shingles(words), _coefficients()
        for batch in slices(batches):
            sets = [shingles.of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, a, b) if len(s) else None for s in sets], pa.binary()),
                ],
                ["id", "h", "n", "set_key", "signature"],
            )

    return rows.mapInArrow(sign, "id bigint, h bigint, n bigint, set_key binary, signature binary")


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _counted(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def _with_both(pairs: DataFrame, of: DataFrame, data: str) -> DataFrame:
    """(a, b, left, right): what ``of`` (id, ``data``) has of both ends. (Adaptive execution splits an end with very many pairs.)"""
    side = lambda end, name: of.select(F.col("id").alias(end), F.col(data).alias(name))
    return pairs.join(side("b", "right"), "b").join(side("a", "left"), "a").select("a", "b", "left", "right")


def _pruned(pairs: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """(a, b, matches) of the candidate pairs (a, b) that survive."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, 4096):
            alive, matches = surviving(_bytes(x.column(2)), _bytes(x.column(3)), threshold)
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(alive)), x.column(1).take(pa.array(alive)), pa.array(matches, pa.int32())], ["a", "b", "matches"])

    return _with_both(pairs, signatures, "signature").mapInArrow(prune, "a bigint, b bigint, matches int")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        last: tuple = (None, None)
        for x in slices(batches):
            keep = []
            for i, (a, ta, tb) in enumerate(zip(*(x.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                if last[0] != a:
                    last = (a, shingles.of(ta))
                s, t = last[1], shingles.of(tb)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(keep, pa.int64())), x.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return _with_both(pairs, texts, "text").mapInArrow(check, "a bigint, b bigint")


def _leaders(buckets: DataFrame) -> DataFrame:
    """Candidates (a, b): every member of a bucket with its smallest and with one drawn by hash."""
    by = F.struct(F.xxhash64("id", "key").alias("h"), F.col("id"))
    heads = buckets.groupBy("key").agg(F.min("id").alias("low"), F.min(by)["id"].alias("drawn"))
    both = buckets.join(heads, "key").select("id", F.explode(F.array_distinct(F.array("low", "drawn"))).alias("head"))
    return both.filter("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()


def _met(queries: DataFrame, rows: DataFrame, by: str, meet, schema: str) -> DataFrame:
    """``meet(group, queries, row)`` for every row and the queries of its group, in pieces of bounded size: queries
    (by, id, tag, data) in blocks of about ``BLOCK``, rows (by, id, tag, data) in runs of about ``RUN``. Each piece is read
    queries first, then row by row, so a task holds one block."""
    many = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    counts = _counted(queries, by).withColumnRenamed("n", "nq").join(_counted(rows, by).withColumnRenamed("n", "nr"), by)
    counts = written(counts.select(by, "nq", "nr", many("nq", BLOCK).alias("blocks"), many("nr", RUN).alias("runs")), "neardup-counts")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = spread_join(queries, counts.withColumnRenamed("nq", "n"), by, ["id"]).withColumn("block", place("blocks")).withColumn("run", every("runs")).withColumn("row", F.lit(1))
    r = spread_join(rows, counts.withColumnRenamed("nr", "n"), by, ["id"]).withColumn("run", place("runs")).withColumn("block", every("blocks")).withColumn("row", F.lit(2))
    columns = [by, "block", "run", "row", "id", "tag", "data"]
    both = q.select(*columns).union(r.select(*columns)).repartition(by, "block", "run").sortWithinPartitions(by, "block", "run", "row")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, block, ready, made = None, [], None, meet()
        for x in slices(batches):
            out = []
            for group, k, run, row, *rest in zip(*(x.column(i).to_pylist() for i in range(7)), strict=True):
                if piece != (group, k, run):
                    piece, block, ready = (group, k, run), [], None
                if row == 1:
                    block.append(rest)
                    continue
                if ready is None and block:
                    ready = made.block(block)
                if ready is not None:
                    out += made.row(group, ready, rest)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [()] * len(made.names))], names=made.names)

    return both.mapInArrow(go, schema)


def _rest(buckets: DataFrame, signatures: DataFrame, labels: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components. In every bucket that holds several, all members are compared with those outside
    its largest component; what survives is verified with the survivors around the same largest component."""
    own = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    heads = own.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component"))["component"].alias("main"), F.count("*").alias("kinds"))
    opened = own.join(heads.filter("kinds > 1"), "key").join(signatures.select("id", F.col("signature").alias("data")), "id")
    opened = written(opened.select("key", "id", F.struct("component", "main").alias("tag"), "data"), "neardup-open")
    threshold = percent / 100
    alike = _met(opened.filter("tag.component <> tag.main"), opened, "key", lambda: _Alike(threshold), "main bigint, id bigint, component bigint, query bigint")
    alike = written(alike.distinct().join(texts.select("id", F.col("text").alias("data")), "id").select("main", "id", F.col("component").alias("tag"), "query", "data"), "neardup-alike")
    return _met(alike.filter("query = 1").drop("query"), alike.filter("query = 0").drop("query"), "main", lambda: _Linked(words, percent), "a bigint, b bigint").distinct()


class _Alike:
    """The signature of a row against a block's: (main, id, component, 1 for queries) of both ends of survivors."""

    names = ["main", "id", "component", "query"]

    def __init__(self, threshold: float):
        self.threshold = threshold

    def block(self, block: list) -> tuple:
        ids, tags, data = zip(*block, strict=True)
        return np.array(ids), np.array([t["component"] for t in tags]), np.frombuffer(b"".join(data), np.uint8).reshape(-1, HASHES), set()

    def row(self, group: int, block: tuple, row: list) -> list[tuple]:
        ids, components, signatures, said = block
        own, tag, data = row
        other = np.flatnonzero(components != tag["component"])
        if not len(other):
            return []
        right = signatures[other]
        alive, _ = surviving(np.broadcast_to(np.frombuffer(data, np.uint8), right.shape), right, self.threshold)
        hit = [i for i in other[alive].tolist() if i not in said]
        said.update(hit)
        main = tag["main"]
        return [(main, own, tag["component"], 0)] * bool(len(alive)) + [(main, int(ids[i]), int(components[i]), 1) for i in hit]


class _Linked:
    """The full set of a row against all sets of a block at once: the links (a, b) between components."""

    names = ["a", "b"]

    def __init__(self, words: int, percent: int):
        self.shingles, self.percent = Shingles(words), percent

    def block(self, block: list) -> tuple:
        ids, components, texts = zip(*block, strict=True)
        sets = [self.shingles.of(t) for t in texts]
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        everything = np.concatenate(sets)
        order = np.argsort(everything, kind="stable")
        return np.array(ids), np.array(components), np.array([len(s) for s in sets]), everything[order], owners[order]

    def row(self, group: int, block: tuple, row: list) -> list[tuple]:
        ids, components, sizes, everything, owners = block
        own, component, text = row
        s = self.shingles.of(text)
        low, high = np.searchsorted(everything, s, "left"), np.searchsorted(everything, s, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(s) else np.zeros(0, int)
        both = np.bincount(owners[at], minlength=len(ids))
        hit = (components != component) & (100 * both >= self.percent * (len(s) + sizes - both))
        return [(min(own, int(i)), max(own, int(i))) for i in ids[hit]]


def _texts(docs: DataFrame, key: str, text: str, classes: DataFrame) -> DataFrame:
    """(id, text): of each class of sets the text of the row that stands for it."""
    rows = docs.select(*_place(key, text_of(text)), text_of(text).alias("text")).select(_place_key().alias("k"), "text")
    stand = classes.select(_place_key().alias("k"), "class")
    return rows.join(stand, "k").groupBy(F.col("class").alias("id")).agg(F.min("text").alias("text"))


def _grouped(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(id, h, n, root, component_id) of every row: ``root`` is a number for the group of its text, null for empty sets."""
    prepare(docs.sparkSession)
    threshold = percent / 100
    signed = written(_signed(docs, key, text, words), "neardup-signed")
    stand = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "h", "n", "signature")).alias("s")
    classes = signed.filter("set_key is not null").groupBy("set_key").agg(stand)
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), "s.id", "s.h", "s.n", "s.signature", "set_key"), "neardup-classes")
    # Sets of up to three shingles link with equal sets alone when the threshold is over three quarters.
    few = 0 if threshold <= 0.75 else 3
    signatures = classes.filter(F.col("n") > few).select(F.col("class").alias("id"), "signature")
    bands = signatures.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * ROWS + 1, F.lit(ROWS))))).alias("key"))
    shared = _counted(bands, "key").filter("n > 1")
    buckets = written(bands.join(shared.select("key"), "key").select("id", "key"), "neardup-buckets")

    leaders = written(_leaders(buckets), "neardup-leaders")
    best = Window.partitionBy("b").orderBy(F.desc("matches"), "a")
    first = _pruned(leaders, signatures, threshold).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP).select("a", "b")
    first = written(first, "neardup-first")
    texts = written(_texts(docs, key, text, classes.join(buckets.select(F.col("id").alias("class")).distinct(), "class", "left_semi")), "neardup-texts")
    labels = written(star_labels(_verified(first, texts, words, percent)), "neardup-labels")

    more = _rest(buckets, signatures, labels, texts, words, percent)
    label = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    joined = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = written(star_labels(joined).select(F.col("id").alias("component"), F.col("component").alias("over")), "neardup-above")
    final = labels.join(above, "component", "left").select("id", F.coalesce("over", "component").alias("root"))
    alone = above.join(labels.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("over").alias("root"))
    linked = final.union(alone).withColumnRenamed("id", "class").join(classes.select("class", "id"), "class")
    linked = written(linked, "neardup-linked")
    tops = linked.groupBy("root").agg(F.min("id").alias("top"))
    roots = linked.join(tops, "root").select("class", "root", "top")
    told = classes.join(roots, "class", "left").select(
        "set_key", F.coalesce("root", "class").alias("root"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("top")).alias("component_id")
    )
    rows = signed.drop("signature").withColumnRenamed("n", "size")
    full = rows.filter("set_key is not null").join(told, "set_key").select("id", "h", "size", "root", "component_id")
    empty = rows.filter("set_key is null").select("id", "h", "size", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    return full.union(empty).withColumnRenamed("size", "n")


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row (``key``, n_shingles, component_id, kept): links are pairs of sets of ``words``-word shingles whose
    similarity is ``percent`` per cent or more."""
    out = settled(docs.sparkSession, "neardup-found", lambda: _grouped(docs, key, text, words, percent))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-copies, with all columns of ``docs``: that with the smallest id; without ids in the group, and
    of rows with one id, that whose text has the smallest hash; of rows with one id and text one. Texts without words are
    alike only within an id."""
    found = settled(docs.sparkSession, "neardup-found", lambda: _grouped(docs, key, text, words, percent))
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "h"))
    kept = found.filter("root is not null").groupBy("root").agg(first.alias("s")).select("s.id", "s.h").union(found.filter("root is null").select("id", "h").distinct())
    copies = _counted(found.select(_place_key().alias("k")), "k")
    k = spare(docs, "_place")
    own = [named(c) for c in docs.columns]
    rows = docs.select(*own, F.concat_ws(":", F.coalesce(named(key).cast("long").cast("string"), F.lit("-")), F.xxhash64(text_of(text)).cast("string")).alias(k))
    many = copies.filter("n > 1").select(F.col("k").alias(k), F.lit(True).alias("_many"))
    kept = kept.select(_place_key().alias(k)).join(many, k, "left").select(k, F.coalesce("_many", F.lit(False)).alias("_many"))
    mark = spare(docs, "_many")
    stay = rows.join(kept.withColumnRenamed("_many", mark), k)
    one = stay.filter(named(mark)).groupBy(k).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("_row")).select("_row.*")
    return stay.filter(~named(mark)).select(*own).union(one.select(*own))
