"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (``SIZES``) of its words in lower case, word ends included, hashed into
``BUCKETS``. Each feature counts as the logarithm of how often it is found among toxic training texts over how often among
the others, smoothed; a logistic regression with an L2 penalty weighs those. It weighs every feature that enough rows have
to tell its ratio from none: ``LEAST_ROWS`` rows, and a ratio of ``LEAST_SIGMAS`` standard errors. The rarer class counts more,
by the root of how much rarer it is.

Training takes the ``TRAIN_ROWS`` labelled rows with the smallest hash of their id (all, where there are fewer), so the bound
holds at any size. Features are counted where they lie; the driver gets a count for each bucket and then, of each training row,
one bit for each weighed feature: 32 KB a row at most, whatever the texts are. Scoring reads every text once and shuffles
nothing.

Rows of labels with a null id or label are left out; an id labelled more than once is toxic if any of its labels says so.
Only texts and labels enter the model. With no training rows, or of one class only, every score is the smoothed share
of the toxic ones. Null text counts as empty and gets the score of a text without features; repeated rows are scored
each on its own, and of an id with several texts one stands for it in training; empty tables give empty results; other
columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written
from .runtime import named, prepare, slices, text_of

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
TRAIN_ROWS = 6000
FOLDS = 5
LEAST_ROWS, LEAST_SIGMAS = 3, 2.0
PENALTY = 1.0
STEPS = 60
#: Set bits of all training rows up to which they are kept as numbers, rather than read from the bits in every step.
KEPT_BITS = 24_000_000

_SPLIT = np.array([not chr(b).isalnum() if b < 128 else False for b in range(256)])


def features(text: str) -> np.ndarray:
    """Buckets of the text's distinct n-grams, sorted. Bytes that are neither letters nor digits all read as one word end."""
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    b = np.where(_SPLIT[raw], np.uint8(32), raw).astype(np.uint32)
    seen = np.zeros(BUCKETS, bool)
    space = np.concatenate([[0], np.cumsum(b == 32)])
    h = np.zeros(len(b), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(b) < n:
            break
        h = (h[: len(b) - n + 1] ^ b[n - 1 :]) * np.uint32(0x01000193)
        if n in SIZES:
            inside = space[n - 1 : len(b)] - space[1 : len(b) - n + 2] == 0  # no word end but at the ends
            x = h[inside]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            seen[(x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1)] = True
    return np.flatnonzero(seen).astype(np.int32)


def packed(places: np.ndarray, wide: int) -> bytes:
    """A set of numbers under ``wide`` as compressed bits."""
    bits = np.zeros(wide, bool)
    bits[places] = True
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpacked(data: bytes, wide: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=wide))


class Model:
    """Weight of each bucket, with its log-count ratio multiplied in, and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def score(self, text: str) -> float:
        z = self.intercept + float(self.weights[features(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def telling(yes: np.ndarray, no: np.ndarray, toxic: int, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that are weighed, and their log-count ratios, from the rows of either class that have each."""
    ratio = np.log((yes + 1) / (toxic + 2)) - np.log((no + 1) / (rest + 2))
    error = np.sqrt(1 / (yes + 1) + 1 / (no + 1))
    used = np.flatnonzero((yes + no >= LEAST_ROWS) & (np.abs(ratio) >= LEAST_SIGMAS * error))
    return used, ratio[used]


class Rows:
    """Training rows as packed bits, read in pieces."""

    def __init__(self, bits: list[bytes], wide: int):
        self.bits, self.wide, self.held = bits, wide, None
        if sum(len(unpacked(b, wide)) for b in bits) <= KEPT_BITS:
            self.held = list(self._read())

    def _read(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for at in range(0, len(self.bits), 256):
            rows = [unpacked(b, self.wide) for b in self.bits[at : at + 256]]
            yield at, at + len(rows), np.repeat(np.arange(len(rows)), list(map(len, rows))), np.concatenate(rows)

    def __iter__(self):
        return iter(self.held) if self.held is not None else self._read()


def fit(bits: list[bytes], labels: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights of the features, ratios multiplied in, and the intercept: logistic regression, all rows in every step (L-BFGS), so
    the result depends on the rows alone."""
    rows, wide, n, toxic = Rows(bits, len(ratio)), len(ratio), len(labels), labels.sum()
    each = np.where(labels == 1, np.sqrt(max(n - toxic, 1) / toxic), 1.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        v, total, g = w[:-1] * ratio, penalty / 2 * float(w[:-1] @ w[:-1]), np.zeros(wide + 1)
        for a, b, owner, place in rows:
            z = np.bincount(owner, v[place], minlength=b - a) + w[-1]
            total += float((each[a:b] * (np.logaddexp(0, z) - labels[a:b] * z)).sum())
            err = each[a:b] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[a:b])
            g[:-1] += np.bincount(place, err[owner], minlength=wide)
            g[-1] += err.sum()
        g[:-1] = g[:-1] * ratio + penalty * w[:-1]
        return total, g

    w = np.zeros(wide + 1)
    w[-1] = np.log(toxic / (n - toxic))
    value, slope = loss(w)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        way, back = slope.copy(), []
        for s, y in reversed(moved):
            back.append((s @ way) / (y @ s))
            way -= back[-1] * y
        way *= (moved[-1][0] @ moved[-1][1]) / (moved[-1][1] @ moved[-1][1]) if moved else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(moved, reversed(back), strict=True):
            way += s * (a - (y @ way) / (y @ s))
        size, fall = 1.0, float(slope @ way)
        new, new_slope = loss(w - way)
        while new > value - 1e-4 * size * fall and size > 1e-6:
            size /= 2
            new, new_slope = loss(w - size * way)
        step, turn = -size * way, new_slope - slope
        w, done = w + step, abs(value - new) < 1e-5 * abs(new)
        value, slope = new, new_slope
        if step @ turn > 0:
            moved = [*moved[-7:], (step, turn)]
        if done:
            break
    return w[:-1] * ratio, float(w[-1])


def fold(key: str):
    """crc32 of the id as text, modulo ``FOLDS``; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(named(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fold_of(key) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_ROWS) -> Model:
    spark = docs.sparkSession
    prepare(spark)
    known = labels.select(named(key).alias("id"), named(label).cast("int").alias("y")).filter("id is not null and y is not null")
    known = known.filter(fold("id") != 0).groupBy("id").agg(F.max(F.least("y", F.lit(1))).alias("y"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(most).collect()  # ids and labels of at most ``most`` rows
    wanted = spark.createDataFrame([(r["id"], r["y"]) for r in picked], known.schema)
    rows = docs.select(named(key).alias("id"), text_of(text).alias("t")).join(F.broadcast(wanted), "id").select("id", "y", "t")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([packed(features(t), BUCKETS) for t in x.column(2).to_pylist()], pa.binary())], ["id", "y", "f"])

    kind = known.schema["id"].dataType.simpleString()
    # The bound holds for repeated ids too: of equal ids the smallest features stand for all.
    found = written(rows.mapInArrow(extract, f"id {kind}, y int, f binary").groupBy("id", "y").agg(F.min("f").alias("f")), "toxicity-features")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for x in slices(batches):
            for y, f in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                n[int(y == 1), unpacked(f, BUCKETS)] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "no", "yes"])

    counts = found.select("y", "f").mapInArrow(count, "bucket bigint, no bigint, yes bigint").groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).toArrow()
    classes = {r["y"] == 1: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, rest = classes.get(True, 0), classes.get(False, 0)
    if not toxic or not rest:
        share = (toxic + 1) / (toxic + rest + 2)
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)))
    yes, no = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["bucket"].to_numpy()
    yes[at], no[at] = counts["yes"].to_numpy(), counts["no"].to_numpy()
    used, ratio = telling(yes, no, toxic, rest)
    column = np.full(BUCKETS, -1)
    column[used] = np.arange(len(used))
    sent = spark.sparkContext.broadcast(column)  # one number for each bucket

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            places = [sent.value[unpacked(f, BUCKETS)] for f in x.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([packed(p[p >= 0], len(used)) for p in places], pa.binary())], ["id", "y", "f"])

    got = sorted(found.mapInArrow(weighed, f"id {kind}, y int, f binary").collect(), key=lambda r: str(r["id"]))
    weights, at = np.zeros(BUCKETS), np.array([r["y"] == 1 for r in got], float)
    weights[used], intercept = fit([bytes(r["f"]) for r in got], at, ratio)
    return Model(weights, intercept)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``key``, ``held_out``, ``score``, ``predicted``."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each bucket
    rows = docs.select(named(key), (fold(key) == 0).alias("held_out"), text_of(text).alias("_text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            s = np.array([sent.value.score(t) for t in x.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, T.StructType(rows.schema.fields[:2]).add("score", "double").add("predicted", "integer"))
