"""Near-copies against all pairs, in plain Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from recordfuse.llm import neardup

R = random.Random(8)
WORDS = ["".join(R.choice("abcdeilnorst") for _ in range(R.randint(2, 8))) for _ in range(400)]
prose = lambda n: " ".join(R.choice(WORDS) for _ in range(n))
vary = lambda t, p: " ".join(R.choice(WORDS) if R.random() < p else w for w in t.split())


def brute(texts, words, percent=80):
    """Sizes of the sets, and by place the smallest place that each text reaches."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("words", [2, 5])
def test_groups_of_all_pairs(spark, words):
    base = [prose(80) for _ in range(4)]
    texts = [vary(b, p) for b in base for p in (0, 0, 0.01, 0.02, 0.05, 0.08, 0.1)] + [None, "", "one", "ONE", "a b", "a b c", "a b c d e", "a b c d e f", " \n ", prose(30_000)]
    texts += [texts[-1] + " end"]
    R.shuffle(texts)
    sizes, label = brute(texts, words)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ID", F.lit(0)).withColumn("H", F.lit(0))
    got = {r.doc_id: r for r in neardup.classify(rows, words=words).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes and [got[i].component_id for i in range(len(texts))] == label
    assert all(got[i].kept == (label[i] == i) for i in range(len(texts)))


def test_each_row_is_judged_by_its_own_text(spark):
    """Ids that stand over different texts, are missing or repeated; columns with clashing names."""
    one, two, three = prose(60), prose(60), prose(60)
    rows = [(5, one), (5, two), (7, one + " x"), (3, two), (None, two), (None, three), (None, three + " y"), (9, None), (9, ""), (None, None), (8, "w"), (8, "w"), (6, "W")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, KEPT int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.classify(df).collect()), key=str)
    want = [(5, 5, True), (5, 3, False), (7, 5, False), (3, 3, True), (None, 3, False), (None, None, False), (None, None, False), (9, 9, True), (9, 9, True), (None, None, False), (8, 6, False), (8, 6, False), (6, 6, True)]
    assert got == sorted(want, key=str)
    stay = neardup.deduplicated(df)
    assert stay.columns == ["doc_id", "text", "KEPT"]
    kept = sorted((r.KEPT for r in stay.collect()))
    assert [n for n in kept if n not in (5, 6, 7, 8)] == [0, 3, 9, 12] and len({5, 6} & set(kept)) == len({7, 8} & set(kept)) == 1


def test_tables_without_rows_or_likeness(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classify(empty).count() == neardup.deduplicated(empty).count() == 0
    alone = spark.createDataFrame([(1, prose(30)), (2, prose(30))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.classify(alone).collect()} == {(1, 1), (2, 2)}
