"""Spaced seeds: both ways against a search along all diagonals, masks against all placings of substitutions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordfuse.llm import decontaminate as d

R = random.Random(11)
WORDS = [f"w{i}" for i in range(500)]
prose = lambda n: " ".join(R.choice(WORDS) for _ in range(n))


def brute_run(same, least, share):
    """The longest stretch, by trying all: (start, end)."""
    n, total = len(same), np.concatenate([[0], np.cumsum(same)])
    for size in range(n, least - 1, -1):
        for s in range(n - size + 1):
            if same[s] and same[s + size - 1] and total[s + size] - total[s] >= share * size - 1e-9:
                return s, s + size
    return 0, 0


def brute(item, text, min_tokens=13, share=0.8):
    item, text = d.tokens_of(item or ""), d.tokens_of(text or "")
    best = None
    for k in range(-len(item) + 1, len(text)) if item and text else ():
        a, b = max(0, -k), min(len(item), len(text) - k)
        same = np.array([item[i] == text[i + k] for i in range(a, b)], bool)
        s, e = brute_run(same, min(min_tokens, len(item)), share)
        if e:
            found = (e - s, -(a + k + s), int(same[s:e].sum()))
            best = max(best, found) if best else found
    return best and (len(item), -best[1], best[0] - best[1], best[2])


def test_masks_miss_no_placing_of_substitutions():
    for least, lengths in ((13, range(13, 26)), (5, range(5, 13)), (4, (4,)), (3, (3,)), (2, (2,)), (1, (1,))):
        shapes = [sum(1 << i for i, x in enumerate(m) if x == "1") for m in d.MASKS[least]]
        for n in lengths:
            gone = np.array([list(c) for c in itertools.combinations(range(n), n // 5)], np.int64)
            bits = (np.int64(1) << gone).sum(1).astype(np.int64)
            hit = np.zeros(len(bits), bool)
            for m, shape in zip(d.MASKS[least], shapes, strict=True):
                for at in range(n - len(m) + 1):
                    hit |= bits & (shape << at) == 0
            assert hit.all(), (least, n)


def test_longest_run_against_all_runs():
    for _ in range(400):
        same = np.array([R.random() < 0.8 for _ in range(R.randint(1, 40))])
        least = R.randint(1, 15)
        assert d.best_run(same, least, 0.8) == brute_run(same, least, 0.8)


@pytest.fixture(scope="module")
def tables(spark):
    put = lambda text, at: " ".join("zz" if i in at else w for i, w in enumerate(text.split()))
    twenty, seven, three = prose(20), prose(7), "one two three"
    items = [(1, prose(30)), (2, twenty), (7, prose(15)), (7, prose(18)), (None, prose(16)), (None, prose(6)), (9, seven), (10, three), (11, ""), (12, None), (2, twenty), (13, "Ünïcode élan №5 naïve façade 東京 год slow quick brown fox jumps over"), (14, prose(60))]
    near = [put(twenty, {6, 8, 11, 15}), put(items[2][1], {2, 7, 12}), put(items[3][1], {3, 8, 13}), put(seven, {3}), put(items[5][1], {0}), put(items[4][1], {1, 6, 11}), put(items[0][1], {1, 2, 9, 15, 20, 28})]
    texts = [prose(30) + " " + x + " " + prose(9) for x in near] + [near[0], near[0], None, "", "x ONE two, three y", "one two zz three", prose(400), items[12][1][:130], items[11][1].upper().replace("BROWN", "red")]
    some = [x for _, x in items if x]
    texts += [" ".join(w if R.random() > p else "zz" for w in R.choice(some).split()) for p in (0.1, 0.2, 0.3) for _ in range(6)]
    docs = [(i if i % 9 else 3, t) for i, t in enumerate(texts)]
    docs.append((None, near[1]))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("most", [d.BROADCAST_HASHES, 0])
def test_both_ways_find_what_all_diagonals_do(spark, tables, most):
    table, tests, docs, items = tables
    want = sorted(((k, i, *o) for k, t in docs for i, x in items if (o := brute(x, t))), key=str)
    got = sorted((tuple(r) for r in d.overlaps(table.withColumn("Item_ID", F.lit(1)), tests, most=most).collect()), key=str)
    assert got == want and len({w[:2] for w in want}) > 20
    bad = {i for i, (_, t) in enumerate(docs) if any(brute(x, t) for _, x in items)}
    marked = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(docs)], "doc_id long, TEXT string, _own int")
    kept = d.clean(marked, tests, most=most)
    assert kept.columns == ["doc_id", "TEXT", "_own"] and {r._own for r in kept.collect()} == set(range(len(docs))) - bad
    assert d.overlaps(table.limit(0), tests, most=most).count() == 0 and d.overlaps(table, tests.limit(0), most=most - 1).count() == 0
    assert d.clean(marked.limit(0), tests, most=most).count() == 0


def test_very_long_texts(spark, tables):
    _, tests, docs, _ = tables
    long = prose(60_000)
    df = spark.createDataFrame([(1, long), (2, long + " " + docs[0][1])], "doc_id long, text string")
    first = {r.doc_id for r in d.overlaps(df, tests).collect()}
    assert first == {2} == {r.doc_id for r in d.overlaps(df, tests, most=0).collect()}
