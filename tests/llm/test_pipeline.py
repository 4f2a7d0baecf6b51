"""The pipeline against plain Python, and each stage on odd tables."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordfuse.llm import decontaminate, quality, sentencepieces

R = random.Random(12)
WORDS = ["".join(R.choice("abcdeilnorst") for _ in range(R.randint(2, 8))) for _ in range(400)]
KEY = "password = hunter2secret"


def english(n):
    shares = quality.REFERENCES["en"][1][:-1]
    return " ".join(R.choices(quality.COMMON_WORDS["en"], shares)[0] if R.random() < sum(shares) else R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [english(120) for _ in range(8)]
    items = [(1, " ".join(R.choice(WORDS) for _ in range(25))), (2, None), (3, "")]
    broken = " ".join("zz" if i in (3, 11) else w for i, w in enumerate(items[0][1].split()))
    texts = [*base, base[0], base[1] + " end", base[2][:-20], " ".join(w + "%%&" for w in english(120).split()), None, "", "short text", english(80) + " " + items[0][1], english(80) + " " + broken + " " + english(9), english(90) + " " + KEY + " " + english(20), english(60) + " é 日本 " + english(60), english(30_000)]
    docs = [(i, t, "en") for i, t in enumerate(texts)] + [(3, base[3], "en"), (3, english(70), "en"), (None, english(70), "en"), (None, base[4], "en"), (50, english(70), None), (51, english(70), "xx"), (50, "of " * 90, None)]
    return docs, items


def alike(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for t in (a, b))]
    return 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def brute(docs, items):
    refs = {g: (quality.np.array(c), quality.np.array(w)) for g, (c, w) in quality.REFERENCES.items()}
    left = [(i, t) for i, t, g in docs if quality.verdict(t or "", g, refs)[-1]]
    group = list(range(len(left)))
    for a, b in itertools.combinations(range(len(left)), 2):
        if group[a] != group[b] and alike(left[a][1], left[b][1]):
            group = [group[a] if g == group[b] else g for g in group]
    left = [min((left[k] for k, g in enumerate(group) if g == one), key=lambda r: (r[0] is None, r[0] or 0)) for one in dict.fromkeys(group)]
    hashes = decontaminate.Hashes()
    tests = [hashes.of(t or "", keep=True) for _, t in items]
    every = lambda h, t: set(range(-len(t), len(h)))
    left = [(i, t) for i, t in left if not any(len(x) and decontaminate.best_overlap(x, hashes.of(t, keep=True), every(hashes.of(t, keep=True), x), 13, 0.8) for x in tests)]
    left = [(i, t.replace(KEY, "[SECRET]")) for i, t in left]
    pieces = sentencepieces.load(sentencepieces.MODEL)
    out = []
    for i, t in left:
        ids = pieces.lib.encode(t)
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pieces.lib.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_run_against_plain_python(spark, rows, tmp_path):
    docs, items = rows
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r)[:4] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    want = brute(docs, items)
    assert got == want and 10 < len(got) < len(docs) - 8


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, rows, tmp_path, name, stage):
    docs, items = rows
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").filter("doc_id is null or doc_id < 18")
    clash = {c: F.lit(i) for i, c in enumerate(("Kept", "n_words", "_place", "_own", "base_spans", "_found", "set_key", "item_id", "n_CHARS", "id"))}
    wide = df.withColumns(clash)
    out = stage(spark, wide, str(tmp_path))
    assert out.columns == wide.columns
    found, plain = out.collect(), stage(spark, df, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(((r.doc_id, r.text) for r in plain), key=str) and len(found) > 5
    assert all(r.Kept == 0 and r.id == 9 and r.n_words == 1 for r in found)
    empty = stage(spark, wide.limit(0), str(tmp_path))
    assert empty.columns == wide.columns and empty.count() == 0
