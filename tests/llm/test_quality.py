"""Quality rules: base rules by brute force, distances, verdicts that depend on the text alone, the fit of references."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from recordfuse.llm import quality

R = random.Random(7)
WORDS = ["".join(R.choice("abcdeilnorst") for _ in range(R.randint(2, 8))) for _ in range(400)]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for t in triples:
        seen[t] = seen.get(t, 0) + 1
    hit = {i + k for i, t in enumerate(triples) if seen[t] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def english(n):
    shares = quality.REFERENCES["en"][1][:-1]
    return " ".join(R.choices(quality.COMMON_WORDS["en"], shares)[0] if R.random() < sum(shares) else R.choice(WORDS) for _ in range(n))


def test_verdicts(spark):
    texts = [english(R.randint(60, 400)) + "." for _ in range(60)] + [" ".join(w + "%%&" for w in english(120).split()), english(120).upper() + "!!", "of " * 90, None, "", "a\nb\n\na\n a \nb", "x y z " * 60, english(30_000), english(49), " ".join(R.choice(WORDS) for _ in range(90))]
    langs = ["en"] * 62 + ["en", None, "xx", "en", "en", "en", "en", None]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, langs, strict=True)), "doc_id long, text string, lang string").withColumn("Kept", F.lit("old")).withColumn("_judged_text", F.lit(1))
    judged = quality.judge(df)
    assert judged.columns == ["doc_id", "text", "lang", "_judged_text", *quality.BASE_COLUMNS, "class_distance", "word_distance", "kept"]
    got = {r.doc_id: r for r in judged.filter("kept is not null").collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in quality.BASE_COLUMNS) == brute(t or "")
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 67)) and got[67].kept and not got[68].kept and got[69].kept
    # A document alone, or twice, has the verdict that it has among others.
    for i in (0, 60, 61, 67):
        alone = quality.judge(df.filter(F.col("doc_id") == i).union(df.filter(F.col("doc_id") == i))).collect()
        assert len(alone) == 2 and all(r == got[i] for r in alone)
    assert quality.judge(df.limit(0)).count() == 0


def test_distance():
    assert quality.js_distance(np.array([1, 0]), np.array([0, 1])) == 1 and quality.js_distance(np.array([3, 1]), np.array([6, 2])) == 0
    p, q = np.array([0.5, 0.25, 0.25]), np.array([0.1, 0.6, 0.3])
    m = (p + q) / 2
    assert abs(quality.js_distance(p * 8, q) - np.sqrt((p * np.log2(p / m)).sum() / 2 + (q * np.log2(q / m)).sum() / 2)) < 1e-12


def test_references_are_what_fit_gives(spark):
    """On the sample tables: the shares of a plain mean over the labelled good rows, near what is stored."""
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.fit(docs, labels)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r.doc_id in good and zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang == "en" and not brute(r.text or "")[-1]]
    mean = np.mean([np.array(c) / sum(c) for c in (quality.histograms(r.text, "en")[0] for r in rows)], 0)
    assert np.abs(mean - got["en"][0]).max() < 1e-4
    assert all(quality.js_distance(np.array(got[g][k]), np.array(quality.REFERENCES[g][k])) < 0.1 for g in got for k in (0, 1))


def test_labelled_rows_that_took_no_part(spark):
    """Of the held-out fold, good documents stay and bad ones go (the base rules aside)."""
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet").filter("quality is not null").select("doc_id", "quality")
    rows = quality.judge(spark.read.parquet(f"{path}/documents.parquet").join(labels, "doc_id")).filter("not base_failed").select("doc_id", "quality", "kept").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and all(r.kept for r in held if r.quality == 1) and not any(r.kept for r in held if r.quality == 0)
