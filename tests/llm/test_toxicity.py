"""Toxicity: held-out rows, the optimum, what may and may not enter the model."""

import random

import numpy as np
from pyspark.sql import functions as F

from recordfuse.llm import toxicity

R = random.Random(5)
WORDS = ["".join(R.choice("abcdeilnorst") for _ in range(R.randint(2, 8))) for _ in range(400)]
prose = lambda n: " ".join(R.choice(WORDS) for _ in range(n))


def test_held_out_rows(spark):
    bad = ["vilewretch", "grubface", "nastyoaf"]
    toxic = [i % 4 == 0 for i in range(400)]
    texts = [prose(60) + (" " + R.choice(bad) + " " + prose(20) if x else "") for x in toxic]
    rows = [*enumerate([*texts, None, "", prose(30_000)]), (7, texts[7]), (None, texts[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("SCORE", F.lit(1)).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic)] + [(None, 1), (5, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    again = toxicity.train(table.repartition(7), labels.repartition(3))
    assert np.array_equal(model.weights, again.weights) and model.intercept == again.intercept
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert len(held) > 40 and all(got[i].held_out == (toxicity.fold_of(i) == 0) for i in range(400)) and got[None].held_out == (toxicity.fold_of(None) == 0)
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values()) and got[400].score == got[401].score
    # Labels of the held-out fold make no difference.
    other = toxicity.train(table, labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(model.weights, other.weights)
    assert toxicity.score(table.limit(0), model).count() == 0 and toxicity.train(table, labels.limit(0)).score("x") == toxicity.train(table.limit(0), labels).score("x") == 0.5
    assert toxicity.train(table, labels.filter("toxic = 1")).score("x") > 0.9


def test_the_fit_is_the_optimum_and_bounded_rows_give_the_same(monkeypatch):
    r = np.random.default_rng(1)
    x = r.random((300, 40)) < 0.3
    y = (x[:, 0] & ~x[:, 1] | (r.random(300) < 0.1)).astype(float)
    ratio = r.normal(size=40)
    bits = [toxicity.packed(np.flatnonzero(a), 40) for a in x]
    weights, b = toxicity.fit(bits, y, ratio)
    each = np.where(y == 1, np.sqrt((300 - y.sum()) / y.sum()), 1.0)
    err = each * (1 / (1 + np.exp(-(x @ weights + b))) - y)
    slope = (x.T @ err) * ratio + toxicity.PENALTY * weights / ratio
    assert np.abs(slope).max() < 0.2 and abs(err.sum()) < 0.2
    monkeypatch.setattr(toxicity, "KEPT_BITS", 0)
    assert np.array_equal(toxicity.fit(bits, y, ratio)[0], weights)


def test_features_are_distinct_n_grams():
    assert len(toxicity.features("")) == 0 and np.array_equal(toxicity.features("Bad-word"), toxicity.features("bad word bad"))
    assert all(len(np.unique(f)) == len(f) for f in map(toxicity.features, ("é ü", "a" * 1000, prose(500))))
    for f in (np.array([], int), np.array([0, 5, 39])):
        assert np.array_equal(toxicity.unpacked(toxicity.packed(f, 40), 40), f)


def test_labelled_sample(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    model = toxicity.train(docs, labels.withColumnRenamed("y", "toxic"))
    rows = toxicity.score(docs.join(labels, "doc_id"), model).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.y == 1]
    clean = [r.predicted for r in rows if r.y == 0]
    assert len(toxic) > 50 and np.mean(toxic) > 0.8 and np.mean(clean) < 0.01
