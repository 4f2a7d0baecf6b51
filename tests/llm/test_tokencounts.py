"""Token counts: all rules against brute force, sums, fields."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordfuse.llm import tokencounts

R = random.Random(5)
WORDS = ["".join(R.choice("abcdeilnorst") for _ in range(R.randint(2, 8))) for _ in range(400)]
LONG = " ".join(R.choice(WORDS) for _ in range(30_000))


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(spark, rule):
    texts = ["hello wörld\n日本\n\nx", None, "", LONG, "a\n\n\nb"]
    got = tokencounts.count(docs(spark, texts).withColumn("section", F.lit(0)), rule=rule).collect()
    by = {i: [r for r in got if r.doc_id == i] for i in range(len(texts))}
    encoder = tokencounts.Encoder(tokencounts.tokenizer_path(tokencounts.RANKS))
    for i, t in enumerate(texts):
        assert abs(sum(r.n_tokens for r in by[i]) - len(encoder.encoding.encode_ordinary(t or ""))) < 1e-6
        assert len(by[i]) == (t or "").count("\n") + 1
    with pytest.raises(ValueError):
        tokencounts.count(docs(spark, texts), rule="no")


def test_token_attribution_by_brute_force():
    for _ in range(200):
        cuts = np.unique(np.random.default_rng(R.randrange(10**6)).integers(1, 40, 8))
        first, after = np.concatenate([[0], cuts]), np.concatenate([cuts, [40]])
        edges = sorted({0, 40, *(R.randrange(40) for _ in range(4))})
        begins, ends = np.array(edges[:-1]), np.array(edges[1:])
        for rule in tokencounts.RULES:
            want = np.zeros(len(begins))
            for f, t in zip(first.tolist(), after.tolist(), strict=True):
                shares = [max(0, min(t, e) - max(f, b)) for b, e in zip(begins, ends, strict=True)]
                if rule == "share":
                    want += np.array(shares) / (t - f)
                else:
                    want[{"start": next(i for i, s in enumerate(shares) if s), "end": max(i for i, s in enumerate(shares) if s), "most": int(np.argmax(shares))}[rule]] += 1
            assert np.allclose(tokencounts.attribute(first, after, begins, ends, rule)[0], want)


def test_tables_and_fields(spark):
    df = docs(spark, ["a b\nc", None]).withColumn("N_tokens", F.lit(1))
    assert tokencounts.count(df.limit(0)).count() == 0
    rows = sorted((tuple(r) for r in tokencounts.count(df.union(df)).collect()), key=str)
    assert rows[0::2] == rows[1::2] and len(rows) == 6
    parts = spark.createDataFrame([(1, "héllo wörld", None, "tail 日本"), (2, None, None, None)], "id long, title string, lead string, body string")
    got = {(r.id, r.section): r for r in tokencounts.count_fields(parts, "id", ["title", "lead", "body"], rule="share").collect()}
    assert len(got) == 6 and got[1, 1].n_tokens == 0 and got[2, 0].doc_tokens == got[2, 1].doc_tokens
    assert (got[1, 0].begins, got[1, 0].ends, got[1, 2].begins, got[1, 2].ends) == (0, 11, 13, 20)
    # All but the two line feeds between the fields belongs to a field.
    assert 0 <= got[1, 0].doc_tokens - got[1, 0].n_tokens - got[1, 2].n_tokens <= 2
    own = docs(spark, ["abc def", "x"]).withColumn("s", F.expr("case doc_id when 0 then array(named_struct('begins', 5, 'ends', 2), named_struct('begins', 0, 'ends', 99)) end"))
    found = {(r.doc_id, r.section): r.n_tokens for r in tokencounts.count(own, sections="s").collect()}
    assert found[0, 0] == 0 and found[0, 1] > 0 and len(found) == 2
