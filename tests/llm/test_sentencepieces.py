"""Encoding and decoding against the library, spans against a walk in plain Python, with maps empty and full."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordfuse.llm import sentencepieces as sp
from recordfuse.llm.runtime import tokenizer_path

R = random.Random(3)
TEXTS = [None, "", " ", "a  b ▁ c", "日本 😀\t\n", "é", "é", " lead and trail  ", "ﬁne  Ⅷ ｱｲｳ ", "㍿ x", "é é", "가나", "　x　　y", "ＡＢＣ①", "\x00\x01a​b", "<s> </s> <unk> <0x41>", "word " * 20_000]
TEXTS += ["".join(R.choice("ab  é①Ｂﬁ▁日\n\t゛か") for _ in range(R.randint(1, 60))) for _ in range(200)]


def models():
    """The public model as it is, and with the map and the rules for spaces of a common normaliser."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(tokenizer_path(sp.MODEL), "rb") as f:
        plain = f.read()
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = proto.ModelProto.FromString(plain)
    model.normalizer_spec.CopyFrom(proto.NormalizerSpec.FromString(lib.serialized_normalizer_spec()))
    return plain, model.SerializeToString()


def walked(normalise, text):
    """The same normalisation character by character: bytes, and of each byte the source it came from."""
    data, units, pool, at = text.encode(), normalise.map.units.tolist(), normalise.map.pool, 0
    jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    pieces = []
    while at < len(data):
        node, best = jump(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= jump(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = i + 1, pool[value : pool.index(b"\0", value)]
        if best:
            pieces += [(b, at, best[0]) for b in best[1]]
            at = best[0]
        else:
            n = len(data[at:].decode()[0].encode())
            pieces += [(data[i], i, i + 1) for i in range(at, at + n)]
            at += n
    if normalise.squeeze_spaces:
        kept = []
        for p in pieces:
            if p[0] != 32 or kept and kept[-1][0] != 32:
                kept.append(p)
        while kept and kept[-1][0] == 32:
            kept.pop()
        pieces = kept
    if normalise.dummy_prefix and pieces:
        pieces.insert(0, (32, pieces[0][1], pieces[0][1]))
    out = [(m, a, b) for x, a, b in pieces for m in (normalise.space if x == 32 else bytes((x,)))]
    return bytes(x for x, _, _ in out), [a for _, a, _ in out], [b for _, _, b in out]


@pytest.mark.parametrize("which", [0, 1])
def test_normalised_as_the_library_does_with_the_walk_s_sources(which):
    pieces = sp.Pieces(proto=models()[which])
    for t in TEXTS:
        out = pieces.normalise(t or "")
        if len(t or "") < 1000:
            until, begins, ends = pieces.normalise.sources(t or "")
            wide = np.diff(until, prepend=0)
            assert (out, np.repeat(begins, wide).tolist(), np.repeat(ends, wide).tolist()) == walked(pieces.normalise, t or "")
        if which:
            assert out.decode() == pieces.lib.normalize(t or "")


@pytest.mark.parametrize("which", [0, 1])
def test_spans_cover_the_text(which):
    pieces = sp.Pieces(proto=models()[which])
    for t in TEXTS:
        t, raw = t or "", (t or "").encode()
        ids, begins, ends = pieces.encode(t)
        assert ids == pieces.lib.encode(t) and begins is not None and len(begins) == len(ids)
        assert (begins <= ends).all() and (np.diff(begins) >= 0).all() and (len(ends) == 0 or ends[-1] <= len(raw))
        if not which:
            assert b"".join(raw[a:b] for a, b in zip(begins, ends, strict=True)) == raw


def test_a_model_without_byte_pieces_and_one_that_the_rules_do_not_fit():
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto.FromString(models()[0])
    model.trainer_spec.byte_fallback = False
    for p in model.pieces:
        if p.type == proto.ModelProto.SentencePiece.BYTE:
            p.type = proto.ModelProto.SentencePiece.UNUSED
    pieces = sp.Pieces(proto=model.SerializeToString())
    ids, begins, ends = pieces.encode("ab 𓀀 c")
    assert 0 in ids and "ab 𓀀 c".encode()[begins[ids.index(0)] : ends[ids.index(0)]] == "𓀀".encode()
    pieces.normalise.dummy_prefix = False
    assert pieces.encode("ab")[1:] == (None, None) and pieces.digests("ab")[3] is None


def test_tables(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS[:40])], "doc_id long, text string, PIECE_IDS int")
    pieces = sp.load(sp.MODEL)
    got = {r.doc_id: r for r in sp.encode_digests(df).collect()}
    for i, t in enumerate(TEXTS[:40]):
        ids = pieces.lib.encode(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(pieces.lib.decode(ids).encode()).hexdigest()
    full = sp.decode(sp.encode(df).withColumn("Decoded", F.lit(1))).collect()
    assert [c for c in full[0].asDict()] == ["doc_id", "text", "piece_ids", "piece_begins", "piece_ends", "decoded"]
    for r in full:
        raw = (r.text or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.piece_begins, r.piece_ends, strict=True)) == raw and r.decoded == pieces.lib.decode(r.piece_ids)
    twice = df.filter("doc_id = 4").union(df.filter("doc_id = 4"))
    assert len({tuple(r) for r in sp.encode_digests(twice).collect()}) == 1
    assert sp.encode_digests(df.limit(0)).count() == sp.decode(sp.encode(df.limit(0))).count() == 0
