"""SentencePiece encoding and decoding with offsets.

Text is normalised by walking the model's compiled character map, longest prefix first, and every normalised byte
remembers the source bytes that it came from. The walk starts at all bytes that a key may begin with at once and goes on, byte
by byte, with those that still have a path in the map; of the prefixes found, the longest at each place counts, from left to
right. A model whose map is empty has no path at all, so each of its characters stands for itself.

The merges are the library's, over the whole text, and so is decoding. The pieces side by side are the normalised text, so
where a piece begins and ends there says which source bytes it covers.

Defined results: null text counts as empty; empty text has no ids and decodes to the empty string; pieces of an unknown
character cover what the library says they do; where pieces and normalised text differ in length (a model that the rules
here do not describe) ids and decoded text stand and the spans are null; repeated rows are encoded each on its own; other
columns, whatever their names, do not matter, and those that clash with added ones are replaced; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import made, named, others, prepare, slices, spare, text_of, tokenizer_path

MARK = "▁"
MODEL = "piece_bpe_32k.model"


class CharsMap:
    """A compiled character map: a double-array trie over UTF-8, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(1, np.uint32)  # a root without children
        self.pool = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.uint32)
            self.pool = blob[4 + size :]
        byte = np.arange(256, dtype=np.uint32)
        child = self._jump(self.units[:1])[0] ^ byte
        there = child < len(self.units)
        #: Bytes that a key may begin with.
        self.first = there & (self.units[np.where(there, child, 0)] & np.uint32(0x800000FF) == byte)

    @staticmethod
    def _jump(units: np.ndarray) -> np.ndarray:
        return (units >> 10) << ((units & 0x200) >> 6)

    def longest(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the places ``at`` those where a key of the map begins, with the length of the longest key and the place of its
        replacement in the pool."""
        size, value = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        which, node = np.arange(len(at)), np.full(len(at), self._jump(self.units[:1])[0], np.uint32)
        for k in range(len(data)):
            inside = at[which] + k < len(data)
            which, node = which[inside], node[inside]
            byte = data[at[which] + k].astype(np.uint32)
            node = node ^ byte
            there = node < len(self.units)
            which, node, byte = which[there], node[there], byte[there]
            unit = self.units[node]
            there = unit & np.uint32(0x800000FF) == byte
            which, unit = which[there], unit[there]
            node = node[there] ^ self._jump(unit)
            if not len(which):
                break
            ends = (unit >> 8 & 1) == 1
            size[which[ends]], value[which[ends]] = k + 1, self.units[node[ends]] & np.uint32(0x7FFFFFFF)
        found = np.flatnonzero(size)
        return at[found], size[found], value[found]

    def replacement(self, value: int) -> bytes:
        return self.pool[value : self.pool.index(b"\0", value)]


class Normaliser:
    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze_spaces: bool, escape_spaces: bool = True):
        self.map = CharsMap(blob)
        self.dummy_prefix, self.squeeze_spaces, self.space = dummy_prefix, squeeze_spaces, MARK.encode() if escape_spaces else b" "

    def steps(self, data: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(source start, source end, replacement) from front to back: longest prefixes, none inside another."""
        out, free = [], 0
        starts = np.flatnonzero(self.map.first[data])
        for at, size, value in zip(*(x.tolist() for x in self.map.longest(data, starts)), strict=True):
            if at >= free:
                free = at + size
                out.append((at, free, self.map.replacement(value)))
        return out

    def replaced(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes after the map and, for each of them, the first source byte of its origin and the one after the last.
        Bytes that are not replaced stand for themselves."""
        data = np.frombuffer(text.encode(), np.uint8)
        out, begins = data, np.arange(len(data), dtype=np.int32)
        ends = begins + np.int32(1)
        if steps := self.steps(data):
            parts, at = [], 0
            for start, end, put in (*steps, (len(data), len(data), b"")):
                n = len(put)
                parts += [(data[at:start], begins[at:start], ends[at:start]), (np.frombuffer(put, np.uint8), np.full(n, start, np.int32), np.full(n, end, np.int32))]
                at = end
            out, begins, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        if self.squeeze_spaces:
            blank = out == 0x20
            keep = ~blank | np.append(False, ~blank[:-1])[: len(blank)]  # of spaces that of each run which comes first
            last = int(np.flatnonzero(~blank)[-1]) + 1 if not blank.all() else 0
            keep[last:] = False
            out, begins, ends = out[keep], begins[keep], ends[keep]
        if self.dummy_prefix and len(out):
            front = np.full(1, begins[0], np.int32)
            out, begins, ends = np.concatenate([np.full(1, 0x20, np.uint8), out]), np.concatenate([front, begins]), np.concatenate([front, ends])
        return out, begins, ends

    def sources(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each byte after the map: where it ends in the normalised text, in which each space is a mark of three bytes, and
        the first source byte of its origin and the one after the last."""
        out, begins, ends = self.replaced(text)
        wide = np.ones(len(out), np.int32)
        wide[out == 0x20] = len(self.space)
        return np.cumsum(wide, dtype=np.int32), begins, ends

    def __call__(self, text: str) -> bytes:
        return self.replaced(text)[0].tobytes().replace(b" ", self.space)


class Pieces:
    """A loaded model."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(proto)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = model.normalizer_spec
        self.normalise = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        kinds = type(model.pieces[0])
        self.sizes = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.sizes[[p.type == kinds.UNKNOWN for p in model.pieces]] = -1
        self.names = [str(i) for i in range(len(model.pieces))]

    def digests(self, text: str) -> tuple[int, str, str, str | None]:
        """(number of ids, SHA-256 of the ids, of the text that the ids decode to, and of the spans as ``begin:end``
        pairs of 32-bit little-endian numbers)."""
        ids, begins, ends = self.encode(text)
        said = (",".join(map(self.names.__getitem__, ids)).encode(), self.decode(ids).encode())
        spans = None if begins is None else hashlib.sha256(np.stack([begins, ends], 1).astype("<i4").tobytes()).hexdigest()
        return len(ids), *(hashlib.sha256(x).hexdigest() for x in said), spans

    def encode(self, text: str) -> tuple[list[int], np.ndarray | None, np.ndarray | None]:
        """Ids, and the first byte and the byte after the last that each covers in the UTF-8 of ``text``."""
        ids = self.lib.encode(text)
        until, begins, ends = self.normalise.sources(text)
        sizes = self.sizes[np.fromiter(ids, np.int64, len(ids))]
        if len(unknown := np.flatnonzero(sizes < 0)):
            surfaces = self.lib.encode(text, out_type=str)
            sizes[unknown] = [len(surfaces[i].encode()) for i in unknown.tolist()]
        after = np.cumsum(sizes)
        if (after[-1] if len(after) else 0) != (until[-1] if len(until) else 0):
            return ids, None, None
        return ids, begins[np.searchsorted(until, after - sizes, "right")], ends[np.searchsorted(until, after - 1, "right")]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def load(model: str) -> Pieces:
    """The model from a path, or by the name of a public vocabulary file."""
    return Pieces(model if "/" in model else tokenizer_path(model))


def encode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with ``piece_ids``, ``piece_begins`` and ``piece_ends`` (arrays; spans in bytes of the UTF-8 text)."""
    prepare(docs.sparkSession)
    added = ("piece_ids", "piece_begins", "piece_ends")
    own = others(docs, *added)
    rows = docs.select(*map(named, own), text_of(text).alias(spare(docs, "_pieces_text")))
    kind = pa.list_(pa.int32())

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in slices(batches, 64):
            got = list(zip(*map(pieces.encode, b.column(len(own)).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, kind) for x in got)], [*own, *added])

    schema = T.StructType(rows.schema.fields[:-1])
    for c in added:
        schema = schema.add(c, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(spans, schema)


def decode(encoded: DataFrame, ids: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded`` (the text of the ids; null ids decode to null)."""
    prepare(encoded.sparkSession)
    own = others(encoded, "decoded")
    rows = encoded.select(*map(named, own), named(ids).alias(spare(encoded, "_pieces_ids")))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in slices(batches, 64):
            texts = [x and pieces.decode(x) if x is None or x else "" for x in b.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*own, "decoded"])

    return rows.mapInArrow(plain, T.StructType(rows.schema.fields[:-1]).add("decoded", "string"))


def encode_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Per row ``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``spans_sha256``: what ``encode`` then ``decode`` give, as digests.
    One pass without a shuffle; a worker holds one batch."""
    prepare(docs.sparkSession)
    rows = docs.select(named(key), text_of(text).alias("_text"))
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in slices(batches):
            got = made([pieces.digests(t) for t in b.column(1).to_pylist()], pa.schema(fields))
            yield pa.RecordBatch.from_arrays([b.column(0), *got.columns], [key, *(n for n, _ in fields)])

    schema = T.StructType(rows.schema.fields[:1])
    return rows.mapInArrow(digest, schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("spans_sha256", "string"))
