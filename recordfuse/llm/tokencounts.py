"""Token counts by offset-mapped attribution.

A document is encoded once as a whole; each token's span of characters follows from the bytes that it stands for (the
vocabulary is byte-level, so the tokens side by side are the text). Sections are intervals of characters. Token spans and
sections, both in order, are joined by binary search, and a token that reaches over a border is allocated by a rule:

``start``: to the section of its first character; ``end``: of its last character; ``most``: to the section with most of its
characters, the earlier one of equals; ``share``: to every section by its share of the token's characters.

A token's first character is the one that holds its first byte, so tokens within one character share it. Tokens outside
every section are not counted for any; with sections that cover the text the counts add up to the number of tokens.

Defined results: null text counts as empty; an empty text has no tokens and one empty line; null or empty lists of
sections give no rows; sections that end before they start, or beyond the text, count what they cover; overlapping
sections each count their tokens; repeated rows are counted each on its own; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import named, prepare, slices, text_of, tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
RULES = ("start", "end", "most", "share")


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first character and the one after the last that each token covers."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        after = np.cumsum(self.sizes[ids])
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) != (after[-1] if len(ids) else 0):
            raise ValueError("the tokens are not the text")
        # The character that each byte belongs to: a new one begins with every byte that does not continue one.
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return ids, char[after - self.sizes[ids]], char[after - 1] + 1


def attribute(first: np.ndarray, after: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Per section its tokens by the rule, and how many tokens of those that touch it reach over one of its borders.
    Tokens are in order, so those that touch a section lie side by side."""
    ends = np.maximum(begins, ends)
    low, high = np.searchsorted(after, begins, "right"), np.searchsorted(first, ends, "left")
    high = np.where(ends > begins, np.maximum(low, high), low)
    over = np.zeros(len(begins))
    counts = (high - low).astype(float)
    # Only tokens at the two ends of a section's run can reach over its borders; runs of tokens within a character too.
    for i in np.flatnonzero(high > low).tolist():
        a, b = int(low[i]), int(high[i])
        f, t = first[a:b], after[a:b]
        across = (f < begins[i]) | (t > ends[i])
        if not across.any():
            continue
        over[i] = across.sum()
        f, t = f[across], t[across]
        part = (np.minimum(t, ends[i]) - np.maximum(f, begins[i])) / (t - f)
        counts[i] -= across.sum()
        if rule == "share":
            counts[i] += part.sum()
        elif rule == "start":
            counts[i] += (f >= begins[i]).sum()
        elif rule == "end":
            counts[i] += (t <= ends[i]).sum()
        else:
            counts[i] += sum(_most(x, y, begins, ends, i) for x, y in zip(f.tolist(), t.tolist(), strict=True))
    return counts, over


def _most(first: int, after: int, begins: np.ndarray, ends: np.ndarray, i: int) -> bool:
    shares = np.minimum(after, ends) - np.maximum(first, begins)
    return int(np.argmax(shares)) == i


def _lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Every line with the line feed that ends it, so the lines cover the text."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    ends = np.append(ends, len(text))
    return np.concatenate([[0], ends[:-1]]), ends


_SCHEMA = "section bigint, begins bigint, ends bigint, n_tokens double, n_crossing bigint, doc_tokens bigint"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def count(docs: DataFrame, key: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "start", ranks: str = RANKS) -> DataFrame:
    """A row (``key``, section, begins, ends, n_tokens, n_crossing, doc_tokens) for each section of each row. ``sections`` is a
    column array<struct<begins, ends>> in characters; without it the lines are the sections."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    prepare(docs.sparkSession)
    given = [] if sections is None else [F.col(f"{sections}.begins").cast("array<bigint>"), F.col(f"{sections}.ends").cast("array<bigint>")]
    rows = docs.select(named(key), text_of(text).alias("_text"), *(c.alias(f"_s{i}") for i, c in enumerate(given)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks if "/" in ranks else tokenizer_path(ranks))
        for x in slices(batches, 128):
            keys, out = [], [[] for _ in _NAMES]
            for i, t in enumerate(x.column(1).to_pylist()):
                ids, first, after = encoder.spans(t)
                begins, ends = _lines(t) if sections is None else (np.array(x.column(c)[i].as_py() or [], np.int64) for c in (2, 3))
                counts, over = attribute(first, after, begins, ends, rule)
                n = len(begins)
                keys += [i] * n
                for column, values in zip(out, (np.arange(n), begins, ends, counts, over.astype(np.int64), np.full(n, len(ids))), strict=True):
                    column.append(values)
            kinds = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2
            made = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(keys, pa.int64())), *made], names=[key, *_NAMES])

    return rows.mapInArrow(go, f"`{key}` {rows.schema[key].dataType.simpleString()}, {_SCHEMA}")


def count_fields(rows: DataFrame, key: str, fields: list[str], between: str = "\n", rule: str = "start", ranks: str = RANKS) -> DataFrame:
    """Tokens of the fields of a row that are written one after the other with ``between`` in the middle: a row for each
    field, ``section`` its place in ``fields``. What stands between belongs to no field; null fields are empty."""
    parts = [text_of(f) for f in fields]
    joined, at, spans = F.concat_ws(between, *parts), F.lit(0), []
    for p in parts:
        spans.append(F.struct(at.cast("long").alias("begins"), (at + F.length(p)).cast("long").alias("ends")))
        at = at + F.length(p) + len(between)
    return count(rows.select(named(key), joined.alias("_joined"), F.array(*spans).alias("_fields")), key, "_joined", "_fields", rule, ranks)
