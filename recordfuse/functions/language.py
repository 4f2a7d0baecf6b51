"""A light language guess, to be replaced by a better one where there is one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Words that tell languages apart.
MARKERS = {
    "en": "the of and to in is that it for was with are this have from".split(),
    "de": "der die und den von zu das mit sich des ist nicht ein eine auf".split(),
    "fr": "le la les et des est une dans que qui pour sur avec du un".split(),
    "es": "el los las que de la una por con para del se su como y".split(),
}
CHARS, LEAST = 500, 20


def _among(own: list[str]):
    return lambda w: w.isin(*own)


def detect_language(c: Column) -> Column:
    """Of the first 500 characters; "en" for short texts and where nothing is found; of equals the first of ``MARKERS``."""
    def counts(words: Column) -> Column:
        return F.struct(*[F.size(F.filter(words, _among(own))).alias(g) for g, own in MARKERS.items()])

    def most(n: Column) -> Column:
        top = F.greatest(*[n[g] for g in MARKERS])
        out = F.lit("en")
        for g in reversed(MARKERS):
            out = F.when((n[g] == top) & (top > 0), g).otherwise(out)
        return out

    found = bound(bound(F.split(F.lower(F.substring(c, 1, CHARS)), r"[^\p{L}]+"), counts), most)
    return F.when(F.length(F.trim(c)) < LEAST, "en").otherwise(F.coalesce(found, F.lit("en")))
