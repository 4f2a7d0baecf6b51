"""Column types of the engine's tables, and the trust that sources have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<value:string,method:string,confidence:double>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
JOB = "struct<company:string,title:string,start:string,end:string,summary:string>"
DEGREE = "struct<institution:string,degree:string,field:string,end_year:int>"

#: Columns of ``source_records`` after ``rec_idx``.
RECORD = {
    "source_type": "string", "source_id": "string", "full_name": VALUE, "emails": f"array<{VALUE}>", "phones": f"array<{VALUE}>",
    "location_raw": VALUE, "links": LINKS, "skills_raw": f"array<{VALUE}>", "headline": VALUE, "experience_raw": f"array<{JOB}>",
    "education_raw": f"array<{DEGREE}>", "parse_errors": "array<string>",
}

# Sources, how a value was found, trust by source, ranks (0 is best) in general and for skills.
SOURCE_TYPES = ("ats_json", "recruiter_csv", "linkedin", "resume", "github", "recruiter_notes")
METHODS = ("direct_field", "regex", "ner_gliner", "ner_spacy", "skill_trie", "fuzzy_match", "ocr", "merged")
TRUST = {"ats_json": 0.95, "recruiter_csv": 0.90, "linkedin": 0.85, "github": 0.80, "resume": 0.75, "recruiter_notes": 0.50}
UNKNOWN_TRUST = 0.40
RANK = {"ats_json": 0, "recruiter_csv": 1, "linkedin": 2, "resume": 3, "github": 4, "recruiter_notes": 5}
SKILL_RANK = {"github": 0, "ats_json": 1, "recruiter_csv": 2, "linkedin": 3, "resume": 4, "recruiter_notes": 5}
UNKNOWN_RANK = 6


def value(v: Column, method: str, confidence: float | Column) -> Column:
    """A found value; null where ``v`` is null."""
    c = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
    made = F.struct(v.alias("value"), F.lit(method).alias("method"), c.alias("confidence"))
    return F.when(v.isNotNull(), made).otherwise(F.lit(None).cast(VALUE))


def no_values() -> Column:
    return F.array().cast(f"array<{VALUE}>")


def constant_map(table: dict) -> Column:
    """A map literal, parsed in one step rather than put together entry by entry."""

    def literal(x) -> str:
        if isinstance(x, list):
            return "array(" + ", ".join(map(literal, x)) + ")"
        return f"{x!r}" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)

    return F.expr("map(" + ", ".join(literal(x) for pair in table.items() for x in pair) + ")")


def lookup(source: Column, table: dict, other) -> Column:
    return F.coalesce(F.try_element_at(constant_map(table), source), F.lit(other))


def trust(source: Column) -> Column:
    return lookup(source, TRUST, UNKNOWN_TRUST)


def rank(source: Column, field: str = "") -> Column:
    return lookup(source, SKILL_RANK if field == "skills" else RANK, UNKNOWN_RANK)


def combined_confidence(source: Column, extraction: Column) -> Column:
    return F.round(trust(source) * extraction, 4)


def completed(df, **columns: Column):
    """``df``'s rows as source records: columns that are not given are null, lists empty. ``rec_idx`` is kept."""
    out = []
    for name, kind in RECORD.items():
        c = columns.get(name)
        if c is None:
            c = F.array().cast(kind) if kind.startswith("array") else F.lit(None)
        out.append(c.cast(kind).alias(name))
    return df.select(F.col("rec_idx").cast("long").alias("rec_idx"), *out)
