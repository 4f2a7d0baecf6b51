"""The corpus pipeline: documents that pass, once each, clean of test items and secrets, encoded.

Every stage takes rows with the columns of ``documents`` and maybe others, whatever they are called; all but the last return the same
columns. An empty table gives an empty table. Rows that repeat an id are rows of their own until the second stage, which keeps one of
equal ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordfuse.llm import decontaminate, neardup, quality, secrets, sentencepieces
from recordfuse.llm.runtime import named, table
from recordfuse.storage import settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null texts and texts under 50 words go, by the base rules; a null or unknown language is judged by
    those alone; repeated rows are judged alike."""
    place = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    judged = quality.judge(docs.toDF(*place.values()), place["text"], place["lang"])
    return judged.filter("kept").select(*place.values()).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (shingles of five words, similarity 0.8 or more): that with the smallest id. Rows
    without an id stay where no row of their group has one, one of each group; of rows with one id and text one stays; of texts without
    words, which are like nothing, one for each id."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a test item. Null and empty texts stay; repeated rows stay or go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark, and ``n_chars`` (where there is such a column) the length
    of what is then there. Null texts, and the numbers beside them, stay as they are."""
    clean = secrets.redact(docs)
    length = F.coalesce(F.length(named("text")).cast("long"), named("n_chars")) if "n_chars" in map(str.lower, docs.columns) else None
    return clean.select(*(length.alias(c) if c.lower() == "n_chars" else named(c) for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number and digests of its tokens, their source spans and the text that they decode to. Null texts count as
    empty and have no tokens; repeated rows have equal results; other columns do not matter."""
    return sentencepieces.encode_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding", encoding),
]

#: The histograms of the first stage, the signatures of the second and the vocabulary of the last are not SQL; tests hold the
#: pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again, and the table before it, with
    all that the stage wrote on its way, is deleted then."""

    def after(k: int) -> DataFrame:
        if k == 0:
            return table(spark, sf_dir, "documents")
        return settled(spark, f"pipeline-{k}", lambda: STAGES[k - 1][1](spark, after(k - 1), sf_dir))

    return STAGES[-1][1](spark, after(len(STAGES) - 1), sf_dir)
