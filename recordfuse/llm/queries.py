"""The queries of this subpackage: one per operator over its whole table, and the SQL that says what some return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, maintext, neardup, quality, secrets, sentencepieces, tokencounts, toxicity, warc
from .runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return turns.select("conv_id", "place", "turn", "role", "new_role", "done", "cost", F.concat("before", "piece").alias("rendered"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return judged.select("doc_id", *quality.BASE_COLUMNS, "kept", "class_distance", "word_distance")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(table(spark, sf_dir, "documents", "doc_id", "text"), words=2)


QUERIES: dict[str, Query] = {
    "op7_quality": op7_quality,
    "op1_decontaminate": op1_decontaminate,
    "op2_secrets": op2_secrets,
    "op8_neardup": op8_neardup,
    "op3_warc": op3_warc,
    "op5_tokencounts": op5_tokencounts,
    "op4_maintext": op4_maintext,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
    "op6_sentencepiece": op6_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
with d as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to
from d left join f using (payload_digest)""",
    "op8_neardup": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents),
s as (select distinct doc_id, unnest(case when len(l) = 0 then [] when len(l) = 1 then l else list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) end) as x from w),
n as (select doc_id, count(*) as n from s group by doc_id),
sized as (select doc_id, x, n from s join n using (doc_id)),
met as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from sized a join sized b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
links as (select a, b from met where 100 * c >= 80 * (na + nb - c)),
e as (select a, b from links union all select b, a from links),
reach(id, node) as (select doc_id, doc_id from documents union select id, b from reach join e on a = node),
top as (select id, min(node) as component_id from reach group by id)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id = component_id as kept from documents left join n using (doc_id) join top on id = doc_id""",
}
