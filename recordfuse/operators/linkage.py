"""Which records are of one person: blocking on equal keys, gates on names and contacts, components."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import name_key, name_threshold, script_family
from ..functions.phones import normalize_phone
from ..functions.text import none_if_empty, trimmed
from ..storage import written
from .graph import connected_components


def email_key(c: Column) -> Column:
    return none_if_empty(F.lower(trimmed(c)))


def record_keys(records: DataFrame, foreign: bool = True) -> DataFrame:
    """(rec_idx, name_key, script, emails, phones): what records are compared by; lists without nulls or repeats."""
    name = F.col("full_name.value")
    phones = F.transform("phones", lambda p: normalize_phone(p.value)["e164"])
    return records.select(
        "rec_idx", name_key(name, foreign).alias("name_key"), script_family(name).alias("script"),
        F.array_distinct(F.array_compact(F.transform("emails", lambda e: email_key(e.value)))).alias("emails"), F.array_distinct(F.array_compact(phones)).alias("phones"),
    )


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def shared_key_pairs(keys: DataFrame, column: str) -> DataFrame:
    """(a, b, key): a < b with an entry of the list ``column`` in common."""
    rows = keys.select("rec_idx", F.explode(column).alias("key"))
    return rows.select(F.col("rec_idx").alias("a"), "key").join(rows.select(F.col("rec_idx").alias("b"), "key"), "key").filter("a < b")


def gated_by_name(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Without pairs whose names are both known and less alike than the threshold of their scripts. The measure depends on
    which name comes first (the record with the smaller index), and is taken once for each two different names."""
    of = lambda side: keys.select(F.col("rec_idx").alias(side), F.col("name_key").alias(f"n{side}"), F.col("script").alias(f"s{side}"))
    named = pairs.join(of("a"), "a").join(of("b"), "b")
    apart = named.filter("na is not null and nb is not null and na <> nb").select("na", "nb").distinct()
    scored = apart.withColumn("ratio", _similarity("na", "nb"))
    ok = (F.col("na") == F.col("nb")) | F.col("na").isNull() | F.col("nb").isNull() | (F.col("ratio") >= name_threshold(F.col("sa"), F.col("sb")))
    return named.join(scored, ["na", "nb"], "left").filter(ok).select("a", "b")


def name_pairs(keys: DataFrame) -> DataFrame:
    """Pairs with one name, unless both have e-mails and share none, or both have phones and share none."""
    rows = keys.filter("name_key is not null")
    left, right = (rows.select(F.col("rec_idx").alias(s), "name_key", F.col("emails").alias(f"e{s}"), F.col("phones").alias(f"p{s}")) for s in "ab")
    clash = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    return left.join(right, "name_key").filter("a < b").filter(~clash(F.col("ea"), F.col("eb")) & ~clash(F.col("pa"), F.col("pb"))).select("a", "b")


def edges(keys: DataFrame) -> DataFrame:
    """(a, b, reason), each pair once; of several reasons the last of email, phone, name."""
    by_email = gated_by_name(shared_key_pairs(keys, "emails").select("a", "b").distinct(), keys)
    by_phone = gated_by_name(shared_key_pairs(keys, "phones").select("a", "b").distinct(), keys)
    every = by_email.withColumn("r", F.lit(1)).union(by_phone.withColumn("r", F.lit(2))).union(name_pairs(keys).withColumn("r", F.lit(3)))
    reason = F.element_at(F.array(F.lit("email"), F.lit("phone"), F.lit("name")), F.max("r"))
    return every.groupBy("a", "b").agg(reason.alias("reason"))


def cluster_id(members: Column) -> Column:
    """A UUID-shaped digest of the sorted members, the same in every run."""
    h = F.sha2(F.array_join(F.array_sort(members), ","), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def contact_links(keys: DataFrame, column: str) -> DataFrame:
    """(a, b): links that connect what the gated pairs of ``shared_key_pairs`` connect, without all pairs. Records with one
    entry, name and script are a star round the first of them, since the gate lets equal names pass. Between two such groups
    one link is enough: without a test where a name is unknown or the names are equal, else where names are alike in an order
    in which some pair of the groups has them. Names that differ under one entry are compared pair by pair."""
    rows = keys.select("rec_idx", F.coalesce("name_key", F.lit("")).alias("name"), "script", F.explode(column).alias("key"))
    groups = rows.groupBy("key", "name", "script").agg(F.min("rec_idx").alias("lo"), F.max("rec_idx").alias("hi"))
    star = rows.join(groups, ["key", "name", "script"]).filter("rec_idx > lo").select(F.col("lo").alias("a"), F.col("rec_idx").alias("b"))
    one = lambda s: groups.select("key", *[F.col(c).alias(c + s) for c in ("name", "script", "lo", "hi")])
    pairs = one("a").join(one("b"), "key").filter("loa <> lob").drop("key")
    free = (F.col("namea") == "") | (F.col("nameb") == "") | (F.col("namea") == F.col("nameb"))
    tested = pairs.filter(~free & (F.col("loa") < F.col("hib")))
    scored = tested.select("namea", "nameb").distinct().withColumn("ratio", _similarity("namea", "nameb"))
    alike = tested.join(scored, ["namea", "nameb"]).filter(F.col("ratio") >= name_threshold(F.col("scripta"), F.col("scriptb")))
    between = pairs.filter(free & (F.col("loa") < F.col("lob"))).select("loa", "lob").union(alike.select("loa", "lob"))
    return star.union(between)


def name_links(keys: DataFrame) -> DataFrame:
    """(a, b): links that, with those of both contacts, connect what ``name_pairs`` connects, one per record at most. Records
    of one name that share an entry are linked by it already; others pair only where neither kind of contact is known to both:
    with a record that has none, or one that has e-mails only with one that has phones only."""
    kind = F.when(F.size("emails") > 0, F.when(F.size("phones") > 0, "both").otherwise("emails")).otherwise(F.when(F.size("phones") > 0, "phones").otherwise("none"))
    rows = keys.filter("name_key is not null").select("rec_idx", "name_key", kind.alias("kind"))
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("rec_idx"))).alias(k)
    blocks = rows.groupBy("name_key").agg(first("none"), first("emails"), first("phones"))
    other = F.when(F.col("kind") == "emails", F.col("phones")).when(F.col("kind") == "phones", F.col("emails"))
    hubs = rows.join(blocks.filter("none is not null or (emails is not null and phones is not null)"), "name_key")
    return hubs.select(F.coalesce("none", other).alias("a"), F.col("rec_idx").alias("b")).filter("a <> b")


def resolve(records: DataFrame, foreign: bool = True) -> DataFrame:
    """(rec_idx, cluster_id, root): ``root`` is the smallest index of the cluster, which is a component of ``edges``. A
    conflict keeps two records from a direct link only; a third may still join them. Keys are computed once and written."""
    keys = record_keys(records, foreign)
    keys = written(keys.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("emails", "phones")}), "keys")
    links = contact_links(keys, "emails").union(contact_links(keys, "phones")).union(name_links(keys))
    found = written(connected_components(keys.select(F.col("rec_idx").alias("id")), links), "clusters")
    ids = found.groupBy("component").agg(cluster_id(F.collect_list(F.col("id").cast("string"))).alias("cluster_id"))
    return found.join(ids, "component").select(F.col("id").alias("rec_idx"), "cluster_id", F.col("component").alias("root"))
