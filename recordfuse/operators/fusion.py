"""One canonical row per cluster, with where every value came from.

All values of all records are one long table of facts (cluster, field, key, order, value). The best fact of each key is an
argument minimum, aggregated before the shuffle; a second aggregation gathers a cluster's distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import normalize_date, ordered, years_between
from ..functions.names import display_name
from ..functions.phones import normalize_phone
from ..functions.skills import canonical_skill
from ..functions.text import none_if_empty, trimmed
from ..schema import DEGREE, JOB, combined_confidence, rank
from .linkage import email_key

#: Order of fields in provenance; those after it have none.
FIELDS = ("full_name", "emails", "phones", "headline", "skills", "linkedin", "github", "portfolio", "other", "experience", "education", "source")
#: The fields that a column of ``merge`` is made of; every cluster has facts of its sources.
NEEDS = {
    "full_name": FIELDS[:1], "emails": ("emails",), "phones": ("phones",), "links": ("linkedin", "github", "portfolio", "other"), "skills": ("skills",), "headline": ("headline",),
    "years_experience": ("experience",), "experience": ("experience",), "education": ("education",), "provenance": FIELDS[:5], "overall_confidence": FIELDS[:5],
}
_FACT = "struct<value:string,source:string,method:string,raw:string,confidence:double,job:" + JOB + ",degree:" + DEGREE + ">"


_ITEM = "struct<field:int,pos:int,value:string,method:string,confidence:double,job:" + JOB + ",degree:" + DEGREE + ">"


def _at(*names: str) -> Column:
    return F.col("f.field").isin(*[FIELDS.index(n) for n in names])


def _only(name: str, c: Column) -> Column:
    return F.when(_at(name), c)


def _items(fields: tuple[str, ...] = FIELDS) -> Column:
    """All that a record says about the fields, as one list."""
    null = F.lit(None)

    def item(field: str, pos, value=null, method=null, confidence=null, job=null, degree=null) -> Column:
        parts = zip(("field", "pos", "value", "method", "confidence", "job", "degree"), (F.lit(FIELDS.index(field)), pos, value, method, confidence, job, degree), strict=True)
        return F.struct(*[c.alias(n) for n, c in parts]).cast(_ITEM)

    def listed(column: str, made) -> Column:
        return F.coalesce(F.transform(column, made), F.array().cast(f"array<{_ITEM}>"))

    zero = F.lit(0)
    single = [item(n, zero, F.col(f"{n}.value"), F.col(f"{n}.method"), F.col(f"{n}.confidence")) for n in ("full_name", "headline") if n in fields]
    single += [item(n, zero, F.col(f"links.{n}")) for n in ("linkedin", "github", "portfolio") if n in fields] + [item("source", zero, F.col("source_type"))]

    def found(field: str, column: str) -> Column:
        return listed(column, lambda v, i: item(field, i, v["value"], v["method"], v["confidence"]))

    lists = {
        "emails": found("emails", "emails"), "phones": found("phones", "phones"), "skills": found("skills", "skills_raw"), "other": listed("links.other", lambda v, i: item("other", i, v)),
        "experience": listed("experience_raw", lambda v, i: item("experience", i, job=v)), "education": listed("education_raw", lambda v, i: item("education", i, degree=v)),
    }
    return F.concat(F.array(*single), *[made for n, made in lists.items() if n in fields])


def facts(records: DataFrame, clusters: DataFrame, fuzzy: bool = True, parse_dates: bool = True, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(cluster_id, field, key, order, fact) of the given fields and of the sources; ``field`` is a place in ``FIELDS``. Records are
    read and joined once, and each rule is applied to the rows of its own field only."""
    joined = records.join(clusters.select("rec_idx", "cluster_id"), "rec_idx")
    rows = joined.select("cluster_id", "rec_idx", "source_type", "source_id", F.explode(_items(fields)).alias("f"))
    src, at, v = F.col("source_type"), F.col("rec_idx"), F.col("f.value")
    skill = _only("skills", v)
    date = lambda c: normalize_date(c, parse_dates) if "experience" in fields else F.lit(None).cast("string")
    rows = rows.withColumns({
        "phone": normalize_phone(_only("phones", v)), "start": date(F.col("f.job.start")), "end": date(F.col("f.job.end")),
        "skill": F.coalesce(canonical_skill(skill, fuzzy), none_if_empty(trimmed(skill))),
    })
    pair = lambda a, b: F.nullif(F.concat_ws("\u0001", F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))), F.lit("\u0001"))
    key = (
        F.when(_at("full_name", "headline", "linkedin", "github", "portfolio"), F.when(F.coalesce(v, F.lit("")) != "", F.lit("")))
        .when(_at("emails"), email_key(v)).when(_at("phones"), F.col("phone.e164")).when(_at("skills"), F.col("skill")).when(_at("other"), v)
        .when(_at("experience"), pair(F.col("f.job.company"), F.col("f.job.title"))).when(_at("education"), pair(F.col("f.degree.institution"), F.col("f.degree.degree")))
        .otherwise(at.cast("string"))
    )
    rows = rows.withColumn("key", key).filter("key is not null")
    ranked, scalar = _at("full_name", "headline", "emails", "phones"), _at("full_name", "headline")
    order = F.struct(
        F.when(ranked, rank(src)).when(_at("skills"), rank(src, "skills")).otherwise(0).cast("int").alias("rank"), F.when(scalar, -F.col("f.confidence")).otherwise(0.0).alias("sure"),
        F.when(scalar, F.col("source_id")).otherwise("").alias("id"), at.alias("rec"), F.col("f.pos").alias("pos"),
    )
    dates = ordered(F.col("start"), F.col("end"))
    job = F.struct(F.col("f.job.company").alias("company"), F.col("f.job.title").alias("title"), dates["start"].alias("start"), dates["end"].alias("end"), F.col("f.job.summary").alias("summary"))
    sourced = scalar | _at("emails", "phones", "skills")
    sure = F.when(_at("phones"), F.col("f.confidence") * F.col("phone.confidence")).otherwise(F.col("f.confidence"))
    fact = F.struct(
        F.when(_at("emails", "phones", "skills"), F.col("key")).otherwise(v).alias("value"), src.alias("source"), F.when(_at("phones"), "regex").otherwise(F.col("f.method")).alias("method"),
        F.when(sourced, v).alias("raw"), F.when(sourced, combined_confidence(src, sure)).alias("confidence"), F.when(_at("experience"), job).alias("job"), F.col("f.degree").alias("degree"),
    ).cast(_FACT)
    return rows.select("cluster_id", F.col("f.field").alias("field"), "key", order.alias("order"), fact.alias("fact"))


def merge(records: DataFrame, clusters: DataFrame, as_of: Column | None = None, fuzzy: bool = True, parse_dates: bool = True, foreign: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """The ``candidates``: one row per cluster. Of equal keys the best ranked fact counts, in the place of the first seen. With
    ``only`` these columns, and facts that none of them is made of are not gathered."""
    fields = FIELDS if only is None else tuple(f for f in FIELDS if any(f in NEEDS.get(c, ()) for c in only))
    rows = facts(records, clusters, fuzzy, parse_dates, fields)
    seen = F.min(F.struct(F.col("order.rec").alias("rec"), F.col("order.pos").alias("pos")))
    best = rows.groupBy("cluster_id", "field", "key").agg(seen.alias("seen"), F.min_by("fact", "order").alias("fact"))
    whole = best.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("field", "seen", "key", "fact"))).alias("all"))

    def of(field: str) -> Column:
        return F.transform(F.filter("all", lambda x: x.field == FIELDS.index(field)), lambda x: x.fact)

    one = lambda field: F.get(of(field), F.lit(0))
    values = lambda field: F.transform(of(field), lambda x: x.value)
    names = F.array(*[F.lit(f) for f in FIELDS])
    label = lambda x: F.when(x.field.isin(*[FIELDS.index(f) for f in ("emails", "phones", "skills")]), F.concat(F.element_at(names, x.field + 1), F.lit("["), x.key, F.lit("]"))).otherwise(F.element_at(names, x.field + 1))
    provenance = F.transform(
        F.filter("all", lambda x: x.field <= FIELDS.index("skills")),
        lambda x: F.struct(label(x).alias("field"), x.fact.source.alias("source"), x.fact.method.alias("method"), x.fact.raw.alias("raw_value"), x.fact.confidence.alias("confidence")),
    )
    shown = whole.select(
        F.col("cluster_id").alias("candidate_id"), one("full_name")["value"].alias("_name"), values("emails").alias("emails"), values("phones").alias("phones"),
        F.lit(None).cast("struct<city:string,region:string,country:string>").alias("location"),
        F.struct(one("linkedin")["value"].alias("linkedin"), one("github")["value"].alias("github"), one("portfolio")["value"].alias("portfolio"), values("other").alias("other")).alias("links"),
        F.transform(of("skills"), lambda x: F.struct(x.value.alias("name"), x.confidence.alias("confidence"), F.array(x.source).alias("sources"))).alias("skills"),
        one("headline")["value"].alias("headline"), F.transform(of("experience"), lambda x: x.job).alias("experience"), F.transform(of("education"), lambda x: x.degree).alias("education"),
        provenance.alias("provenance"), values("source").alias("source_records_merged"),
    )
    years = F.aggregate("experience", F.lit(0.0), lambda a, j: a + F.coalesce(years_between(j.start, j.end, as_of), F.lit(0.0)))
    sure = F.aggregate("provenance", F.lit(0.0), lambda a, p: a + p.confidence) / F.size("provenance")
    out = shown.withColumns({
        "full_name": display_name(F.col("_name"), foreign), "years_experience": F.when(years > 0, F.round(years, 1)),
        "overall_confidence": F.when(F.size("provenance") > 0, F.round(sure, 4)).otherwise(0.0),
    })
    if only is not None:
        return out.select(*only)
    return out.select("candidate_id", "full_name", "emails", "phones", "location", "links", "skills", "headline", "years_experience", "experience", "education", "provenance", "overall_confidence", "source_records_merged")


def provenance_rows(candidates: DataFrame) -> DataFrame:
    """The provenance as a long table."""
    return candidates.select("candidate_id", F.posexplode("provenance").alias("pos", "p")).select("candidate_id", "pos", "p.*")
