"""Source records made from the benchmark's star schema, in Spark and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.readers import ats_records, csv_records, union_sources

FIRST = ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn")
LAST = ("Stone", "Rivers", "Marsh", "Field", "Woods", "Hill", "Lake", "Vale")
STARTS = ("January 2018", "Mar 2016", "4/2019", "2015")
ENDS = ("Present", "Jun 2019", "2017-05", "2012")
SKILLS = ("python, k8s", "js,React , js", "underwater basketry", "sql", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, name, email, phone, role, employer, start, end, skills) of every customer. Some e-mails and phones are shared by
    people of different names; some are missing."""
    c = F.col("c_custkey")
    letter = lambda n: F.chr(97 + F.floor(c / n) % 26)
    own = F.lower(F.concat(F.col("first"), F.lit("."), F.col("last"), c.cast("string"), F.lit("@example.com")))
    email = F.when(c % 11 == 0, F.concat(F.lit("team"), F.floor(c / 33).cast("string"), F.lit("@example.com"))).when(c % 5 != 0, own)
    phone = F.when(c % 7 != 0, F.concat(F.lit("(212) 2"), F.lpad((F.floor(c / 2) % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.floor(c / 200) % 10000).cast("string"), 4, "0")))
    # A customer takes some bytes of a file and makes much work: the few pieces that a file is read in are dealt to all tasks.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").repartition(n, "c_custkey").withColumns({"first": _pick(FIRST, c % 6), "last": F.concat(_pick(LAST, F.floor(c / 6) % 8), letter(48), letter(1248))})
    return rows.select(
        c.alias("c"), F.concat_ws(" ", "first", "last").alias("name"), email.alias("email"), phone.alias("phone"), F.col("c_mktsegment").alias("role"),
        F.concat(F.lit("Corp"), (c % 10).cast("string")).alias("employer"), _pick(STARTS, c % 4).alias("start"), _pick(ENDS, F.floor(c / 4) % 4).alias("end"), _pick(SKILLS, c % 5).alias("skills"),
    )


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PEOPLE_SQL = f"""
people as (
  select c, first || ' ' || last as name,
    case when c % 11 = 0 then 'team' || (c // 33) || '@example.com' when c % 5 <> 0 then lower(first || '.' || last || c || '@example.com') end as email,
    case when c % 7 <> 0 then '(212) 2' || lpad(((c // 2) % 100)::varchar, 2, '0') || '-' || lpad(((c // 200) % 10000)::varchar, 4, '0') end as phone,
    role, 'Corp' || (c % 10) as employer, list_extract({_list(STARTS)}, (c % 4 + 1)::int) as sdate, list_extract({_list(ENDS)}, ((c // 4) % 4 + 1)::int) as edate,
    list_extract({_list(SKILLS)}, (c % 5 + 1)::int) as skills
  from (select c_custkey as c, c_mktsegment as role, list_extract({_list(FIRST)}, (c_custkey % 6 + 1)::int) as first,
    list_extract({_list(LAST)}, ((c_custkey // 6) % 8 + 1)::int) || chr((97 + (c_custkey // 48) % 26)::int) || chr((97 + (c_custkey // 1248) % 26)::int) as last from customer))"""


def csv_source(spark: SparkSession, sf_dir: str, everyone: DataFrame | None = None) -> DataFrame:
    """Every third person as a row of a delimited file: capitals, a suffix, spaces, no skills."""
    p = (people(spark, sf_dir) if everyone is None else everyone).filter("c % 3 = 0")
    rows = p.select(
        F.col("c").alias("rec_idx"), F.concat(F.lit(" "), F.upper("name"), F.lit(" JR.")).alias("Full_Name"), F.concat(F.upper("email"), F.lit(" ")).alias("e-mail"),
        F.col("phone").alias("mobile"), F.lit("").alias("company"), F.col("employer").alias("Employer"), F.when(F.col("c") % 2 == 0, F.col("role")).alias("job_title"), F.lit("x").alias("unknown"),
    )
    return csv_records(rows, F.concat(F.lit("recruiter.csv:row"), F.col("rec_idx").cast("string")))


def ats_source(spark: SparkSession, sf_dir: str, everyone: DataFrame | None = None) -> DataFrame:
    p = people(spark, sf_dir) if everyone is None else everyone
    return ats_records(p.select(F.col("c").alias("rec_idx"), F.concat(F.lit("ats.json:item"), F.col("c").cast("string")).alias("source_id"), "name", "email", "phone", "role", "employer", F.lit(None).cast("string").alias("summary"), "skills", "start", "end"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    everyone = people(spark, sf_dir)
    return union_sources([csv_source(spark, sf_dir, everyone), ats_source(spark, sf_dir, everyone)])


#: What the two sources hold, in SQL; ``idx`` is rec_idx.
RECORDS_SQL = (
    PEOPLE_SQL
    + f""",
records as (
  select c as idx, 'recruiter_csv' as src, 'recruiter.csv:row' || c as sid, upper(name) || ' JR.' as name, upper(email) as email, phone, employer, case when c % 2 = 0 then role end as role,
    null as sdate, null as edate, '' as skills, c from people where c % 3 = 0
  union all select {1 << 56} + c, 'ats_json', 'ats.json:item' || c, name, email, phone, employer, role, sdate, edate, skills, c from people),
keys as (
  select idx, c, src, lower(email) as email, '+1' || regexp_replace(phone, '[^0-9]', '', 'g') as phone,
    array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_replace(lower(name), '\\b(jr|sr)\\b\\.?', '', 'g'), '[^a-z ]', ' ', 'g'), ' '), lambda x: x <> '')), '_') as name_key
  from records)"""
)


def clusters(found: DataFrame) -> DataFrame:
    """A given clustering of the records for fusion: people with one number modulo 1000 are one."""
    return found.select("rec_idx", F.concat(F.lit("k"), (F.pmod(F.col("rec_idx"), F.lit(1 << 56)) % 1000).cast("string")).alias("cluster_id"))
