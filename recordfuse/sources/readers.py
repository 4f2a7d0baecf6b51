"""Sources as source records: delimited files, JSON exports, notes, document text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.language import detect_language
from ..functions.skills import canonical_each, find_skills
from ..operators.layout import SKILL_SECTIONS, lines_under
from ..schema import JOB, VALUE, completed, value
from ..storage import files_at

# Headers that name a field.
HEADERS = {
    "name": ("name", "full_name", "fullname", "candidate_name"),
    "email": ("email", "email_address", "e-mail"),
    "phone": ("phone", "phone_number", "mobile", "contact_number"),
    "current_company": ("current_company", "company", "employer"),
    "title": ("title", "job_title", "role", "position"),
}


def _blank(c: Column) -> Column:
    return t.none_if_empty(t.trimmed(c.cast("string")))


def _one(v: Column) -> Column:
    """A list of the value, or of none."""
    return F.when(v.isNotNull(), F.array(v)).otherwise(F.array().cast(f"array<{VALUE}>"))


def _numbered(df: DataFrame, by: Column) -> DataFrame:
    """``rec_idx`` rising in the order of ``by`` (with gaps): a range sort, so no task has all rows."""
    return df.withColumn("_by", by).sort("_by").withColumn("rec_idx", F.monotonically_increasing_id()).drop("_by")


def _job(company: Column, title: Column, start=None, end=None, summary=None) -> Column:
    null = F.lit(None).cast("string")
    parts = zip(("company", "title", "start", "end", "summary"), (company, title, *(null if x is None else x for x in (start, end, summary))), strict=True)
    made = F.array(F.struct(*[c.alias(n) for n, c in parts]).cast(JOB))
    return F.when(company.isNotNull() | title.isNotNull(), made).otherwise(F.array().cast(f"array<{JOB}>"))


def csv_records(rows: DataFrame, source_id: Column) -> DataFrame:
    """From a table with a header's columns and ``rec_idx``. Of several columns for a field the last that is not blank counts;
    all-blank rows are dropped."""
    found = {}
    for name, headers in HEADERS.items():
        own = [c for c in rows.columns if c.strip().lstrip("﻿").lower() in headers]
        found[name] = F.coalesce(*[_blank(F.col(f"`{c}`")) for c in reversed(own)]) if own else F.lit(None).cast("string")
    got = rows.select("rec_idx", source_id.alias("source_id"), *[c.alias(n) for n, c in found.items()]).filter(F.coalesce(*HEADERS).isNotNull())
    return completed(
        got, source_type=F.lit("recruiter_csv"), source_id=F.col("source_id"), full_name=value(F.col("name"), "direct_field", 1.0), emails=_one(value(F.col("email"), "direct_field", 1.0)),
        phones=_one(value(F.col("phone"), "direct_field", 1.0)), experience_raw=_job(F.col("current_company"), F.col("title")),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a row's place in its file is in its id."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", encoding="UTF-8")
    rows = rows.withColumn("rec_idx", F.monotonically_increasing_id()).withColumn("_file", F.input_file_name())
    within = F.row_number().over(Window.partitionBy("_file").orderBy("rec_idx")) - 1
    named = rows.withColumn("_row", within)
    return csv_records(named, F.concat(F.element_at(F.split("_file", "/"), -1), F.lit(":row"), F.col("_row").cast("string")))


ATS_FIELDS = {
    "name": "$.person.display_name", "email": "$.person.contact_email", "phone": "$.person.contact_phone", "role": "$.current_role", "employer": "$.employer", "summary": "$.summary_text",
    "skills": "$.tagged_skills", "start": "$.most_recent_start", "end": "$.most_recent_end",
}


def ats_records(items: DataFrame) -> DataFrame:
    """From (rec_idx, source_id, ``ATS_FIELDS`` as text). Records without name, e-mail and phone are dropped; skills are cut at
    commas and less sure."""
    got = items.select("rec_idx", "source_id", *[_blank(F.col(c)).alias(c) for c in ATS_FIELDS]).filter("coalesce(name, email, phone) is not null")
    skills = F.filter(F.transform(F.split("skills", ","), t.trimmed), lambda x: x != "")
    return completed(
        got, source_type=F.lit("ats_json"), source_id=F.col("source_id"), full_name=value(F.col("name"), "direct_field", 1.0), emails=_one(value(F.col("email"), "direct_field", 1.0)),
        phones=_one(value(F.col("phone"), "direct_field", 1.0)), skills_raw=F.coalesce(t.as_values(skills, "direct_field", 0.85), F.array().cast(f"array<{VALUE}>")),
        experience_raw=_job(F.col("employer"), F.col("role"), F.col("start"), F.col("end"), F.col("summary")),
    )


def read_ats(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that hold an array of objects or one object; malformed files and items that are no objects give nothing."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    whole = files.select("file", F.try_parse_json("value").alias("v")).filter("v is not null")
    listed = whole.select("file", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.try_parse_json(F.concat(F.lit("["), F.to_json("v"), F.lit("]")))).alias("v"))
    listed.createOrReplaceTempView("_recordfuse_ats")
    items = spark.sql("select file, pos, value as item from _recordfuse_ats, lateral variant_explode(v) where schema_of_variant(value) like 'OBJECT%'")
    place = F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1
    numbered = items.withColumn("rec_idx", F.monotonically_increasing_id()).withColumn("source_id", F.concat("file", F.lit(":item"), place.cast("string")))
    return ats_records(numbered.select("rec_idx", "source_id", *[F.try_variant_get("item", p, "string").alias(n) for n, p in ATS_FIELDS.items()]))


#: What a user can put in: ``ner``, a function from a text column to array<struct<label, text, score>> (labels PERSON and SKILL are used);
#: ``chunks``, one to array<string> of noun phrases; ``language``, one to a language code; ``pdf_text``, as ``read_resumes`` takes it.
PLUGINS: dict[str, Callable] = {}
NER_CHARS, CHUNK_CHARS, NER_LEAST = 4000, 5000, 0.4
_ENTITY = "array<struct<label:string,text:string,score:double>>"


def register_plugin(name: str, function: Callable | None) -> None:
    """Puts a plug-in in, or with None takes it out again."""
    if name not in ("ner", "chunks", "language", "pdf_text"):
        raise ValueError(f"no plug-in is called {name}")
    PLUGINS.pop(name, None)
    if function is not None:
        PLUGINS[name] = function


def entities(text: Column, chars: int = NER_CHARS) -> Column:
    """What the recogniser finds in the first characters and is sure enough of; an empty list without one."""
    if "ner" not in PLUGINS:
        return F.array().cast(_ENTITY)
    found = PLUGINS["ner"](F.substring(text, 1, chars)).cast(_ENTITY)
    return F.coalesce(F.filter(found, lambda e: (e.score >= NER_LEAST) & (t.trimmed(e.text) != "")), F.array().cast(_ENTITY))


def person(found: Column) -> Column:
    """The surest person, of equally sure ones the first."""
    best = F.aggregate(F.filter(found, lambda e: F.upper(e.label) == "PERSON"), F.lit(None).cast("struct<label:string,text:string,score:double>"), lambda a, e: F.when(a.isNull() | (e.score > a.score), e).otherwise(a))
    return value(t.trimmed(best["text"]), "ner_gliner", best["score"])


def skill_parts(text: Column) -> Column:
    """struct<lines, sure>: the lines under a heading for skills, and the names in the whole text and then in those lines."""
    def parts(lines: Column) -> Column:
        return F.struct(lines.alias("lines"), F.array_distinct(F.concat(find_skills(text), F.flatten(F.transform(lines, find_skills)))).alias("sure"))

    lines = F.transform(lines_under(text, *SKILL_SECTIONS), lambda raw: F.regexp_replace(t.trimmed(raw), "^[-•*▪·–— \t]+", ""))
    return t.bound(lines, parts)


def note_skills(text: Column, fuzzy: bool = True, found: Column | None = None, chunks: Column | None = None) -> Column:
    return skills_of(skill_parts(text), fuzzy, found, chunks)


def skills_of(parts: Column, fuzzy: bool = True, found: Column | None = None, chunks: Column | None = None) -> Column:
    """Skills of the whole text, then of lines under a heading for skills (and such a line as a whole, less sure), then those that a
    recogniser found, as the dictionary knows them or as they stand, then noun phrases that the dictionary knows; each name
    once, where it was first found, with the most that it was sure. ``parts`` is what ``skill_parts`` gives, best as a column."""
    whole = F.array_compact(canonical_each(parts["lines"], fuzzy))
    both = F.struct(parts["sure"].alias("sure"), whole.alias("whole"))
    out = t.bound(both, lambda b: F.concat(t.as_values(b["sure"], "skill_trie", 0.85), t.as_values(F.array_except(b["whole"], b["sure"]), "skill_trie", 0.8)))
    if found is None and chunks is None:
        return out
    more = [out]
    if found is not None:
        named = F.filter(found, lambda e: F.upper(e.label) == "SKILL")
        raw = F.transform(named, lambda e: t.trimmed(e.text))
        known = F.zip_with(canonical_each(raw, fuzzy), raw, lambda k, r: F.coalesce(k, r))
        more.append(F.zip_with(known, named, lambda k, e: F.struct(k.alias("value"), F.lit("ner_gliner").alias("method"), e.score.alias("confidence"))))
    if chunks is not None:
        more.append(t.as_values(F.array_compact(canonical_each(F.coalesce(chunks, F.array().cast("array<string>")), fuzzy)), "ner_spacy", 0.4))
    every = F.concat(*more)

    def surest(name: Column, of: Column) -> Column:
        return F.aggregate(F.filter(of, lambda v: v.value == name), F.lit(None).cast(VALUE), lambda a, v: F.when(a.isNull() | (v.confidence > a.confidence), v).otherwise(a))

    return t.bound(every, lambda of: F.transform(F.array_distinct(F.transform(of, lambda v: v.value)), lambda n: surest(n, of)))


def note_records(notes: DataFrame, compat: bool = False) -> DataFrame:
    """From (rec_idx, source_id, text). Notes in which nothing is found are dropped."""
    rows = notes.filter(F.col("text").rlike(r"\S")).select("rec_idx", "source_id", t.normal_lines(F.col("text")).alias("text"))
    found, chunks = (F.col("found"), person(F.col("found"))) if "ner" in PLUGINS else (None, None), None
    if "ner" in PLUGINS:
        rows = rows.withColumn("found", entities(F.col("text")))
    if "chunks" in PLUGINS:
        rows, chunks = rows.withColumn("chunks", PLUGINS["chunks"](F.substring("text", 1, CHUNK_CHARS)).cast("array<string>")), F.col("chunks")
    language = PLUGINS.get("language", detect_language)
    # Columns of a plain projection would be evaluated again wherever they are used: by Python's arguments and by the filter below.
    once = F.struct(
        t.note_name(F.col("text"), found[1], compat).alias("name"), t.as_values(t.emails(F.col("text")), "regex", 0.9).alias("emails"),
        t.as_values(t.phones(F.col("text")), "regex", 0.6).alias("phones"), skill_parts(F.col("text")).alias("parts"), language(F.col("text")).alias("lang"),
    )
    more = [c for c in ("found", "chunks") if c in rows.columns]
    got = rows.select("rec_idx", "source_id", *more, F.inline(F.array(once)))
    skills = F.struct(skills_of(F.col("parts"), True, found[0], chunks).alias("skills"))
    got = got.select("rec_idx", "source_id", "name", "emails", "phones", "lang", F.inline(F.array(skills)))
    got = got.filter("name is not null or size(emails) > 0 or size(phones) > 0 or size(skills) > 0")
    return completed(
        got, source_type=F.lit("recruiter_notes"), source_id=F.col("source_id"), full_name=F.col("name"), emails=F.col("emails"), phones=F.col("phones"), skills_raw=F.col("skills"),
        parse_errors=F.when(F.col("lang") != "en", F.array(F.concat(F.lit("non_english_detected:"), F.col("lang")))).otherwise(F.array().cast("array<string>")),
    )


def read_notes(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("source_id"), F.col("value").alias("text"))
    return note_records(_numbered(files, F.col("source_id")), compat)


def resume_records(resumes: DataFrame) -> DataFrame:
    """From (rec_idx, source_id, text): document text, one record each. Without text there is a record that says so."""
    text = t.normal_lines(F.coalesce(F.col("text"), F.lit("")))
    rows = resumes.select("rec_idx", "source_id", text.alias("text")).withColumn("jobs", t.experience(F.col("text")))
    c, full = F.col("text"), t.trimmed(F.col("text")) != ""
    stem = F.regexp_replace("source_id", r"\.[^.]*$", "")
    named = None
    if "ner" in PLUGINS:
        rows = rows.withColumn("found", entities(F.col("text"), 2000))
        named = person(F.col("found"))
    when = lambda v, kind: F.when(full, v).otherwise(F.lit(None).cast(kind))
    items = lambda v: F.when(full, v).otherwise(F.array().cast(f"array<{VALUE}>"))
    return completed(
        rows, source_type=F.lit("resume"), source_id=F.col("source_id"), full_name=when(t.resume_name(c, stem, named), VALUE), emails=items(t.as_values(t.emails(c), "regex", 0.95)),
        phones=items(t.as_values(t.phones(c), "regex", 0.9)), location_raw=when(value(t.location(c), "regex", 0.8), VALUE), links=F.when(full, t.links(c)),
        skills_raw=items(t.as_values(find_skills(c), "skill_trie", 0.85)), headline=when(t.headline(c, F.col("jobs")), VALUE), experience_raw=F.col("jobs"), education_raw=t.education(c),
        parse_errors=F.when(full, F.array().cast("array<string>")).otherwise(F.array(F.lit("empty_resume_text"))),
    )


def read_resumes(spark: SparkSession, path: str, to_text: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Text files, or any files with ``to_text`` (or the plug-in ``pdf_text``): (source_id, content) to (source_id, text)."""
    to_text = to_text or PLUGINS.get("pdf_text")
    if to_text is None:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_id"), F.col("value").alias("text"))
    else:
        files = to_text(spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_id"), "content"))
    return resume_records(_numbered(files, F.col("source_id")))


#: Readers by kind, in the order in which their records come.
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {"recruiter_csv": read_csv, "ats_json": read_ats, "recruiter_notes": read_notes, "resume": read_resumes}


def register_source(kind: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Adds a source: a function from (session, path) to source records."""
    REGISTRY[kind] = reader


def union_sources(found: list[DataFrame]) -> DataFrame:
    """All records, source after source: ``rec_idx`` has the source's place in its upper bits."""
    out = None
    for i, df in enumerate(found):
        own = df.withColumn("rec_idx", F.col("rec_idx") + F.lit(i << 56))
        out = own if out is None else out.unionByName(own)
    return out


#: Folders of inputs below one root, as ``list_inputs`` knows them: kind, folder, pattern.
INPUTS = (("recruiter_csv", "", "*.csv"), ("ats_json", "", "*.json"), ("recruiter_notes", "notes", "*.txt"), ("resume", "resumes", "*.pdf"))


def list_inputs(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Names of the input files below a folder, by kind of source."""
    return {kind: files_at(spark, f"{root.rstrip('/')}/{folder}".rstrip("/"), pattern) or [] for kind, folder, pattern in INPUTS}
