"""Lines and blocks of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import titled
from ..functions.text import bound, trimmed

# Words that are headings, and what begins a bullet.
HEADINGS = (
    "experience", "education", "skills", "summary", "profile", "objective", "employment", "work history", "certifications", "projects", "languages",
    "interests", "awards", "publications", "references", "contact", "technical skills", "professional experience", "career history",
)
BULLET = "^[-*•◦▪·–—]\\s+"
SKILL_SECTIONS = ("skills", "technical skills", "technologies", "tools")


def indent_level(line: Column) -> Column:
    """0 without indent, 1 for up to three columns, 2 for up to seven, 3 beyond; a tab is four."""
    lead = F.length(F.replace(F.regexp_extract(line, r"^[ \t]*", 0), F.lit("\t"), F.lit("    ")))
    return F.when(lead == 0, 0).when(lead < 4, 1).when(lead < 8, 2).otherwise(3)


def is_heading(stripped: Column) -> Column:
    bare = F.regexp_replace(stripped, ":+$", "")
    word = F.lower(trimmed(bare)).isin(*HEADINGS)
    capitals = (stripped == F.upper(stripped)) & (stripped != F.lower(stripped)) & F.length(bare).between(2, 40)
    front = F.regexp_replace(stripped, ":$", "")
    title = stripped.endswith(":") & (front == titled(front)) & (front != F.lower(front)) & (F.length(stripped) <= 50)
    return (stripped != "") & (word | capitals | title)


def tag_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(``key``, pos, raw, tag, indent_level, section): ``section`` is the last heading so far. The window runs within one
    document."""
    rows = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("pos", "raw"))
    s = trimmed(F.col("raw"))
    tag = F.when(s == "", "blank").when(is_heading(s), "heading").when(s.rlike(BULLET) | (indent_level(F.col("raw")) >= 1), "bullet").otherwise("body")
    rows = rows.withColumn("tag", tag)
    title = F.when(F.col("tag") == "heading", trimmed(F.regexp_replace(s, ":+$", "")))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.when(F.col("tag") == "blank", 0).otherwise(indent_level(F.col("raw")))
    return rows.select(key, "pos", "raw", "tag", level.alias("indent_level"), F.last(title, ignorenulls=True).over(so_far).alias("section"))


def lines_in_section(tagged: DataFrame, *names: str) -> DataFrame:
    return tagged.filter(F.lower("section").isin(*[n.lower() for n in names]) & ~F.col("tag").isin("blank", "heading"))


def section_text(tagged: DataFrame, key: str, *names: str) -> DataFrame:
    """(``key``, text): the section's lines, joined by line feeds."""
    rows = lines_in_section(tagged, *names).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda r: r.raw), "\n").alias("text"))


def lines_under(text: Column, *names: str) -> Column:
    """The lines under headings of these names (in lower case), without blank ones, as array<string>: for use inside one document,
    without a shuffle. The work grows with the lines, and texts that hold none of the names are not cut. (No inner function uses an
    outer one's variable: what is found may be handed to a Python function, which Spark does not take out of such an expression.)"""
    mark = lambda raw: F.concat(F.when(is_heading(trimmed(raw)), "h").otherwise("b"), raw)
    pieces = F.split(F.array_join(F.transform(F.split(text, "\n"), mark), "\n"), "\n(?=h)")
    title = lambda p: trimmed(F.regexp_replace(trimmed(F.substr(F.substring_index(p, "\n", 1), F.lit(2))), ":+$", ""))
    own = F.filter(pieces, lambda p: p.startswith("h") & F.lower(title(p)).isin(*names))
    rest = F.flatten(F.transform(own, lambda p: F.slice(F.split(p, "\n"), F.lit(2), F.length(p))))
    lines = F.filter(F.transform(rest, lambda raw: F.substr(raw, F.lit(2))), lambda raw: trimmed(raw) != "")
    named = bound(F.lower(text), lambda low: reduce(Column.__or__, [low.contains(n) for n in names]))
    return F.when(named, lines).when(text.isNotNull(), F.array().cast("array<string>"))


def page_layout(blocks: DataFrame, page: list[str]) -> DataFrame:
    """(``page``, is_two_column, mid_x) from blocks (x0, y0, x1, y1, page_width): two columns if more than two text blocks lie
    on either side of the middle."""
    mid = F.col("page_width") / 2
    side = blocks.filter("block_type = 0").groupBy(*page).agg(F.max(mid).alias("mid_x"), F.count_if(F.col("x1") <= mid + 15).alias("l"), F.count_if(F.col("x0") >= mid - 15).alias("r"))
    return side.select(*page, ((F.col("l") > 2) & (F.col("r") > 2) & (F.col("mid_x") > 0)).alias("is_two_column"), "mid_x")


def reading_order(blocks: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """(``doc``, text): text blocks by column, then height in steps of 5, then left edge; pages with a blank line between."""
    joined = blocks.filter("block_type = 0").join(page_layout(blocks, [doc, page]), [doc, page])
    column = F.when(F.col("is_two_column") & (F.col("x0") >= F.col("mid_x") - 15), 1).otherwise(0)
    place = F.struct(column.alias("c"), (F.bround(F.col("y0") / 5) * 5).alias("y"), F.col("x0"), F.col("block_no"), trimmed(F.col("text")).alias("text"))
    pages = joined.groupBy(doc, page).agg(F.array_sort(F.collect_list(place)).alias("b"))
    text = F.array_join(F.filter(F.transform("b", lambda x: x.text), lambda t: t != ""), "\n")
    return pages.select(doc, page, text.alias("t")).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "t"))).alias("p")).select(doc, F.array_join(F.transform("p", lambda x: x.t), "\n\n").alias("text"))


def ocr_gate(native: Column, recognised: Column | None = None) -> Column:
    """struct<text, note>: recognised text takes the place of native text of fewer than 50 characters, unless it is blank."""
    thin = F.length(F.regexp_replace(native, "[ \n]", "")) < 50
    if recognised is None:
        return F.struct(native.alias("text"), F.when(thin, "ocr_unavailable").otherwise("native_text_ok").alias("note"))
    got = F.coalesce(trimmed(recognised), F.lit("")) != ""
    return F.struct(F.when(thin & got, recognised).otherwise(native).alias("text"), F.when(~thin, "native_text_ok").when(got, "ocr_success").otherwise("ocr_failed:empty").alias("note"))
