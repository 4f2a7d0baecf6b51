"""Dates as text: ``YYYY-MM`` or ``present``."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound, none_if_empty, trimmed

PRESENT = r"(?i)^(present|current|now|ongoing|till date|to date|today)$"
#: Forms that need no parser, in the order in which they are tried.
FORMS = ("MMMM yyyy", "MMM yyyy", "M/yyyy", "yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/MM/dd", "yyyy/M")
_NAMED = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
#: What ``FORMS`` and the rules before them read; all else goes to the parser.
PLAIN = rf"(?i)^(?:\d{{4}}|\d{{4}}[-/]\d{{1,2}}|\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}/\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|{_NAMED}\.? \d{{4}}|{_NAMED} \d{{1,2}}, \d{{4}}|\d{{1,2}} {_NAMED} \d{{4}})$"
_BASE = datetime.date(1900, 1, 1)


def parsed(raw: str) -> str | None:
    """Month first; what is not said is 1 January 1900; None where there is a time of day or no date."""
    from dateutil import parser

    try:
        return parser.parse(raw, default=_BASE, dayfirst=False, yearfirst=False).strftime("%Y-%m")
    except (ValueError, OverflowError, TypeError, AttributeError):
        return None


@F.pandas_udf(T.StringType())
def _parsed(raw: pd.Series) -> pd.Series:
    return raw.map(parsed, na_action="ignore")


def normalize_date(c: Column, parse: bool = True) -> Column:
    """Forms in ``FORMS`` natively; with ``parse`` the rest by a date parser, to which only the rest is sent."""
    t = none_if_empty(trimmed(c))

    def read(x: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(x, r"(?i)\bsept\b", "Sep"), r"(?<=[A-Za-z])\.(?=\s)", "")
        formed = bound(plain, lambda p: F.date_format(F.coalesce(*[F.try_to_timestamp(p, F.lit(f)) for f in FORMS]), "yyyy-MM"))
        return F.coalesce(F.when(x.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), x), F.when(x.rlike(PRESENT), F.lit("present")), F.when(x.rlike(r"^\d{4}$"), F.concat(x, F.lit("-01"))), formed)

    known = bound(t, read)
    return F.coalesce(known, _parsed(F.when(~t.rlike(PLAIN) & ~t.rlike(PRESENT), t))) if parse else known


def date_pair(start: Column, end: Column, parse: bool = True) -> Column:
    """struct<start, end>, put the right way round; an end that is ``present`` stays."""
    return ordered(normalize_date(start, parse), normalize_date(end, parse))


def ordered(s: Column, e: Column) -> Column:
    """struct<start, end> of two normal dates."""
    month = r"^\d{4}-\d{2}$"
    swap = s.rlike(month) & e.rlike(month) & (s > e)
    return F.struct(F.when(swap, e).otherwise(s).alias("start"), F.when(swap, s).otherwise(e).alias("end"))


def years_between(start: Column, end: Column, as_of: Column | None = None) -> Column:
    day = lambda c: F.try_to_timestamp(F.concat(c, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    until = F.when(end == "present", F.current_date() if as_of is None else as_of).otherwise(day(end))
    days = F.datediff(until, day(start))
    return F.when(days.isNotNull(), F.round(F.greatest(days / F.lit(365.25), F.lit(0.0)), 1))
