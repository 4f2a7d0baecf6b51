"""Names: display form, key, script."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound, none_if_empty, trimmed

# What is no part of a name's key, and the code ranges of script families.
SUFFIXES = r"\b(jr|sr|ii|iii|iv|phd|md|esq)\b\.?"
SCRIPTS = {
    "indic_arabic": r"[\x{0900}-\x{097F}\x{0600}-\x{06FF}\x{0980}-\x{09FF}\x{0B80}-\x{0BFF}\x{0C00}-\x{0C7F}]",
    "cjk": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]",
    "latin": r"[\x{0000}-\x{007F}\x{00C0}-\x{024F}]",
}
THRESHOLDS = {"latin": 0.50, "indic_arabic": 0.45, "cjk": 0.35}


@lru_cache(4096)
def romanised(ch: str) -> str:
    """A letter in ASCII, read off its name in the character database: accents dropped, syllables by name."""
    plain = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
    if plain or ch.isspace():
        return plain or " "
    name = unicodedata.name(ch, "").split()
    if not name or "LETTER" not in name and "SIGN" not in name:
        return ""
    if name[0] in ("KATAKANA", "HIRAGANA", "HANGUL"):
        return name[-1].lower() if name[-1].isalpha() else ""
    if name[0] == "ARABIC":
        sound = name[2] if len(name) > 2 else ""
        return sound[:2].lower() if sound[:2] in ("SH", "TH", "KH", "GH", "DH") else sound[:1].lower()
    return name[-1].lower() if "SIGN" not in name or "VOWEL" in name else ""


def transliterate(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    out: list[str] = []
    for ch in text:
        name = unicodedata.name(ch, "")
        # An Indic vowel sign or a virama stands in the place of the vowel that a letter has by itself.
        if ("VOWEL SIGN" in name or "VIRAMA" in name) and out and out[-1].endswith("a") and len(out[-1]) > 1:
            out[-1] = out[-1][:-1]
        out.append("" if "VIRAMA" in name else romanised(ch))
    return "".join(out)


@F.pandas_udf(T.StringType())
def _transliterate(names: pd.Series) -> pd.Series:
    return names.map(transliterate, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def ascii_name(c: Column, foreign: bool = True) -> Column:
    """``c`` in ASCII. Only names with other characters go through Python; without ``foreign`` those are dropped."""
    other = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    rest = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    return F.coalesce(_transliterate(other), c) if foreign else rest


def name_key(c: Column, foreign: bool = True) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(ascii_name(c, foreign)), SUFFIXES, ""), r"[^a-z\s]", " ")
    parts = F.filter(F.split(plain, r"\s+"), lambda x: x != "")
    return none_if_empty(F.array_join(F.array_sort(parts), "_"))


def titled(c: Column) -> Column:
    """Every run of letters with a capital in front and small letters after it."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")


def display_name(c: Column, foreign: bool = True) -> Column:
    same = F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c) if foreign else c
    s = F.regexp_replace(trimmed(same), r"\s+", " ")
    one_case = (F.upper(s) != F.lower(s)) & ((s == F.upper(s)) | (s == F.lower(s)))
    return F.when(one_case, titled(s)).otherwise(s)


def script_family(c: Column) -> Column:
    """The script with most characters; of equals the first of latin, indic_arabic, cjk, unknown; of blank text unknown."""
    def counts(seen: Column) -> Column:
        n = [F.length(seen) - F.length(F.regexp_replace(seen, SCRIPTS[s], "")) for s in ("latin", "indic_arabic", "cjk")]
        return F.struct(F.length(seen).alias("all"), *[x.alias(s) for s, x in zip(("latin", "indic_arabic", "cjk"), n, strict=True)])

    def top(k: Column) -> Column:
        most = F.greatest(k["latin"], k["indic_arabic"], k["cjk"], k["all"] - k["latin"] - k["indic_arabic"] - k["cjk"])
        return F.when(F.coalesce(k["all"], F.lit(0)) == 0, "unknown").when(k["latin"] == most, "latin").when(k["indic_arabic"] == most, "indic_arabic").when(k["cjk"] == most, "cjk").otherwise("unknown")

    return bound(bound(F.regexp_replace(c, r"(?U)\s", ""), counts), top)


def name_threshold(a: Column, b: Column) -> Column:
    """By the scripts of two names."""
    def among(*s: str) -> Column:
        return a.isin(*s) & b.isin(*s)

    indic = among("latin", "indic_arabic") & ((a == "indic_arabic") | (b == "indic_arabic"))
    cjk = among("latin", "cjk") & ((a == "cjk") | (b == "cjk"))
    return F.when(indic, THRESHOLDS["indic_arabic"]).when(cjk, THRESHOLDS["cjk"]).otherwise(THRESHOLDS["latin"])
