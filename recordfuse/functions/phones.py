"""Phone numbers in E.164, by the published numbering plans (no per-country number metadata)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, trimmed

#: Country calling codes with the least and most digits of a national number.
CODES = {
    "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9),
    "43": (7, 13), "44": (9, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "49": (6, 11), "51": (8, 9), "52": (10, 10), "53": (8, 8), "54": (10, 11), "55": (10, 11),
    "56": (9, 9), "57": (10, 10), "58": (10, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10),
    "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "93": (9, 9), "94": (9, 9), "95": (7, 10), "98": (10, 10),
    "212": (9, 9), "213": (8, 9), "216": (8, 8), "218": (9, 9), "220": (7, 7), "221": (9, 9), "225": (10, 10), "233": (9, 9), "234": (8, 10), "237": (9, 9), "243": (9, 9), "244": (9, 9),
    "249": (9, 9), "250": (9, 9), "251": (9, 9), "254": (9, 9), "255": (9, 9), "256": (9, 9), "260": (9, 9), "261": (9, 9), "263": (9, 10),
    "351": (9, 9), "352": (6, 11), "353": (7, 9), "354": (7, 7), "355": (8, 9), "356": (8, 8), "357": (8, 8), "358": (6, 12), "359": (8, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8),
    "373": (8, 8), "374": (8, 8), "375": (9, 10), "376": (6, 9), "377": (8, 9), "380": (9, 9), "381": (8, 9), "382": (8, 8), "385": (8, 9), "386": (8, 8), "387": (8, 9), "389": (8, 8),
    "420": (9, 9), "421": (9, 9), "423": (7, 7), "502": (8, 8), "503": (8, 8), "504": (8, 8), "505": (8, 8), "506": (8, 8), "507": (7, 8), "591": (8, 8), "593": (8, 9), "595": (9, 9),
    "598": (8, 8), "852": (8, 8), "853": (8, 8), "855": (8, 9), "856": (8, 10), "880": (8, 10), "886": (8, 9), "960": (7, 7), "961": (7, 8), "962": (8, 9), "963": (8, 9), "964": (8, 10),
    "965": (8, 8), "966": (8, 9), "967": (7, 9), "968": (8, 8), "971": (8, 9), "972": (8, 9), "973": (8, 8), "974": (8, 8), "975": (7, 8), "976": (8, 8), "977": (8, 10), "992": (9, 9),
    "993": (8, 8), "994": (9, 9), "995": (9, 9), "996": (9, 9), "998": (9, 9),
}
NANP = "^[2-9][0-8][0-9][2-9][0-9]{6}$"
#: The digits of an international number; no calling code begins with another, so at most one branch can fit.
INTERNATIONAL = "^(?:1[2-9][0-8][0-9][2-9][0-9]{6}|" + "|".join(f"{code}[0-9]{{{least},{most}}}" for code, (least, most) in CODES.items()) + ")$"


def _judged(raw: Column, digits: Column) -> Column:
    plus = raw.startswith("+")
    national = F.when(digits.startswith("1") & (F.length(digits) == 11), F.substring(digits, 2, 10)).otherwise(digits)
    e164 = F.when(plus, F.when(digits.rlike(INTERNATIONAL), F.concat(F.lit("+"), digits))).otherwise(F.when(national.rlike(NANP), F.concat(F.lit("+1"), national)))
    bad = (
        F.when(F.coalesce(raw, F.lit("")) == "", "empty_input")
        .when((F.length(digits) < 3) | raw.rlike("[A-Za-z]{3,}(?<!ext)(?<!sion)$"), F.lit("parse_failed:NOT_A_NUMBER"))
        .when(e164.isNull(), "parsed_but_invalid")
    )
    found = F.struct(e164.alias("e164"), F.when(plus, 1.0).otherwise(0.6).alias("confidence"), F.when(plus, "explicit_country_code").otherwise("assumed_region:US").alias("note"))
    none = lambda note: F.struct(F.lit(None).cast("string").alias("e164"), F.lit(0.0).alias("confidence"), note.alias("note"))
    return bound(bad, lambda note: F.when(note.isNull(), found).otherwise(none(note)))


def normalize_phone(c: Column) -> Column:
    """struct<e164, confidence, note>. Numbers without a country code are read as North American."""
    core = lambda raw: F.regexp_replace(raw, r"(?i)\s*(?:x|ext\.?|extension)\s*\d+$", "")
    return bound(trimmed(c), lambda raw: bound(F.regexp_replace(core(raw), r"[^0-9]", ""), lambda digits: _judged(raw, digits)))


def dedupe_phones(c: Column) -> Column:
    return F.array_distinct(c)
