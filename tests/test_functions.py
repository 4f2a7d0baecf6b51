"""Scalar functions against tables of (input, expected)."""

import re

import duckdb
from pyspark.sql import functions as F

from recordfuse.functions import dates, names, phones, skills, text
from recordfuse.functions.language import detect_language
from recordfuse.operators.layout import lines_under
from recordfuse.queries import ORACLE_SQL, QUERIES
from recordfuse.sources.readers import note_records, note_skills
from recordfuse.udfs.wratio import best_match, ratio, wratio


def values(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dates(spark):
    table = {
        "January 2018": "2018-01", "Jan 2018": "2018-01", "01/2018": "2018-01", "1/2018": "2018-01", "2018-01": "2018-01", "2018": "2018-01", "Present": "present", "till date": "present", "": None,
        "garbage": None, "Sept 2020": "2020-09", "01/02/2023": "2023-01", "May": "1900-05", "13/2018": None, "2018-13": None, "March 3, 2019": "2019-03",
    }
    assert values(spark, dates.normalize_date, [*table, None]) == [*table.values(), None]


def test_date_pair_and_years(spark):
    df = spark.createDataFrame([("Jan 2020", "Jan 2018"), ("2020", "Present"), ("2019-01", None)], "s string, e string")
    got = df.select(dates.date_pair(F.col("s"), F.col("e")).alias("d")).select("d.*", dates.years_between(F.col("d.start"), F.col("d.end"), F.lit("2024-01-01").cast("date")).alias("y")).collect()
    assert [tuple(r) for r in got] == [("2018-01", "2020-01", 2.0), ("2020-01", "present", 4.0), ("2019-01", None, None)]


def test_name_keys(spark):
    table = {
        "Karl Weber Jr.": "karl_weber", "Quist Nora": "nora_quist", "  ": None, "O'Hara, Ann": "ann_hara_o", "Ida Falk Ph.D.": "d_falk_ida_ph", "Zoë Müller": "muller_zoe",
        "ハナ スズキ": "hana_suzuki",
    }
    got = values(spark, names.name_key, [*table, None])
    assert got[:6] == list(table.values())[:6] and got[7] is None
    assert got[6] and got[6].isascii()


def test_display_names(spark):
    table = {"KARL WEBER": "Karl Weber", "ann  o'hara": "Ann O'Hara", "McDowell Ray": "McDowell Ray"}
    assert values(spark, names.display_name, list(table)) == list(table.values())


def test_scripts(spark):
    table = {"Karl": "latin", "नीला": "indic_arabic", "سلمى": "indic_arabic", "ハナ": "cjk", "": "unknown", "Иван": "unknown", "Zoë": "latin"}
    assert values(spark, names.script_family, list(table)) == list(table.values())


def test_thresholds(spark):
    df = spark.createDataFrame([("latin", "latin"), ("latin", "indic_arabic"), ("cjk", "latin"), ("cjk", "cjk"), ("cjk", "indic_arabic"), ("unknown", "latin")], "a string, b string")
    assert [r[0] for r in df.select(names.name_threshold(F.col("a"), F.col("b"))).collect()] == [0.5, 0.45, 0.35, 0.35, 0.5, 0.5]


def test_phones(spark):
    table = {"(212) 555-0123": "+12125550123", "+91 98765 43210": "+919876543210", "1-212-555-0123 ext 5": "+12125550123", "555": None, "": None, "192.168.10.11": None, "+44 20 7946 0958": "+442079460958", "+41 44 668 18 00": "+41446681800", "+234 803 123 4567": "+2348031234567", "+999 123 456 789": None}
    got = values(spark, phones.normalize_phone, [*table, None])
    assert [g["e164"] for g in got] == [*table.values(), None]
    assert got[0]["confidence"] == 0.6 and got[1]["confidence"] == 1.0 and got[4]["note"] == got[-1]["note"] == "empty_input"


def test_script_of_a_whole_long_text(spark, tmp_path):
    rows = [(1, "ab " * 400_000 + "ハナス" * 500_000), (2, "ab"), (3, "नीला"), (4, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    assert dict(QUERIES["n7_script"](spark, str(tmp_path)).collect()) == {1: "cjk", 2: "latin", 3: "indic_arabic", 4: "unknown"}


def test_skills(spark):
    assert values(spark, skills.find_skills, ["Uses C++, node.js and apache spark; go!", "pythonic", "", None]) == [["C++", "Node.js", "Spark", "Go"], [], [], []]
    assert set(values(spark, skills.scan_skills, ["ruby on rails"])[0]) == {"Ruby", "Rails"}
    assert values(spark, skills.canonical_skill, ["k8s", " PySpark ", "kuberneties", "zk-snark", "", None]) == ["Kubernetes", "Spark", "Kubernetes", None, None, None]


def test_skills_by_shared_beginnings_are_those_of_every_key(spark):
    notes = [" and ".join(list(skills.KEYS)[i::7]) for i in range(7)] + ["rest api.js, node.js/c++x c++", "ruby on railsx", "REST-API rest api"]
    alone = lambda k, x: re.search(r"(?<![a-z0-9_])" + re.escape(k) + r"(?![a-z0-9_])", x.lower())
    want = [[n for n in skills.CANONICAL if any(v == n and alone(k, x) for k, v in skills.KEYS.items())] for x in notes]
    assert values(spark, skills.scan_skills, [*notes, "", None]) == [*want, [], []]
    longest = re.compile(r"(?<![a-z0-9_])(?:" + "|".join(map(re.escape, sorted(skills.KEYS, key=len, reverse=True))) + r")(?![a-z0-9_])")
    assert values(spark, skills.find_skills, notes) == [list(dict.fromkeys(skills.KEYS[k] for k in longest.findall(x.lower()))) for x in notes]


def test_lines_under_headings(spark):
    texts = ["tools\n a\n\n- b\nSkills:\nEducation\nc\nSKILLS\nd", "no headings, skills", "Tools:", "", None]
    assert values(spark, lambda c: lines_under(c, "skills", "tools"), texts) == [["d"], [], [], [], None]
    assert values(spark, lambda c: lines_under(c, "skills", "tools"), ["Tools:\n a\n\n- b"]) == [[" a", "- b"]]


def test_wratio():
    assert ratio("abc", "abc") == 100 and ratio("", "a") == 0
    assert wratio("machine learning", "learning machine") == 95
    assert best_match("kuberneties", ("Kubernetes", "Java"), 80) == "Kubernetes" and best_match("javascirpt", ("JavaScript",), 80) is None


def test_text_layers(spark):
    note = "Candidate ref: a#1\nSpoke with Ann Lee re: Engineer.\nMail b@x.org, a@x.org 212-555-0123"
    df = spark.createDataFrame([(note,)], "x string")
    c = F.col("x")
    row = df.select(text.note_name(c).alias("n"), text.note_name(c, compat=True).alias("q"), text.emails(c).alias("e"), text.phones(c).alias("p")).first()
    assert row.n.value == "Ann Lee" and row.q.value == "ref" and row.e == ["a@x.org", "b@x.org"] and row.p == ["212-555-0123"]


def test_links(spark):
    x = "see https://www.linkedin.com/in/ann-lee github.com/annl https://ann.github.io/cv. https://a.com/x) https://a.com/x"
    got = values(spark, text.links, [x])[0]
    assert (got.linkedin, got.github, got.portfolio, got.other) == ("https://linkedin.com/in/ann-lee", "https://github.com/annl", "https://ann.github.io/cv", ["https://a.com/x"])


def test_language(spark):
    assert values(spark, detect_language, ["the cat is in the house of the man", "der Hund ist nicht in dem Haus und die Katze", "kurz", "   "]) == ["en", "de", "en", "en"]


def test_skill_lists_are_matched_fuzzily(spark):
    got = values(spark, lambda c: skills.canonical_skills(F.split(c, ";")), ["js; kuberneties;zk-snark;Kubernetes;", "python;java", "zk-snark", None])
    assert got == [["JavaScript", "Kubernetes"], ["Python", "Java"], [], None]
    assert best_match("x" * 100_000, skills.CANONICAL, skills.FUZZY_LEAST) is None


def test_note_skills_take_misspelt_lines(spark):
    notes = ["Skills:\n- kuberneties\n* Python\nzk-snark\n\nSUMMARY\npostgresqll", "Skills:\npython", "kuberneties", ""]
    got = values(spark, note_skills, notes)
    assert [[(v.value, v.confidence) for v in x] for x in got] == [[("Python", 0.85), ("Kubernetes", 0.8)], [("Python", 0.85)], [], []]
    assert [[v.value for v in x] for x in values(spark, lambda c: note_skills(c, fuzzy=False), notes)] == [["Python"], ["Python"], [], []]
    rows = spark.createDataFrame([(i, str(i), x) for i, x in enumerate(notes)], "rec_idx long, source_id string, text string")
    assert {r.rec_idx: [v.value for v in r.skills_raw] for r in note_records(rows).collect()} == {0: ["Python", "Kubernetes"], 1: ["Python"], 2: []}


def test_location_is_that_of_its_sql(spark, tmp_path):
    """Words that end at letters of other scripts, and white space that SQL's pattern does not take."""
    texts = [
        "éParis, France", "Doez, Ouhe ciä", "Das, Ci über", "Lyon, Ilé", "Foo\x0bBar, Baz", "Rome,\x0bItaly", "Rome, Italy", "Rome, IT\r", "x\nOslo, Norway\nRome, IT", "May, June\nBern, CH",
        "Ab, Cd_", "_Ab, Cd", "Ab, Cd9", "Ab , CD", "A, B", "Rome,", "", None, "Rome, Italia sul mare blu qui", "ΩRome, Ita Ω",
    ]
    spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.location for r in QUERIES["x11_location"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(ORACLE_SQL["x11_location"]).fetchall())
    assert got[0] == "Paris, France" and got[1] == "Doez, Ouhe ci" and got[4] == "Bar, Baz" and got[5] is None


def _layers_before(note):
    """Layers of a note by the plain rules, as they are written down, each on its own."""
    def lines(x):
        return [s for s in (re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", v) for v in x.split("\n")) if s]

    label = re.search(r"(?im)^\s*(?:name|candidate)\s*[:\-]\s*(.+)$", note)
    if label and label[1].strip() and not re.match(r"ref\b", label[1].strip().lower()):
        return label[1].strip()
    for phrase in text.CONTEXTS:
        if m := re.search(rf"\b(?i:{phrase}) (?!(?i:ref)\b){text.NAME_WORDS}", note):
            return m[1]
    line = (lines(note) or [None])[0]
    if line and len(line.split()) <= 4 and not re.search("[0-9@]", line) and line[-1] not in ".?!":
        return line
    pairs = [m for m in re.findall(text.BIGRAM, note) if m.lower() not in text.BIGRAM_STOPS]
    return pairs[0] if pairs else None


def test_notes_by_the_plain_rules(spark):
    """Quick ways to e-mails, names and skills against the rules themselves."""
    notes = [
        "a@b.com_x@y.zz, @a@b.cc a@@b.de x.y+z@q-r.s.tt_u@v.ww", "a" * 50_000 + " " + "b" * 50_000 + "@c.org", "no mail 1", "\n \t\n  Ann Lee \nx", "\r\nBo Quist\r\n2", "SPOKE WITH Ann Lee. x 1", "i met with ref and Called Bo Zed 5.",
        "1.\nit was Full Stack and Ada Stone.", "Candidate: ref 5\ncalled Ada", "name - Ida Falk\n1", "12\n34", " \n", "uses go,java;c++c++ c#/sql_ k8s.js",
    ]
    rows = spark.createDataFrame([(i, str(i), x) for i, x in enumerate(notes)], "rec_idx long, source_id string, text string")
    got = {r.rec_idx: r for r in note_records(rows).collect()}
    for i, note in enumerate(notes):
        x = re.sub(r"\r\n?", "\n", note)
        mails = sorted(set(re.findall(text.EMAIL, x))) if len(x) < 1000 else ["b" * 50_000 + "@c.org"]
        name, known = _layers_before(x), [k for k in dict.fromkeys(skills.KEYS[m] for m in re.findall(skills._LEFT + "(?:" + "|".join(map(re.escape, sorted(skills.KEYS, key=len, reverse=True))) + ")" + skills._RIGHT, x.lower()))]
        assert (i in got) == bool(name or mails or known), note[:50]
        if i in got:
            assert [v.value for v in got[i].emails] == mails and (got[i].full_name and got[i].full_name.value) == name and [v.value for v in got[i].skills_raw] == known, note[:50]


def test_note_is_read_once(spark, tmp_path):
    """Python gets lists that are there already; what finds them in the text is not among its arguments again."""
    spark.createDataFrame([(1, "Ann Lee")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["s7_note_records"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    python = [line for line in plan.toString().split("\n") if "ArrowEvalPython" in line]
    assert len(python) == 1 and "text#" not in python[0]
