"""Layout, linkage, fusion, projection and whole runs."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from recordfuse import fixtures
from recordfuse.operators import fusion, graph, layout, linkage, views
from recordfuse.plans import projection, snapshot
from recordfuse.plans.pipeline import run
from recordfuse.schema import completed, value
from recordfuse.sources import readers


def people(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rec_idx long, name string, email string, phone string")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(value(F.col(c), "direct_field", 1.0)))
    return completed(df, source_type=F.lit("ats_json"), source_id=F.col("rec_idx").cast("string"), full_name=value(F.col("name"), "direct_field", 1.0), emails=F.coalesce(one("email"), F.array()), phones=F.coalesce(one("phone"), F.array()))


#: Records and how many clusters they make; no two cases share a name or a contact.
CASES = [
    ([("Mira Kamath", "m@x.com", None), ("Mira Kamath", "m@x.com", None)], 1),
    ([("Nila Patel", "n@x.com", None), ("नीला पटेल", "N@x.com ", None)], 1),
    ([("Hana Suzuki", "h@x.com", None), ("ハナ スズキ", "h@x.com", None)], 1),
    ([("Odd Berg", None, "212-555-0123"), ("Lucia Ferrante", None, "(212) 555-0123")], 2),
    ([("Karl Weber Jr.", None, None), ("Karl Weber", None, None)], 1),
    ([("Nora Quist", None, None), ("Quist Nora", None, None)], 1),
    ([("Otto Brandt", "a@x.com", None), ("Otto Brandt", "b@x.com", None)], 2),
    ([(None, "c@x.com", None), ("Ann Lee", "c@x.com", None), (None, None, None)], 2),
]


def test_resolve(spark):
    rows = [r for case, _ in CASES for r in case]
    got = dict(linkage.resolve(people(spark, rows)).select("rec_idx", "root").collect())
    at, found = 0, []
    for case, _ in CASES:
        found.append(len({got[at + i] for i in range(len(case))}))
        at += len(case)
    assert found == [n for _, n in CASES] and len(set(got.values())) == sum(found)


def test_resolve_connects_what_all_pairs_do(spark):
    """Star links against every gated pair, over names and contacts that often meet: equal, alike, far and missing ones."""
    rng = random.Random(5)
    names = ("Ann Lee", "Anna Lee", "Lee Ann", "Bo Quist", "Zed Young", "安娜", None)
    for size in (0, 60, 90):
        rows = [(rng.choice(names), rng.choice(["a@x.com", "b@x.com", None, None, f"u{i}@x.com"]), rng.choice(["212-555-0123", None, None, f"212-555-{1000 + i}"])) for i in range(size)]
        found = people(spark, rows) if rows else people(spark, [(None, None, None)]).filter("rec_idx < 0")
        got = {r.rec_idx: r.root for r in linkage.resolve(found).collect()}
        pairs = [(r.a, r.b) for r in linkage.edges(linkage.record_keys(found)).collect()]
        root = {i: i for i in range(size)}

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        assert got == {i: top(i) for i in range(size)}


def test_components_of_a_long_chain(spark):
    n = 60
    nodes = spark.range(n + 5)
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = dict(graph.connected_components(nodes, edges).collect())
    assert all(got[i] == 0 for i in range(n)) and all(got[i] == i for i in range(n, n + 5))


def test_tagged_lines(spark):
    text = "Skills:\n- Python\n\tJava\n\nEXPERIENCE\nWorked."
    rows = layout.tag_lines(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("pos").collect()
    assert [(r.tag, r.indent_level, r.section) for r in rows] == [("heading", 0, "Skills"), ("bullet", 0, "Skills"), ("bullet", 2, "Skills"), ("blank", 0, "Skills"), ("heading", 0, "EXPERIENCE"), ("body", 0, "EXPERIENCE")]


RESUME = """Tilda Holm
tilda.holm@mail.example | +46 70 123 45 67
linkedin.com/in/tildaholm  github.com/tholm
Skills: Kotlin, Docker, Kafka
Experience
Data Engineer at Fjord Analytics | Mar 2020 - Present
Moved nightly loads to streams with Kafka.
Junior Developer at Lumen | Feb 2017 - Jan 2020
Wrote services in Kotlin.
Education
Master of Science in Statistics, Uppsala University, 2016
"""


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("inputs")
    (d / "r.csv").write_text("﻿Name,E-mail,mobile,employer,role,other\nKARL WEBER,karl@x.com,212-555-0123,Acme,Engineer,1\n,,,,,\n,,,,Only Title,\n")
    items = [{"person": {"display_name": "Karl Weber", "contact_email": "karl@x.com", "contact_phone": 5}, "employer": "Acme", "current_role": "Dev", "tagged_skills": "js, K8s, zzz", "most_recent_start": "January 2018", "most_recent_end": "Present"}, 5, {"person": [1]}, {"person": 7, "employer": "x"}]
    (d / "a.json").write_text(json.dumps(items))
    (d / "bad.json").write_text("{not json")
    (d / "notes").mkdir()
    (d / "notes" / "n.txt").write_bytes(b"Candidate ref: x#1\r\nSpoke with Ann Lee re: Engineer.\r\nStrong on: python\r\n")
    (d / "cv").mkdir()
    (d / "cv" / "p.txt").write_text(RESUME)
    (d / "cv" / "q.txt").write_text(" ")
    inputs = {"recruiter_csv": str(d / "r.csv"), "ats_json": str(d / "*.json"), "recruiter_notes": str(d / "notes"), "resume": str(d / "cv")}
    return run(spark, inputs, output=str(d / "out"), run_ts="t", as_of="2024-01-01"), str(d / "out"), inputs


def test_run(spark, result):
    r, folder, inputs = result
    rows = {x.full_name: x for x in r.candidates.collect()}
    karl, tilda = rows["Karl Weber"], rows["Tilda Holm"]
    assert not r.errors and len(rows) == 4 and "Ann Lee" in rows  # None: the title alone and the empty document
    assert karl.source_records_merged == ["recruiter_csv", "ats_json"] and karl.phones == ["+12125550123"] and [s.name for s in karl.skills] == ["JavaScript", "Kubernetes", "zzz"]
    assert [(j.company, j.title, j.start, j.end) for j in karl.experience] == [("Acme", "Engineer", None, None), ("Acme", "Dev", "2018-01", "present")] and karl.years_experience == 6.0
    assert tilda.years_experience == 6.7 and tilda.education[0].institution == "Uppsala University" and tilda.education[0].end_year == 2016 and tilda.headline == "Data Engineer at Fjord Analytics"
    assert all(0 <= x.overall_confidence <= 1 for x in rows.values())
    said = json.dumps({"sources": sorted(inputs.values()), "ts": "t"}, sort_keys=True)
    assert r.run_id == hashlib.sha256(said.encode()).hexdigest()[:12] and snapshot.make_run_id(["b", "a"], "x") == snapshot.make_run_id(["a", "b"], "x")
    assert snapshot.list_snapshots(spark, folder) == [r.run_id] and snapshot.read_snapshot(spark, folder, r.run_id).count() == r.candidates.count()
    assert snapshot.read_snapshot(spark, folder, "none") is None and snapshot.write_snapshot(r.candidates, folder, r.run_id, "t") is None


def test_sources_that_fail_do_not_end_a_run(spark, result, tmp_path):
    r, _, inputs = result
    assert r.sources_processed[2:] == ["recruiter_notes (1 records, 1/1 files)", "resume (2 records, 2/2 files)"]

    def broken(spark, path):
        raise KeyError(path)

    readers.register_source("github", broken)
    try:
        (tmp_path / "none").mkdir()
        given = {"recruiter_csv": "/nowhere/x.csv", "recruiter_notes": str(tmp_path / "none"), "resume": "/nowhere", "github": "x"}
        r = run(spark, given)
        assert r.candidates is None and "github: KeyError" in r.errors and r.errors[-1] == "no records"
        assert "recruiter_notes (unreadable: no files found)" in r.sources_skipped or "recruiter_notes (empty or missing: no files found)" in r.sources_skipped
        assert "resume (unreadable: directory missing)" in r.sources_skipped
    finally:
        del readers.REGISTRY["github"]
    for name in ("a.csv", "b.json", "c.md"):
        (tmp_path / name).write_text("x")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "n.txt").write_text("x")
    assert readers.list_inputs(spark, str(tmp_path)) == {"recruiter_csv": ["a.csv"], "ats_json": ["b.json"], "recruiter_notes": ["n.txt"], "resume": []}


def test_plug_ins(spark):
    """A recogniser and noun phrases beside the rules: the surest person, skills once each with the most that any layer was sure."""
    notes = spark.createDataFrame([(1, "n", "Strong on: python and zk proofs\nhello there"), (2, "m", "Candidate: Ann Lee\nnothing")], "rec_idx long, source_id string, text string")
    found = [("PERSON", "Bo Quist", 0.5), ("PERSON", " Cy Field ", 0.9), ("SKILL", "Python", 0.95), ("SKILL", "zk proofs", 0.6), ("SKILL", "low", 0.1)]
    listed = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("text"), F.lit(c).alias("score")) for a, b, c in found])
    plain = {r.rec_idx: r for r in readers.note_records(notes).collect()}
    readers.register_plugin("ner", lambda c: listed)
    readers.register_plugin("chunks", lambda c: F.array(F.lit("k8s"), F.lit("python"), F.lit("zk-snark")))
    readers.register_plugin("language", lambda c: F.lit("sv"))
    try:
        got = {r.rec_idx: r for r in readers.note_records(notes).collect()}
        cv = readers.resume_records(notes).orderBy("rec_idx").collect()
    finally:
        for name in ("ner", "chunks", "language"):
            readers.register_plugin(name, None)
    assert (got[1].full_name.value, got[1].full_name.method, got[1].full_name.confidence) == ("Cy Field", "ner_gliner", 0.9) and got[2].full_name.value == "Ann Lee"
    assert [(s.value, s.method, s.confidence) for s in got[1].skills_raw] == [("Python", "ner_gliner", 0.95), ("zk proofs", "ner_gliner", 0.6), ("Kubernetes", "ner_spacy", 0.4)]
    assert got[1].parse_errors == ["non_english_detected:sv"] and [c.full_name.value for c in cv] == ["Cy Field", "Ann Lee"]
    assert [s.value for s in plain[1].skills_raw] == ["Python"] and plain[2].full_name.value == "Ann Lee" and 2 in plain
    with pytest.raises(ValueError):
        readers.register_plugin("other", None)


def test_projection(spark, result):
    c = result[0].candidates
    how = projection.load({"fields": [{"path": "mail", "from": "emails[0]", "required": True}, {"path": "skills", "from": "skills[] name"}, {"path": "tel", "from": "phones[0]", "normalize": "E164"}, {"path": "none", "from": "a.b[1]"}], "include_confidence": True, "on_missing": "error"})
    good, bad = projection.project(c, how)
    assert good.count() == 2 and bad.count() == c.count() - 2 and bad.first().error.startswith("projection_failed")
    text = [json.loads(x.value) for x in projection.as_json(good.filter("mail = 'karl@x.com'"), "omit").collect()][0]
    assert text["tel"] == "+12125550123" and "none" not in text and text["mail_confidence"] == 0.95 and text["skills"][0] == "JavaScript"
    snapshot.write_projected(projection.as_json(good.select("mail", "tel")), result[1] + "/projected")
    assert sorted(json.loads(x.value)["mail"] for x in spark.read.text(result[1] + "/projected").collect()) == ["karl@x.com", "tilda.holm@mail.example"]
    with pytest.raises(ValueError):
        projection.load({"fields": ["name"]})


def test_views(result):
    c = result[0].candidates
    assert [r.full_name for r in views.search(c, " KUBER").collect()] == ["Karl Weber"]
    assert views.summary(c, 1, 4).first().n_candidates == c.count()


def test_people_of_one_file_are_dealt_and_fused_by_what_is_wanted(spark, tmp_path):
    spark.range(3000).selectExpr("id as c_custkey", "concat('S', id % 3) as c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    sizes = fixtures.people(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 1500
    found = fixtures.records(spark, str(tmp_path))
    whole = fusion.merge(found, fixtures.clusters(found), F.lit("2024-01-01").cast("date"), fuzzy=False)
    for only in (("candidate_id", "full_name", "emails", "overall_confidence"), ("years_experience", "candidate_id"), ("candidate_id", "source_records_merged", "phones", "skills", "provenance"), ("candidate_id", "links")):
        part = fusion.merge(found, fixtures.clusters(found), F.lit("2024-01-01").cast("date"), fuzzy=False, only=only)
        assert part.columns == list(only) and sorted(map(str, part.collect())) == sorted(map(str, whole.select(*only).collect()))
    kept = fusion.facts(found, fixtures.clusters(found), fuzzy=False, fields=("full_name", "emails"))
    assert {fusion.FIELDS[r.field] for r in kept.select("field").distinct().collect()} == {"full_name", "emails", "source"}


def test_stars_are_told_from_longer_trees(spark):
    edges = lambda *e: spark.createDataFrame(list(e), "u long, v long")
    assert graph._stars(edges((2, 1), (3, 1), (5, 4))) and graph._stars(edges((2, 1)).filter("u < 0"))
    assert not graph._stars(edges((2, 1), (3, 2))) and not graph._stars(edges((3, 1), (3, 2)))
