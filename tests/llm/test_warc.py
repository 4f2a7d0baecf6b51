"""Archives: round trips, dictionaries, repeats, and files that a lost try leaves behind."""

import hashlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from recordfuse.llm import queries, warc

R = random.Random(5)
WORDS = ["".join(R.choice("abcdeilnorst") for _ in range(R.randint(2, 8))) for _ in range(400)]
prose = lambda n, r=R: " ".join(r.choice(WORDS) for _ in range(n))
one = lambda i, text: warc.record(7, i, i, "u", text.encode(), "d", len(text.encode()))

PAGES = [(3, "u", "x" * 200), (1, None, "x" * 200), (2, "v\r\nw", "x" * 200), (4, "a", "short"), (5, "b", "short"), (6, "c", None), (7, "d", "é" * 5000), (8, "e", "y" * 100), (8, "e", "y" * 100), (None, "n", "x" * 200)]
PAGES += [(None, "n", "z" * 300), (None, "n", "z" * 300), (9, "f", "w" * 99), (10, "f", "w" * 99), (11, "", ""), (12, "g", "long " * 400_000)]


def brute(pages):
    """(page_id, bytes, digest, record_type, refers_to) in plain Python; of repeats the smallest id is the response."""
    out, seen = [], {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (h or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        first = seen.setdefault(digest, (i,)) if len(raw) >= 100 else None
        new = first is None or (digest, "said") not in seen
        if first is not None:
            seen[digest, "said"] = True
        out.append((i, len(raw), digest, "response" if new else "revisit", None if new else first[0]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("ROW", F.lit(1))


@pytest.mark.parametrize("most", [warc.MOST_SENT, 0])
def test_round_trip(spark, table, most, monkeypatch):
    monkeypatch.setattr(warc, "MOST_SENT", most)
    assert sorted((tuple(r) for r in warc.round_trip(table).collect()), key=str) == brute(PAGES)
    assert warc.round_trip(table.limit(0)).count() == 0


def test_only_what_is_in_the_list_is_read_and_record_ids_are_unique(spark, table, tmp_path):
    folder = str(tmp_path / "archives")
    listed = warc.write(table, folder).collect()
    shutil.copy(f"{folder}/{listed[0]['name']}", f"{folder}/part-000000-00000-left-behind.warc.zst")
    got = warc.read(spark, folder).collect()
    assert len(got) == len(PAGES) == len({r.record_id for r in got}) == sum(r["records"] for r in listed)
    assert {(r.page_id, bytes(r.payload).decode()) for r in got if r.payload is not None} <= {(i, h or "") for i, _, h in PAGES}
    assert {r.url for r in got} == {"u", None, "v%0D%0Aw", "a", "b", "c", "d", "e", "n", "f", "", "g"}


def test_query_over_whole_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.op3_warc(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)


@pytest.mark.parametrize("number, words", [(600, 200), (250, 16_000), (40, 900), (40, 60), (3, 50), (1, 20_000), (1, 1), (40, 0)])
def test_every_archive_starts_with_its_dictionary(number, words):
    """Many records, few long ones, small archives, a single record and records without content."""
    import zstandard

    r = random.Random(number)
    records = [one(i, prose(words, r)) for i in range(number)]
    data = warc.archive(records)
    size = int.from_bytes(data[4:8], "little")
    assert data[:4] == b"\x5d\x2a\x4d\x18" and 256 <= size <= warc.DICTIONARY_BYTES and zstandard.ZstdCompressionDict(data[8 : 8 + size]).dict_id()
    assert list(warc.records_of(data)) == records
    found = warc.pieces(records)
    places = [(records.index(x), x.find(p)) for p in found[:: max(1, len(found) // 50)] for x in records if p in x]
    assert len(found) >= min(300, sum(-(-len(x) // warc.PIECE_BYTES) for x in records)) and (words < 16_000 or max(at for _, at in places) > 16_384)
