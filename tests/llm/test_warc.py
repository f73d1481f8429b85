from __future__ import annotations

import gzip
import hashlib
import io
import random

import duckdb
import pyarrow.fs
from pyspark.sql import functions as F

from brightwater.llm import warc
from brightwater.llm.queries import ORACLE_SQL, QUERIES


def brute(rows):
    first = {}
    for page_id, html in rows:
        if page_id is not None and len((html or "").encode()) >= 100:
            first[html] = min(page_id, first.get(html, page_id))
    out = []
    for page_id, html in rows:
        payload = (html or "").encode()
        least = first.get(html) if len(payload) >= 100 else None
        revisit = least is not None and page_id != least
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force_and_sql_on_whole_table(spark):
    data = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html").collect()]
    got = result(QUERIES["op3_warc"](spark, data))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{data}/pages.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op3_warc"]).fetchall(), key=str) == got


def test_odd_rows(spark):
    draw = random.Random(1)
    nasty = ["".join(draw.choices(["\r", "\n", "\r\n\r\n", "WARC/1.1", "é", "x", "\0", "\U0001f600"], k=draw.randint(0, 80))) for _ in range(60)]
    long = "<p>" * 400_000
    rows = [(i, html) for i, html in enumerate(nasty)] + [(i + 100, html) for i, html in enumerate(nasty)]
    rows += [(300, None), (301, ""), (302, "a" * 99), (303, "a" * 99), (304, "b" * 100), (305, "b" * 100), (304, "b" * 100)]
    rows += [(None, "b" * 100), (None, "c" * 120), (None, "c" * 120), (400, long), (399, long), (398, long + "x"), (304, "other " * 30)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").select("*", F.lit(1).alias("payload"), F.lit(2).alias("first"))
    assert result(warc.archive_pages(pages.repartition(3), per_file=7)) == brute(rows)


def test_one_payload_holds_a_third_of_the_table(spark):
    draw = random.Random(3)
    rows = [(i, "hot page " * 20 if i % 3 == 0 else f"page {draw.randrange(1500)} " * 20) for i in range(4_000)]
    draw.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id bigint, html string").repartition(6)
    records = warc.with_record_types(pages).collect()
    assert result(warc.archive_pages(pages)) == brute(rows)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in records)


def test_empty_table(spark):
    assert result(warc.archive_pages(spark.createDataFrame([], "page_id bigint, html string"))) == []


def test_members_are_whole_records_and_the_index_finds_them(spark, tmp_path):
    rows = [(i, f"page {i} \r\n\r\n " * (i % 9)) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").repartition(2)
    warc.write_archives(warc.with_record_types(pages), f"file://{tmp_path}/whole")
    index = warc.normalise(spark, f"file://{tmp_path}/whole", f"file://{tmp_path}/records").collect()
    assert len(index) == 50
    before = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "whole").glob("*.gz")))
    archives = {r["archive"] for r in index}
    after = 0
    for archive in archives:
        data = pyarrow.fs.FileSystem.from_uri(archive)[1]
        data = open(data, "rb").read()
        mine = sorted((r["offset"], r["length"], r["record_id"]) for r in index if r["archive"] == archive)
        assert [o for o, _, _ in mine] == [sum(n for _, n, _ in mine[:k]) for k in range(len(mine))]
        assert sum(n for _, n, _ in mine) == len(data)
        for offset, length, record_id in mine:
            record = gzip.decompress(data[offset : offset + length])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record_id.encode() in record
            assert record in before
        after += len(gzip.decompress(data))
    assert after == len(before)


def test_any_split_into_members_reads_the_same():
    records = [b"WARC/1.0\r\nContent-Length: %d\r\nWARC-Record-ID: <%d>\r\n\r\n%s\r\n\r\n" % (n, n, b"\r\n\r\nx" * (n // 5)) for n in (0, 5, 500, 100_000)]
    whole = b"".join(records)
    draw = random.Random(2)
    for _ in range(20):
        cuts = [0, *sorted(draw.sample(range(len(whole)), 3)), len(whole)]
        packed = b"".join(gzip.compress(whole[a:b]) for a, b in zip(cuts, cuts[1:]))
        assert [r for _, r in warc.records_of(io.BytesIO(packed))] == records
