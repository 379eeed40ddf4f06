"""WARC archives: exact round trips, segments, revisits and broken archives."""

from __future__ import annotations

import gzip
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_chunked_framing():
    for n in (0, 1, 10, 25):
        body = bytes(range(n))
        assert warc.dechunked(warc.chunked(body, 10)) == body
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    for bad in (b"3\r\nabcd\r\n0\r\n\r\n", b"1\r\na\r\n0\r\n\r\nmore", b"1\r\na\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_records_parse_and_segments_join():
    html = b"x\r\n\r\nWARC/1.1\r\n" * 40
    made = warc.records("7", "http://a b/\r\nX: y", html, brute.sha1(html), None, "0/1", segment=100)
    parsed = list(warc.parse(b"".join(r + b"\r\n" for r in made)))
    kinds = [h["warc-type"] for h, _ in parsed]
    assert kinds == ["response"] + ["continuation"] * (len(kinds) - 1) and len(kinds) > 5
    assert [h["warc-segment-number"] for h, _ in parsed] == [str(i + 1) for i in range(len(parsed))]
    assert "\r" not in parsed[0][0]["warc-target-uri"] and len({h["warc-record-id"] for h, _ in parsed}) == len(parsed)
    whole = b"".join(b for _, b in parsed)
    assert int(parsed[-1][0]["warc-segment-total-length"]) == len(whole)
    assert warc.payload(parsed[0][0], whole) == html
    with pytest.raises(ValueError):
        warc.payload(parsed[0][0], warc.HTTP_HEAD + warc.chunked(html + b"!"))


def pages(spark, n: int = 60):
    rng = random.Random(4)
    same = "copy é " * 300
    rows = [(i, f"http://x/{i}", rng.choice([same, "short", None, "", "ü\x00\r\n\r\n" * rng.randint(1, 900), f"page {i} " * rng.randint(1, 5000)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def expected(rows):
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", -1))
    out = {}
    for i, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= warc.REVISIT_BYTES and last[h] > i
        out[i] = (len(body), brute.sha1(body), "revisit" if again else "response", last[h or ""] if again else None)
    return out


@pytest.mark.parametrize(("segment", "records"), [(65536, 1000), (700, 3)])
def test_round_trip(spark, tmp_path, segment, records):
    rows, df = pages(spark)
    path = str(tmp_path / "w")
    warc.write_archives(df.withColumns({"digest": F.lit("clash"), "again": F.lit(1), "first": F.lit(2)}), path, segment, records)
    got = warc.read_archives(spark, path).collect()
    want = expected(rows)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.data) == texts[r.page_id] for r in got if r.record_type == "response")
    assert any(r.record_type == "revisit" for r in got)


def test_a_lost_segment_is_an_error(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archives(spark.createDataFrame([(1, "u", "y" * 3000)], SCHEMA), str(path), segment=700)
    file = next(p for p in Path(path).glob("*.gz") if b"continuation" in gzip.decompress(p.read_bytes()))
    parts = gzip.decompress(file.read_bytes()).split(b"WARC/1.1")
    file.write_bytes(gzip.compress(b"WARC/1.1".join(parts[:2] + parts[3:])))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="segments"):
        warc.read_archives(spark, str(path)).collect()


@pytest.mark.parametrize("segment", [65536, 700])
def test_a_lost_response_is_an_error(spark, tmp_path, segment):
    rows = [(1, "u", "y" * 3000), (2, "u", "y" * 3000), (3, "u", "z")]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"), segment)
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 3
    (file,) = Path(tmp_path / "w").glob("*.gz")
    parts = gzip.decompress(file.read_bytes()).split(b"WARC/1.1")
    kept = [p for p in parts if b"\r\nPage-ID: 2\r\n" not in p and b"continuation" not in p]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.gz").write_bytes(gzip.compress(b"WARC/1.1".join(kept)))
    with pytest.raises(ValueError, match="refer"):
        warc.read_archives(spark, str(tmp_path / "x"))


def test_a_very_long_page(spark, tmp_path):
    page = "long é " * 700_000
    warc.write_archives(spark.createDataFrame([(1, "u", page)], SCHEMA), str(tmp_path / "w"))
    (row,) = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert bytes(row.data) == page.encode() and row.payload_bytes == len(page.encode())


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    long = "z" * 1500
    df = spark.createDataFrame([(None, None, long), (1, "u", long), (3, "u", long), (3, "u", long), (None, "u", None)], SCHEMA)
    warc.write_archives(df, str(tmp_path / "a"))
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()), key=str)
    assert got == sorted([(None, "response", None), (None, "response", None), (1, "revisit", 3), (3, "response", None), (3, "response", None)], key=str)
    warc.write_archives(df.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).isEmpty()


@pytest.mark.parametrize("which", ["sf", "large"])
def test_query_gives_what_its_sql_gives(spark, request, which):
    path = request.getfixturevalue(which)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/pages.parquet'")
    assert sorted(map(tuple, warc.op8_warc(spark, path).collect()), key=str) == sorted(con.execute(warc.ORACLE_SQL).fetchall(), key=str)


def test_one_gzip_member_a_record(spark, tmp_path):
    bodies = {i: f"page {i} ".encode() * (i + 1) for i in range(5)}
    made = [r for i, b in bodies.items() for r in warc.records(str(i), f"http://x/{i}", b, brute.sha1(b), None, f"0/{i}", segment=10_000)]
    (tmp_path / "members.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n") for r in made))
    got = {r.page_id: bytes(r.data) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == bodies
    with pytest.raises(ValueError):
        warc.inflated(b"")
    with pytest.raises(EOFError):
        warc.inflated(gzip.compress(b"one") + gzip.compress(b"two")[:-9])
