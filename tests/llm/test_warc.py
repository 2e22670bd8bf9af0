import base64
import hashlib
import struct

import duckdb
import pytest
import zstandard
from llmcases import SMALL

from dealflow.llm import oracle, queries, warc

PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, None, "<p>one</p>"),
    (3, None, "<p>one</p>"),
    (4, "http://a/4", None),
    (5, "http://a/5", ""),
    (6, "bad\r\naddress", "x\r\n\r\nWARC/1.1\r\n\r\n" * 50),
    (7, "http://a/7", "ü" * 300_000),
    (None, "http://a/n", "<p>one</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "x", 1) for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, rows int")


def test_round_trip(spark, pages):
    got = warc.read(warc.archived(pages)).collect()
    assert len(got) == len(PAGES)
    html = {(p[0], (p[2] or "").encode()) for p in PAGES}
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload)) in html and r.refers_to is None
            assert r.payload_bytes == len(r.payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
        else:
            assert r.payload is None
    found = sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit")
    assert found == [(2, 1), (3, 1), (3, 1), (5, 4)]


def test_least_bytes(spark, pages):
    got = warc.read(warc.archived(pages, settings=warc.Settings(least_bytes=5)))
    assert got.filter("record_type = 'revisit'").count() == 3


def test_empty(spark, pages):
    assert warc.read(warc.archived(pages.limit(0))).count() == 0


def test_dictionary_leads_and_records_stand_alone():
    settings = warc.Settings(dictionary_bytes=2048)
    records = [f"record {i} with common words and number {i * i}".encode() * 3 for i in range(400)]
    frames = list(warc.archive(records, settings))
    magic, size = struct.unpack("<II", frames[0][:8])
    assert magic == 0x184D2A5D and size == len(frames[0]) - 8
    known = zstandard.ZstdCompressionDict(frames[0][8:])
    for i in (0, 17, 399):
        assert zstandard.ZstdDecompressor(dict_data=known).decompress(frames[i + 1]) == records[i]
    assert sum(map(len, frames[1:])) < sum(len(zstandard.compress(r)) for r in records)


def test_too_few_records_need_no_dictionary():
    (frame,) = warc.archive([b"one"], warc.Settings())
    assert zstandard.decompress(frame) == b"one"


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    result = con.execute(oracle.SQL["op1_warc"])
    names = [d[0] for d in result.description]
    got = queries.QUERIES["op1_warc"](spark, SMALL).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())
