import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import duckdb

from lumenlog.llm.common import scratch_path
from lumenlog.llm.warc import ORACLE, assemble, op6_warc, read_archives, records_of, warc_round_trip, write_archives


def brute(rows, least=0):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = Counter()
    for body, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        top = max(ids, key=lambda x: -1 if x is None else x)
        if len(body) < least:
            out.update((i, len(body), digest, "response", None) for i in ids)
        else:
            rest = list(ids)
            rest.remove(top)
            out[top, len(body), digest, "response", None] += 1
            out.update((i, len(body), digest, "revisit", top) for i in rest)
    return out


ROWS = [
    (1, "http://a.example/x", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b.example/\r\nX: y", None), (4, "", ""), (5, "u", "tail\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (6, "u", "é漢🙂\x00\n" * 2000), (7, "u", "x" * 3_000_000), (7, "u", "x" * 3_000_000), (8, "u", "tail\r\n\r\n"), (None, "u", "no id"), (None, "u", "<p>one</p>"), (9, "u", "\r\n\r\n"),
]


def test_round_trip_of_awkward_rows(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as row", "'z' as digest", "2 as size")
    for least in (0, 12):
        assert Counter(map(tuple, warc_round_trip(pages, scratch_path(spark, "t"), least).collect())) == brute(ROWS, least)
    assert warc_round_trip(pages.limit(0), scratch_path(spark, "t")).collect() == []


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = scratch_path(spark, "t")
    write_archives(pages, path)
    records = read_archives(spark, path)
    assert Counter(r.type for r in records.select("type").collect()) == {"request": 12, "metadata": 12, "response": 8, "revisit": 4}
    rows = assemble(records).collect()
    assert Counter(bytes(r.payload).decode() for r in rows if r.type == "response") == Counter({h or "" for _, _, h in ROWS})
    assert all(len(r.requests) == len(r.metadata) == 1 for r in rows)
    ids = {r.capture_id for r in rows if r.type == "response"}
    assert all(r.refers_to in ids for r in rows if r.type == "revisit")


def test_archives_with_a_member_for_each_record():
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    assert [b for _, b in records_of(gzip.compress(record) + gzip.compress(record))] == [b"a:b", b"a:b"]


def test_against_sql(spark, small):
    pages = f"{small}/pages.parquet"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{pages}'")
    result = con.execute(ORACLE)
    names = [d[0] for d in result.description]
    assert Counter(map(tuple, op6_warc(spark, small).select(*names).collect())) == Counter(result.fetchall())


def test_archives_by_payload_size(spark, monkeypatch):
    """Few captures an archive, several classes of size, equal payloads in one class, and an inflater that holds little."""
    from lumenlog.llm import warc

    monkeypatch.setattr(warc, "ARCHIVES", ((10, 2), (1000, 1), (None, 1)))
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert Counter(map(tuple, warc_round_trip(pages, scratch_path(spark, "t")).collect())) == brute(ROWS)
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 100000\r\n\r\n" + b"y" * 100_000 + b"\r\n\r\n"
    stream = warc._Bytes(gzip.compress(record) + gzip.compress(record) + b"\0" * 700, block=13)
    for _ in range(2):
        assert stream.head().startswith(b"WARC/1.0")
        assert stream.take(100_000) == b"y" * 100_000 and stream.take(4) == b"\r\n\r\n"
    assert stream.head() is None
