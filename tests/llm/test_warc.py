import gzip
import hashlib
import io

import duckdb
import pytest

from quillgraph.llm import warc as A
from quillgraph.llm.files import new_folder
from quillgraph.llm.tables import table


def plain(rows):
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    last = {}
    for p, b in raw:
        if len(b) >= 1000 and p is not None:
            last[b] = max(p, last.get(b, p))
    out = []
    for p, b in raw:
        to = last.get(b)
        revisit = to is not None and p != to
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", None), (2, None, ""), (3, "http://b/\r\nx: y", "é" * 499), (4, "u", "é" * 500), (5, "u", "é" * 500), (5, "u", "é" * 500), (None, "u", "é" * 500), (None, None, "n" * 1000), (None, None, "n" * 1000), (9, "long", "z\r\n\r\n" * 400_000), (10, "x", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 40)]


@pytest.mark.parametrize("roll", [1, 3000, 10**9])
def test_round_trip_and_edges(spark, roll):
    df = spark.createDataFrame([(*r, "k", 3) for r in ROWS], "page_id long, url string, html string, digest string, n int").repartition(2)
    got = A.archive_pages(df, new_folder(spark, "warc"), roll=roll).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(ROWS)
    assert A.archive_pages(df.limit(0), new_folder(spark, "warc")).count() == 0


def test_files(spark, sf):
    folder = new_folder(spark, "warc")
    pages = table(spark, sf, "pages")
    whole = A.write_archives(pages, f"{folder}/a").collect()
    done = A.normalise(spark.createDataFrame(whole), f"{folder}/b").collect()
    assert sum(r.records for r in done) == pages.count()
    plain_bytes = sorted(gzip.open(r.archive.removeprefix("file://")).read() for r in whole)
    assert plain_bytes == sorted(gzip.open(r.archive.removeprefix("file://")).read() for r in done)
    for r in done:
        raw, end = open(r.archive.removeprefix("file://"), "rb").read(), 0
        for line in open(r["index"].removeprefix("file://"), newline="\n"):
            offset, length, kind, name, uri = line.rstrip("\n").split("\t")
            fields, _ = A.parse(gzip.decompress(raw[int(offset) : int(offset) + int(length)]))
            assert (fields["warc-type"], fields["warc-record-id"], int(offset)) == (kind, name, end)
            end += int(length)
        assert end == len(raw)


def test_damaged_streams():
    rec = A.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False, 3)
    whole = gzip.compress(rec * 3)
    assert list(A.records_of(io.BytesIO(whole))) == [rec] * 3
    assert list(A.records_of(io.BytesIO(gzip.compress(rec[:50]) + gzip.compress(rec[50:] + rec)))) == [rec] * 2
    assert list(A.records_of(io.BytesIO(b""))) == []
    for bad in (whole[:-20], gzip.compress(rec[:-5]), gzip.compress(b"nothing\r\n\r\n")):
        with pytest.raises(ValueError):
            list(A.records_of(io.BytesIO(bad)))


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(con.execute(A.ORACLES["op7_warc"]).fetchall()) == sorted(tuple(r) for r in A.op7_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
