import gzip
import hashlib
import io
import os
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalquarry.llm import warc
from evalquarry.llm.shared import fresh_path, saved


class Trickle(io.BytesIO):
    """Gives few bytes at a time, so that members and headers are cut anywhere."""

    def read(self, n=-1):
        return super().read(min(n, 7))


def test_records_come_back_from_any_cuts():
    payloads = [b"", b"x" * 10, os.urandom(70000), "é漢".encode() * 500]
    data = b"".join(warc.record(str(i), f"http://a/{i}", p, None) for i, p in enumerate(payloads)) + warc.record("9", None, payloads[1], "1")
    for stream in (Trickle(data), io.BytesIO(data)):
        got = list(warc.read(stream))
        assert [r.http()[1] for r in got] == [*payloads, b""]
        assert got[-1].headers["warc-type"] == "revisit"
        assert gzip.decompress(data[got[2].position : got[3].position]).startswith(b"WARC/1.1\r\n")


def test_damage_is_an_error():
    good = warc.record("1", "http://a", b"payload" * 100, None)
    with pytest.raises(warc.Damaged):
        list(warc.read(io.BytesIO(good[:-5])))
    with pytest.raises(warc.Damaged):
        list(warc.read(io.BytesIO(good + b"junk that is no member")))
    with pytest.raises(warc.Damaged):
        list(warc.read(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcdefgh\r\n\r\n"))))
    bent = gzip.decompress(good).replace(b"payloadpayload", b"PAYLOADpayload", 1)
    head, body = next(warc.read(io.BytesIO(gzip.compress(bent)))).http()
    assert warc.digest(body) != warc.digest(b"payload" * 100)
    assert zlib.crc32(good)


def rows(spark, pages):
    archives = saved(warc.write_archives(pages, fresh_path(spark, "warc")), "archives")
    return warc.read_archives(spark, archives).collect()


def test_pages_come_back(spark):
    long, short = "<p>é</p>" * 200, "<p>x</p>"
    data = [(1, "http://a/1", long), (5, "http://a/5\r\nX: y", long), (3, None, long), (2, "u", short), (4, "u", short), (6, "u", None), (7, "", ""), (8, "u", "z" * 999), (9, "u", "z" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (None, "u", long), (11, "u", "y" * 1000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("id", F.lit(0)).withColumn("same", F.lit("x")).withColumn("refers_to", F.lit(5))
    got = rows(spark, pages)
    revisits = {1: 5, 3: 5, 10: 11}
    want = Counter()
    for i, _, html in data:
        raw = (html or "").encode()
        want[(str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if i in revisits else "response", str(revisits[i]) if i in revisits else None)] += 1
    assert Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.digest_ok for r in got)
    texts = {str(i): (h or "").encode() for i, _, h in data}
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload) == texts[r.record_id] for r in got)


def test_no_pages(spark):
    assert rows(spark, spark.createDataFrame([], "page_id long, url string, html string")) == []


def test_each_archive_has_its_own_task(spark):
    folder, n = fresh_path(spark, "warc"), 5
    some = [warc.writer(folder)(iter([pa.RecordBatch.from_pydict({"id": [str(i)], "url": ["u"], "html": ["x" * 9], "refers_to": [None]})])) for i in range(n)]
    archives = spark.createDataFrame([(next(s)["path"][0].as_py(),) for s in some], "path string")
    read = warc.read_archives(spark, archives)
    assert read.rdd.getNumPartitions() == n
    at = read.select("path", F.spark_partition_id().alias("part")).distinct().collect()
    assert len(at) == len({r.path for r in at}) == len({r.part for r in at}) == n


@pytest.mark.parametrize("what", ["payload", "length", "block"])
def test_a_bent_record_is_reported(spark, tmp_path, what):
    good = gzip.decompress(warc.record("1", "http://a", b"payload" * 100, None))
    bent = {
        "payload": good.replace(b"payloadpayload", b"PAYLOADpayload", 1),
        "length": good.replace(b"utf-8\r\nContent-Length: 700", b"utf-8\r\nContent-Length: 701", 1),
        "block": good.replace(b"HTTP/1.1 200 OK", b"HTTP/1.1 200 KO", 1),
    }[what]
    assert bent != good
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(bent) + warc.record("2", None, b"x", None))
    records = warc.read_archives(spark, spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string"))
    assert {r.record_id: r.digest_ok for r in records.collect()} == {"1": False, "2": True}
    if what == "payload":
        assert records.filter("record_id = '1'").first().payload_digest == hashlib.sha1(b"PAYLOAD" + b"payload" * 99).hexdigest()
    with pytest.raises(Exception, match="isn't what its digests say"):
        warc.checked(records).collect()


def test_a_very_long_page(spark):
    html = "<p>é</p>" * 500_000
    got = rows(spark, spark.createDataFrame([(1, "u", html), (2, "u", html)], "page_id long, url string, html string"))
    assert {r.record_id: (r.record_type, r.payload_bytes) for r in got} == {"1": ("revisit", 4_500_000), "2": ("response", 4_500_000)}
    assert bytes(next(r.payload for r in got if r.payload is not None)) == html.encode()


def test_names_without_a_scheme_and_local_names_open():
    assert warc.opened("/a/b")[1] == "/a/b"
    assert warc.opened("file:///a/b")[1] == "/a/b"
