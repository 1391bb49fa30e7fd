import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql.types import StructType

from ripplegraph.llm import warc


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x"), (2, "http://b/", "<p>x"), (9, None, "<p>x"), (3, "u\r\nv", None), (4, "e", ""), (5, "long", "é" * 100_000), (5, "long", "é" * 100_000), (None, "n", "<p>x"), (None, "n", "alone"), (7, "http://r", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", warc.F.lit(1))
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for k, _, h in rows:
        by.setdefault(h or "", []).append(-1 if k is None else k)
    for x in got:
        if x.record_type == "response":
            raw, k = bytes(x.payload), -1 if x.page_id is None else x.page_id
            assert k == max(by[raw.decode()]) and x.refers_to is None and x.payload_bytes == len(raw)
            assert x.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        else:
            first = [y for y in got if y.record_type == "response" and y.page_id == x.refers_to and y.payload_digest == x.payload_digest]
            assert first and x.payload is None and x.payload_bytes == first[0].payload_bytes
    assert sorted((x.page_id, x.refers_to) for x in got if x.record_type == "revisit" and x.page_id) == [(1, 9), (2, 9), (3, 4)]
    # plain readers find whole records
    whole = b"".join(gzip.open(tmp_path / "w" / f).read() for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    assert whole.count(b"\r\nWARC-Record-ID: ") == len(rows)
    small = warc.read_warc(spark, path).where("record_type = 'revisit' and page_id in (1, 2)")
    assert {x.page_id for x in small.collect()} == {1, 2}
    assert "PushedFilters: [In(page_id" in small._jdf.queryExecution().toString() or small.count() == 2


def test_min_payload_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer"), (4, "d", "longer")], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/m", min_payload=3)
    assert {x.page_id: x.refers_to for x in warc.read_warc(spark, f"file://{tmp_path}/m").collect()} == {1: None, 2: None, 3: 4, 4: None}
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_pushed_filters_skip_records():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    r = warc.WarcReader("x", StructType.fromDDL(warc.FIELDS))
    left = list(r.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (1, 2)), GreaterThan(("page_id",), 0), StringContains(("url",), "a"), EqualTo(("payload_digest",), "X")]))
    assert [type(x) for x in left] == [StringContains, EqualTo] and len(r.tests) == 4
    head = {"page_id": 1, "record_type": "response", "payload_digest": None}
    assert r.wanted(head) and not r.wanted(head | {"page_id": None}) and not r.wanted(head | {"record_type": "revisit"}) and not r.wanted(head | {"payload_digest": "Y"})


def record(kind, ident, uri, block, *more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", "WARC-Date: 2024-05-0%dT00:00:00Z" % (ident % 9 + 1), *([f"WARC-Target-URI: {uri}"] if uri else []), *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def foreign(n):
    """Records as other writers make them: no index, no manifest, fields of this writer missing."""
    out = [record("warcinfo", 0, None, b"software: x\r\n", "Content-Type: application/warc-fields")]
    payloads = {}
    for k in range(1, n):
        body = (f"<p>page {k} " + "x" * (k * 37 % 9000)).encode() + (b"\r\n\r\nWARC/1.0\r\n" if k % 5 == 0 else b"")
        if k % 4 == 3:
            out.append(record("request", k, f"http://h/{k}", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "Content-Type: application/http; msgtype=request"))
        else:
            payloads[k] = body
            digest = [f"WARC-Payload-Digest: sha1:{warc.digest32(body)}"] if k % 2 else []
            out.append(record("response", k, f"http://h/{k}", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body, "Content-Type: application/http; msgtype=response", *digest))
    return out, payloads


def test_archives_of_other_writers(spark, tmp_path):
    records, payloads = foreign(200)
    for name, data in (("members.warc.gz", b"".join(map(gzip.compress, records))), ("whole.warc.gz", gzip.compress(b"".join(records))), ("plain.warc", b"".join(records))):
        folder = tmp_path / name.split(".")[0]
        folder.mkdir()
        (folder / name).write_bytes(data)
        (folder / "notes.txt").write_text("not an archive")
        for path in (folder, folder / name):
            for split in (warc.SPLIT_BYTES, 5000):
                df = warc.read_warc(spark, f"file://{path}", split_bytes=split)
                got = df.collect()
                assert sorted(x.record_id for x in got) == sorted(f"<urn:uuid:{k}>" for k in range(200)), (name, split)
                for x in got:
                    k = int(x.record_id[10:-1])
                    if k in payloads:
                        assert (bytes(x.payload), x.payload_bytes, x.payload_digest, x.url) == (payloads[k], len(payloads[k]), warc.digest32(payloads[k]), f"http://h/{k}")
                    assert x.page_id is None and x.record_type == ("warcinfo" if k == 0 else "request" if k % 4 == 3 else "response")
        assert df.where("record_type = 'response' and date >= '2024-05-05T00:00:00Z'").count() == sum(k % 9 >= 4 for k in payloads)
        assert [x.payload_bytes for x in df.where("url = 'http://h/17'").select("payload_bytes").collect()] == [len(payloads[17])]
        assert df.where(warc.F.col("url").startswith("http://h/19")).count() == 11
        assert df.where(f"payload_digest = '{warc.digest32(payloads[8])}'").count() == 1
    assert len(warc.WarcReader(f"file://{tmp_path}/members", StructType.fromDDL(warc.FIELDS), 5000).partitions()) > 5
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no WARC archive"):
        warc.read_warc(spark, f"file://{tmp_path}/none").count()


def test_unwanted_payloads_are_passed_over(tmp_path):
    """In a plain archive a payload that no predicate or column wants isn't read."""
    big = record("response", 1, "http://big", b"x" * 50_000_000)
    small = record("response", 2, "http://small", b"y")
    path = tmp_path / "a.warc"
    path.write_bytes(big + small)

    class Counted:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n):
            out = self.f.read(n)
            self.n += len(out)
            return out

        def seek(self, at):
            self.f.seek(at)

        def tell(self):
            return self.f.tell()

    for fields, tests in (("url string, payload binary", [("url", warc.EqualTo, "http://small")]), ("url string", [])):
        reader = warc.WarcReader(str(path), StructType.fromDDL(fields))
        reader.tests = tests
        with open(path, "rb") as f:
            counted = Counted(f)
            rows = list(reader.scanned(counted, warc.Part(str(path), 0, len(big) + len(small), False)))
        assert [r[0] for r in rows][-1] == "http://small" and counted.n < 4 * warc.STEP


def test_large_archive_splits_by_index(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}" * 200) for k in range(300)], "page_id long, url string, html string").repartition(2)
    warc.write_warc(pages, f"file://{tmp_path}/s")
    df = warc.read_warc(spark, f"file://{tmp_path}/s", split_bytes=4000)
    assert df.rdd.getNumPartitions() > 4 and df.select("page_id").distinct().count() == df.count() == 300
    assert df.where("page_id = 7 and record_type = 'response'").select("url", "date").collect()[0].url == "http://h/7"
    assert df.where("page_id is null").count() == 0
