import gzip
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tessera.llm import warc
from tessera.llm.common import scratch

SCHEMA = "page_id long, url string, html string, payload string, revisit string, sha string"


def pages():
    rows = [(i, f"http://x.org/{i}", f"<p>{i % 40}</p>" * (i % 11), "a", "b", "c") for i in range(200)]
    rows += [(500 + i, "http://hot", "hot payload", "a", "b", "c") for i in range(90)] + [(900, None, None, "a", "b", "c"), (901, "u\r\nWARC-Type: evil", "", "a", "b", "c")]
    rows += [(None, "n", "hot payload", "a", "b", "c"), (None, "n", "only null ids", "a", "b", "c"), (None, "n", "only null ids", "a", "b", "c"), (589, "http://hot", "hot payload", "a", "b", "c")]
    return rows + [(950, "http://big", os.urandom(300_000).hex(), "a", "b", "c"), (951, "http://é", "é\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08", "a", "b", "c")]


def brute(rows, least=0):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[2] or "").encode()].append(r[0])
    out = Counter()
    for r in rows:
        body = (r[2] or "").encode()
        first = max((i for i in groups[body] if i is not None), default=None)
        of = first if len(groups[body]) > 1 and first is not None and r[0] != first and len(body) >= least else None
        out[(r[0], len(body), warc.digest(body), "response" if of is None else "revisit", of)] += 1
    return out


def read(spark, folder, **options):
    return warc.load(spark, folder, **options)


def columns(df):
    return df.select(F.col("page_id").cast("long"), F.col("payload_length").cast("long"), F.substring_index("payload_digest", ":", -1), "record_type", F.col("refers_to").cast("long"))


@pytest.fixture(scope="module")
def archive(spark):
    rows, folder = pages(), scratch(spark, "test-warc")
    made = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(4), folder)
    return rows, folder, made


@pytest.mark.parametrize("size", ["40000", "100000000"])
def test_round_trip(spark, archive, size):
    rows, folder, made = archive
    df = read(spark, folder, range=size)
    assert Counter(tuple(r) for r in columns(df).collect()) == brute(rows)
    assert made.agg(F.sum("records")).first()[0] == len(rows)
    bodies = Counter(bytes(r.payload) for r in df.where("record_type = 'response'").collect())
    assert set(bodies) == {(r[2] or "").encode() for r in rows}


def test_small_payloads_are_responses(spark):
    rows, folder = pages(), scratch(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, SCHEMA), folder, least=12)
    assert Counter(tuple(r) for r in columns(read(spark, folder)).collect()) == brute(rows, 12)


def test_predicates_are_pushed_down(spark, archive):
    rows, folder, _ = archive
    df = read(spark, folder, payload="false", verify="false").where("record_type = 'revisit' and page_id in ('500', '501') and content_length > 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "record_type" in plan and {r.page_id for r in df.collect()} == {"500", "501"}
    reader = warc.WarcReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("page_id",), ("500",)), GreaterThan(("content_length",), 1)]))
    assert [type(f) for f in rest] == [GreaterThan] and dict(reader.wanted) == {"warc-type": {"revisit"}, "warc-page-id": {"500"}}
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(got) == 1 and got[0][2] == "revisit"


def test_unwanted_payloads_are_not_inflated(archive, monkeypatch):
    _, folder, _ = archive
    reader = warc.WarcReader({"path": folder, "payload": "false", "verify": "false"})
    monkeypatch.setattr(warc.zlib, "crc32", lambda *_: pytest.fail("a payload was inflated"))
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == len(pages())


def test_files_are_plain_gzip_and_others_can_be_read(spark, archive):
    _, folder, _ = archive
    path, _ = warc.files.listed(folder, ".warc.gz")[0]
    with gzip.open(path) as f:
        assert f.read(10) == b"WARC/1.1\r\n"
    other = scratch(spark, "test-warc").removeprefix("file:")
    os.makedirs(other)
    with open(f"{other}/a.warc.gz", "wb") as f:
        for i in range(3):
            f.write(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: %d\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n" % i))
    assert sorted((r.page_id, bytes(r.payload)) for r in read(spark, other).collect()) == [(str(i), b"body") for i in range(3)]


def test_damage_is_an_error(spark, archive):
    _, folder, _ = archive
    path, _ = warc.files.listed(folder, ".warc.gz")[0]
    bad = scratch(spark, "test-warc").removeprefix("file:")
    os.makedirs(bad)
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(f"{bad}/a.warc.gz", "wb").write(data)
    reader = warc.WarcReader({"path": bad})
    with pytest.raises(Exception):
        [r for p in reader.partitions() for r in reader.read(p)]


def test_empty_table(spark):
    folder = scratch(spark, "test-warc")
    assert warc.write(spark.createDataFrame([], SCHEMA), folder).collect() == []
    assert read(spark, folder).collect() == []
