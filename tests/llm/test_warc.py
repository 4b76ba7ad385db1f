import gzip

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains
from pyspark.sql.types import StructType

from treeloom.llm import warc
from treeloom.llm.common import work_path

ROWS = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (0, "http://c/x y", "same"), (3, None, None), (4, "http://d/\r\nX: 1", ""), (5, "u", "é汉\r\n\r\nx" * 3),
    (6, "v", "z" * 300_000), (None, "w", "lonely"), (None, "w", "lonely"), (7, "w", "lonely"), (8, "q", "twice"), (8, "q", "twice"),
]


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        first = min(same) if same and len(b) >= least else None
        revisit = first is not None and i != first
        out.append((i, len(b), warc.base32_sha1(b), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def pages(spark):
    return spark.createDataFrame([(*r, "c", 1) for r in ROWS], "page_id long, url string, html string, digest string, first int").repartition(3)


def read(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    for least, most in ((0, 1 << 20), (0, 0), (6, 1 << 20)):
        path = work_path(spark, "t")
        warc.write_archive(pages(spark), path, min_payload_bytes=least, broadcast_rows=most)
        assert read(warc.read_archive(spark, path)) == brute(ROWS, least)
        full = warc.read_archive(spark, path, payload=True).where("record_type = 'response'").collect()
        assert sorted((r.page_id, bytes(r.payload).decode()) for r in full if r.page_id == 6) == [(6, "z" * 300_000)]
        assert all(warc.base32_sha1(bytes(r.payload)) == r.payload_digest for r in full)
        assert {r.target_uri for r in warc.read_archive(spark, path).collect() if r.page_id in (0, 4)} == {"http://c/x%20y", "http://d/%0D%0AX:%201"}


def test_pushed_predicates(spark):
    path = work_path(spark, "t")
    warc.write_archive(pages(spark), path)
    ids = lambda *p: sorted(r.page_id for r in warc.read_archive(spark, path, predicates=p).collect())
    assert ids(("record_type", "=", "revisit"), ("page_id", ">", 1)) == [2, 4]
    assert ids(("page_id", "in", [3, 5])) == [3, 5] and ids(("page_id", "<=", 0)) == [0]
    assert len(ids(("target_uri", "starts", "http://"))) == 4 and ids(("refers_to", "there", None), ("page_id", "<", 2)) == [1]
    with pytest.raises(Exception, match="no predicate"):
        ids(("payload", "=", "x"))


def test_one_dataframe_in_two_filters(spark):
    path = work_path(spark, "t")
    warc.write_archive(pages(spark), path)
    df = warc.read_archive(spark, path)
    both = df.where("record_type = 'response'").unionByName(df.where("record_type = 'revisit'"))
    assert both.where("refers_to IS NOT NULL").count() == 5 and both.count() == len(ROWS) == df.count()


def test_spark_filters_are_taken_or_given_back():
    schema = StructType.fromDDL(warc.SCHEMA)
    reader = warc.FilteringWarcReader(schema, {"path": "/nowhere"})
    refused = EqualTo(("payload",), b"x"), StringContains(("target_uri",), "x")
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), *refused, GreaterThan(("page_id",), 3)])) == list(refused)
    assert reader.wanted({"record_type": "response", "page_id": 4}) and not reader.wanted({"record_type": "response", "page_id": None})


def test_spark_pushes_filters_where_asked(spark):
    path = work_path(spark, "t")
    warc.write_archive(pages(spark), path)
    warc.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("warc").schema(warc.HEADER_COLUMNS).option("sparkFilters", "true").load(path).where("record_type = 'revisit' AND page_id > 1")
        assert sorted(r.page_id for r in df.collect()) == [2, 4]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_members_are_plain_gzip_and_foreign_files_are_read(spark, tmp_path):
    record = warc.record_bytes(9, "http://x/", b"body")
    data = warc.member(record)
    assert gzip.decompress(data) == record
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + data + gzip.compress(record))
    (tmp_path / "b.warc").write_bytes(record + warc.record_bytes(10, None, b"", 9))
    rows = warc.read_archive(spark, str(tmp_path), payload=True).collect()
    assert sorted((r.page_id, r.record_type, None if r.payload is None else bytes(r.payload)) for r in rows) == [(9, "response", b"body")] * 4 + [(10, "revisit", None)]


def test_empty_archive(spark):
    path = work_path(spark, "t")
    warc.write_archive(pages(spark).limit(0), path)
    assert warc.read_archive(spark, path).collect() == []


def test_payloads_are_verified(spark, tmp_path):
    record = warc.record_bytes(9, "http://x/", b"body" * 10)
    damaged = record.replace(b"bodybody", b"bodyBODY", 1)
    for name, data in (("a.warc", damaged), ("a.warc.gz", warc.member(damaged))):
        at = tmp_path / name.replace(".", "-")
        at.mkdir()
        (at / name).write_bytes(data)
        assert [r.page_id for r in warc.read_archive(spark, str(at)).collect()] == [9]
        with pytest.raises(Exception, match="payload_digest is"):
            warc.read_archive(spark, str(at), verify=True).collect()


def test_cut_archives_fail(spark, tmp_path):
    record = warc.record_bytes(9, "http://x/", b"body" * 10)
    head = record.index(b"\r\n\r\n")
    cases = [(record + record[: head - 5], "a.warc"), (record[:-20], "a.warc"), (warc.member(record) + warc.member(record)[:-30], "a.warc.gz")]
    for k, (data, name) in enumerate(cases):
        at = tmp_path / str(k)
        at.mkdir()
        (at / name).write_bytes(data)
        for kw in ({}, {"payload": True}):
            with pytest.raises(Exception, match="record"):
                warc.read_archive(spark, str(at), **kw).collect()
