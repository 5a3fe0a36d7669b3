import base64
import hashlib

from helpers import oracle, same_rows
from pyspark.sql import functions as F

from giftrisk.llm import warc as W
from giftrisk.llm.common import scratch_path

PAGES = [(4, "http://a/x y", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (5, "http://c\r\nd", ""),
         (6, "http://é", "<p>ü \U0001F600\r\n\r\nWARC/1.1</p>"), (9, "http://big", "<b>" + "x" * 300_000), (2, "http://b", "<p>one</p>"),
         (None, "http://n", "<p>one</p>"), (None, "http://n", "alone")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, offset long, digest string")


def test_round_trip(spark):
    df = pages(spark)
    folder = scratch_path(spark, "warc")
    index = W.write(df, folder)
    got = W.read(index, folder).collect()
    assert len(got) == len(PAGES)
    for r in got:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest and len(r.payload) == r.payload_bytes
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got)
    assert kinds == sorted([("4", "revisit", "2"), ("2", "response", "None"), ("2", "response", "None"), ("3", "response", "None"),
                            ("5", "revisit", "3"), ("6", "response", "None"), ("9", "response", "None"),
                            ("None", "revisit", "2"), ("None", "response", "None")])
    part = W.read(index.where("page_id = 6"), folder).collect()
    assert [r.payload.decode() for r in part] == [PAGES[4][2]]


def test_matches_sql(spark):
    df = pages(spark, [r for r in PAGES if r[0] is not None])
    folder = scratch_path(spark, "warc")
    got = W.read(W.write(df, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert same_rows(got.toPandas(), oracle(W.SQL, pages=df.select("page_id", "url", "html")))


def test_ranges_are_coalesced():
    gap, top = W.GAP_BYTES, W.RANGE_BYTES
    assert W.ranges([(0, 10), (10, 5), (15 + gap, 5), (21 + 2 * gap, 9)]) == [(0, 3, 0, 20 + gap), (3, 4, 21 + 2 * gap, 9)]
    assert len(W.ranges([(0, top), (top, 1)])) == 2


def test_archives_rotate_and_empty_table(spark, monkeypatch):
    folder = scratch_path(spark, "warc")
    assert W.read(W.write(pages(spark).limit(0), folder), folder).count() == 0
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 1)
    folder = scratch_path(spark, "warc")
    index = W.write(pages(spark), folder)
    assert W.read(index, folder).count() == len(PAGES)


def test_archives_are_read_back_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(W, "RANGE_BYTES", 20_000)
    folder = scratch_path(spark, "warc")
    index = W.write(pages(spark, [(i, f"http://a/{i}", " ".join(str(hash((i, j))) for j in range(300))) for i in range(200)]), folder)
    got = W.read(index, folder)
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 200
    monkeypatch.setattr(W, "TASK_BYTES", 10_000)
    many = W.read(index, folder)
    assert many.rdd.getNumPartitions() == -(-index.agg(F.sum("length")).first()[0] // 10_000)
    assert sorted(r.page_id for r in many.collect()) == list(range(200))
