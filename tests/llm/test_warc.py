from __future__ import annotations

import hashlib
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from formicary.llm.shared import new_path
from formicary.llm.warc import BundleReader, fetch, page_of, parse_records, read_archive, round_trip, write_archive
from tests.llm.helpers import frame

SCHEMA = "page_id long, url string, html string"
BIG = "<p>é" + "x" * 1200
ROWS = [
    (1, "http://a.example/1", BIG), (2, "http://a.example/2\r\nX: y", BIG), (3, None, BIG), (4, "http://a.example/4", "small"), (5, "http://a.example/5", "small"), (6, "u", None), (7, "u", ""),
    (8, "http://long.example/", "y" * 700_000), (9, "w", "z" * 999), (10, "w", "z" * 999), (11, "w", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (None, "n", BIG), (12, "t", "q" * 1000), (12, "t", "q" * 1000),
]


def brute_force(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        revisit = len(payload) >= 1000 and same and (page is None or page < max(same))
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = frame(spark, ROWS, SCHEMA)
    got = round_trip(pages.withColumn("digest", pages.url))
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute_force(ROWS)


def test_one_record_is_read_by_its_place(spark):
    index = write_archive(frame(spark, ROWS, SCHEMA).repartition(3), new_path(spark, "warc"), bundle_bytes=300)
    rows = index.collect()
    assert len({r.bundle for r in rows}) > 1
    for r in rows:
        reader = BundleReader(r.bundle)
        record = reader.record(r.frame, r.offset, r.length)
        assert record.headers["warc-record-id"] == r.record_id
        reader.close()
    got = read_archive(index)
    places = ("page_id", "bundle", "frame", "offset", "length")
    assert sorted((tuple(r) for r in got.select(*places).collect()), key=repr) == sorted(((page_of(r.record_id), *r[1:]) for r in rows), key=repr)


def test_many_bundles_are_read_by_many_tasks(spark):
    rows = [(k, f"http://a.example/{k}", f"{k}" + "é" * 60_000) for k in range(64)]
    index = write_archive(frame(spark, rows, SCHEMA).repartition(8), new_path(spark, "warc"), bundle_bytes=1000)
    got = read_archive(index).withColumn("task", F.spark_partition_id()).select("bundle", "task").distinct().collect()
    assert len({r.bundle for r in got}) >= 8 and len({r.task for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_records_are_fetched_by_id(spark):
    index = write_archive(frame(spark, ROWS, SCHEMA), new_path(spark, "warc"))
    wanted = [r for r in index.collect() if page_of(r.record_id) in (3, 8, 12)]
    got = fetch(index, spark.createDataFrame([(r.record_id,) for r in wanted] + [("<urn:page:99:00>",)], "record_id string"))
    assert sorted((r.page_id, r.payload_bytes, bytes(r.payload)) for r in got.collect()) == [(3, len(BIG.encode()), BIG.encode()), (8, 700_000, b"y" * 700_000), (12, 1000, b"q" * 1000), (12, 1000, b"q" * 1000)]


def test_a_payload_of_most_rows_is_dealt_to_all_tasks(spark):
    """Where the join shuffles, too; empty and short payloads aren't joined at all."""
    rows = [(k, None, BIG if k % 3 else ("" if k % 2 else f"{k}" + "y" * 1000)) for k in range(600)]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = round_trip(frame(spark, rows, SCHEMA).repartition(3)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute_force(rows)
    in_bundle = Counter(r.bundle for r in got)
    assert len(in_bundle) == 4 and max(in_bundle.values()) < 200


def test_empty_table(spark):
    assert round_trip(frame(spark, [], SCHEMA)).collect() == []
