import base64
import hashlib
import random
import uuid

import pytest
from terrafold.llm import warc
from terrafold.session import shared_folder

PAGES = "page_id long, url string, html string, id string, key string, payload string, records string, header string"


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "i", "k", "p", "r", "h") for r in rows], PAGES)


def wanted(rows, least=0):
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        ids = [x[0] for x in rows if (x[2] or "") == (html or "") and x[0] is not None]
        first = min(ids, default=None)
        again = len(b) >= least and i != first
        out.append((-1 if i is None else i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [
    (5, "http://a/1", "<p>é東</p>"), (3, "http://a/2", "<p>é東</p>"), (9, None, "<p>é東</p>"), (1, "u", None), (2, "u", ""), (7, "x\r\nWARC-Type: conversion", "long " * 200_000),
    (3, "http://a/2", "<p>é東</p>"), (None, "n", "<p>é東</p>"), (None, "n", "only without id"), (-4, "m", "WARC/1.1\r\n\r\nWARC-Type: none\r\n\r\n"),
]


@pytest.mark.parametrize("least", [0, 1, 10])
def test_pages_come_back(spark, least):
    assert got(warc.archive_pages(pages(spark, ROWS), least)) == wanted(ROWS, least)


def test_a_payload_of_many_records_and_an_empty_table(spark, monkeypatch):
    rows = ROWS + [(100 + k, "u", "copy") for k in range(300)]
    monkeypatch.setattr(warc, "REFERENCES", 20)
    assert got(warc.archive_pages(pages(spark, rows))) == wanted(rows)
    assert got(warc.archive_pages(pages(spark, []))) == []


def test_payloads_are_stored_once(spark, folder):
    warc.write_archive(pages(spark, ROWS), folder)
    stored = [bytes(r.payload) for r in spark.read.parquet(f"{folder}/payloads").collect()]
    assert sorted(stored) == sorted({(r[2] or "").encode() for r in ROWS})
    assert spark.read.parquet(f"{folder}/headers").count() == len(ROWS)


def test_raw_records_come_back_byte_by_byte(spark, folder):
    rng = random.Random(2)
    body = [bytes(rng.randrange(256) for _ in range(200)) for _ in range(4)] + [b"", b"\r\n\r\n", b"\r\n\r\nx"]
    head = [b"WARC/1.0\r\nWARC-Type: response\r\nX-Folded: a\r\n  b\r\n\r\n", b"warc-type:\tmetadata\r\nX: \xff\xfe\r\n\r\n", b"\r\n\r\n"]
    raw = [h + b for h in head for b in body] + [b"no empty line", b"", None]
    df = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(raw)], "record_id long, record binary")
    back = warc.raw_record(warc.read_archive(spark, warc.archive_records(df, folder)))
    assert {r.id: bytes(r.record) for r in back.collect()} == {k: r or b"" for k, r in enumerate(raw)}
    spark.sql(f"DROP TABLE {warc._name(folder)}")  # as in a session that hasn't written it
    assert warc.read_archive(spark, folder).count() == len(raw)


def test_a_payload_that_is_not_its_digests_is_an_error(spark, folder):
    rows = spark.sql("SELECT 1L AS id, unhex(sha2('other', 256)) AS key, cast('text' AS binary) AS payload, cast('' AS binary) AS header, 1L AS records")
    warc._store_payloads(rows, folder)
    warc._store_headers(rows, folder)
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, folder).collect()


def test_payloads_that_share_a_digest_must_be_equal(spark, folder):
    rows = spark.sql("SELECT id, unhex(sha2('x', 256)) AS key, cast(cast(id AS string) AS binary) AS payload FROM range(2)")
    with pytest.raises(Exception, match="different payloads"):
        warc._store_payloads(rows, folder)


def test_plan_moves_headers_to_the_payloads(spark, folder):
    warc.write_archive(pages(spark, ROWS), folder)
    plan = warc.read_archive(spark, folder)._jdf.queryExecution().executedPlan().toString()
    few = plan.split("ShuffledHashJoin")[1].split("BroadcastHashJoin")[0].split("SortMergeJoin")[0]
    assert few.count("Exchange") == 1 and "Bucketed: true" in few
