import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import queries, warc
from strandline.llm.work import new_path

PAGES = [(3, "http://a", "<p>one</p>"), (1, "http://b", "<p>one</p>"), (2, "http://c\r\nX: y", "é WARC/1.1\r\n\r\n"), (4, None, None), (5, "http://e", ""), (6, "http://f", "z" * 100_000), (7, "http://g", "own")]


def archive(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as payload", "3 as sha256")
    path = new_path(spark, "warc")
    warc.write(df, path, **options)
    return warc.read(spark, path)


def test_round_trip(spark):
    got = {r.key: r for r in archive(spark, PAGES).collect()}
    assert len(got) == len(PAGES)
    for key, _, html in PAGES:
        r, data = got[key], (html or "").encode()
        assert bytes(r.payload) == data and r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        record = bytes(r.record)
        assert record.startswith(r.header.encode()) and record.endswith(b"\r\n\r\n")
    assert (got[3].record_type, got[3].refers, got[1].record_type) == ("revisit", "1", "response")
    assert (got[5].record_type, got[5].refers) == ("revisit", "4")
    assert got[2].header.count("\r\n") == 8


def test_small_payloads_repeated_rows_and_null_keys(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (3, "u", "abcdef"), (None, "u", "abcdef"), (None, "u", "solo"), (None, "v", "solo")]
    got = archive(spark, rows, min_bytes=4).collect()
    assert sorted(((r.key, r.record_type) for r in got), key=str) == sorted([(1, "response"), (2, "response"), (3, "response"), (3, "response"), (None, "revisit"), (None, "response"), (None, "response")], key=str)
    assert sorted(bytes(r.payload) for r in got) == sorted(h.encode() for _, _, h in rows)
    assert archive(spark, []).count() == 0


def test_repeated_keys_with_different_payloads(spark):
    rows = [(1, "u", "Y"), (2, "u", "X"), (2, "u", "Y"), (3, "u", "X"), (3, "u", "Z"), (3, "u", "Z")]
    got = archive(spark, rows).collect()
    assert sorted((r.key, bytes(r.payload).decode(), r.record_type, r.refers) for r in got) == [
        (1, "Y", "response", ""),
        (2, "X", "response", ""),
        (2, "Y", "revisit", "1"),
        (3, "X", "revisit", "2"),
        (3, "Z", "response", ""),
        (3, "Z", "response", ""),
    ]


def test_files_hold_all_records(spark, tmp_path):
    a = archive(spark, PAGES)
    warc.write_files(a, str(tmp_path / "files"))
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "files").glob("*.txt")))
    assert len(data) == sum(len(bytes(r.record)) for r in a.collect())
    assert data.count(b"WARC-Record-ID: ") == len(PAGES)


def test_query_reads_payloads_and_fails_on_a_damaged_byte(spark):
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    assert queries.archived(spark, path).count() == len(PAGES)
    plan = queries.archived(spark, path)._jdf.queryExecution().toString()
    assert "payload:binary" in plan and "raise_error" in plan
    stored = spark.read.parquet(f"{path}/payloads")
    damaged = stored.withColumn("payload", F.when(F.octet_length("payload") == 100_000, F.encode(F.concat(F.lit("y"), F.repeat(F.lit("z"), 99_999)), "UTF-8")).otherwise(F.col("payload")))
    rows = damaged.collect()
    spark.createDataFrame(rows, stored.schema).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="payload of record 6 is damaged"):
        queries.archived(spark, path).collect()
