"""A stream's result equals its batch twin's."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.streaming import streams

START = datetime(2024, 1, 1)


@pytest.fixture
def wave_dir(spark, tmp_path):
    rows = [(k % 3, START + timedelta(hours=5 * k), float(k % 7), float((k * 37) % 360)) for k in range(60)] + [(0, START + timedelta(days=400), 0.0, 0.0)]
    spark.createDataFrame(rows, "cell_id long, t timestamp, hs double, dir double").coalesce(1).write.parquet(str(tmp_path / "waves"))
    return str(tmp_path / "waves")


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_daily_waves(spark, wave_dir, tmp_path):
    got = run(spark, streams.daily_waves(stream(spark, wave_dir)), "daily", tmp_path).select("cell_id", "day", "n", F.round("hs", 9))
    want = spark.read.parquet(wave_dir).where("t < '2025-01-01'").groupBy("cell_id", F.to_date("t")).agg(F.count("*"), F.round(F.avg("hs"), 9))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_storm_sessions(spark, wave_dir, tmp_path):
    limits = spark.createDataFrame([(0, 4.0), (1, 4.0), (2, 4.0)], "cell_id long, threshold double")
    w = stream(spark, wave_dir)
    got = run(spark, streams.storm_sessions(w, limits), "storms", tmp_path).collect()
    assert got and all(r.hs_max > 4 and r.end > r.start for r in got)
    n = spark.read.parquet(wave_dir).where("hs > 4 and t < '2025-01-01'").count()
    assert sum(r.n for r in got) == n


def test_images_once_and_longest(spark, tmp_path):
    rows = [("L8", k % 5, START + timedelta(days=k % 5), 0.1, float(k)) for k in range(20)] + [("S2", 99, START + timedelta(days=300), 0.99, 1.0)]
    spark.createDataFrame(rows, "sat string, file long, acq_ts timestamp, cloud double, length double").coalesce(1).write.parquet(str(tmp_path / "i"))
    got = run(spark, streams.new_images(stream(spark, str(tmp_path / "i"))), "images", tmp_path)
    assert sorted(r.file for r in got.collect()) == [0, 1, 2, 3, 4]
    longest = run(spark, streams.longest_a_day(stream(spark, str(tmp_path / "i"))), "longest", tmp_path)
    assert sorted((r.file, r.length) for r in longest.collect()) == [(k, 15.0 + k) for k in range(5)]


def test_running_rates(spark, tmp_path):
    spark.createDataFrame([(1, float(d), 2.0 * d) for d in range(10)] + [(2, 0.0, 1.0)], "transect_id long, day double, dist double").coalesce(1).write.parquet(str(tmp_path / "o"))
    got = {r.transect_id: (r.n, r.rate) for r in run(spark, streams.running_rates(stream(spark, str(tmp_path / "o"))), "rates", tmp_path, "update").collect()}
    assert got[1][0] == 10 and abs(got[1][1] - 2 * 365.2425) < 1e-6
    assert got[2] == (1, None) or got[2][1] != got[2][1]


def test_static_joins_and_pairs(spark, tmp_path):
    spark.createDataFrame([(1, START, 10.0, 0.5, "WL"), (1, START + timedelta(days=1), 3.0, 0.0, "VE")], "transect_id long, acq_ts timestamp, dist double, tide double, kind string").coalesce(1).write.parquet(str(tmp_path / "p"))
    o = stream(spark, str(tmp_path / "p"))
    slopes = spark.createDataFrame([(1, 0.25)], "transect_id long, slope double")
    got = run(spark, streams.corrected_waterlines(o.where("kind = 'WL'"), slopes), "corrected", tmp_path).collect()
    assert [r.corrected for r in got] == [12.0]
    limits = spark.createDataFrame([(1, 4.0, 5.0)], "transect_id long, p5 double, p25 double")
    assert [r.impact for r in run(spark, streams.impact_alerts(o, limits), "alerts", tmp_path).collect()] == [3]
    pairs = run(spark, streams.edge_and_water(o.where("kind = 'VE'"), o.where("kind = 'WL'"), 2), "pairs", tmp_path).collect()
    assert [r.width for r in pairs] == [7.0]


def test_trailing(spark, wave_dir, tmp_path):
    got = run(spark, streams.trailing_waves(stream(spark, wave_dir), "2 days", "1 day"), "trailing", tmp_path).collect()
    assert got and all(r.hs_std >= 0 for r in got)
