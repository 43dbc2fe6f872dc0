"""Hand cases of operators."""

import math
from datetime import date

from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import geometry, joins, windows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_nearest_prefers_the_earlier_of_equal_distances(spark):
    left = spark.createDataFrame([(1, 10), (1, 163), (1, 164), (2, 5)], "k long, t long")
    right = spark.createDataFrame([(1, 8, "a"), (1, 12, "b"), (1, 317, "c")], "k long, r long, v string")
    got = {r.t: r.r_v for r in joins.nearest_in_time(left, right, ["k"], "t", "r", 153).where("k = 1").collect()}
    assert got == {10: "a", 163: "b", 164: "b"}
    assert joins.nearest_in_time(left, right, ["k"], "t", "r", 153).where("k = 2").first().r_v is None


def test_nearest_keeps_the_tolerance(spark):
    left = spark.createDataFrame([(1, 165), (1, 166)], "k long, t long")
    right = spark.createDataFrame([(1, 12, "b")], "k long, r long, v string")
    got = {r.t: r.r_v for r in joins.nearest_in_time(left, right, ["k"], "t", "r", 153).collect()}
    assert got == {165: "b", 166: None}


def test_interpolation_on_between_and_after_samples(spark):
    left = spark.createDataFrame([(0,), (5,), (10,), (11,)], "t long")
    right = spark.createDataFrame([(0, 1.0), (10, 3.0)], "r long, v double")
    b = joins.bracketed(left, right, "t", "r", "v", 20)
    got = {r.t: r.x for r in b.select("t", joins.interpolated(b, "t").alias("x")).collect()}
    assert got == {0: 1.0, 5: 2.0, 10: None, 11: None}


def test_transect_with_no_one_and_two_hits(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 10.0), (2, 100.0, 0.0, 100.0, 10.0)], "transect_id int, x0 double, y0 double, x1 double, y1 double")
    v = spark.createDataFrame([(7, 0, -1.0, 2.0), (7, 1, 1.0, 2.0), (7, 2, 1.0, 8.0), (7, 3, -1.0, 8.0)], "line_id int, seq int, x double, y double")
    found = joins.crossings(t, joins.segments(v), 3.0)
    assert sorted(r.dist for r in found.collect()) == [2.0, 8.0]
    assert [(r.transect_id, r.dist) for r in joins.first_crossings(found).collect()] == [(1, 2.0)]


def test_circular_mean_around_north(spark):
    d = spark.createDataFrame([(350.0,), (10.0,)], "d double")
    m = d.agg(S.circular_mean(F.col("d"))).first()[0]
    assert min(m, 360 - m) < 1e-9


def test_utm_of_a_known_point(spark):
    d = spark.createDataFrame([(56.0, -3.0), (0.0, -1.0)], "lat double, lon double")
    e, n = S.to_utm(F.col("lat"), F.col("lon"), F.lit(-3.0))
    got = rows(d.select(e, n, S.utm_epsg(F.col("lat"), F.col("lon"))))
    # the meridian's length by numerical integration
    a, f, n = 6378137.0, 1 / 298.257223563, 20000
    e2, step = f * (2 - f), math.radians(56) / n
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * step) ** 2) ** 1.5 * step for k in range(n))
    assert math.isclose(got[0][0], 500000, abs_tol=1e-6) and math.isclose(got[0][1], 0.9996 * arc, abs_tol=0.01)
    assert got[0][2] == 32630 and got[1][2] == 32630 and math.isclose(got[1][1], 0, abs_tol=1e-6)


def test_affine_both_ways(spark):
    g = {k: F.lit(v) for k, v in {"x0": 100.0, "dx": 10.0, "rx": 1.0, "y0": 200.0, "ry": 2.0, "dy": -10.0}.items()}
    x, y = S.to_world(F.col("c"), F.col("r"), g)
    d = spark.createDataFrame([(3.0, 4.0)], "c double, r double").select(x.alias("x"), y.alias("y"))
    c, r = S.to_pixel(F.col("x"), F.col("y"), g)
    got = rows(d.select(c, r))[0]
    assert math.isclose(got[0], 3) and math.isclose(got[1], 4)


def test_gap_fill_keeps_its_limit(spark):
    d = spark.createDataFrame([(1, k, 0.0 if k == 0 else 24.0 if k == 24 else None) for k in range(25)], "id int, n int, v double")
    got = {r.n: r.v for r in windows.filled(d, ["id"], "n", "v", 10).collect()}
    assert got[10] == 10.0 and got[14] == 14.0 and got[12] is None


def test_exponential_mean(spark):
    d = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, None), (1, 3, 4.0)], "id int, n int, v double")
    got = [r.m for r in windows.exponential_mean(d, ["id"], "n", "v", "m", 3).orderBy("n").collect()]
    assert got == [1.0, 1.5, 1.5, 2.75]


def test_runs(spark):
    d = spark.createDataFrame([(1, k, f) for k, f in enumerate([True, True, False, True])], "g int, k int, f boolean")
    assert [r.run for r in windows.runs(d, ["g"], "k", "f").orderBy("k").collect()] == [1, 1, 2, 3]


def test_daily_linear(spark):
    d = spark.createDataFrame([(1, date(2020, 1, 1), 0.0), (1, date(2020, 1, 4), 3.0)], "id int, day date, v double")
    assert [r.v for r in windows.daily_linear(d, ["id"], "day", "v").orderBy("day").collect()] == [0.0, 1.0, 2.0, 3.0]


def test_daily_linear_deals_series_by_their_days(spark, monkeypatch):
    monkeypatch.setattr(windows, "DAYS_A_TASK", 100)
    d = spark.createDataFrame([(k, date(2020, m, 1), float(k * m)) for k in range(40) for m in (1, 3)], "id int, day date, v double")
    assert windows.days_spanned(d, ["id"], "day") == 40 * 61
    found = windows.daily_linear(d, ["id"], "day", "v").withColumn("task", F.spark_partition_id())
    tasks = found.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).collect()
    assert sum(r.n for r in tasks) == 40 * 61 and len(tasks) > 10 and sum(r.ids for r in tasks) == 40
    assert windows.days_spanned(d.limit(0), ["id"], "day") == 0 and windows.daily_linear(d.limit(0), ["id"], "day", "v").count() == 0


def test_resampled_line_keeps_its_ends(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 5.0)], "line_id int, seq int, x double, y double")
    got = sorted(rows(geometry.resampled(v, 5.0)))
    assert got == [(1, 0.0, 0.0, 0.0), (1, 5.0, 5.0, 0.0), (1, 10.0, 10.0, 0.0), (1, 15.0, 10.0, 5.0)]


def test_missing_marks(spark):
    d = spark.createDataFrame([(["1.5", "--", "masked", "x"],)], "v array<string>")
    assert rows(d.select(S.clean_list(F.col("v"))))[0][0] == [1.5, None, None, None]


def test_smoothing_keeps_ends_and_straight_lines(spark):
    v = spark.createDataFrame([(1, k, float(k), float(2 * k)) for k in range(8)] + [(2, 0, 0.0, 0.0), (2, 1, 1.0, 5.0)], "line_id int, seq int, x double, y double")
    got = {(r.line_id, r.seq): (r.x, r.y) for r in geometry.smoothed(v).collect()}
    assert got[(1, 0)] == (0.0, 0.0) and got[(1, 7)] == (7.0, 14.0) and got[(2, 1)] == (1.0, 5.0)
    assert all(math.isclose(got[(1, k)][0], k) for k in range(2, 6))


def test_chains_of_lines(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 10.4, 0.0, 20.0, 0.0), (3, 20.0, 0.3, 30.0, 5.0), (4, 50.0, 0.0, 60.0, 0.0)], "line_id long, x0 double, y0 double, x1 double, y1 double")
    assert {r.line_id: r.group for r in geometry.merged(e, 0.5).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
