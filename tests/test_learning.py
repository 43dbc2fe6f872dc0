"""Spectra, learning, objects and contours against small independent results."""

import math

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import learn, raster, spectra


def test_spectrum_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 50, 60))
    y = 3 + 2 * np.sin(2 * np.pi * 0.2 * t + 0.4) + rng.normal(0, 0.3, 60)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, y, strict=True)], "id int, t double, y double")
    s = spectra.sums(df, ["id"], "t", ["y"], F.array(F.lit(0.1), F.lit(0.2)))
    got = {r.f: r.p for r in s.select("f", (spectra.cross_power("y", "y") / F.col("y_y")).alias("p")).collect()}
    for f, p in got.items():
        x = np.stack((np.ones(60), np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)), 1)
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert math.isclose(p, 1 - e @ e / ((y - y.mean()) @ (y - y.mean())), rel_tol=1e-6)


def test_objects(spark):
    cells = [(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 3, 3), (1, 4, 4), (2, 0, 0)] + [(3, 0, k) for k in range(30)] + [(3, k, 29) for k in range(1, 30)]
    got = raster.objects(spark.createDataFrame(cells, "image_id int, row long, col long"))
    sizes = sorted((r.image_id, r.n) for r in got.groupBy("image_id", "label").agg(F.count("*").alias("n")).collect())
    assert sizes == [(1, 1), (1, 1), (1, 3), (2, 1), (3, 59)]


def test_contour_of_a_plane(spark):
    px = [(1, r, c, float(c)) for r in range(4) for c in range(4)]
    s = raster.contour_segments(spark.createDataFrame(px, "image_id int, row int, col int, v double"), "v", 1.5).collect()
    assert len(s) == 3 and all(x.xa == 1.5 and x.xb == 1.5 for x in s)
    flat = spark.createDataFrame([(1, r, c, 1.0) for r in range(3) for c in range(3)], "image_id int, row int, col int, v double")
    assert raster.contour_segments(flat, "v", 1.5).count() == 0


def test_clusters_and_components(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(k % 2 * 10 + rng.normal()), float(rng.normal())) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = {r.id: r.cluster for r in learn.clusters(df, ["a", "b"], 2).collect()}
    assert all(got[k] == k % 2 for k in range(60))
    scores, shares = learn.principal_components(df, ["a", "b"])
    assert scores.columns == ["id", "a", "b", "pc1"] and math.isclose(sum(shares), 1)
    costs = learn.elbow(df, ["a", "b"], [2, 3])
    assert costs[0][1] > costs[1][1]


def test_ridge_beats_the_last_value_on_a_wave(spark):
    df = spark.createDataFrame([(g, k, math.sin(k / 3 + g)) for g in (1, 2) for k in range(200)] + [(3, 0, 1.0)], "id long, k int, v double")
    got = {r.id: r for r in learn.ridge_by_group(df, "id", "k", "v").collect()}
    assert got[1].rmse < 0.2 * got[1].naive_rmse and got[3].n_test == 0


def test_the_rougher_class_is_numbered_last(spark):
    rows = [(k, 1.0 + k % 3 / 10, 0.2) if k % 2 else (k, 5.0 + k % 5 / 10, 2.0) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, elevation double, slope double")
    assert all((r.cluster == 1) == (r.elevation > 3) for r in learn.clusters(df, ["elevation", "slope"], 2).collect())
