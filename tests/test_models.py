"""Neighbours, graph clusters, parameter search, influence, pan-sharpening and evaluation against plain Python or numpy."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import catalog
from strandline.operators import graphs, nearest, parts, raster, tuning

COLUMNS = ["a", "b", "c", "d"]
POINTS = "k long, a double, b double, c double, d double, s string"


def cloud():
    rng = random.Random(2)
    rows = [(k, *(rng.gauss(0, 1 + i) for i in range(4)), "xy"[k % 2]) for k in range(300)]
    rows += [(1000 + k, 0.5, 0.5, 0.5, 0.5, "x") for k in range(150)]  # a third of all rows on one place
    rows += [(2000, 80.0, 90.0, 0.0, 0.0, "x"), (2001, -70.0, 3.0, 1.0, 1.0, "y"), (2002, None, 1.0, 1.0, 1.0, "x"), (2003, math.nan, 1.0, 1.0, 1.0, "x"), (2004, 0.0, 0.0, 0.0, 0.0, "alone")]
    return rows


def near(rows, k, by, apart):
    fine = [r for r in rows if all(v is not None and v == v for v in r[1:5])]
    out = {}
    for r in fine:
        d = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(r[1:5], o[1:5]))), o[0]) for o in fine if (not by or o[5] == r[5]) and not (apart and o[0] == r[0]))
        out[r[0]] = d[:k]
    return out


@pytest.mark.parametrize(("by", "apart", "k"), [(False, True, 5), (True, False, 1), (True, True, 7)])
def test_nearest_equals_brute_force(spark, by, apart, k):
    rows = cloud()
    df = spark.createDataFrame(rows, POINTS).repartition(3)
    found = nearest.nearest(df, df.withColumnRenamed("k", "o"), "k", "o", COLUMNS, k, by=["s"] if by else None, apart=apart).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.k, r["rank"])):
        got.setdefault(r.k, []).append((r.distance, r.o))
    want = {key: v for key, v in near(rows, k, by, apart).items() if v}
    assert {key: [o for _, o in v] for key, v in got.items()} == {key: [o for _, o in v] for key, v in want.items()}
    assert all(abs(a[0] - b[0]) < 1e-9 for key in want for a, b in zip(got[key], want[key], strict=True))


def test_distances_that_the_root_makes_equal_are_ordered_by_key(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (9, 1.0, 0.0), (3, 1.0, 2.0**-26)], "k long, a double, b double")
    found = nearest.nearest(df.where("k = 1"), df.withColumnRenamed("k", "o"), "k", "o", ["a", "b"], 2, apart=True).collect()
    assert sorted((r["rank"], r.o, r.distance) for r in found) == [(1, 3, 1.0), (2, 9, 1.0)]


@pytest.mark.parametrize("n", [365, 404])
def test_points_made_beyond_the_last_bound(spark, monkeypatch, n):
    # 18 and 19 bounds in blocks of four
    monkeypatch.setattr(nearest, "PER_CELL", 1)
    rng = random.Random(5)
    rows = [(k, *(rng.gauss(0, 1) for _ in range(4)), "x") for k in range(n)]
    five = near(rows, 5, False, True)
    made = nearest.between_neighbours(spark.createDataFrame(rows, POINTS), "k", COLUMNS, copies=2).collect()
    assert {(r.from_key, r.copy): r.to_key for r in made} == {(k, c): five[k][(k * 7919 + c * 31) % 5][1] for k in range(n) for c in (0, 1)}


def test_made_points_keep_the_sign_of_zero_as_sql_does(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 0.1) for _ in range(48)] + [-1e-9 if k % 3 else 1e-9] * 16, 2 * (k % 5) + 1) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    cur = con.execute(catalog.oracle_sql()["oversampled_rows"])
    names = [d[0] for d in cur.description]
    got = catalog.queries()["oversampled_rows"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(r) for r in cur.fetchall())
    assert len(got) == 80 and {str(r.x3) for r in got} == {"0.0", "-0.0"}


def test_points_are_made_between_neighbours(spark):
    rows = [r for r in cloud() if r[0] < 300]
    df = spark.createDataFrame(rows, POINTS)
    given = {r[0]: r[1:5] for r in rows}
    five = near(rows, 5, False, True)
    made = nearest.between_neighbours(df, "k", COLUMNS, copies=2).collect()
    assert len(made) == 600
    for r in made:
        a, b = given[r.from_key], given[r.to_key]
        assert r.to_key in [o for _, o in five[r.from_key]]
        assert all(min(p, q) - 1e-12 <= r[c] <= max(p, q) + 1e-12 for c, p, q in zip(COLUMNS, a, b))
    assert nearest.between_neighbours(df.limit(0), "k", COLUMNS).count() == 0


def test_parts_end_with_the_last_bound(spark):
    values = spark.createDataFrame([(v / 2,) for v in range(-1, 70)], "v double")
    for n in (1, 2, 3, 5, 8, 17, 18, 23, 26, 31):  # mostly no multiples of the blocks' size
        for closed in (False, True):
            found = values.select("v", parts.bounds_below(F.col("v"), [float(b) for b in range(n)], closed).alias("p")).collect()
            assert all(r.p == sum(b < r.v or (closed and b == r.v) for b in range(n)) for r in found), (n, closed)


def test_nearest_points_are_not_joined_as_pairs(spark, monkeypatch):
    # the two widest columns part the points in four only
    monkeypatch.setattr(nearest, "PER_CELL", 100)
    rng = np.random.default_rng(7)
    n = 3000
    x = np.column_stack([rng.integers(0, 2, n) * 90.0, rng.integers(0, 2, n) * 70.0, rng.uniform(0, 9, n), rng.uniform(0, 9, n)])
    df = spark.createDataFrame([(k, *map(float, x[k]), "x") for k in range(n)], POINTS)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    seen = store.executionsList()
    before = max((seen.apply(i).executionId() for i in range(seen.size())), default=-1)
    found = nearest.nearest(df, df.withColumnRenamed("k", "o"), "k", "o", COLUMNS, 4, apart=True).collect()
    bus.waitUntilEmpty()
    most, runs = 0, store.executionsList()
    for run in [r for r in (runs.apply(i) for i in range(runs.size())) if r.executionId() > before]:
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        metrics = [m for node in (nodes.apply(i) for i in range(nodes.size())) for m in (node.metrics().apply(i) for i in range(node.metrics().size()))]
        rows = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
        most = max([most, *(int(v.get().replace(",", "")) for v in rows if v.isDefined())])
    assert n <= most < n * n / 20
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert len(found) == 4 * n and all(want[r.k, r["rank"] - 1] == r.o for r in found)


def test_nearest_among_uneven_sets_and_crowds_that_ask(spark, monkeypatch):
    for name, value in (("PER_CELL", 8), ("AT_ONCE", 3000), ("ASKING", 15)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(0, 1 + i, 400) for i in range(3)])
    x[:40], x[50, 1], x[52, 0] = x[0], math.inf, -math.inf
    kinds = ["rare" if k % 100 == 7 else "ab"[k % 3 == 0] for k in range(400)]
    points = [(f"k{k:03d}", *map(float, x[k]), kinds[k]) for k in range(400)]
    y = np.vstack([rng.normal(0, 3, (80, 3)), np.tile([90.0, 80.0, 70.0], (5, 1)), rng.normal(60, 0.1, (100, 3))])
    asking = [(k, *map(float, y[k]), ["a", "b", "rare", "none"][k % 4]) for k in range(len(y))]
    kind = "a double, b double, c double, s string"
    found = nearest.nearest(spark.createDataFrame(asking, f"k long, {kind}"), spark.createDataFrame(points, f"o string, {kind}"), "k", "o", ["a", "b", "c"], 6, by=["s"])
    got = {(r.k, r["rank"]): (r.distance, r.o) for r in found.collect()}
    want = {}
    for k, *place, s in asking:
        d = sorted((math.sqrt((place[0] - o[1]) ** 2 + (place[1] - o[2]) ** 2 + (place[2] - o[3]) ** 2), o[0]) for o in points if o[4] == s)
        want |= {(k, i + 1): v for i, v in enumerate(d[:6])}
    assert {key: o for key, (_, o) in got.items()} == {key: o for key, (_, o) in want.items()}
    assert all(got[key][0] == want[key][0] or abs(got[key][0] - want[key][0]) < 1e-9 for key in want)


def test_graph_of_nearest_points_beyond_the_last_bound(spark, monkeypatch):
    # 18 parts of an axis, so 17 bounds in blocks of four: the last block is short
    monkeypatch.setattr(nearest, "PER_CELL", 1)
    rng = random.Random(4)
    of = lambda k: k % 3
    rows = [(k, rng.gauss(20 * of(k), 1), rng.gauss(0, 1), 0.0, 0.0, "x") for k in range(330)]
    df = spark.createDataFrame(rows, POINTS)
    found = nearest.nearest(df, df.withColumnRenamed("k", "o"), "k", "o", COLUMNS, 3, apart=True)
    got = {}
    for r in found.collect():
        got.setdefault(r.k, set()).add(r.o)
    assert got == {key: {o for _, o in v} for key, v in near(rows, 3, False, True).items()}
    edges = found.select(F.col("k").alias("a"), F.col("o").alias("b"), F.lit(1.0).alias("weight"))
    assert graphs.spectral_clusters(edges, 3, tolerance=1e-3).count() == 330


def test_three_planted_clusters(spark):
    rng = random.Random(6)
    of = lambda v: v * 7 % 3
    n, edges = 900, set()
    while len(edges) < 100_000:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b and (of(a) == of(b) or rng.random() < 0.1):
            edges.add((min(a, b), max(a, b)))
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(5, 5, 9.0)], "a long, b long, weight double")
    found = {r.node: r.cluster for r in graphs.spectral_clusters(df, 3).collect()}
    assert len(found) == n and len({(of(v), c) for v, c in found.items()}) == 3


def test_spectral_vectors_are_numpys(spark):
    rng = np.random.default_rng(1)
    w = np.triu(rng.uniform(size=(30, 30)) * (rng.uniform(size=(30, 30)) < 0.4), 1)
    df = spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(*np.nonzero(w))], "a long, b long, weight double")
    rows = sorted(graphs.spectral_vectors(df, 2, tolerance=1e-9).collect())
    w = w + w.T
    d = np.sqrt(w.sum(1))
    want = np.linalg.eigh(w / np.outer(d, d))[1][:, ::-1][:, :2]
    got = np.array([[r.v0, r.v1] for r in rows])
    assert np.abs(np.abs((got * want).sum(0)) - 1).max() < 1e-3


def test_search_equals_fitting_each_trial_alone(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    trials = [(n, p) for n in (1, 2, 4) for p in (0.0, 5.0, 500.0)]
    for g in range(4):
        x = rng.normal(size=(60, 4))
        y = x @ [3.0, g, 0.0, 0.2] + rng.normal(size=60) + 2
        fold = np.arange(60) % 3
        rows += [(g, int(f), *map(float, v), float(t)) for f, v, t in zip(fold, x, y)]
        for n, p in trials:
            sse = 0.0
            for f in range(3):
                a, b = x[fold != f][:, :n], y[fold != f]
                m, my = a.mean(0), b.mean()
                w = np.linalg.solve((a - m).T @ (a - m) + p * np.eye(n), (a - m).T @ (b - my))
                sse += ((y[fold == f] - my - (x[fold == f][:, :n] - m) @ w) ** 2).sum()
            want[g, n, p] = math.sqrt(sse / 60)
    rows += [(9, 0, 1.0, 1.0, 1.0, 1.0, 1.0)]  # one fold only
    df = spark.createDataFrame(rows, "g long, fold int, x0 double, x1 double, x2 double, x3 double, y double").repartition(3)
    got = tuning.search(df, "g", "fold", ["x0", "x1", "x2", "x3"], "y", trials).collect()
    assert all(abs(r.rmse - want[r.g, r.features, r.penalty]) < 1e-8 for r in got if r.g != 9)
    for g in range(4):
        best = [(r.features, r.penalty) for r in got if r.g == g and r.best]
        assert best == [min(trials, key=lambda t: want[g, *t])]
    assert [r.rmse for r in got if r.g == 9] == [None] * len(trials) and not any(r.best for r in got if r.g == 9)


def test_influence_is_that_of_the_permuted_column(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, 0.1] + rng.normal(size=200) * 0.1
    keys = rng.permutation(1000)[:200]
    monkeypatch.setattr(tuning, "_PARTS", 16)
    df = spark.createDataFrame([(int(k), *map(float, v), float(t)) for k, v, t in zip(keys, x, y)], "k long, x0 double, x1 double, y double").repartition(3)
    w = tuning.least_squares(df, ["x0", "x1"], "y")
    assert np.allclose(w, np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0])
    from pyspark.sql import functions as F

    got = {r.feature: r for r in tuning.influence(df, "k", ["x0", "x1"], "y", w, F.col("k") * 7919 % 10007).collect()}
    i, j = np.argsort(keys), np.argsort(keys * 7919 % 10007)
    for c in (0, 1):
        z = x.copy()
        z[i, c] = x[j, c]
        assert abs(got[f"x{c}"].shuffled - math.sqrt(((y - w[0] - z @ w[1:]) ** 2).mean())) < 1e-9
    assert got["x0"].change > 10 * got["x1"].change > 0


def pixels():
    rng = np.random.default_rng(4)
    return [(k, r, c, *map(float, rng.normal(size=3) @ [[2, 1, 0.5], [0, 1, 0.3], [0, 0, 0.4]] + [5, 6, 7])) for k in range(3) for r in range(12) for c in range(12)]


def test_pan_sharpening_with_its_own_component_changes_nothing(spark):
    from pyspark.sql import functions as F

    rows = pixels() + [(9, 0, 0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "image_id long, row long, col long, u double, v double, w double")
    axes = raster.principal_axes(df, ["u", "v", "w"])
    p = df.join(axes, "image_id").withColumn("pan", sum(((F.col(c) - F.col("mean")[i]) * F.col("axis")[i] for i, c in enumerate("uvw")), F.lit(0.0)) * 3 + 8)
    got = {(r.image_id, r.row, r.col): (r.u, r.v, r.w) for r in raster.pan_sharpened(p, ["u", "v", "w"], "pan").collect()}
    assert all(np.allclose(got[tuple(r[:3])], r[3:]) for r in rows)


def test_pan_sharpening_equals_numpy_and_leaves_clouds_out(spark):
    rows = [(*r, math.sin(i) if i % 11 else None) for i, r in enumerate(pixels())]
    df = spark.createDataFrame(rows, "image_id long, row long, col long, u double, v double, w double, pan double")
    got = {(r.image_id, r.row, r.col): (r.u, r.v, r.w) for r in raster.pan_sharpened(df, ["u", "v", "w"], "pan").collect()}
    for k in range(3):
        own = [r for r in rows if r[0] == k and r[6] is not None]
        x, pan = np.array([r[3:6] for r in own]), np.array([r[6] for r in own])
        u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        axis = vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
        first = (x - x.mean(0)) @ axis
        matched = np.empty(len(pan))
        matched[np.argsort(pan)] = np.sort(first)
        want = x + np.outer(matched - first, axis)
        assert all(np.allclose(got[r[:3]], v) for r, v in zip(own, want))
    assert all(got[r[:3]] == (None, None, None) for r in rows if r[6] is None)


def test_evaluation_of_images(spark):
    size = 10
    truth = lambda k, r, c: int(c >= 5)
    guess = lambda k, r, c: int(c >= 5 + (k if k < 3 else 20) - (2 if (k, r) == (1, 4) else 0))
    rows = [(k, r, c, truth(k, r, c), guess(k, r, c)) for k in range(4) for r in range(size) for c in range(size)] + [(0, 90, 90, None, 1)]
    got = {r.image_id: r for r in raster.evaluated(spark.createDataFrame(rows, "image_id long, row long, col long, t int, p int"), "t", "p").collect()}
    assert sorted(got) == [0, 1, 2, 3] and all(r.n == 100 and r.n_true == 9 for r in got.values())
    assert (got[0].accuracy, got[0].precision, got[0].recall, got[0].kappa, got[0].mean_distance, got[0].max_distance) == (1.0, 1.0, 1.0, 1.0, 0.0, 0.0)
    assert got[2].max_distance == got[2].back_distance == got[2].mean_distance == 2.0 and got[2].precision == 1.0 and got[2].recall == 0.6
    both = sum(t and p for k, _, _, t, p in rows if k == 1)
    t, p = 50, sum(p for k, _, _, _, p in rows if k == 1)
    chance = (t * p + (100 - t) * (100 - p)) / 10_000
    right = sum(t == p for k, _, _, t, p in rows if k == 1) / 100
    assert got[1].precision == both / p and abs(got[1].kappa - (right - chance) / (1 - chance)) < 1e-12
    assert got[1].max_distance == 1.0 and got[1].mean_distance < 1.0
    assert got[3].precision is None and got[3].recall == 0.0 and got[3].n_predicted == 0 and got[3].max_distance is None and got[3].back_distance is None


def test_ensemble_equals_fitting_without_each_fold(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    y = np.c_[x @ [1.0, 2.0] + 3 + rng.normal(size=80), x @ [-1.0, 0.5] + rng.normal(size=80)]
    fold = np.arange(80) % 4
    df = spark.createDataFrame([(1, i, int(f), *map(float, a), *map(float, b)) for i, (f, a, b) in enumerate(zip(fold, x, y))] + [(2, 0, 0, 1.0, 1.0, 1.0, 1.0)], "g long, i int, fold int, a double, b double, u double, v double")
    got = {(r.g, r.i): r for r in tuning.forecast(df, tuning.members(df, "g", "fold", ["a", "b"], ["u", "v"], 2.0), "g", ["a", "b"], ["u", "v"]).collect()}
    said = []
    for f in range(4):
        z = np.c_[np.ones(80), x][fold != f]
        w = np.linalg.solve(z.T @ z + 2.0 * np.diag([0, 1, 1]), z.T @ y[fold != f])
        said.append(np.c_[np.ones(80), x] @ w)
    mean, spread = np.mean(said, 0), np.std(said, 0)
    assert all(np.allclose([got[1, i].u_mean, got[1, i].v_mean, got[1, i].u_spread, got[1, i].v_spread], [*mean[i], *spread[i]]) for i in range(80))
    assert got[1, 0].members == 4 and got[2, 0].members is None and got[2, 0].u_mean is None
