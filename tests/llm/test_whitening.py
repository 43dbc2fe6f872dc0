import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from strandline.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, components=8, weight="count"):
    """(key, deviation, whitened) of all rows that remain, n, shares: with Python's whole numbers and plain numpy."""
    fine = [(k, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    longest = max(len(x) for _, x in fine)
    fine = [(k, x) for k, x in fine if len(x) == longest]
    fitted = [x for _, x in fine] if weight == "count" else [list(x) for x in {tuple(x) for _, x in fine}]
    n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fitted, float) - mean
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > e[0] * longest * 1e-12).sum()))
    out = [(key, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), (np.array(x) - mean) @ u[:, :k] / np.sqrt(e[:k])) for key, x in fine]
    return out, n, e[:k] / np.trace(v)


def hold(got, want):
    rows, n, shares = want
    assert Counter((r.vec_id, int(r.deviation)) for r in got) == Counter((k, d) for k, d, _ in rows)
    assert {r.n for r in got} == {n} and all(r.identity_error < 1e-8 for r in got)
    assert np.allclose(got[0].explained, shares, rtol=1e-9)
    order = lambda k: (k is None, k)
    a = np.array([r.z for r in sorted(got, key=lambda r: (order(r.vec_id), int(r.deviation)))])
    b = np.array([z for _, _, z in sorted(rows, key=lambda r: (order(r[0]), r[1]))])
    signs = np.sign((a * b).sum(0))
    assert np.allclose(a * signs, b, atol=1e-6)


def made(copies=40):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1 + i) + (k % 3) * i for i in range(12)]) for k in range(200)]
    rows += [(1000 + k, rows[7][1]) for k in range(copies)] + [(7, rows[7][1]), (None, rows[8][1])]
    odd = [(2000, None), (2001, [1.0, None] * 6), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, []), (2005, [1.0])]
    return rows, odd


@pytest.mark.parametrize(("weight", "hot_share"), [("count", whitening.HOT_SHARE), ("one", 0.1), ("count", 2.0)])
def test_equals_brute_force(spark, weight, hot_share):
    rows, odd = made()
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], SCHEMA).selectExpr("*", "1 as x", "2 as w", "3 as z").repartition(3)
    got = whitening.whiten(df, weight=weight, hot_share=hot_share).collect()
    hold(got, brute_force(rows + odd, weight=weight))


def test_given_vectors(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    want, n, shares = brute_force([(r["vec_id"], r["embedding"]) for r in t])
    got = queries.op13_multiplicity_whitening(spark, sf_dir).collect()
    assert len(got) == 8 * len(want) and {r.component for r in got} == set(range(1, 9))
    by = {k: (d, z) for k, d, z in want}
    signs = {c: np.sign(sum(r.whitened * by[r.vec_id][1][c - 1] for r in got if r.component == c)) for c in range(1, 9)}
    for r in got:
        assert r.n == n and r.deviation == by[r.vec_id][0] and r.identity_error < 1e-8
        assert abs(r.explained / shares[r.component - 1] - 1) < 1e-9
        assert abs(r.whitened * signs[r.component] - by[r.vec_id][1][r.component - 1]) < 1e-6


def test_large_numbers_stay_exact(spark):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-3e5, 3e5) for _ in range(3)]) for k in range(60)]
    hold(whitening.whiten(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect(), brute_force(rows))


def test_nothing_to_whiten(spark):
    none = spark.createDataFrame([], SCHEMA)
    same = spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(4)], SCHEMA)
    null = spark.createDataFrame([(1, None, 0)], SCHEMA)
    for df in (none, same, null):
        out = whitening.whiten(df)
        assert out.count() == 0 and out.columns == ["vec_id", "n", "deviation", "z", "explained", "identity_error"]


def test_constant_dimensions_have_no_component(spark):
    rows = [(k, [float(k % 5), 1.0, float(k % 5)]) for k in range(20)]
    got = whitening.whiten(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()
    assert len(got) == 20 and all(len(r.z) == 1 for r in got)
    hold(got, brute_force(rows))
