"""Plans and results that must hold when tables are large."""

import re

import numpy as np
import pytest

from strandline import catalog
from strandline.operators import joins, morphology, windows
from strandline.operators.rounds import State
from strandline.plans.pixels import neighbour_std
from strandline.sources import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


CELL = r"BroadcastHashJoin \[(_cx|cx|c)#"


@pytest.mark.parametrize("name", ["nearest_defence", "survey_attributes", "survey_positions", "swath_profile", "transects_hit", "tile_lookup", "nearest_feature", "away_from_clouds", "uncontained"])
def test_sides_dealt_to_cells_are_not_broadcast(name, spark, sf_dir):
    assert not re.search(CELL, plan(catalog.queries()[name](spark, sf_dir)))


def test_crossing_pairs_are_not_broadcast(spark, sf_dir):
    assert not re.search(CELL, plan(morphology.crossing_pairs(T.transect(spark, sf_dir), 20.0)))


def test_round_tables_are_not_broadcast(spark):
    held = State(spark.range(1000).withColumnRenamed("id", "a"))
    try:
        assert "BroadcastHashJoin" not in plan(held.table.join(spark.range(10).withColumnRenamed("id", "a"), "a"))
    finally:
        held.drop()


def test_rock_is_met_without_a_broadcast(spark, sf_dir):
    assert "BroadcastHashJoin [_row" not in plan(catalog.queries()["rock_head"](spark, sf_dir))


def test_trailing_wave_sorts_pieces_without_sliding_frames(spark, sf_dir):
    assert "specifiedwindowframe(RangeFrame, -" not in plan(catalog.queries()["trailing_wave"](spark, sf_dir))


def test_trailing_equals_plain_sums(spark):
    rows = [(k % 2, (k * 37) % 101, float(k * k % 13)) for k in range(300)]
    got = sorted((r.g, r.t, r.v, r.v_mean, r.v_std) for r in windows.trailing(spark.createDataFrame(rows, "g int, t long, v double"), ["g"], "t", 10, ["v"]).collect())
    assert len(got) == len(rows)
    for g, t, _, mean, std in got:
        near = np.array([v for h, s, v in rows if h == g and t - 10 <= s <= t])
        assert abs(mean - near.mean()) < 1e-9 and abs(std - near.std()) < 1e-9


def test_intervals_make_no_pairs(spark):
    rng = np.random.default_rng(3)
    spans = [(i, float(s), float(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 300, 120), rng.choice([0, 1, 2, 3, 9, 40], 120), strict=True))]
    left, right = spark.createDataFrame([(float(t) / 2,) for t in range(-10, 700)], "t double"), spark.createDataFrame(spans, "i int, s double, e double")
    out = joins.in_intervals(left, right, "t", "s", "e", "i", ["i"])
    assert "Join" not in plan(out)
    assert {r.t: r.i for r in out.collect()} == {t / 2: max((i for i, s, e in spans if s <= t / 2 <= e), default=None) for t in range(-10, 700)}


def test_exponential_mean_collects_no_lists(spark):
    rows = [(k, None if k % 11 == 5 else float(k * 7 % 31)) for k in range(900)]
    out = windows.exponential_mean(spark.createDataFrame(rows, "k int, y double").selectExpr("1 as g", "k", "y"), ["g"], "k", "y", "m")
    assert "collect_list" not in plan(out)
    m = None
    for r in sorted(out.collect(), key=lambda r: r.k):
        m = m if r.y is None else r.y if m is None else m + 2 / 11 * (r.y - m)
        assert abs(r.m - m) < 1e-9


def test_neighbourhoods_need_no_join(spark):
    p = spark.createDataFrame([(1, r, c, float(r * 8 + c) ** 1.5) for r in range(8) for c in range(8)], "image_id long, row long, col long, a double")
    out = neighbour_std(p, "a", 8)
    assert "Join" not in plan(out)
    a = np.pad(np.array([[float(r * 8 + c) ** 1.5 for c in range(8)] for r in range(8)]), 1, mode="symmetric")
    got = {(r.row, r.col): r.std for r in out.collect()}
    assert len(got) == 64 and all(abs(s - a[r : r + 3, c : c + 3].std()) < 1e-9 for (r, c), s in got.items())


def test_influence_of_keys_beyond_32_bits(spark, tmp_path):
    rows = [(k % 3 * 70_000, f"19{92 + k % 7}-0{k % 9 + 1}-{k % 28 + 1:02d}", float(k % 50 + 1)) for k in range(400)]
    spark.createDataFrame(rows, "l_suppkey long, d string, l_quantity double").selectExpr("l_suppkey", "timestamp(d) as l_shipdate", "l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["feature_influence"](spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(r.rmse > 0 for r in got)
