"""Operators on cliffs, crossing transects and as-of joins against plain versions."""

import random

from pyspark.sql import functions as F

from strandline.operators import joins, morphology, windows


def test_samples_are_found_across_any_gap(spark):
    rng = random.Random(2)
    series = sorted({0.0, 1.0, 30.0, *[rng.uniform(60, 90) for _ in range(50)]})
    times = [-5.0, 0.0, 0.5, 1.0, 10.0, 29.9, 30.0, 45.0, 200.0, *[rng.uniform(55, 95) for _ in range(60)], series[-1]]
    left = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k long, t double")
    right = spark.createDataFrame([(t, 2 * t) for t in series], "rt double, v double")
    got = {r.k: (r.prev_time, r.prev, r.next_time, r.next) for r in joins.bracketed(left, right, "t", "rt", "v").collect()}
    assert len(got) == len(times)
    for k, t in enumerate(times):
        before, after = [s for s in series if s <= t], [s for s in series if s > t]
        p, n = (max(before) if before else None), (min(after) if after else None)
        assert got[k] == (p, None if p is None else 2 * p, n, None if n is None else 2 * n)
    assert [tuple(r)[2:] for r in joins.bracketed(left.limit(1), right.limit(0), "t", "rt", "v").collect()] == [(None, None, None, None)]


def test_overlapping_intervals_give_the_last_one(spark):
    rng = random.Random(3)
    spans = [(k, a := rng.randrange(100), a + rng.randrange(30)) for k in range(40)]
    left = spark.createDataFrame([(t,) for t in range(-3, 140)], "t long")
    right = spark.createDataFrame(spans, "i long, s long, e long")
    got = {r.t: r.i for r in joins.in_intervals(left, right, "t", "s", "e", "i", ["i"], 7).collect()}
    assert got == {t: max((i for i, s, e in spans if s <= t <= e), default=None) for t in range(-3, 140)}


def test_exponential_mean_is_the_recursion(spark):
    rng = random.Random(4)
    rows = [(g, k, None if rng.random() < 0.2 else rng.random()) for g in range(3) for k in range(400)]
    got = {(r.g, r.k): r.m for r in windows.exponential_mean(spark.createDataFrame(rows, "g int, k int, y double"), ["g"], "k", "y", "m").collect()}
    for g in range(3):
        m = None
        for _, k, y in (r for r in rows if r[0] == g):
            m = m if y is None else y if m is None else m + 2 / 11 * (y - m)
            assert got[g, k] == m or abs(got[g, k] - m) < 1e-12


def plain_cliff(z):
    low = min(range(len(z)), key=lambda k: (z[k], k))
    end, toe, top = len(z) - 1, low, len(z) - 1
    while True:
        old = toe, top
        chord = lambda k, a, b: z[k] - z[a] - (k - a) * (z[b] - z[a]) / (b - a)
        over = {k: chord(k, toe, end) for k in range(toe, end)}
        best = max(over, key=lambda k: (over[k], -k))
        if over[best] > 0.001 and best < top:
            top = best
        if top > low:
            under = {k: chord(k, low, top) for k in range(low, top)}
            best = min(under, key=lambda k: (under[k], k))
            if under[best] < -0.001 and best > toe:
                toe = best
        if (toe, top) == old:
            return toe, top


def test_cliffs(spark):
    rng = random.Random(5)
    profiles = {0: [0, 0.5, 1, 1.2, 14, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34], 1: [k / 10 for k in range(20)], 2: [5.0], 3: [3, 2, 1]}
    profiles |= {k: [0.2 * i + rng.uniform(-3, 3) + (12 if i > 20 else 0) for i in range(40)] for k in range(4, 20)}
    rows = [(t, k, float(v)) for t, z in profiles.items() for k, v in enumerate(z)]
    got = {r.transect_id: r for r in morphology.cliffs(spark.createDataFrame(rows, "transect_id long, seq long, z double"), "transect_id", "seq", "z").collect()}
    assert 2 not in got and 3 not in got and got[0].cliff and not got[1].cliff
    for t in (0, 1, *range(4, 20)):
        z = profiles[t]
        if min(range(len(z)), key=lambda k: (z[k], k)) < len(z) - 1:
            assert (got[t].toe, got[t].top) == plain_cliff(z)


def test_longest_of_crossing_transects_go(spark):
    rng = random.Random(6)
    t = [(k, x := rng.uniform(0, 100), y := rng.uniform(0, 100), x + rng.uniform(-30, 30), y + rng.uniform(-30, 30)) for k in range(60)]
    got = {r.transect_id for r in morphology.uncrossed(spark.createDataFrame(t, "transect_id long, x0 double, y0 double, x1 double, y1 double")).collect()}
    size = {k: (((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5, k) for k, x0, y0, x1, y1 in t}
    side = lambda a, p, q: (a[3] - a[1]) * (q - a[2]) - (a[4] - a[2]) * (p - a[1])
    cross = lambda a, b: side(a, b[1], b[2]) * side(a, b[3], b[4]) <= 0 and side(b, a[1], a[2]) * side(b, a[3], a[4]) <= 0
    pairs = {(a[0], b[0]) for a in t for b in t if a[0] != b[0] and cross(a, b)}
    left = set()
    for k in sorted(size, key=size.get):  # from the shortest on
        if not any((k, o) in pairs for o in left):
            left.add(k)
    assert got == left
    assert not {(a, b) for a, b in pairs if a in left and b in left}
    assert all(any((k, o) in pairs for o in left) for k in set(size) - left)


def test_every_second_of_a_chain_stays(spark):
    t = [(k, 10.0 * k, 0.0, 10.0 * k + 12.0 + k / 100, (-1.0) ** k) for k in range(1, 31)]
    df = spark.createDataFrame([(k, x0, -y1, x1, y1) for k, x0, _, x1, y1 in t], "transect_id long, x0 double, y0 double, x1 double, y1 double")
    left = {r.transect_id for r in morphology.uncrossed(df).collect()}
    assert left == set(range(1, 31, 2))


def test_runs_of_crossing_transects_are_spread(spark):
    n = 1000
    rows = [(1, k, 10.0 * k, 0.0, 10.0 * k + (15.0 if k % 2 else -15.0) * (10 <= k < n - 10), 50.0) for k in range(n)]
    rows += [(2, 0, 0.0, 0.0, 30.0, 20.0), (2, 1, 10.0, 0.0, 0.0, 20.0), (2, 2, 20.0, 0.0, 20.0, 5.0), (3, 0, 0.0, 0.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "line_id long, transect_id long, x0 double, y0 double, x1 double, y1 double").repartition(3)
    got = {(r.line_id, r.transect_id): r for r in morphology.respaced(df, "line_id").collect()}
    run = sorted(k for line, k in got if line == 1 and got[line, k].hit)
    assert run == list(range(run[0], n - 10, 2)) and 9 <= run[0] <= 10
    ends = [got[1, k].x1 for k in run]
    assert max(abs((b - a) - (ends[1] - ends[0])) for a, b in zip(ends, ends[1:])) < 1e-6 and ends[0] < ends[-1]
    assert [got[1, k].x1 for k in range(5)] == [10.0 * k for k in range(5)] and (1, n - 1) in got
    # the last of a line ends the run that reaches it
    assert {k for k in got if k[0] != 1} == {(2, 0), (2, 2), (3, 0)} and (got[2, 0].x1, got[2, 0].y1) == (30.0, 20.0) and got[2, 2].x1 == 20.0


def test_merged_chains_settle(spark):
    from strandline.operators import geometry

    lines = [(k, float(10 * k), 0.0, float(10 * k + 10), 0.0) for k in range(130)] + [(500, 5000.0, 0.0, 5001.0, 0.0)]
    got = geometry.merged(spark.createDataFrame(lines, "line_id long, x0 double, y0 double, x1 double, y1 double"), 0.5)
    assert {(r.line_id, r.group) for r in got.select("line_id", F.col("group")).collect()} == {*((k, 0) for k in range(130)), (500, 500)}
