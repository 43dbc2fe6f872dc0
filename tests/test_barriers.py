"""Barriers against a walk along each profile in plain Python."""

import math
import random

import pytest

from strandline.operators import barriers as B


def brute_force(z, level):
    """Of a profile (heights a metre apart, None for missing): the columns of barriers, or None."""
    land = [i for i, v in enumerate(z) if v is not None and v >= 0]
    if not land:
        return None
    first, last = land[0], land[-1]
    peak = max(land, key=lambda i: (z[i], -i))
    if z[peak] < level or peak == first:
        return None

    def off(a, b, low):
        slope = (z[b] - z[a]) / (b - a)
        d = {i: z[i] - z[a] - (i - a) * slope for i in land if low <= i <= b}
        return d, max(d, key=lambda i: (d[i], -i)), min(d, key=lambda i: (d[i], i))

    toe, top, raised, moving = first, peak, False, True
    while moving:
        moving = False
        d, hi, _ = off(first, top, first)
        new = peak if hi == first else hi
        if new == last:
            return None
        if new < top and d[hi] > B.OFF_CHORD and z[new] > level:
            top, moving = new, True
        d, _, lo = off(first, top, first)
        if lo > toe and d[lo] < -B.OFF_CHORD:
            toe, moving = lo, True
        if z[toe] < level and not raised:
            raised = moving = True
            near = min((i for i in land if toe <= i <= top), key=lambda i: (abs(z[i] - level), i))
            toe = max(i for i in land if i < near) if z[near] > level and near != first else near
    if top <= toe or top == last:
        return None
    limit = min(land, key=lambda i: (abs(i - top - B.BACK_LIMIT), i))
    limit = limit if limit > top else last
    back_top, back_toe, moving = top, limit, True
    while moving:
        moving = False
        d, _, lo = off(top, limit, back_top)
        if back_top < lo < back_toe and d[lo] < -B.OFF_CHORD:
            back_toe, moving = lo, True
        d, hi, _ = off(top, back_toe, top)
        if hi != back_top and hi < back_toe and d[hi] > B.OFF_CHORD:
            back_top, moving = hi, True
    if back_top == last:
        return None
    body = [i for i in land if toe <= i < back_toe]
    crest = max(body, key=lambda i: (z[i], -i))
    spacing = land[1] - land[0]
    volume = sum(z[i] for i in body) * spacing - 0.5 * (z[toe] + z[body[-1]]) * (body[-1] - toe)
    back_slope = (z[back_top] - z[back_toe]) / (back_top - back_toe) if back_top != back_toe else None
    return (toe, top, back_top, back_toe, crest, z[crest], z[top] - z[toe], z[back_top] - z[back_toe], abs(toe - back_toe), abs(top - back_top), (z[top] - z[toe]) / (top - toe), back_slope, volume)


def profiles():
    rng = random.Random(9)
    out = [[None] * 5, [], [-1.0, -2.0], [5.0, 4.0, 3.0], [0.0, 1.0, 1.5], [0.0, 1.0, 2.0, 3.0], [0.0, 4.0, 4.0, 1.0, 2.0]]
    for k in range(50):
        n = rng.randrange(20, 500)
        wide, high = rng.uniform(5, 60), rng.uniform(1, 12)
        at = rng.uniform(10, n)
        out.append([high * math.exp(-(((i - at) / wide) ** 2)) + i * rng.choice([0, 0.001, 0.01]) - (k % 3) * 0.3 + rng.uniform(-0.2, 0.2) if rng.random() > 0.02 else None for i in range(n)])
    return out


def test_equals_a_walk_along_each_profile(spark):
    given = profiles()
    rows = [(k, i, v) for k, p in enumerate(given) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "transect_id long, at long, z double").selectExpr("*", "1 as toe", "2 as prev").repartition(3)
    got = {r.transect_id: tuple(r)[1:] for r in B.barriers(df, "transect_id", "at", "z", 2.0).collect()}
    want = {k: v for k, p in enumerate(given) if (v := brute_force(p, 2.0))}
    assert set(got) == set(want) and len(want) > 20
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9)
    assert B.barriers(df.limit(0), "transect_id", "at", "z", 2.0).count() == 0


def test_sections_with_no_one_two_and_four_crossings(spark):
    z = {1: [0.0, 1.0, 0.0], 2: [0.0, 1.0, 4.0], 3: [0.0, 4.0, 6.0, 1.0], 4: [0.0, 4.0, 0.0, 4.0, 0.0], 5: [3.0]}
    df = spark.createDataFrame([(k, i, v) for k, p in z.items() for i, v in enumerate(p)], "transect_id long, at long, z double")
    got = {r.transect_id: (r.crossings, round(r.width, 9), r.volume) for r in B.sections(df, "transect_id", "at", "z", [2.0]).collect()}
    assert got == {1: (0, 0.0, 0.0), 2: (1, B.OPEN, B.OPEN), 3: (2, round(1 + 0.8 + 0.5, 9), 6.0), 4: (4, 1.0, 2.0), 5: (0, 0.0, 0.0)}
