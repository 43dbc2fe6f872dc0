"""Queries on line surgery: loops, chains, curves, smoothing, transects between contours."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.scalars import rounded
from strandline.operators import geometry, lines, morphology
from strandline.plans.shore import _FUTURE, _level, future
from strandline.registry import register
from strandline.sources import tables as T

_LOOPS = """s AS (SELECT line_id, seq, x AS xa, y AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM v_tangle WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
j AS (SELECT a.line_id, a.seq, a.xa, a.ya, a.xb, a.yb, b.seq AS seq2, b.xa AS xa2, b.ya AS ya2, b.xb AS xb2, b.yb AS yb2, (a.xb - a.xa) * (b.yb - b.ya) - (a.yb - a.ya) * (b.xb - b.xa) AS den
  FROM s a JOIN s b ON a.line_id = b.line_id AND b.seq > a.seq + 1 WHERE a.xb IS NOT NULL AND b.xb IS NOT NULL),
u AS (SELECT *, ((xa2 - xa) * (yb2 - ya2) - (ya2 - ya) * (xb2 - xa2)) / den AS u, ((xa2 - xa) * (yb - ya) - (ya2 - ya) * (xb - xa)) / den AS v FROM j WHERE den <> 0),
c AS (SELECT line_id, seq + u AS p, max(seq2 + v) AS q, arg_max(xa + u * (xb - xa), seq2 + v) AS x, arg_max(ya + u * (yb - ya), seq2 + v) AS y FROM u WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 GROUP BY ALL),
n AS (SELECT c.line_id, c.p, c.q, c.x, c.y, d.p AS next FROM c ASOF LEFT JOIN c d ON c.line_id = d.line_id AND c.q <= d.p),
g AS (SELECT * FROM n WHERE p = (SELECT min(p) FROM n m WHERE m.line_id = n.line_id) UNION ALL SELECT n.* FROM g JOIN n ON n.line_id = g.line_id AND n.p = g.next)"""


@register("WITH RECURSIVE" + T.sql(f""", {_LOOPS},
k AS (SELECT line_id, seq::DOUBLE AS pos, x, y FROM v_tangle v WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.line_id = v.line_id AND v.seq > g.p AND v.seq <= g.q) UNION ALL SELECT line_id, p, x, y FROM g WHERE p <> floor(p))
SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY pos) - 1 AS seq, round(x, 6) AS x, round(y, 6) AS y FROM k""", "v_tangle").removeprefix("WITH"))
def simple_lines(spark, sf_dir):
    """Lines without the loops in which they cross themselves."""
    return lines.simple(T.tangle(spark, sf_dir)).select("line_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("WITH RECURSIVE" + T.sql(""", n AS (SELECT line_id, count(*) AS n FROM v_piece GROUP BY line_id),
e AS (SELECT v.line_id, CASE WHEN seq = 0 THEN 0 ELSE 1 END AS side, x, y FROM v_piece v JOIN n USING (line_id) WHERE seq = 0 OR seq = n - 1),
a AS (SELECT a.line_id * 2 + 1 - a.side AS node, b.line_id * 2 + b.side AS next FROM e a JOIN e b ON a.x = b.x AND a.y = b.y AND a.line_id <> b.line_id),
nodes AS (SELECT line_id * 2 + unnest([0, 1]) AS node FROM n),
walk AS (SELECT node AS start, node, 0 AS place FROM nodes WHERE node NOT IN (SELECT next FROM a) UNION ALL SELECT start, a.next, place + 1 FROM walk JOIN a ON a.node = walk.node),
kept AS (SELECT *, min(node) OVER (PARTITION BY start) AS least FROM walk),
v AS (SELECT least // 2 AS line_id, place, CASE WHEN node % 2 = 1 THEN n.n - 1 - v.seq ELSE v.seq END AS k, v.x, v.y, v.line_id AS part FROM kept JOIN v_piece v ON v.line_id = node // 2 JOIN n ON n.line_id = v.line_id WHERE least % 2 = 0)
SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY place, k) - 1 AS seq, round(x, 6) AS x, round(y, 6) AS y, part FROM v WHERE place = 0 OR k > 0""", "v_piece").removeprefix("WITH"))
def merged_lines(spark, sf_dir):
    """Pieces of lines put together in order, those that stand the other way round reversed."""
    return lines.chained(T.piece(spark, sf_dir), 0.001).select("line_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "part")


_SPLINE = """a AS (SELECT *, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS h FROM v_vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
b AS (SELECT *, coalesce(sum(h) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, (lead(x) OVER w - x) / h AS dx, (lead(y) OVER w - y) / h AS dy, lag(h) OVER w AS h0 FROM a WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
c AS (SELECT *, lag(dx) OVER w AS dx0, lag(dy) OVER w AS dy0, (lag(dx) OVER w * h + dx * h0) / (h0 + h) AS ix, (lag(dy) OVER w * h + dy * h0) / (h0 + h) AS iy FROM b WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
d AS (SELECT *, CASE WHEN ix IS NOT NULL THEN ix WHEN dx0 IS NULL THEN 2 * dx - lead(ix) OVER w ELSE 2 * dx0 - lag(ix) OVER w END AS mx, CASE WHEN iy IS NOT NULL THEN iy WHEN dy0 IS NULL THEN 2 * dy - lead(iy) OVER w ELSE 2 * dy0 - lag(iy) OVER w END AS my FROM c WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
p AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(mx) OVER w AS nmx, lead(my) OVER w AS nmy FROM d WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
k AS (SELECT *, unnest(range(ceil(s)::BIGINT, ceil(s + h)::BIGINT + 1))::DOUBLE AS pos FROM p WHERE nx IS NOT NULL),
t AS (SELECT *, (pos - s) / h AS t FROM k WHERE pos >= s AND pos < s + h)"""


@register(T.sql(f""", {_SPLINE},
r AS (SELECT line_id, pos, (2 * t * t * t - 3 * t * t + 1) * x + (t * t * t - 2 * t * t + t) * h * mx + (3 * t * t - 2 * t * t * t) * nx + (t * t * t - t * t) * h * nmx AS x,
  (2 * t * t * t - 3 * t * t + 1) * y + (t * t * t - 2 * t * t + t) * h * my + (3 * t * t - 2 * t * t * t) * ny + (t * t * t - t * t) * h * nmy AS y FROM t UNION ALL SELECT line_id, s, x, y FROM p WHERE nx IS NULL)
SELECT line_id, round(pos, 5) AS "at", round(x, 5) AS x, round(y, 5) AS y FROM r""", "v_vertex"))
def spline_lines(spark, sf_dir):
    """A point every metre along smooth curves through all vertices."""
    return lines.splined(T.vertex(spark, sf_dir)).select("line_id", *[F.round(c, 5).alias(c) for c in ("at", "x", "y")])


_WINDOW, _ORDER, _STEP = 9, 3, 5


def _smooth_sql(source: str, name: str) -> str:
    """One pass: vertices at equal distances, then a weighted sum over mirrored neighbours."""
    half = _WINDOW // 2
    w = "[" + ", ".join(f"{v!r}::DOUBLE" for v in lines.weights(_WINDOW, _ORDER)) + "]"
    return f"""{name}m AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, coalesce(sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2), 0) AS l FROM {source} WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
{name}s AS (SELECT *, sum(l) OVER (PARTITION BY line_id ORDER BY seq) - l AS s0 FROM {name}m),
{name}k AS (SELECT *, unnest(range(floor(s0 / {_STEP})::BIGINT + 1, ceil((s0 + l) / {_STEP})::BIGINT)) * {_STEP}.0::DOUBLE AS pos FROM {name}s WHERE nx IS NOT NULL),
{name}p AS (SELECT line_id, pos, x + (pos - s0) / l * (nx - x) AS x, y + (pos - s0) / l * (ny - y) AS y FROM {name}k UNION ALL SELECT line_id, 0.0, x, y FROM {name}s WHERE seq = 0 UNION ALL SELECT line_id, s0, x, y FROM {name}s WHERE nx IS NULL),
{name}n AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY pos) - 1 AS seq, count(*) OVER (PARTITION BY line_id) - 1 AS n, x, y FROM {name}p),
{name}d AS (SELECT a.line_id, a.seq, a.n, a.x AS x0, a.y AS y0, d, {w}[d + {half + 1}] AS w, a.n - abs(a.n - abs(a.seq + d)) AS other FROM {name}n a, (SELECT unnest(range(-{half}, {half + 1})) AS d)),
{name} AS (SELECT d.line_id, d.seq, CASE WHEN d.seq IN (0, any_value(d.n)) THEN any_value(x0) ELSE sum(w * b.x) END AS x, CASE WHEN d.seq IN (0, any_value(d.n)) THEN any_value(y0) ELSE sum(w * b.y) END AS y
  FROM {name}d d JOIN {name}n b ON b.line_id = d.line_id AND b.seq = d.other GROUP BY d.line_id, d.seq)"""


@register(T.sql(f", {_smooth_sql('v_vertex', 'one')},\n{_smooth_sql('one', 'two')} SELECT line_id, seq, round(x, 5) AS x, round(y, 5) AS y FROM two", "v_vertex"))
def smoothed_resampled_lines(spark, sf_dir):
    """Lines put at equal distances and smoothed by cubics over nine vertices, twice."""
    out = lines.smoothed(T.vertex(spark, sf_dir), _WINDOW, _ORDER, passes=2, spacing=float(_STEP))
    return out.select("line_id", "seq", rounded(F.col("x"), 5).alias("x"), rounded(F.col("y"), 5).alias("y"))


_LAND, _SEA, _EVERY = 150.0, 200.0, 40
_BETWEEN = f"""m AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, coalesce(sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2), 0) AS l FROM v_coast WHERE cls = 0 WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
s AS (SELECT *, sum(l) OVER (PARTITION BY line_id ORDER BY seq) - l AS s0 FROM m),
k AS (SELECT *, unnest(range(floor(s0 / {_EVERY})::BIGINT + 1, ceil((s0 + l) / {_EVERY})::BIGINT)) * {_EVERY}.0::DOUBLE AS pos FROM s WHERE nx IS NOT NULL),
p AS (SELECT line_id, pos, x + (pos - s0) / l * (nx - x) AS x, y + (pos - s0) / l * (ny - y) AS y FROM k UNION ALL SELECT line_id, 0.0, x, y FROM s WHERE seq = 0 UNION ALL SELECT line_id, s0, x, y FROM s WHERE nx IS NULL),
a AS (SELECT *, atan2(lead(x) OVER w - x, lead(y) OVER w - y) AS b0, row_number() OVER w - 1 AS id FROM p WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
b AS (SELECT *, coalesce(b0, lag(b0) OVER (PARTITION BY line_id ORDER BY pos)) AS b FROM a),
rays AS (SELECT line_id, id, x AS qx, y AS qy, unnest([0, 1]) AS side, x + (CASE unnest([0, 1]) WHEN 0 THEN {_LAND} * sin(b - pi() / 2) ELSE {_SEA} * sin(b + pi() / 2) END) AS ex, y + (CASE unnest([0, 1]) WHEN 0 THEN {_LAND} * cos(b - pi() / 2) ELSE {_SEA} * cos(b + pi() / 2) END) AS ey FROM b),
g AS (SELECT line_id AS other, seq, cls, x AS xa, y AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM v_coast WHERE cls IN (1, 2) WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
j AS (SELECT *, (ex - qx) * (yb - ya) - (ey - qy) * (xb - xa) AS den FROM rays JOIN g ON cls = side + 1 AND xb IS NOT NULL AND greatest(xa, xb) >= least(qx, ex) AND least(xa, xb) <= greatest(qx, ex) AND greatest(ya, yb) >= least(qy, ey) AND least(ya, yb) <= greatest(qy, ey)),
u AS (SELECT *, ((xa - qx) * (yb - ya) - (ya - qy) * (xb - xa)) / den AS u, ((xa - qx) * (ey - qy) - (ya - qy) * (ex - qx)) / den AS v FROM j WHERE den <> 0),
h AS (SELECT line_id, id, side, arg_min(qx + u * (ex - qx), (u, other, seq)) AS x, arg_min(qy + u * (ey - qy), (u, other, seq)) AS y FROM u WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 GROUP BY ALL),
t AS (SELECT r.line_id, r.id, n.x AS x0, n.y AS y0, coalesce(f.x, r.ex) AS x1, coalesce(f.y, r.ey) AS y1 FROM rays r JOIN h n ON n.side = 0 AND n.line_id = r.line_id AND n.id = r.id LEFT JOIN h f ON f.side = 1 AND f.line_id = r.line_id AND f.id = r.id WHERE r.side = 1)"""


def _between(spark, sf_dir):
    c = T.coast(spark, sf_dir)
    return lines.between_contours(c.where("cls = 0"), c.where("cls = 1"), c.where("cls = 2"), float(_EVERY), _LAND, _SEA)


@register(T.sql(f", {_BETWEEN} SELECT line_id, id AS transect_id, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM t", "v_coast"))
def contour_transects(spark, sf_dir):
    """Transects across the lines of class 0, from the first line of class 1 on the one side to that of class 2 on the other."""
    return _between(spark, sf_dir).select("line_id", "transect_id", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@register(T.sql(f", {_BETWEEN} SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY id) - 1 AS seq, round((x0 + x1) / 2, 4) AS x, round((y0 + y1) / 2, 4) AS y FROM t", "v_coast"))
def contour_midpoints(spark, sf_dir):
    """New lines through the middles of the transects between two contours."""
    return lines.midpoint_lines(_between(spark, sf_dir)).select("line_id", "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_NORMALS = """m AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, coalesce(sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2), 0) AS l FROM v_vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
s AS (SELECT *, sum(l) OVER (PARTITION BY line_id ORDER BY seq) - l AS s0 FROM m),
k AS (SELECT *, unnest(range(floor(s0 / 10)::BIGINT + 1, ceil((s0 + l) / 10)::BIGINT)) * 10.0::DOUBLE AS pos FROM s WHERE nx IS NOT NULL),
p AS (SELECT line_id, pos, x + (pos - s0) / l * (nx - x) AS x, y + (pos - s0) / l * (ny - y) AS y FROM k UNION ALL SELECT line_id, 0.0, x, y FROM s WHERE seq = 0 UNION ALL SELECT line_id, s0, x, y FROM s WHERE nx IS NULL),
a AS (SELECT *, atan2(lead(x) OVER w - x, lead(y) OVER w - y) AS b0, row_number() OVER w - 1 AS id FROM p WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
b AS (SELECT *, coalesce(b0, lag(b0) OVER (PARTITION BY line_id ORDER BY pos)) AS b FROM a),
t AS (SELECT line_id, id, x + 2 * sin(b - pi() / 2) AS x0, y + 2 * cos(b - pi() / 2) AS y0, x + 8 * sin(b + pi() / 2) AS x1, y + 8 * cos(b + pi() / 2) AS y1 FROM b)"""


@register(T.sql(f""", {_NORMALS},
c AS (SELECT DISTINCT t.line_id, t.id FROM t JOIN t o ON o.line_id = t.line_id AND o.id <> t.id
  AND ((t.x1 - t.x0) * (o.y0 - t.y0) - (t.y1 - t.y0) * (o.x0 - t.x0)) * ((t.x1 - t.x0) * (o.y1 - t.y0) - (t.y1 - t.y0) * (o.x1 - t.x0)) <= 0
  AND ((o.x1 - o.x0) * (t.y0 - o.y0) - (o.y1 - o.y0) * (t.x0 - o.x0)) * ((o.x1 - o.x0) * (t.y1 - o.y0) - (o.y1 - o.y0) * (t.x1 - o.x0)) <= 0),
h AS (SELECT t.*, c.id IS NOT NULL AND t.id < max(t.id) OVER (PARTITION BY t.line_id) AS hit FROM t LEFT JOIN c ON c.line_id = t.line_id AND c.id = t.id),
i AS (SELECT *, id - row_number() OVER (PARTITION BY line_id, hit ORDER BY id) AS island FROM h),
g AS (SELECT line_id, island, min(id) AS first, max(id) AS last FROM i WHERE hit GROUP BY ALL),
q AS (SELECT i.*, i.id - first AS j, last - first + 1 AS n, a.x1 AS ax, a.y1 AS ay, z.x1 AS zx, z.y1 AS zy FROM i LEFT JOIN g ON i.hit AND g.line_id = i.line_id AND g.island = i.island LEFT JOIN t a ON a.line_id = i.line_id AND a.id = first LEFT JOIN t z ON z.line_id = i.line_id AND z.id = last + 1)
SELECT line_id, id AS transect_id, round(CASE WHEN hit THEN ax + (CASE WHEN n > 1 THEN j / (n - 1) ELSE 0 END) * (zx - ax) ELSE x1 END, 5) AS x1, round(CASE WHEN hit THEN ay + (CASE WHEN n > 1 THEN j / (n - 1) ELSE 0 END) * (zy - ay) ELSE y1 END, 5) AS y1, hit AS moved FROM q WHERE NOT hit OR j % 2 = 0""", "v_vertex"))
def respaced_transects(spark, sf_dir):
    """Transects across each line every 10 m; where neighbours cross, their seaward ends are spread evenly and every second one goes."""
    t = geometry.shore_normals(T.vertex(spark, sf_dir), 10.0, 2.0, 8.0).drop("at")
    out = morphology.respaced(t, "line_id")
    return out.select("line_id", "transect_id", F.round("x1", 5).alias("x1"), F.round("y1", 5).alias("y1"), F.col("hit").alias("moved"))


@register(T.sql(f""", {_FUTURE.format(rate='1')},
d AS (SELECT transect_id, unnest([dist, dist + error, dist - error]) AS d FROM v_survey UNION ALL SELECT transect_id, dist FROM f WHERE dist > dist0),
s AS (SELECT transect_id, min(d) AS low, max(d) AS high, greatest(25 - (max(d) - min(d)), 0) / 2 AS short FROM d GROUP BY transect_id),
t AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS l FROM v_transect LEFT JOIN s USING (transect_id))
SELECT transect_id, round(coalesce(x0 + (low - short) * (x1 - x0) / l, x0), 5) AS x0, round(coalesce(y0 + (low - short) * (y1 - y0) / l, y0), 5) AS y0, round(coalesce(x0 + (high + short) * (x1 - x0) / l, x1), 5) AS x1, round(coalesce(y0 + (high + short) * (y1 - y0) / l, y1), 5) AS y1 FROM t""", "v_survey", "v_transect"))
def truncated_transects(spark, sf_dir):
    """Transects cut to their surveyed positions with errors, and to the future ones that lie beyond the latest."""
    s = T.survey(spark, sf_dir)
    past = s.select("transect_id", F.explode(F.array(F.col("dist"), F.col("dist") + F.col("error"), F.col("dist") - F.col("error"))).alias("dist"))
    latest = s.groupBy("transect_id").agg(F.max_by("dist", "year").alias("latest"))
    ahead = future(s, [2030, 2050, 2100], F.lit(0.05), F.lit(2), _level, F.lit(1)).select("transect_id", "dist").join(latest, "transect_id").where("dist > latest").select("transect_id", "dist")
    out = lines.truncated(T.transect(spark, sf_dir), past.union(ahead))
    return out.select("transect_id", *[F.round(c, 5).alias(c) for c in ("x0", "y0", "x1", "y1")])
