"""Queries that join lines, points, profiles and pixels by place."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import joins, raster, spectra
from strandline.plans.geometry import _HITS
from strandline.plans.learning import _SPECTRUM
from strandline.registry import register
from strandline.sources import tables as T


def _near(points, others, x: str, y: str, ox: str, oy: str, reach: float):
    """Pairs of points and others in the same or a neighbouring cell of the reach's size."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: cell(c) + k))
    spread = others.select("*", around(ox).alias("_cx")).select("*", around(oy).alias("_cy"))
    return joins.by_cell(points.withColumns({"_cx": cell(x), "_cy": cell(y)}), spread, ["_cx", "_cy"])


@register(T.sql(f""", {_HITS}, y AS (SELECT *, 1950 + line_id % 60 AS year, abs(dist - len / 2) AS off FROM h)
SELECT transect_id, year, round(arg_min(dist, (off, line_id, seq)), 6) AS dist, CASE WHEN year < 1970 THEN 5.0::DOUBLE WHEN year < 2000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS error FROM y GROUP BY transect_id, year""", "v_coast", "v_transect"))
def survey_positions(spark, sf_dir):
    """Position of each survey year on each transect: of several hits the nearest to the transect's midpoint."""
    hits = joins.crossings(T.transect(spark, sf_dir), joins.segments(T.coast(spark, sf_dir)), 20.0)
    y = hits.withColumns({"year": 1950 + F.col("line_id") % 60, "off": F.abs(F.col("dist") - F.col("len") / 2)})
    return y.groupBy("transect_id", "year").agg(F.round(F.min_by("dist", F.struct("off", "line_id", "seq")), 6).alias("dist")).withColumn("error", S.survey_error(F.col("year")))


@register(T.sql("""SELECT v.line_id, v.seq, round(p.a, 6) AS value FROM v_vertex v LEFT JOIN v_pixel p ON p.image_id = v.line_id AND p."row" = floor((v.y + 60) / 15)::BIGINT AND p.col = floor(v.x / 40)::BIGINT""", "v_vertex", "v_pixel"))
def raster_sample(spark, sf_dir):
    """Raster value at each vertex; null outside the raster."""
    v = T.vertex(spark, sf_dir).withColumns({"row": F.floor((F.col("y") + 60) / 15), "col": F.floor(F.col("x") / 40)})
    p = T.pixel(spark, sf_dir).select(F.col("image_id").alias("line_id"), "row", "col", "a")
    return v.join(p, ["line_id", "row", "col"], "left").select("line_id", "seq", F.round("a", 6).alias("value"))


@register(T.sql("""SELECT transect_id, min(seq) FILTER (z < -23) AS first_low, count(*) FILTER (z < -23) AS n_low FROM v_profile GROUP BY transect_id""", "v_profile"))
def first_low_sample(spark, sf_dir):
    """First sample along each transect under a threshold."""
    low = F.col("z") < -23
    return T.profile(spark, sf_dir).groupBy("transect_id").agg(F.min(F.when(low, F.col("seq"))).alias("first_low"), F.count_if(low).alias("n_low"))


#: Size of the cells of rock depth, depth under which rock counts as met, and how far beyond it erosion may go.
_CELL_X, _CELL_Y, _ROCK, _EROSION = 5, 10, 0.02, 25


@register(T.sql(f""", r AS (SELECT vec_id AS row, i AS col FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE embedding[i + 1]::DOUBLE >= 0 AND embedding[i + 1]::DOUBLE < {_ROCK}),
t AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM v_transect), k AS (SELECT *, unnest(range(50)) AS k FROM t),
f AS (SELECT transect_id, min(k) AS k FROM k JOIN r ON r.row = floor((y0 + k / 49 * (y1 - y0)) / {_CELL_Y})::BIGINT AND r.col = floor((x0 + k / 49 * (x1 - x0)) / {_CELL_X})::BIGINT GROUP BY transect_id HAVING min(k) < 49),
n AS (SELECT t.*, greatest(k - 1, 0) / 49 AS low, (k + 1) / 49 AS high FROM t JOIN f USING (transect_id)), m AS (SELECT *, floor((high - low) * len)::BIGINT AS n FROM n),
i AS (SELECT *, unnest(range(n)) AS i FROM m), s AS (SELECT *, low + CASE WHEN n > 1 THEN i / (n - 1) ELSE 0 END * (high - low) AS share FROM i),
g AS (SELECT transect_id, arg_min(share * len, i) AS dist FROM s JOIN r ON r.row = floor((y0 + share * (y1 - y0)) / {_CELL_Y})::BIGINT AND r.col = floor((x0 + share * (x1 - x0)) / {_CELL_X})::BIGINT GROUP BY transect_id)
SELECT transect_id, round(dist, 5) AS dist, round(dist + {_EROSION}, 5) AS erosion_limit FROM g""", "v_transect"))
def rock_head(spark, sf_dir):
    """Where each transect first meets rock, sampled at 50 nodes and then every metre, and how far erosion may go."""
    e = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).withColumn("v", F.col("v").cast("double"))
    found = raster.first_below(T.transect(spark, sf_dir), e, _CELL_X, _CELL_Y, _ROCK)
    return found.select("transect_id", F.round("dist", 5).alias("dist"), F.round(F.col("dist") + _EROSION, 5).alias("erosion_limit"))


@register(T.sql("""SELECT transect_id, round(CASE WHEN a > 360 THEN a - 360 ELSE a END, 6) AS angle FROM (SELECT transect_id, 180 - degrees(atan2(y1 - y0, x1 - x0)) AS a FROM v_transect)""", "v_transect"))
def shore_angles(spark, sf_dir):
    """Angle of the shore at each transect, clockwise from north."""
    return T.transect(spark, sf_dir).select("transect_id", F.round(S.shore_angle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]), 6).alias("angle"))


@register(T.sql(""", b AS (SELECT line_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v_coast GROUP BY line_id)
SELECT line_id FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.line_id <> b.line_id AND o.x0 <= b.x0 AND o.x1 >= b.x1 AND o.y0 <= b.y0 AND o.y1 >= b.y1)""", "v_coast"))
def uncontained(spark, sf_dir):
    """Boxes that no other box contains: a box is dealt to the cells that it touches, and met there by the boxes whose lower corner it holds."""
    b = T.coast(spark, sf_dir).groupBy("line_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    b = b.withColumns({"cx": F.floor(F.col("x0") / 20), "cy": F.floor(F.col("y0") / 20)})
    span = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / 20), F.floor(F.col(z) / 20)))
    o = b.select(*[F.col(c).alias(f"o_{c}") for c in ("line_id", "x0", "x1", "y0", "y1")]).select("*", span("o_x0", "o_x1").alias("ox")).select("*", span("o_y0", "o_y1").alias("oy"))
    inside = (F.col("o_line_id") != F.col("line_id")) & (F.col("o_x0") <= F.col("x0")) & (F.col("o_x1") >= F.col("x1")) & (F.col("o_y0") <= F.col("y0")) & (F.col("o_y1") >= F.col("y1"))
    return b.join(o.hint("merge"), (b["cx"] == o["ox"]) & (b["cy"] == o["oy"]) & inside, "left_anti").select("line_id")


@register(T.sql(""", c AS (SELECT x AS cx, y AS cy FROM v_coast WHERE cls = 3)
SELECT line_id, seq FROM v_coast v WHERE cls <> 3 AND NOT EXISTS (SELECT 1 FROM c WHERE cy BETWEEN y - 8 AND y + 8 AND cx BETWEEN x - 8 AND x + 8 AND (x - cx) ** 2 + (y - cy) ** 2 <= 64)""", "v_coast"))
def away_from_clouds(spark, sf_dir):
    """Vertices farther than 8 m from every cloud point (a vertex of class 3)."""
    v = T.coast(spark, sf_dir)
    a = v.where("cls <> 3")
    c = v.where("cls = 3").select(F.col("x").alias("cx"), F.col("y").alias("cy"))
    hit = _near(a, c, "x", "y", "cx", "cy", 8.0).where("(x - cx) * (x - cx) + (y - cy) * (y - cy) <= 64").select("line_id", "seq").distinct()
    return a.join(hit, ["line_id", "seq"], "left_anti").select("line_id", "seq")


@register(T.sql(""", s AS (SELECT t.transect_id, v.line_id, v.seq, (v.line_id % 10)::DOUBLE AS z, ((v.x - x0) * (x1 - x0) + (v.y - y0) * (y1 - y0)) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS along, abs((v.x - x0) * (y1 - y0) - (v.y - y0) * (x1 - x0)) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS off, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM v_transect t, v_coast v WHERE v.x BETWEEN x0 - 4 AND x1 + 4 AND v.y BETWEEN y0 - 4 AND y1 + 4),
k AS (SELECT *, floor(along / 20)::BIGINT AS step, (along - (floor(along / 20) * 20 + 10)) ** 2 + off * off AS d2 FROM s WHERE off <= 3 AND along BETWEEN 0 AND len)
SELECT transect_id, step, count(*) AS n, round(sum(z / greatest(d2, 0.01)) / sum(1 / greatest(d2, 0.01)), 5) AS idw, min(z) AS low, max(z) AS high FROM k GROUP BY ALL""", "v_transect", "v_coast"))
def swath_profile(spark, sf_dir):
    """Inverse-distance mean, least and greatest value of the points within 3 m of each transect, by steps of 20 m."""
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - 4) / 10), F.floor((F.col(b) + 4) / 10)))
    t = T.transect(spark, sf_dir).select("*", span("x0", "x1").alias("c")).select("*", span("y0", "y1").alias("d"))
    v = T.coast(spark, sf_dir).select("line_id", "seq", "x", "y", F.floor(F.col("x") / 10).alias("c"), F.floor(F.col("y") / 10).alias("d"))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    s = joins.by_cell(t, v, ["c", "d"]).where("x between x0 - 4 and x1 + 4 and y between y0 - 4 and y1 + 4").select("transect_id", (F.col("line_id") % 10).cast("double").alias("z"), ((dx * (F.col("x1") - F.col("x0")) + dy * (F.col("y1") - F.col("y0"))) / length).alias("along"), (F.abs(dx * (F.col("y1") - F.col("y0")) - dy * (F.col("x1") - F.col("x0"))) / length).alias("off"), length.alias("len"))
    off = F.col("along") - (F.floor(F.col("along") / 20) * 20 + 10)
    k = s.where("off <= 3 and along between 0 and len").withColumns({"step": F.floor(F.col("along") / 20), "d2": F.greatest(off * off + F.col("off") * F.col("off"), F.lit(0.01))})
    return k.groupBy("transect_id", "step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("z") / F.col("d2")) / F.sum(1 / F.col("d2")), 5).alias("idw"), F.min("z").alias("low"), F.max("z").alias("high"))


@register(T.sql(""", m AS (SELECT * FROM v_pixel WHERE a > 0.2), v AS (SELECT image_id, "row" AS r, col AS c, a AS va FROM v_pixel WHERE a <= 0.2)
SELECT m.image_id, m."row", m.col, round(arg_min(va, ((m."row" - r) ** 2 + (m.col - c) ** 2, r, c)), 6) AS filled FROM m JOIN v USING (image_id) GROUP BY ALL""", "v_pixel"))
def grid_fill(spark, sf_dir):
    """Masked cells take the nearest valid value of their image."""
    p = T.pixel(spark, sf_dir)
    v = p.where("a <= 0.2").select("image_id", F.col("row").alias("r"), F.col("col").alias("c"), F.col("a").alias("va"))
    j = p.where("a > 0.2").join(v, "image_id").withColumn("d", (F.col("row") - F.col("r")) * (F.col("row") - F.col("r")) + (F.col("col") - F.col("c")) * (F.col("col") - F.col("c")))
    return j.groupBy("image_id", "row", "col").agg(F.round(F.min_by("va", F.struct("d", "r", "c")), 6).alias("filled"))


@register(T.sql(f""", {_SPECTRUM}, p AS (SELECT transect_id, round(f * 365)::BIGINT AS k, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (cc * ss - cs * cs) / yy AS power FROM m),
l AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS b FROM p WINDOW w AS (PARTITION BY transect_id ORDER BY k))
SELECT transect_id, k AS per_year, round(power, 8) AS power FROM l WHERE power > a AND power > b AND k > 2 QUALIFY row_number() OVER (PARTITION BY transect_id ORDER BY power DESC, k) = 1""", "v_daily"))
def top_peak(spark, sf_dir):
    """Highest local peak of each spectrum above two cycles a year."""
    d = T.daily(spark, sf_dir).select("transect_id", F.col("y").alias("x"), F.datediff("day", F.lit("1995-01-01")).cast("double").alias("t"))
    s = spectra.sums(d, ["transect_id"], "t", ["x"], F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: k / 365))
    p = s.select("transect_id", F.round(F.col("f") * 365).cast("long").alias("per_year"), (spectra.cross_power("x", "x") / F.col("x_x")).alias("power"))
    w = Window.partitionBy("transect_id").orderBy("per_year")
    peaks = p.withColumns({"a": F.lag("power").over(w), "b": F.lead("power").over(w)}).where("power > a and power > b and per_year > 2")
    return peaks.groupBy("transect_id").agg(F.max_by("per_year", F.struct("power", -F.col("per_year"))).alias("per_year"), F.round(F.max("power"), 8).alias("power"))


@register(T.sql(""", o AS (SELECT * FROM (VALUES (-1), (0), (1)) t(i), (VALUES (-1), (0), (1)) u(j)), m AS (SELECT image_id, "row" AS r, col AS c FROM v_pixel WHERE a > -0.1),
e AS (SELECT image_id, r + i AS r, c + j AS c FROM m, o GROUP BY ALL HAVING count(*) = 9), d AS (SELECT DISTINCT image_id, r + i AS r, c + j AS c FROM e, o)
SELECT image_id, count(*) AS n FROM d GROUP BY image_id""", "v_pixel"))
def opening(spark, sf_dir):
    """Pixels of masks after erosion and dilation by a 3 x 3 square."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    moved = lambda d: d.select("image_id", "r", "c", steps.alias("s")).select("image_id", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"))
    m = T.pixel(spark, sf_dir).where("a > -0.1").select("image_id", F.col("row").alias("r"), F.col("col").alias("c"))
    e = moved(m).groupBy("image_id", "r", "c").count().where("count = 9").select("image_id", "r", "c")
    return moved(e).distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@register(T.sql(""", f AS (SELECT image_id, floor(b * 40)::BIGINT AS qa, a FROM v_pixel)
SELECT image_id, round(count(*) FILTER (qa IN (1, 3, 5)) / count(*), 6) AS share, round(avg(CASE WHEN qa IN (1, 3, 5) THEN -1.0 ELSE a END), 6) AS masked_mean FROM f GROUP BY image_id HAVING count(*) FILTER (qa IN (1, 3, 5)) / count(*) <= 0.3""", "v_pixel"))
def quality_mask(spark, sf_dir):
    """Share of masked quality codes of the images that stay, and the mean with masked pixels set to nodata."""
    bad = F.floor(F.col("b") * 40).isin(1, 3, 5)
    g = T.pixel(spark, sf_dir).withColumn("bad", bad).groupBy("image_id").agg((F.count_if("bad") / F.count(F.lit(1))).alias("s"), F.round(F.avg(F.when(F.col("bad"), -1.0).otherwise(F.col("a"))), 6).alias("masked_mean"))
    return g.where("s <= 0.3").select("image_id", F.round("s", 6).alias("share"), "masked_mean")


@register(T.sql("""SELECT p.image_id, p."row" * 2 + 1 AS "row", p.col * 2 + 1 AS col, round((p.a + r.a + d.a + x.a) / 4, 6) AS value FROM v_pixel p JOIN v_pixel r ON r.image_id = p.image_id AND r."row" = p."row" AND r.col = p.col + 1
JOIN v_pixel d ON d.image_id = p.image_id AND d."row" = p."row" + 1 AND d.col = p.col JOIN v_pixel x ON x.image_id = p.image_id AND x."row" = p."row" + 1 AND x.col = p.col + 1""", "v_pixel"))
def finer_grid(spark, sf_dir):
    """Bilinear values at the middle of each four pixels, on a grid twice as fine."""
    w = Window.partitionBy("image_id", "row").orderBy("col")
    p = T.pixel(spark, sf_dir).withColumn("right", F.lead("a").over(w)).where("right is not null")
    v = Window.partitionBy("image_id", "col").orderBy("row")
    q = p.withColumns({"down": F.lead("a").over(v), "across": F.lead("right").over(v)}).where("down is not null")
    return q.select("image_id", (F.col("row") * 2 + 1).alias("row"), (F.col("col") * 2 + 1).alias("col"), F.round((F.col("a") + F.col("right") + F.col("down") + F.col("across")) / 4, 6).alias("value"))


@register(T.sql(""", y AS (SELECT unnest([2030, 2050, 2100]) AS year), l AS (SELECT year, 0.01::DOUBLE * (year - 2000) + 5 AS level FROM y), n AS (SELECT *, lead(z) OVER (PARTITION BY transect_id ORDER BY seq) AS nz FROM v_profile)
SELECT transect_id, year::BIGINT AS year, round(min(seq + (level - z) / (nz - z)), 6) AS pos FROM n, l WHERE (z < level AND nz >= level) OR (z >= level AND nz < level) GROUP BY ALL""", "v_profile"))
def bathtub(spark, sf_dir):
    """First place where each profile crosses the sea level of future years."""
    w = Window.partitionBy("transect_id").orderBy("seq")
    n = T.profile(spark, sf_dir).withColumn("nz", F.lead("z").over(w)).select("*", F.explode(F.array(*[F.lit(y).cast("long") for y in (2030, 2050, 2100)])).alias("year"))
    n = n.withColumn("level", 0.01 * (F.col("year") - 2000) + 5).where("(z < level and nz >= level) or (z >= level and nz < level)")
    return n.groupBy("transect_id", "year").agg(F.round(F.min(F.col("seq") + (F.col("level") - F.col("z")) / (F.col("nz") - F.col("z"))), 6).alias("pos"))


@register("""WITH s AS (SELECT s_suppkey, (s_suppkey % 7) * 0.31::DOUBLE AS lat, (s_suppkey % 11) * 0.23::DOUBLE AS lon FROM supplier), g AS (SELECT unnest(range(0, 11)) * 0.25::DOUBLE AS v)
SELECT s_suppkey, arg_min(a.v, (round(abs(a.v - lat), 9), a.v)) AS cell_lat, arg_min(b.v, (round(abs(b.v - lon), 9), b.v)) AS cell_lon FROM s, g a, g b GROUP BY s_suppkey""")
def nearest_cell(spark, sf_dir):
    """Grid cell of each site: the nearest latitude and longitude of a regular grid, each by itself."""
    s = T.table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 7) * 0.31).alias("lat"), ((F.col("s_suppkey") % 11) * 0.23).alias("lon"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: k * 0.25)
    best = lambda c: F.array_min(F.transform(grid, lambda v: F.struct(F.round(F.abs(v - F.col(c)), 9).alias("d"), v.alias("v"))))["v"]
    return s.select("s_suppkey", best("lat").alias("cell_lat"), best("lon").alias("cell_lon"))


@register(T.sql("""SELECT line_id, seq, round(100 + x * 10 + y * 1, 6) AS wx, round(200 + x * 2 - y * 10, 6) AS wy, 32600 + ((floor((x / 2 - 60 + 180) / 6)::BIGINT % 60) + 1) AS epsg FROM v_vertex""", "v_vertex").replace("AS epsg", "AS epsg_north"))
def world_coordinates(spark, sf_dir):
    """Pixel to world by a geotransform, and the zone code of a longitude."""
    g = {k: F.lit(v) for k, v in {"x0": 100.0, "dx": 10.0, "rx": 1.0, "y0": 200.0, "ry": 2.0, "dy": -10.0}.items()}
    wx, wy = S.to_world(F.col("x"), F.col("y"), g)
    return T.vertex(spark, sf_dir).select("line_id", "seq", F.round(wx, 6).alias("wx"), F.round(wy, 6).alias("wy"), S.utm_epsg(F.lit(1.0), F.col("x") / 2 - 60).cast("long").alias("epsg_north"))
