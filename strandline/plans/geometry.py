"""Queries on lines and transects."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import geometry, joins
from strandline.registry import register
from strandline.sources import tables as T

_MEASURED = """m AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, coalesce(sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2), 0) AS length,
  ((degrees(atan2(lead(x) OVER w - x, lead(y) OVER w - y)) % 360) + 360) % 360 AS b FROM v_vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
s AS (SELECT *, sum(length) OVER (PARTITION BY line_id ORDER BY seq) - length AS s0 FROM m)"""


@register(T.sql(f""", {_MEASURED} SELECT line_id, seq, round(length, 6) AS length, round(coalesce(b, lag(b) OVER (PARTITION BY line_id ORDER BY seq)), 5) AS bearing FROM s""", "v_vertex"))
def segments(spark, sf_dir):
    """Length and bearing of each line segment."""
    return geometry.measured(T.vertex(spark, sf_dir)).select("line_id", "seq", F.round("length", 6).alias("length"), F.round("bearing", 5).alias("bearing"))


@register(T.sql(f""", {_MEASURED},
k AS (SELECT *, unnest(range(floor(s0 / 25)::BIGINT + 1, ceil((s0 + length) / 25)::BIGINT)) * 25.0::DOUBLE AS pos FROM s WHERE nx IS NOT NULL),
p AS (SELECT line_id, pos, x + (pos - s0) / length * (nx - x) AS x, y + (pos - s0) / length * (ny - y) AS y FROM k
  UNION ALL SELECT line_id, 0.0, x, y FROM s WHERE seq = 0 UNION ALL SELECT line_id, s0, x, y FROM s WHERE nx IS NULL)
SELECT line_id, round(pos, 4) AS "at", round(x, 4) AS x, round(y, 4) AS y FROM p""", "v_vertex"))
def resample(spark, sf_dir):
    """Vertices every 25 m along each line."""
    return geometry.resampled(T.vertex(spark, sf_dir), 25.0).select("line_id", *[F.round(c, 4).alias(c) for c in ("at", "x", "y")])


@register(T.sql(""", c AS (SELECT *, (lead(x) OVER w - x) * (lead(y, 2) OVER w - lead(y) OVER w) - (lead(y) OVER w - y) * (lead(x, 2) OVER w - lead(x) OVER w) AS c FROM v_vertex WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
t AS (SELECT *, sum(c) OVER (PARTITION BY line_id) AS turn FROM c)
SELECT line_id, CASE WHEN turn > 0 THEN 31 - seq ELSE seq END AS seq, round(x, 6) AS x, round(y, 6) AS y FROM t""", "v_vertex"))
def orientation(spark, sf_dir):
    """Lines turned to one side."""
    return geometry.oriented(T.vertex(spark, sf_dir)).select("line_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(T.sql(f""", {_MEASURED},
k AS (SELECT *, unnest(range(floor(s0 / 50)::BIGINT + 1, ceil((s0 + length) / 50)::BIGINT)) * 50.0::DOUBLE AS pos FROM s WHERE nx IS NOT NULL),
p AS (SELECT line_id, pos, x + (pos - s0) / length * (nx - x) AS x, y + (pos - s0) / length * (ny - y) AS y FROM k
  UNION ALL SELECT line_id, 0.0, x, y FROM s WHERE seq = 0 UNION ALL SELECT line_id, s0, x, y FROM s WHERE nx IS NULL),
a AS (SELECT *, atan2(lead(x) OVER w - x, lead(y) OVER w - y) AS b0, row_number() OVER w - 1 AS id FROM p WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
b AS (SELECT *, coalesce(b0, lag(b0) OVER (PARTITION BY line_id ORDER BY pos)) AS b FROM a)
SELECT line_id, id AS transect_id, round(x + 20 * sin(b - pi() / 2), 4) AS x0, round(y + 20 * cos(b - pi() / 2), 4) AS y0, round(x + 60 * sin(b + pi() / 2), 4) AS x1, round(y + 60 * cos(b + pi() / 2), 4) AS y1 FROM b""", "v_vertex"))
def shore_normals(spark, sf_dir):
    """Transects across each line every 50 m."""
    return geometry.shore_normals(T.vertex(spark, sf_dir), 50.0, 20.0, 60.0).select("line_id", "transect_id", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@register(T.sql(f""", {_MEASURED} SELECT line_id, count(*) AS n, round(sum(length), 5) AS total FROM s GROUP BY line_id HAVING sum(length) > 400""", "v_vertex"))
def long_lines(spark, sf_dir):
    """Lines over a minimum length."""
    m = geometry.measured(T.vertex(spark, sf_dir)).groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
    return m.where("total > 400").select("line_id", "n", F.round("total", 5).alias("total"))


@register(T.sql("SELECT line_id, seq, x, y FROM v_vertex", "v_vertex"))
def line_round_trip(spark, sf_dir):
    """Vertices put together as text and taken apart again."""
    return geometry.disassembled(geometry.assembled(T.vertex(spark, sf_dir)))


@register(T.sql("""SELECT line_id, count(*) AS n, 'LINESTRING (' || string_agg(x::DECIMAL(12, 3)::VARCHAR || ' ' || y::DECIMAL(12, 3)::VARCHAR, ', ' ORDER BY seq) || ')' AS wkt FROM v_vertex GROUP BY line_id""", "v_vertex"))
def line_texts(spark, sf_dir):
    """Each line as text, its coordinates in millimetres."""
    v = T.vertex(spark, sf_dir)
    return geometry.assembled(v.withColumns({c: F.col(c).cast("decimal(12,3)") for c in ("x", "y")}))


_HITS = """sg AS (SELECT line_id, seq, x AS xa, y AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM v_coast WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
j AS (SELECT *, (x1 - x0) * (yb - ya) - (y1 - y0) * (xb - xa) AS den FROM v_transect, sg WHERE xb IS NOT NULL AND greatest(xa, xb) >= least(x0, x1) AND least(xa, xb) <= greatest(x0, x1) AND greatest(ya, yb) >= least(y0, y1) AND least(ya, yb) <= greatest(y0, y1)),
u AS (SELECT *, ((xa - x0) * (yb - ya) - (ya - y0) * (xb - xa)) / den AS u, ((xa - x0) * (y1 - y0) - (ya - y0) * (x1 - x0)) / den AS v FROM j WHERE den <> 0),
h AS (SELECT transect_id, line_id, seq, x0 + u * (x1 - x0) AS x, y0 + u * (y1 - y0) AS y, u * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS dist, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM u WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1)"""


@register(T.sql(f""", {_HITS} SELECT transect_id, line_id, round(arg_min(x, (dist, seq)), 6) AS x, round(arg_min(y, (dist, seq)), 6) AS y, round(min(dist), 6) AS dist, round(min(dist) - any_value(len) / 2, 6) AS signed FROM h GROUP BY ALL""", "v_coast", "v_transect"))
def transects_hit(spark, sf_dir):
    """First crossing of each transect with each line, with its signed distance to the transect's midpoint."""
    found = joins.first_crossings(joins.crossings(T.transect(spark, sf_dir), joins.segments(T.coast(spark, sf_dir)), 20.0))
    return found.select("transect_id", "line_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "dist")], F.round(F.col("dist") - F.col("len") / 2, 6).alias("signed"))


@register(T.sql(""", c AS (SELECT *, floor(x / 10)::BIGINT AS cx, floor(y / 10)::BIGINT AS cy FROM v_coast), o AS (SELECT * FROM (VALUES (-1), (0), (1)) t(i), (VALUES (-1), (0), (1)) u(j)),
d AS (SELECT a.line_id, a.seq, b.line_id AS near_line, b.seq AS near_seq, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM c a, o JOIN c b ON b.cx = a.cx + o.i AND b.cy = a.cy + o.j AND b.line_id <> a.line_id)
SELECT line_id, seq, arg_min(near_line, (d, near_line, near_seq)) AS near_line, round(min(d), 6) AS d FROM d WHERE d <= 10 GROUP BY ALL""", "v_coast"))
def nearest_feature(spark, sf_dir):
    """Nearest vertex of other lines within 10 m of each vertex."""
    v = T.coast(spark, sf_dir)
    cell = lambda c: F.floor(F.col(c) / 10)
    around = lambda c: F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: cell(c) + k))
    a = v.withColumns({"cx": cell("x"), "cy": cell("y")})
    b = v.select(F.col("line_id").alias("near_line"), F.col("seq").alias("near_seq"), F.col("x").alias("bx"), F.col("y").alias("by"), around("x").alias("cx")).select("*", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.floor(F.col("by") / 10) + k)).alias("cy"))
    j = joins.by_cell(a, b, ["cx", "cy"]).where("line_id <> near_line").withColumn("d", F.sqrt((F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")))).where("d <= 10")
    return j.groupBy("line_id", "seq").agg(F.min_by("near_line", F.struct("d", "near_line", "near_seq")).alias("near_line"), F.round(F.min("d"), 6).alias("d"))


@register(T.sql(""", b AS (SELECT line_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v_coast GROUP BY line_id)
SELECT transect_id, count(*) AS n_lines, min(line_id) AS first_line, max(line_id) AS last_line FROM v_transect t JOIN b ON t.x0 <= b.x1 AND t.x1 >= b.x0 AND t.y0 <= b.y1 AND t.y1 >= b.y0 GROUP BY transect_id""", "v_coast", "v_transect"))
def tile_lookup(spark, sf_dir):
    """Lines whose box meets a transect's box."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 50), F.floor(F.col(b) / 50)))
    b = T.coast(spark, sf_dir).groupBy("line_id").agg(F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"))
    b = b.select("*", span("bx0", "bx1").alias("c")).select("*", span("by0", "by1").alias("d"))
    t = T.transect(spark, sf_dir).select("*", span("x0", "x1").alias("c")).select("*", span("y0", "y1").alias("d"))
    j = joins.by_cell(t, b, ["c", "d"]).where("x0 <= bx1 and x1 >= bx0 and y0 <= by1 and y1 >= by0").select("transect_id", "line_id").distinct()
    return j.groupBy("transect_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line"))
