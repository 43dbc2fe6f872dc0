"""Queries on what other queries derive: validation, pooled results, envelopes, extended transects, buffers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import geometry, joins
from strandline.plans.pixels import _INDEX_SQL, index_classes
from strandline.plans.series import _DAILY_KIND, _daily_kind
from strandline.plans.shore import _FUTURE, _level, future
from strandline.registry import register
from strandline.sources import tables as T


@register(T.sql(f""", {_DAILY_KIND}, o AS (SELECT * FROM v_obs WHERE kind = 'VE'),
j AS (SELECT o.event_id, o.sat, o.dist - d.dist AS e, row_number() OVER (PARTITION BY o.event_id ORDER BY abs(d.day - o.acq_ts::DATE), d.day) AS r FROM o LEFT JOIN d ON d.kind = 'WL' AND d.transect_id = o.transect_id AND abs(d.day - o.acq_ts::DATE) <= 3)
SELECT event_id, sat, round(e, 6) AS error FROM j WHERE r = 1""", "v_obs"))
def validation_errors(spark, sf_dir):
    """Signed difference of each satellite position from the ground truth of its transect nearest in time; null without one."""
    o = T.obs(spark, sf_dir).where("kind = 'VE'").select("event_id", "sat", "transect_id", "dist", F.unix_date(F.to_date("acq_ts")).alias("n"))
    truth = _daily_kind(spark, sf_dir).where("kind = 'WL'").select("transect_id", "dist", F.unix_date("day").alias("d"))
    return joins.nearest_in_time(o, truth, ["transect_id"], "n", "d", 3).select("event_id", "sat", F.round(F.col("dist") - F.col("r_dist"), 6).alias("error"))


@register(T.sql("""SELECT series, transect_id, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'VE' AS series, transect_id, dist AS value FROM v_obs WHERE kind = 'VE' UNION ALL SELECT 'WL', transect_id, dist FROM v_obs WHERE kind = 'WL' UNION ALL SELECT 'both', transect_id, dist FROM v_obs) GROUP BY ALL""", "v_obs"))
def pooled_results(spark, sf_dir):
    """Two series and their pool under one schema."""
    o = T.obs(spark, sf_dir)
    part = lambda name, where: o.where(where).select(F.lit(name).alias("series"), "transect_id", F.col("dist").alias("value"))
    both = part("VE", "kind = 'VE'").unionByName(part("WL", "kind = 'WL'")).unionByName(part("both", "true"))
    return both.groupBy("series", "transect_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register(T.sql(f""", {_FUTURE.format(rate='1')}, e AS (SELECT transect_id, year, unnest([dist - 5 - 0.5 * (year - year0), dist, dist + 5 + 0.5 * (year - year0)]) AS d FROM f)
SELECT transect_id, year::BIGINT AS year, round(min(d), 5) AS landward, round(max(d), 5) AS seaward FROM e GROUP BY ALL""", "v_survey"))
def error_envelope(spark, sf_dir):
    """Least and greatest future position under the position and rate errors."""
    f = future(T.survey(spark, sf_dir), [2030, 2050, 2100], F.lit(0.05), F.lit(2), _level, F.lit(1))
    error = 5 + 0.5 * (F.col("year") - F.col("year0"))
    e = f.select("transect_id", "year", F.explode(F.array(F.col("dist") - error, F.col("dist"), F.col("dist") + error)).alias("d"))
    return e.groupBy("transect_id", "year").agg(F.round(F.min("d"), 5).alias("landward"), F.round(F.max("d"), 5).alias("seaward"))


@register(T.sql(f""", {_FUTURE.format(rate='1')}, v AS (SELECT transect_id, avg(CASE WHEN kind = 'VE' THEN dist END) - avg(CASE WHEN kind = 'WL' THEN dist END) AS gap FROM v_obs GROUP BY transect_id)
SELECT transect_id, year::BIGINT AS year, round(dist + gap, 5) AS edge FROM f JOIN v USING (transect_id)""", "v_survey", "v_obs"))
def future_edge(spark, sf_dir):
    """Future vegetation edge: the future shoreline and the transect's present mean width."""
    f = future(T.survey(spark, sf_dir), [2030, 2050, 2100], F.lit(0.05), F.lit(2), _level, F.lit(1))
    of = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("dist")))
    v = T.obs(spark, sf_dir).groupBy("transect_id").agg((of("VE") - of("WL")).alias("gap"))
    return f.join(v, "transect_id").select("transect_id", "year", F.round(F.col("dist") + F.col("gap"), 5).alias("edge"))


@register(T.sql("""SELECT transect_id, round(x0 - 10 * (x1 - x0) / l, 6) AS x0, round(y0 - 10 * (y1 - y0) / l, 6) AS y0, round(x1 + 25 * (x1 - x0) / l, 6) AS x1, round(y1 + 25 * (y1 - y0) / l, 6) AS y1, round(x0 + 30 * (x1 - x0) / l, 6) AS px, round(y0 + 30 * (y1 - y0) / l, 6) AS py
FROM (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS l FROM v_transect)""", "v_transect"))
def extended_transects(spark, sf_dir):
    """Transects made longer at both ends, and the point 30 m along each."""
    t = T.transect(spark, sf_dir)
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    ux, uy = (F.col("x1") - F.col("x0")) / length, (F.col("y1") - F.col("y0")) / length
    r = lambda c, n: F.round(c, 6).alias(n)
    return t.select("transect_id", r(F.col("x0") - 10 * ux, "x0"), r(F.col("y0") - 10 * uy, "y0"), r(F.col("x1") + 25 * ux, "x1"), r(F.col("y1") + 25 * uy, "y1"), r(F.col("x0") + 30 * ux, "px"), r(F.col("y0") + 30 * uy, "py"))


@register(T.sql(""", g AS (SELECT line_id, x AS xa, y AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM v_coast WHERE cls = 5 WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
p AS (SELECT line_id, seq, x, y FROM v_coast WHERE cls <> 5),
d AS (SELECT p.line_id, p.seq, greatest(0, least(1, ((x - xa) * (xb - xa) + (y - ya) * (yb - ya)) / ((xb - xa) ** 2 + (yb - ya) ** 2))) AS t, x, y, xa, ya, xb, yb FROM p JOIN g ON xb IS NOT NULL AND x BETWEEN least(xa, xb) - 2 AND greatest(xa, xb) + 2 AND y BETWEEN least(ya, yb) - 2 AND greatest(ya, yb) + 2)
SELECT DISTINCT line_id, seq FROM d WHERE sqrt((x - xa - t * (xb - xa)) ** 2 + (y - ya - t * (yb - ya)) ** 2) <= 2""", "v_coast"))
def within_buffer(spark, sf_dir):
    """Vertices of other lines within 2 m of reference lines (class 5)."""
    v = T.coast(spark, sf_dir)
    g = joins.segments(v.where("cls = 5")).drop("line_id", "seq")
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(F.col(a), F.col(b)) - 2) / 10), F.floor((F.greatest(F.col(a), F.col(b)) + 2) / 10)))
    g = g.select("*", span("xa", "xb").alias("cx")).select("*", span("ya", "yb").alias("cy"))
    p = v.where("cls <> 5").withColumns({"cx": F.floor(F.col("x") / 10), "cy": F.floor(F.col("y") / 10)})
    near = joins.point_to_segment(F.col("x"), F.col("y"), F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")) <= 2
    return p.join(g, ["cx", "cy"]).where(near).select("line_id", "seq").distinct()


@register(T.sql(f""", {_INDEX_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY image_id, veg ORDER BY md5((image_id * 64 + "row" * 8 + col)::VARCHAR), "row", col) AS r, count(*) OVER (PARTITION BY image_id, veg) AS n FROM i),
s AS (SELECT image_id, CASE WHEN count(DISTINCT veg) = 2 THEN min(n) ELSE 0 END AS size FROM c GROUP BY image_id)
SELECT image_id, veg, count(*) AS n, round(avg(nd), 6) AS nd FROM c JOIN s USING (image_id) WHERE r <= size GROUP BY ALL""", "v_pixel"))
def balanced_pixels(spark, sf_dir):
    """Index values of two classes of an image, the larger cut down in order of a hash."""
    i = index_classes(T.pixel(spark, sf_dir))
    sizes = i.groupBy("image_id", "veg").count().groupBy("image_id").agg(F.min("count").alias("size"), F.count(F.lit(1)).alias("k")).where("k = 2")
    h = F.md5((F.col("image_id") * 64 + F.col("row") * 8 + F.col("col")).cast("string"))
    c = i.withColumn("r", F.row_number().over(Window.partitionBy("image_id", "veg").orderBy(h, "row", "col")))
    return c.join(sizes, "image_id").where("r <= size").groupBy("image_id", "veg").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("nd"), 6).alias("nd"))


_SMOOTH = "CASE WHEN k > 1 AND k < n THEN " + " + ".join(
    f"{weight} * " + ("{c}" if d == 0 else f"coalesce(lead({{c}}, {d}) OVER w, lag({{c}}, {d}) OVER w, {{c}})" if d > 0 else f"coalesce(lag({{c}}, {-d}) OVER w, lead({{c}}, {-d}) OVER w, {{c}})")
    for weight, d in zip(geometry._FIVE, range(-2, 3), strict=True)
) + " ELSE {c} END"


@register(T.sql(f""", k AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY line_id) AS n FROM v_vertex)
SELECT line_id, seq, round({_SMOOTH.format(c="x")}, 6) AS x, round({_SMOOTH.format(c="y")}, 6) AS y FROM k WINDOW w AS (PARTITION BY line_id ORDER BY seq)""", "v_vertex"))
def smoothed_lines(spark, sf_dir):
    """Lines after a five-point quadratic smoothing that keeps their ends."""
    return geometry.smoothed(T.vertex(spark, sf_dir)).select("line_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
