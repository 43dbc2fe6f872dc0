"""Queries that write derived tables as files and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators.rounds import shared_folder
from strandline.registry import register
from strandline.sources import files
from strandline.sources import tables as T


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@register(T.sql("SELECT line_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM v_coast", "v_coast"))
def line_files(spark, sf_dir):
    """Lines written as features, one a row, and read again."""
    at = _folder(spark)
    files.write_lines(T.coast(spark, sf_dir), at)
    return files.read_line_rows(spark, at).select(F.col("line_id").cast("long").alias("line_id"), "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(T.sql("SELECT event_id, transect_id, sat, round(x0 + dist / 100, 6) AS x, round(y0 + dist, 6) AS y, dist AS z FROM v_obs JOIN v_transect USING (transect_id)", "v_obs", "v_transect"))
def point_files(spark, sf_dir):
    """Observed points with their transect and satellite written as features and read again."""
    at = _folder(spark)
    o = T.obs(spark, sf_dir).join(T.transect(spark, sf_dir), "transect_id")
    files.write_points(o.select("event_id", "transect_id", "sat", (F.col("x0") + F.col("dist") / 100).alias("x"), (F.col("y0") + F.col("dist")).alias("y"), F.col("dist").alias("z")), at, z="z")
    p = files.read_points(spark, at, ["event_id", "transect_id", "sat"])
    return p.select(F.col("event_id").cast("long").alias("event_id"), F.col("transect_id").cast("long").alias("transect_id"), "sat", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


@register(T.sql("SELECT date, tide FROM v_tide", "v_tide"))
def tide_files(spark, sf_dir):
    """The tide series written as CSV with a header and read again."""
    at = _folder(spark)
    T.tide(spark, sf_dir).write.option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(at, header=True)
    return files.read_tides(spark, at)


@register(T.sql("""SELECT 'S' || storm_id AS name, start::DATE AS "start", "end"::DATE AS "end", floor(gust)::INT AS gust, "end"::DATE - start::DATE AS days FROM v_storm""", "v_storm"))
def storm_files(spark, sf_dir):
    """The storm catalogue written as CSV with days as text and read again."""
    at = _folder(spark)
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    s = T.storm(spark, sf_dir).select(F.concat(F.lit("S"), F.col("storm_id")).alias("Name"), day("start").alias("Start"), day("end").alias("End"), F.floor("gust").cast("int").alias("WindGust"))
    s.write.csv(at, header=True)
    return files.read_storms(spark, at)


@register(T.sql("""SELECT strftime(acq_date, '%Y%m%d') || '_' || sat || '_' || file AS file, acq_date, CASE WHEN file % 7 = 0 THEN 12.0 ELSE (file % 7)::DOUBLE END AS acc_georef FROM v_image""", "v_image"))
def catalogue_files(spark, sf_dir):
    """The image catalogue written as CSV and read again: dates from the files' names, a default where accuracy is missing."""
    at = _folder(spark)
    i = T.image(spark, sf_dir)
    name = F.concat_ws("_", F.date_format("acq_date", "yyyyMMdd"), "sat", F.col("file").cast("string"))
    i.select(name.alias("file"), F.when(F.col("file") % 7 != 0, F.col("file") % 7).alias("acc_georef")).write.csv(at, header=True)
    return files.catalogue(spark.read.schema("file string, acc_georef string").csv(at, header=True)).select("file", "acq_date", "acc_georef")


@register(T.sql("""SELECT transect_id, kind, row_number() OVER (PARTITION BY transect_id, kind ORDER BY acq_ts, event_id) - 1 AS place, CASE WHEN event_id % 9 > 0 THEN round(dist, 2) END AS dist FROM v_obs""", "v_obs"))
def result_files(spark, sf_dir):
    """Lists of positions per transect with masked ones among them, cleaned, rounded, written as text by kind, and taken apart again."""
    at = _folder(spark)
    o = T.obs(spark, sf_dir).withColumn("text", F.when(F.col("event_id") % 9 == 0, F.element_at(F.array(*[F.lit(v) for v in ("masked", "--", "nan")]), (F.col("event_id") % 3 + 1).cast("int"))).otherwise(F.col("dist").cast("string")))
    lists = o.groupBy("transect_id", "kind").agg(F.array_sort(F.collect_list(F.struct("acq_ts", "event_id", "text")))["text"].alias("dist"))
    files.write_results(lists.withColumn("dist", S.clean_list(F.col("dist"))), at, "kind", {"dist": 2})
    back = spark.read.parquet(at).select("transect_id", "kind", F.posexplode(F.from_json("dist", "array<double>")).alias("place", "dist"))
    return back.select("transect_id", "kind", F.col("place").cast("long").alias("place"), "dist")


@register(T.sql(""", r AS (SELECT line_id // 2 AS run, line_id % 2 AS side, seq, x, y FROM v_coast WHERE line_id // 2 IN (SELECT line_id // 2 FROM v_coast GROUP BY line_id // 2 HAVING count(DISTINCT line_id) = 2)),
k AS (SELECT run, x, y, row_number() OVER (PARTITION BY run ORDER BY side, CASE side WHEN 0 THEN seq ELSE -seq END) AS k FROM r),
n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM k WINDOW w AS (PARTITION BY run ORDER BY k))
SELECT run, round(abs(sum(x * ny - nx * y)) / 2, 4) AS area, count(*) + 1 AS points FROM n GROUP BY run""", "v_coast"))
def patch_areas(spark, sf_dir):
    """Rings between neighbouring lines, with their area."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    lines = T.coast(spark, sf_dir).groupBy("line_id").agg(points.alias("points"))
    lines = lines.select(F.floor(F.col("line_id") / 2).alias("run"), (F.col("line_id") % 2).cast("string").alias("kind"), "points")
    return files.between_lines(lines, "0", "1").select("run", F.round("area", 4).alias("area"), F.size("ring").cast("long").alias("points"))


@register(T.sql("""SELECT image_id AS raster_id, "row", col, CASE WHEN round(a, 1) <> 0 THEN round(a, 1) END AS v, round(100 * image_id + (col + 0.5::DOUBLE) * 15, 6) AS x, round(8000 - 15 * ("row" + 0.5::DOUBLE), 6) AS y FROM v_pixel""", "v_pixel"))
def raster_cells(spark, sf_dir):
    """Raster cells placed by their raster's origin and cell size; a value that stands for no data is null."""
    p = T.pixel(spark, sf_dir).select(F.col("image_id").alias("raster_id"), "row", "col", F.round("a", 1).alias("v"))
    place = p.select("raster_id").distinct().select("raster_id", (100.0 * F.col("raster_id")).alias("x0"), F.lit(15.0).alias("dx"), F.lit(8000.0).alias("y0"), F.lit(-15.0).alias("dy"))
    return files.cells(p, 0.0, place).select("raster_id", "row", "col", "v", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(T.sql("""SELECT site, class, label, image_id, "row", col, round(a, 9) AS a, round(coalesce(b, 1e-9), 9) AS b FROM (
  SELECT image_id % 5 AS site, CASE WHEN a > 0.1 THEN 'sand' WHEN a > -0.1 THEN 'water' ELSE 'other' END AS class, CASE WHEN a > 0.1 THEN 1 WHEN a > -0.1 THEN 2 END AS label, image_id, "row", col, a, CASE WHEN b > -0.2 THEN b END AS b FROM v_pixel) WHERE class <> 'other' AND site IN (0, 2, 3)""", "v_pixel"))
def labelled_pixels(spark, sf_dir):
    """Labelled pixels written by site and class; three sites and two classes read again, stacked with their numbers."""
    at = _folder(spark)
    kind = F.when(F.col("a") > 0.1, "sand").when(F.col("a") > -0.1, "water").otherwise("other")
    p = T.pixel(spark, sf_dir).select((F.col("image_id") % 5).alias("site"), kind.alias("class"), "image_id", "row", "col", "a", F.when(F.col("b") > -0.2, F.col("b")).alias("b"))
    files.write_labels(p, at)
    found = files.read_labels(spark, at, {"sand": 1, "water": 2}, [0, 2, 3])
    return found.select(F.col("site").cast("long").alias("site"), "class", "label", "image_id", "row", "col", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))
