"""Queries on the image catalogue: filters, counts, duplicates, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.registry import register
from strandline.sources import tables as T


@register(T.sql("""SELECT site, sat, count(*) AS n_all, count(*) FILTER (cloud <= 0.8) AS n_clear FROM v_image GROUP BY ALL""", "v_image"))
def cloud_filter(spark, sf_dir):
    """Images of each site and satellite, and those with at most 80 % cloud."""
    return T.image(spark, sf_dir).groupBy("site", "sat").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("cloud") <= 0.8).alias("n_clear"))


@register(T.sql("""SELECT sat, count(*) AS n FROM v_image WHERE site = 7 AND (acq_date BETWEEN DATE '1995-03-01' AND DATE '1996-02-29' OR acq_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') GROUP BY sat HAVING count(*) > 0""", "v_image"))
def availability(spark, sf_dir):
    """Images of a site in a list of date ranges, by satellite."""
    ranges = spark.createDataFrame([("1995-03-01", "1996-02-29"), ("1997-01-01", "1997-12-31")], "first string, last string").select(F.to_date("first").alias("first"), F.to_date("last").alias("last"))
    images = T.image(spark, sf_dir).where("site = 7")
    hit = images.join(F.broadcast(ranges), F.col("acq_date").between(F.col("first"), F.col("last")), "left_semi")  # the user's list of ranges
    return hit.groupBy("sat").agg(F.count(F.lit(1)).alias("n"))


@register(T.sql("""SELECT sat, count(*) AS n FROM v_image WHERE sat <> 'L9' OR acq_date < DATE '1997-05-31' GROUP BY sat""", "v_image"))
def scan_line_clip(spark, sf_dir):
    """A satellite's images only before its scan-line failure."""
    return T.image(spark, sf_dir).where((F.col("sat") != "L9") | (F.col("acq_date") < F.lit("1997-05-31").cast("date"))).groupBy("sat").agg(F.count(F.lit(1)).alias("n"))


@register(T.sql("""SELECT sat, CASE WHEN cloud > 0.95 THEN 'cloudy' WHEN length < 5000 THEN 'empty_poor' WHEN file % 50 = 3 THEN 'missing_mask' WHEN length < 10000 THEN 'no_contours' ELSE 'kept' END AS outcome, count(*) AS n FROM v_image GROUP BY ALL""", "v_image"))
def skip_routing(spark, sf_dir):
    """Each image's outcome by the first rule that skips it."""
    o = F.when(F.col("cloud") > 0.95, "cloudy").when(F.col("length") < 5000, "empty_poor").when(F.col("file") % 50 == 3, "missing_mask").when(F.col("length") < 10000, "no_contours").otherwise("kept")
    return T.image(spark, sf_dir).groupBy("sat", o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_SHIFT = ", ".join(f"('{k}', {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in S.COREGISTRATION.items())


@register(T.sql(f""", o(sat, dx, dy) AS (VALUES {_SHIFT}), w AS (SELECT site, sat, acq_date, avg(dx + cloud) AS dx, avg(dy - cloud) AS dy FROM v_image JOIN o USING (sat) GROUP BY ALL)
SELECT sat, date_trunc('month', acq_date)::DATE AS month, count(*) AS n, round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy, round(avg(sqrt(dx * dx + dy * dy)), 6) AS shift FROM w GROUP BY ALL""", "v_image"))
def shift_stats(spark, sf_dir):
    """Co-registration shifts: mean of each date, then of each month."""
    o = spark.createDataFrame([(k, x, y) for k, (x, y) in S.COREGISTRATION.items()], "sat string, dx double, dy double")
    w = T.image(spark, sf_dir).join(F.broadcast(o), "sat")  # five rows
    w = w.groupBy("site", "sat", "acq_date").agg(F.avg(F.col("dx") + F.col("cloud")).alias("dx"), F.avg(F.col("dy") - F.col("cloud")).alias("dy"))
    return w.groupBy("sat", F.to_date(F.date_trunc("month", "acq_date")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dx"), 6).alias("dx"), F.round(F.avg("dy"), 6).alias("dy"), F.round(F.avg(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), 6).alias("shift"))


@register(T.sql("""SELECT sat, acq_date, file, length FROM v_image QUALIFY row_number() OVER (PARTITION BY sat, acq_date ORDER BY length DESC, file DESC) = 1""", "v_image"))
def dedupe_longest(spark, sf_dir):
    """Of lines of one satellite and date the longest; the later on equal length."""
    return T.image(spark, sf_dir).groupBy("sat", "acq_date").agg(F.max(F.struct("length", "file")).alias("m")).select("sat", "acq_date", "m.file", "m.length")


@register(T.sql("""SELECT date_trunc('month', acq_date)::DATE AS month, count(*) AS n, count(*) FILTER (cloud < 0.5) AS usable, count(*) FILTER (cloud >= 0.5) AS cloudy, round(100 * count(*) FILTER (cloud >= 0.5) / count(*), 4) AS cloudy_share FROM v_image GROUP BY ALL""", "v_image"))
def image_counts(spark, sf_dir):
    """Images a month, usable and cloudy."""
    cloudy = F.count_if(F.col("cloud") >= 0.5)
    return T.image(spark, sf_dir).groupBy(F.to_date(F.date_trunc("month", "acq_date")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cloud") < 0.5).alias("usable"), cloudy.alias("cloudy"), F.round(100 * cloudy / F.count(F.lit(1)), 4).alias("cloudy_share"))


def merged_satellites(parts: list[DataFrame]) -> DataFrame:
    """Per-satellite tables under one schema; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@register(T.sql("""SELECT site, row_number() OVER (PARTITION BY site ORDER BY acq_date, file) - 1 AS idx, file, sat, acq_date, CASE WHEN sat = 'S2' THEN cloud END AS cloud FROM v_image""", "v_image"))
def merge_satellites(spark, sf_dir):
    """Satellites' tables merged, sorted by date and numbered anew within each site."""
    i = T.image(spark, sf_dir)
    parts = [i.where(F.col("sat") == s).select("site", "file", "acq_date", F.lit(s).alias("sat"), *(["cloud"] if s == "S2" else [])) for s in ("L8", "L9", "S2")]
    return merged_satellites(parts).withColumn("idx", (F.row_number().over(Window.partitionBy("site").orderBy("acq_date", "file")) - 1).cast("long")).select("site", "idx", "file", "sat", "acq_date", "cloud")


@register(T.sql(""", d AS (SELECT DISTINCT site, sat FROM v_image WHERE acq_date < DATE '1995-02-01'), a AS (SELECT DISTINCT site, sat FROM v_image WHERE acq_date >= DATE '1995-01-15' AND acq_date < DATE '1995-02-15')
SELECT site, sat, 'one side' AS part FROM ((SELECT * FROM d EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM d)) UNION ALL (SELECT site, sat, 'both' FROM (SELECT * FROM d INTERSECT SELECT * FROM a))""", "v_image"))
def done_todo(spark, sf_dir):
    """Site and satellite pairs in one of two periods, and in both."""
    i = T.image(spark, sf_dir)
    d = i.where("acq_date < date'1995-02-01'").select("site", "sat").distinct()
    a = i.where("acq_date >= date'1995-01-15' and acq_date < date'1995-02-15'").select("site", "sat").distinct()
    return d.exceptAll(a).union(a.exceptAll(d)).withColumn("part", F.lit("one side")).union(d.intersect(a).withColumn("part", F.lit("both")))


@register(T.sql("""SELECT file, sat, acq_date FROM v_image WHERE (site, sat) NOT IN (SELECT DISTINCT site, sat FROM v_image WHERE acq_date < DATE '1995-01-20')""", "v_image"))
def resume(spark, sf_dir):
    """Images whose site and satellite have not been processed yet."""
    i = T.image(spark, sf_dir)
    done = i.where("acq_date < date'1995-01-20'").select("site", "sat").distinct()
    return i.join(done, ["site", "sat"], "left_anti").select("file", "sat", "acq_date")


@register(T.sql("""SELECT file, substr('S2_' || file || '_x.tif', 1, 2) AS sat_part, split_part('S2_' || file || '_x.tif', '_', 2)::BIGINT AS id_part, strftime(acq_date, '%Y%m%d') AS stamp, dayofyear(acq_date) AS doy, year(acq_date) - CASE WHEN month(acq_date) < 9 THEN 1 ELSE 0 END AS season,
  round((acq_date - DATE '1990-01-01') / 365.2425, 6) AS years FROM v_image""", "v_image"))
def name_parts(spark, sf_dir):
    """Parts of file names and of dates."""
    name = F.concat(F.lit("S2_"), F.col("file").cast("string"), F.lit("_x.tif"))
    d = F.col("acq_date")
    return T.image(spark, sf_dir).select("file", F.substring_index(name, "_", 1).alias("sat_part"), F.split(name, "_")[1].cast("long").alias("id_part"), F.date_format(d, "yyyyMMdd").alias("stamp"), F.dayofyear(d).cast("long").alias("doy"), (F.year(d) - F.when(F.month(d) < 9, 1).otherwise(0)).cast("long").alias("season"), F.round(F.datediff(d, F.lit("1990-01-01")) / S.DAYS_A_YEAR, 6).alias("years"))


@register(T.sql(""", r AS (SELECT sat, cloud, (length - 100000) / 1000 AS e FROM v_image)
SELECT sat, round(sqrt(min(m)), 6) AS best_rmse, arg_min(band, (m, band)) AS best_band FROM (SELECT sat, floor(cloud * 10)::BIGINT AS band, avg(e * e) AS m FROM r GROUP BY ALL) GROUP BY sat""", "v_image"))
def best_threshold(spark, sf_dir):
    """The band with the smallest error of each satellite."""
    e = (F.col("length") - 100000) / 1000
    m = T.image(spark, sf_dir).groupBy("sat", F.floor(F.col("cloud") * 10).alias("band")).agg(F.avg(e * e).alias("m"))
    return m.groupBy("sat").agg(F.round(F.sqrt(F.min("m")), 6).alias("best_rmse"), F.min_by("band", F.struct("m", "band")).alias("best_band"))
