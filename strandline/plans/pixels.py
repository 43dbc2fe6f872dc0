"""Queries on pixel tables: an image's pixels as rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.registry import register
from strandline.sources import tables as T


@register(T.sql("""SELECT image_id, "row", col, round((a - b) / nullif(a + b, 0), 4) AS nd, round((a - b) / (abs(a) + abs(b) + 0.5) * 1.5, 6) AS savi, CASE WHEN a > 0.2 THEN NULL ELSE round(a, 6) END AS masked FROM v_pixel WHERE abs(a + b) > 0.001""", "v_pixel"))
def indices(spark, sf_dir):
    """Spectral indices of each pixel, and a band with clouded pixels masked."""
    p = T.pixel(spark, sf_dir).where("abs(a + b) > 0.001")
    a, b = F.col("a"), F.col("b")
    return p.select("image_id", "row", "col", F.round(S.normalized_difference(a, b), 4).alias("nd"), F.round((a - b) / (F.abs(a) + F.abs(b) + 0.5) * 1.5, 6).alias("savi"), F.when(a > 0.2, F.lit(None)).otherwise(F.round(a, 6)).alias("masked"))


def neighbour_std(pixels, band: str, size: int):
    """Population standard deviation of the 3 x 3 neighbourhood; beyond the edge the image is mirrored on its border pixels."""
    # a pixel is sent to those whose neighbourhood holds it, to itself twice along an edge; rows meet in one aggregate, without a join
    to = lambda c: F.filter(F.array(c - 1, c, c + 1, F.when((c == 0) | (c == size - 1), c)), lambda k: k.isNotNull() & (k >= 0) & (k < size))
    sent = pixels.select("image_id", band, F.col("row").alias("_r"), F.col("col").alias("_c"), F.explode(to(F.col("row"))).alias("row")).select("*", F.explode(to(F.col("_c"))).alias("col"))
    own = F.max((F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")))
    return sent.groupBy("image_id", "row", "col").agg(F.stddev_pop(band).alias("std"), own.alias("_own")).where("_own").drop("_own")


@register(T.sql(""", o AS (SELECT * FROM (VALUES (-1), (0), (1)) t(i), (VALUES (-1), (0), (1)) u(j)), w AS (SELECT p.image_id, p."row", p.col, p."row" + i AS r, p.col + j AS c FROM v_pixel p, o),
m AS (SELECT image_id, "row", col, CASE WHEN r < 0 THEN -r - 1 WHEN r > 7 THEN 15 - r ELSE r END AS r, CASE WHEN c < 0 THEN -c - 1 WHEN c > 7 THEN 15 - c ELSE c END AS c FROM w)
SELECT m.image_id, m."row", m.col, round(stddev_pop(p.a), 6) AS std FROM m JOIN v_pixel p ON p.image_id = m.image_id AND p."row" = m.r AND p.col = m.c GROUP BY ALL""", "v_pixel"))
def neighbour_deviation(spark, sf_dir):
    """Neighbourhood standard deviation of a band."""
    return neighbour_std(T.pixel(spark, sf_dir), "a", 8).select("image_id", "row", "col", F.round("std", 6).alias("std"))


@register(T.sql(""", h AS (SELECT image_id, least(255, floor((a + 0.5) * 256)::BIGINT) AS b, count(*) AS n FROM v_pixel WHERE a BETWEEN -0.5 AND 0.5 GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS w0, sum(n * b) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS w, sum(n * b) OVER (PARTITION BY image_id) AS s FROM h WINDOW w AS (PARTITION BY image_id ORDER BY b)),
v AS (SELECT image_id, b, round(w0::DOUBLE * (w - w0) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / nullif(w - w0, 0)) ** 2, 6) AS between FROM c)
SELECT image_id, arg_min(b, (-between, b)) AS threshold_bin FROM v WHERE between IS NOT NULL GROUP BY image_id""", "v_pixel"))
def otsu(spark, sf_dir):
    """Threshold of each image that parts its histogram of 256 bins best."""
    h = T.pixel(spark, sf_dir).where("a between -0.5 and 0.5").groupBy("image_id", F.least(F.lit(255).cast("long"), F.floor((F.col("a") + 0.5) * 256)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w, p = Window.partitionBy("image_id").orderBy("b"), Window.partitionBy("image_id")
    nb = F.col("n") * F.col("b")
    c = h.withColumns({"w0": F.sum("n").over(w).cast("double"), "s0": F.sum(nb).over(w).cast("double"), "w": F.sum("n").over(p).cast("double"), "s": F.sum(nb).over(p).cast("double")})
    gap = F.col("s0") / F.col("w0") - F.try_divide(F.col("s") - F.col("s0"), F.col("w") - F.col("w0"))
    v = c.withColumn("between", F.round(F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap, 6)).where("between is not null")
    return v.groupBy("image_id").agg(F.min_by("b", F.struct(-F.col("between"), "b")).alias("threshold_bin"))


@register(T.sql(""", z AS (SELECT image_id, quantile_cont(a, 0.005) AS lo, quantile_cont(a, 0.10) AS hi, quantile_cont(a, 0.999) AS top FROM v_pixel GROUP BY image_id)
SELECT image_id, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, count(*) FILTER (a > lo AND a < hi) AS n_between, round(avg(least(1, greatest(0, a / top))), 6) AS stretched FROM v_pixel JOIN z USING (image_id) GROUP BY image_id""", "v_pixel"))
def zone_limits(spark, sf_dir):
    """Limits of the transition zone, pixels strictly within it, and the mean of the stretched band."""
    p = T.pixel(spark, sf_dir)
    q = p.groupBy("image_id").agg(F.percentile("a", [0.005, 0.10, 0.999]).alias("q")).select("image_id", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), F.col("q")[2].alias("top"))
    j = p.join(q, "image_id")
    return j.groupBy("image_id").agg(F.round(F.first("lo"), 6).alias("lo"), F.round(F.first("hi"), 6).alias("hi"), F.count_if((F.col("a") > F.col("lo")) & (F.col("a") < F.col("hi"))).alias("n_between"), F.round(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("a") / F.col("top")))), 6).alias("stretched"))


@register(T.sql(""", f AS (SELECT *, abs(a) < 0.001 AS nodata, a > 0.15 AS cloud FROM v_pixel)
SELECT image_id, count(*) FILTER (nodata) AS n_nodata, round(count(*) FILTER (cloud <> nodata) / count(*) FILTER (NOT nodata), 6) AS cloud_share FROM f GROUP BY image_id HAVING count(*) FILTER (cloud) / count(*) <= 0.2""", "v_pixel"))
def cloud_share(spark, sf_dir):
    """Cloud share of the images that aren't rejected for cloud."""
    f = T.pixel(spark, sf_dir).withColumns({"nodata": F.abs("a") < 0.001, "cloud": F.col("a") > 0.15})
    g = f.groupBy("image_id").agg(F.count_if("nodata").alias("n_nodata"), F.round(F.count_if(F.col("cloud") != F.col("nodata")) / F.count_if(~F.col("nodata")), 6).alias("cloud_share"), (F.count_if("cloud") / F.count(F.lit(1))).alias("c"))
    return g.where("c <= 0.2").drop("c")


@register(T.sql(""", o AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= 4),
d AS (SELECT DISTINCT image_id, "row" + i AS "row", col + j AS col FROM v_pixel, o WHERE a > 0.2 AND "row" + i BETWEEN 0 AND 7 AND col + j BETWEEN 0 AND 7)
SELECT image_id, count(*) AS n_dilated, min("row") AS top, max("row") AS bottom FROM d GROUP BY image_id""", "v_pixel"))
def dilation(spark, sf_dir):
    """Mask grown by a disk of radius two."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4])
    d = T.pixel(spark, sf_dir).where("a > 0.2").select("image_id", "row", "col", F.explode(steps).alias("s")).select("image_id", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col")).where("row between 0 and 7 and col between 0 and 7").distinct()
    return d.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_dilated"), F.min("row").alias("top"), F.max("row").alias("bottom"))


@register(T.sql(""", c AS (SELECT image_id, CASE WHEN a > 0.1 THEN 1 WHEN a > 0 THEN 2 ELSE 3 END AS k FROM v_pixel)
SELECT image_id, count(*) FILTER (k = 1) AS veg, count(*) FILTER (k = 2) AS sand, count(*) FILTER (k = 3) AS water FROM c GROUP BY image_id HAVING count(*) FILTER (k = 1) / count(*) >= 0.05""", "v_pixel"))
def class_shares(spark, sf_dir):
    """Pixels of each class, of images where a class has at least 5 %."""
    k = F.when(F.col("a") > 0.1, "veg").when(F.col("a") > 0, "sand").otherwise("water")
    c = T.pixel(spark, sf_dir).select("image_id", k.alias("k")).groupBy("image_id").pivot("k", ["veg", "sand", "water"]).agg(F.count(F.lit(1))).na.fill(0)
    return c.where("veg / (veg + sand + water) >= 0.05")


_INDEX_SQL = """i AS (SELECT image_id, "row", col, a > 0.05 AS veg, (a - b) / (abs(a) + abs(b) + 0.5) AS nd FROM v_pixel)"""


def index_classes(pixels):
    """Pixels with their class and index."""
    return pixels.select("image_id", "row", "col", (F.col("a") > 0.05).alias("veg"), ((F.col("a") - F.col("b")) / (F.abs("a") + F.abs("b") + 0.5)).alias("nd"))
