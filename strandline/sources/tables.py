"""The given tables as coastal inputs: observations, tides, waves, storms, images, surveys, lines and pixels.

Each view is a DataFrame here and the same expression as a DuckDB common table expression in ``CTES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its timestamps without zone become timestamps (the session's zone is UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def micros(c: str = "acq_ts"):
    return F.unix_micros(F.col(c))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge (VE) and waterline (WL) observations of transects."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    sat = F.element_at(F.array(F.lit("L8"), F.lit("L9"), F.lit("S2")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("user_id").alias("transect_id"), F.col("ts").alias("acq_ts"), F.when(F.col("event_type") == "view", "VE").otherwise("WL").alias("kind"), F.col("value").alias("dist"), sat.alias("sat"), "event_id")


def tide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.groupBy("ts").agg(F.min_by("value", "event_id").alias("value")).select(F.col("ts").alias("date"), (F.col("value") / 50 - 1).alias("tide"))


def wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select((F.col("user_id") % 10).alias("cell_id"), F.col("ts").alias("t"), (F.col("value") / 25).alias("hs"), ((F.col("event_id") * 37) % 360).cast("double").alias("dir"), (3 + k / 10).alias("tp"), "event_id")


def storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error' and value > 100")
    return e.select(F.col("event_id").alias("storm_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 6 hours")).alias("end"), F.col("value").alias("gust"))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    sat = F.when(F.col("o_orderstatus") == "F", "L8").when(F.col("o_orderstatus") == "O", "S2").otherwise("L9")
    return o.select(F.col("o_orderkey").alias("file"), F.to_date("o_orderdate").alias("acq_date"), sat.alias("sat"), F.col("o_totalprice").alias("length"), ((F.col("o_orderkey") % 100) / 100).alias("cloud"), (F.col("o_custkey") % 25).alias("site"))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("transect_id"), F.year("l_shipdate").cast("long").alias("year")).agg(F.avg("l_quantity").alias("dist"))
    return i.withColumn("error", F.when(F.col("year") < 1996, 5.0).when(F.col("year") < 1999, 2.0).otherwise(1.0))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("transect_id"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("y"))


def vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines of 32 vertices."""
    e = table(spark, sf_dir, "embeddings")
    pairs = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((i * 10 + 20 * F.get("embedding", i * 2).cast("double")).alias("x"), (50 * F.get("embedding", i * 2 + 1).cast("double")).alias("y"))))
    return e.select(F.col("vec_id").alias("line_id"), pairs.alias("seq", "p")).select("line_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y")


def transect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transect of 120 m for every part, all along the coast."""
    p = table(spark, sf_dir, "part")
    x, y = 3 + (F.col("p_partkey") * 37 % 3000) / 10, 2.5 * F.col("p_partkey") - 60
    return p.select(F.col("p_partkey").alias("transect_id"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size") / 10).alias("x1"), (y + 120).alias("y1"))


def coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polylines set side by side, 5 m apart, with a class each."""
    v = vertex(spark, sf_dir).withColumn("y", F.col("y") + 5.0 * F.col("line_id"))
    return v.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_id"), F.col("label").cast("long").alias("cls")), "line_id")


def tangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines of 32 vertices that cross themselves about ten times."""
    e = table(spark, sf_dir, "embeddings")
    pairs = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((i * 3 + 60 * F.get("embedding", i * 2).cast("double")).alias("x"), (60 * F.get("embedding", i * 2 + 1).cast("double")).alias("y"))))
    return e.select(F.col("vec_id").alias("line_id"), pairs.alias("seq", "p")).select("line_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y")


def piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polylines cut into eight pieces of five vertices that share their ends, numbered out of order and every third turned round."""
    v = coast(spark, sf_dir).select("line_id", "seq", "x", "y", F.explode(F.sequence(F.floor(F.greatest(F.col("seq") - 1, F.lit(0)) / 4), F.floor(F.least(F.col("seq"), F.lit(31)) / 4))).alias("p"))
    at, n = F.col("seq") - 4 * F.col("p"), F.when(F.col("p") == 7, 3).otherwise(4)
    turned = (F.col("line_id") + F.col("p")) % 3 == 0
    return v.select((F.col("line_id") * 8 + (F.col("p") * 5 + 3) % 8).alias("line_id"), F.when(turned, n - at).otherwise(at).alias("seq"), "x", "y")


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 8 x 8 pixels: band a of the image, band b of the image with the next id."""
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("a"), (F.col("label") % 2).cast("long").alias("cls"))
    b = e.select((F.col("vec_id") - 1).alias("image_id"), F.col("embedding").alias("b"))
    # images are joined whole, then cut into pixels
    p = a.join(b, "image_id").select("image_id", "cls", F.least(F.size("a"), F.size("b")).alias("n"), F.posexplode(F.arrays_zip("a", "b")).alias("i", "v")).where("i < n")
    return p.select("image_id", F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).cast("long").alias("col"), F.col("v.a").cast("double").alias("a"), F.col("v.b").cast("double").alias("b"), "cls")


def block_mean(k: int, size: int, column: str = "embedding"):
    """Mean of the k-th block of so many components of a vector."""
    return F.aggregate(F.slice(column, size * k + 1, size), F.lit(0.0), lambda a, v: a + v.cast("double")) / size


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return i.select(F.col("l_suppkey").alias("transect_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), (F.col("l_quantity") - 25).alias("z"))


CTES = {
    "v_obs": "SELECT user_id AS transect_id, ts AS acq_ts, CASE event_type WHEN 'view' THEN 'VE' ELSE 'WL' END AS kind, value AS dist, CASE event_id % 3 WHEN 0 THEN 'L8' WHEN 1 THEN 'L9' ELSE 'S2' END AS sat, event_id FROM events WHERE event_type IN ('view', 'click')",
    "v_tide": "SELECT ts AS date, arg_min(value, event_id) / 50 - 1 AS tide FROM events WHERE event_type = 'signup' GROUP BY ts",
    "v_wave": "SELECT user_id % 10 AS cell_id, ts AS t, value / 25 AS hs, ((event_id * 37) % 360)::DOUBLE AS dir, 3 + (props->>'$.k')::DOUBLE / 10 AS tp, event_id FROM events WHERE event_type = 'purchase'",
    "v_storm": "SELECT event_id AS storm_id, ts AS start, ts + INTERVAL 6 HOUR AS \"end\", value AS gust FROM events WHERE event_type = 'error' AND value > 100",
    "v_image": "SELECT o_orderkey AS file, o_orderdate::DATE AS acq_date, CASE o_orderstatus WHEN 'F' THEN 'L8' WHEN 'O' THEN 'S2' ELSE 'L9' END AS sat, o_totalprice AS length, (o_orderkey % 100) / 100 AS cloud, o_custkey % 25 AS site FROM orders",
    "v_survey": "SELECT l_suppkey AS transect_id, year(l_shipdate) AS year, avg(l_quantity) AS dist, CASE WHEN year(l_shipdate) < 1996 THEN 5.0::DOUBLE WHEN year(l_shipdate) < 1999 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS error FROM lineitem GROUP BY l_suppkey, year(l_shipdate)",
    "v_daily": "SELECT l_suppkey AS transect_id, l_shipdate::DATE AS day, sum(l_quantity) AS y FROM lineitem GROUP BY ALL",
    "v_vertex": "SELECT vec_id AS line_id, i AS seq, 10 * i + 20 * embedding[2 * i + 1]::DOUBLE AS x, 50 * embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(32)) AS i)",
    "v_coast": "SELECT vec_id AS line_id, i AS seq, 10 * i + 20 * embedding[2 * i + 1]::DOUBLE AS x, 50 * embedding[2 * i + 2]::DOUBLE + 5.0::DOUBLE * vec_id AS y, label::BIGINT AS cls FROM embeddings, (SELECT unnest(range(32)) AS i)",
    "v_tangle": "SELECT vec_id AS line_id, i AS seq, 3 * i + 60 * embedding[2 * i + 1]::DOUBLE AS x, 60 * embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(32)) AS i)",
    "v_piece": "SELECT line_id * 8 + (p * 5 + 3) % 8 AS line_id, CASE WHEN (line_id + p) % 3 = 0 THEN CASE WHEN p = 7 THEN 3 ELSE 4 END - (seq - 4 * p) ELSE seq - 4 * p END AS seq, x, y FROM (SELECT vec_id AS line_id, i AS seq, 10 * i + 20 * embedding[2 * i + 1]::DOUBLE AS x, 50 * embedding[2 * i + 2]::DOUBLE + 5.0::DOUBLE * vec_id AS y FROM embeddings, (SELECT unnest(range(32)) AS i)), (SELECT unnest(range(8)) AS p) WHERE seq BETWEEN 4 * p AND 4 * p + 4",
    "v_transect": "SELECT p_partkey AS transect_id, 3 + (p_partkey * 37 % 3000) / 10 AS x0, 2.5::DOUBLE * p_partkey - 60 AS y0, 3 + (p_partkey * 37 % 3000) / 10 + p_size / 10 AS x1, 2.5::DOUBLE * p_partkey - 60 + 120 AS y1 FROM part",
    "v_pixel": "SELECT e.vec_id AS image_id, i // 8 AS row, i % 8 AS col, e.embedding[i + 1]::DOUBLE AS a, n.embedding[i + 1]::DOUBLE AS b, (e.label % 2)::BIGINT AS cls FROM embeddings e JOIN embeddings n ON n.vec_id = e.vec_id + 1, (SELECT unnest(range(64)) AS i)",
    "v_profile": "SELECT l_suppkey AS transect_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq, l_quantity - 25 AS z FROM lineitem",
}


def sql(body: str, *views: str) -> str:
    """DuckDB SQL over views: WITH the views' expressions, then body (which may go on with more, after a comma)."""
    return "WITH " + ",\n".join(f"{v} AS ({CTES[v]})" for v in views) + ("\n" if not body.lstrip().startswith(",") else "") + body
