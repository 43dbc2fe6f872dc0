"""Streaming twins as queries: a given table is read as a stream until it is drained, and the sink's rows are the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators.rounds import shared_folder
from strandline.plans.waves import _CIRC
from strandline.registry import register
from strandline.sources import tables as T
from strandline.streaming import streams


class Arriving:
    """Stands for a session whose reader streams: the views of tables then are streaming frames."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    @property
    def read(self) -> Arriving:
        return self

    def parquet(self, path: str) -> DataFrame:
        schema = self.spark.read.parquet(path).schema
        return self.spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a single file


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that has arrived and returns what its sink holds. Complete results replace those of the batch before.

    Every batch has a folder by its number, which a batch that is tried again overwrites, so no row is written twice.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")

    run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(stream.columns)


@register(T.sql("""SELECT sat, file, cloud FROM v_image WHERE cloud <= 0.5""", "v_image"))
def live_images(spark, sf_dir):
    """Clear images as they arrive, each once."""
    images = T.image(Arriving(spark), sf_dir).withColumn("acq_ts", F.col("acq_date").cast("timestamp"))
    return drained(streams.new_images(images, cloud=0.5).select("sat", "file", "cloud"), "append")


@register(T.sql(f"""SELECT cell_id, t::DATE AS day, count(*) AS n, round(avg(hs), 6) AS hs, round({_CIRC.format(o='')}, 4) AS dir FROM v_wave GROUP BY ALL""", "v_wave"))
def live_daily_waves(spark, sf_dir):
    """Tumbling days of arriving waves."""
    found = drained(streams.daily_waves(T.wave(Arriving(spark), sf_dir)), "complete")
    return found.select("cell_id", "day", "n", F.round("hs", 6).alias("hs"), F.round("dir", 4).alias("dir"))


@register(T.sql("""SELECT cell_id, u AS until, round(avg(hs), 6) AS hs_mean, round(stddev_pop(hs), 5) AS hs_std
FROM (SELECT *, unnest([date_trunc('day', t) + INTERVAL 1 DAY, date_trunc('day', t) + INTERVAL 2 DAY, date_trunc('day', t) + INTERVAL 3 DAY]) AS u FROM v_wave) GROUP BY cell_id, u""", "v_wave"))
def live_trailing_waves(spark, sf_dir):
    """Windows of three days that slide by a day over arriving waves."""
    found = drained(streams.trailing_waves(T.wave(Arriving(spark), sf_dir), "3 days"), "complete")
    return found.select("cell_id", "until", F.round("hs_mean", 6).alias("hs_mean"), F.round("hs_std", 5).alias("hs_std"))


@register(T.sql(""", p AS (SELECT cell_id, quantile_cont(hs, 0.95) AS threshold FROM v_wave GROUP BY cell_id), h AS (SELECT w.* FROM v_wave w JOIN p USING (cell_id) WHERE hs > threshold),
s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY cell_id ORDER BY t) <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS begins FROM h), r AS (SELECT *, sum(begins) OVER (PARTITION BY cell_id ORDER BY t, event_id) AS run FROM s)
SELECT cell_id, min(t) AS start, max(t) + INTERVAL 24 HOUR AS "end", count(*) AS n, round(max(hs), 6) AS hs_max FROM r GROUP BY cell_id, run""", "v_wave"))
def live_storms(spark, sf_dir):
    """Sessions of arriving waves above the 95th percentile of their cell."""
    limits = T.wave(spark, sf_dir).groupBy("cell_id").agg(F.percentile("hs", 0.95).alias("threshold"))
    found = drained(streams.storm_sessions(T.wave(Arriving(spark), sf_dir), limits), "complete")
    return found.select("cell_id", "start", "end", "n", F.round("hs_max", 6).alias("hs_max"))


@register(T.sql("""SELECT sat, acq_date AS day, file, length FROM v_image QUALIFY row_number() OVER (PARTITION BY sat, acq_date ORDER BY length DESC, file DESC) = 1""", "v_image"))
def live_longest_a_day(spark, sf_dir):
    """Of a satellite's arriving lines of one day the longest."""
    images = T.image(Arriving(spark), sf_dir).withColumn("acq_ts", F.col("acq_date").cast("timestamp"))
    return drained(streams.longest_a_day(images), "complete")


@register(T.sql("""SELECT event_id, round(dist + (event_id % 7) / 10 / coalesce(0.02 + (x1 - x0) / 50, 0.1), 6) AS corrected FROM v_obs o LEFT JOIN v_transect t USING (transect_id) WHERE kind = 'WL'""", "v_obs", "v_transect"))
def live_corrected_waterlines(spark, sf_dir):
    """Arriving waterlines moved to the datum by their tide and their transect's slope, 0.1 where it has none."""
    slopes = T.transect(spark, sf_dir).select("transect_id", (0.02 + (F.col("x1") - F.col("x0")) / 50).alias("slope"))
    waters = T.obs(Arriving(spark), sf_dir).where("kind = 'WL'").withColumn("tide", (F.col("event_id") % 7) / 10)
    found = drained(streams.corrected_waterlines(waters, slopes).select("event_id", "corrected"), "append")
    return found.select("event_id", F.round("corrected", 6).alias("corrected"))


@register(T.sql("""SELECT v.transect_id, v.acq_ts AS ve_ts, w.acq_ts AS wl_ts, round(w.dist - v.dist, 6) AS width FROM v_obs v JOIN v_obs w ON v.transect_id = w.transect_id
WHERE v.kind = 'VE' AND w.kind = 'WL' AND w.acq_ts >= v.acq_ts - INTERVAL 2 DAY AND w.acq_ts <= v.acq_ts + INTERVAL 2 DAY""", "v_obs"))
def live_widths(spark, sf_dir):
    """Pairs of arriving edges and waterlines of a transect at most two days apart."""
    seen = Arriving(spark)
    found = drained(streams.edge_and_water(T.obs(seen, sf_dir).where("kind = 'VE'"), T.obs(seen, sf_dir).where("kind = 'WL'"), days=2), "append")
    return found.select("transect_id", "ve_ts", "wl_ts", F.round("width", 6).alias("width"))


@register(T.sql(""", l AS (SELECT transect_id, quantile_cont(dist, 0.05) AS p5 FROM v_obs GROUP BY transect_id) SELECT event_id, 3 AS impact FROM v_obs JOIN l USING (transect_id) WHERE dist <= p5""", "v_obs"))
def live_alerts(spark, sf_dir):
    """Arriving positions at or under the 5th percentile of their transect."""
    limits = T.obs(spark, sf_dir).groupBy("transect_id").agg(F.percentile("dist", [0.05, 0.25]).alias("p")).select("transect_id", F.col("p")[0].alias("p5"), F.col("p")[1].alias("p25"))
    return drained(streams.impact_alerts(T.obs(Arriving(spark), sf_dir), limits).select("event_id", "impact"), "append")


@register(T.sql("""SELECT transect_id, count(*) AS n, round(regr_slope(dist, day) * 365.2425, 4) AS rate FROM (SELECT transect_id, dist, epoch_us(acq_ts)::DOUBLE / 86400000000 - 19700 AS day FROM v_obs) GROUP BY transect_id HAVING count(*) > 1""", "v_obs"))
def live_rates(spark, sf_dir):
    """Rate of each transect after all observations have arrived, from running sums that are kept per transect."""
    seen = T.obs(Arriving(spark), sf_dir).select("transect_id", (T.micros().cast("double") / 86400000000 - 19700).alias("day"), "dist")
    with streams.rocks_db(spark):
        found = drained(streams.running_rates(seen), "update")
    last = found.groupBy("transect_id").agg(F.max("n").alias("n"), F.max_by("rate", "n").alias("rate"))
    return last.where("n > 1").select("transect_id", "n", F.round(F.col("rate"), 4).alias("rate"))
