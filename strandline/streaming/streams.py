"""Streaming twins of batch operators: frames in, streaming frames out; callers choose the sink and its checkpoint folder."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.functions import scalars as S


def new_images(images: DataFrame, time: str = "acq_ts", late: str = "7 days", cloud: float = 0.95) -> DataFrame:
    """Each clear image once, however often its row arrives within the watermark."""
    clear = images.where(F.col("cloud") <= cloud).withWatermark(time, late)
    return clear.dropDuplicatesWithinWatermark(["sat", "file"])


def daily_waves(waves: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily means of each cell, directions on the circle."""
    g = waves.withWatermark("t", late).groupBy(F.window("t", "1 day"), "cell_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("hs").alias("hs"), S.circular_mean(F.col("dir")).alias("dir")).select("cell_id", F.to_date("window.start").alias("day"), "n", "hs", "dir")


def trailing_waves(waves: DataFrame, length: str = "90 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean and deviation of each cell over a sliding window that moves by a step."""
    g = waves.withWatermark("t", late).groupBy(F.window("t", length, step), "cell_id")
    return g.agg(F.avg("hs").alias("hs_mean"), F.stddev_pop("hs").alias("hs_std")).select("cell_id", F.col("window.end").alias("until"), "hs_mean", "hs_std")


def storm_sessions(waves: DataFrame, thresholds: DataFrame, gap: str = "24 hours", late: str = "1 day") -> DataFrame:
    """Runs of waves above the threshold of their cell (static: cell_id, threshold), parted by gaps."""
    high = waves.withWatermark("t", late).join(thresholds, "cell_id").where("hs > threshold")
    g = high.groupBy(F.session_window("t", gap), "cell_id").agg(F.count(F.lit(1)).alias("n"), F.max("hs").alias("hs_max"))
    return g.select("cell_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "hs_max")


def longest_a_day(lines: DataFrame, time: str = "acq_ts", late: str = "1 day") -> DataFrame:
    """Of a satellite's lines of one day the longest, the later file on equal length."""
    g = lines.withWatermark(time, late).groupBy(F.window(time, "1 day"), "sat").agg(F.max(F.struct("length", "file")).alias("m"))
    return g.select("sat", F.to_date("window.start").alias("day"), "m.file", "m.length")


def corrected_waterlines(observations: DataFrame, slopes: DataFrame, default: float = 0.1) -> DataFrame:
    """Arriving waterlines (with their tide) moved to the datum by their transect's slope (static: transect_id, slope)."""
    j = observations.join(slopes, "transect_id", "left")
    return j.withColumn("corrected", S.tidal_correction(F.col("dist"), F.col("tide"), F.col("slope"), default=default))


def edge_and_water(edges: DataFrame, waters: DataFrame, days: int = 153, late: str = "1 day") -> DataFrame:
    """Pairs of edge and waterline rows of a transect at most so many days apart; the nearest is picked downstream."""
    e = edges.select("transect_id", F.col("acq_ts").alias("ve_ts"), F.col("dist").alias("ve")).withWatermark("ve_ts", late)
    w = waters.select(F.col("transect_id").alias("w_id"), F.col("acq_ts").alias("wl_ts"), F.col("dist").alias("wl")).withWatermark("wl_ts", late)
    near = F.expr(f"transect_id = w_id and wl_ts >= ve_ts - interval {days} days and wl_ts <= ve_ts + interval {days} days")
    return e.join(w, near).select("transect_id", "ve_ts", "wl_ts", (F.col("wl") - F.col("ve")).alias("width"))


def impact_alerts(observations: DataFrame, limits: DataFrame) -> DataFrame:
    """Arriving positions at or under the 5th percentile of their transect (static: transect_id, p5, p25)."""
    j = observations.join(limits, "transect_id")
    cls = F.when(F.col("dist") <= F.col("p5"), 3).when(F.col("dist") < F.col("p25"), 2).otherwise(1)
    return j.withColumn("impact", cls).where("impact = 3")


RATE_SCHEMA = "transect_id bigint, n bigint, rate double"


class RunningRate(StatefulProcessor):
    """Least-squares rate a year of a transect from running sums (count, x, y, xy, xx); days count from the first row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n bigint, x0 double, x double, y double, xy double, xx double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, x0, x, y, xy, xx = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        for part in rows:
            day = part["day"].astype(float)
            if not n and len(day):
                x0 = float(day.iloc[0])
            d, v = day - x0, part["dist"].astype(float)
            n, x, y, xy, xx = n + len(d), x + float(d.sum()), y + float(v.sum()), xy + float((d * v).sum()), xx + float((d * d).sum())
        self.sums.update((int(n), x0, x, y, xy, xx))
        spread = n * xx - x * x
        rate = (n * xy - x * y) / spread * S.DAYS_A_YEAR if n > 1 and spread > 0 else None
        yield pd.DataFrame({"transect_id": [key[0]], "n": [int(n)], "rate": [rate]})

    def close(self) -> None:
        pass


def running_rates(observations: DataFrame) -> DataFrame:
    """Each transect's rate after every batch, from (transect_id, day, dist). Needs the RocksDB state store."""
    return observations.groupBy("transect_id").transformWithStateInPandas(RunningRate(), outputStructType=RATE_SCHEMA, outputMode="Update", timeMode="None")


@contextlib.contextmanager
def rocks_db(spark: SparkSession):
    """Queries started meanwhile keep their state in RocksDB, which state of several variables needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
