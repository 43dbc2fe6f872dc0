"""Rounds over a whole table until it no longer changes, and chains ranked by pointer doubling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local session without one gets a folder of its own."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='spark-rounds-', dir='/tmp')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(given)
    return given.rstrip("/")


class State:
    """A table of the shared folder that every round writes anew; the one before is deleted. Writing cuts lineage and outlives executors.

    It is joined by sorting: a file of numbers that repeat is many times smaller than its rows, so its size doesn't tell whether it can be broadcast.
    """

    def __init__(self, first: DataFrame) -> None:
        self.spark, self.path, self.table = first.sparkSession, None, first
        self.put(first)

    def put(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, f"{shared_folder(self.spark)}/round-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path).hint("merge")
        if before:
            self._delete(before)
        return self.table

    def drop(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(state: DataFrame, step: Callable[[DataFrame], DataFrame], mark: Column, rounds: int) -> DataFrame:
    """Applies step until the state stays the same by the sum of a hash (mark) over its rows and by their number.

    Raises if the state still changes after so many rounds.
    """
    known, held = None, State(state)
    for _ in range(rounds):
        seen = held.table.agg(F.count(F.lit(1)), F.sum(mark.cast("decimal(38,0)"))).first()
        if seen == known:
            return held.table
        known = seen
        held.put(step(held.table))
    raise RuntimeError(f"the state still changes after {rounds} rounds")


def ranked(links: DataFrame, weight: str | None = None) -> DataFrame:
    """Chains of (node, next) followed to their ends: adds last, hops to it, low (the least node from here on) and behind (weights from here on).

    next is null at a chain's end. Every round doubles the reach of a node's pointer, so n nodes take about log2(n) rounds. Nodes
    of a cycle, and those that lead into one, have no last; low is then the least node of the cycle and of what leads there.
    """
    own = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    held = State(
        links.select("node", F.col("next").alias("ptr"), F.when(F.col("next").isNull(), F.col("node")).alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("node").alias("low"), own.alias("behind"))
    )
    reach, nodes = 1, None
    while True:
        n, open_ends = held.table.agg(F.count(F.lit(1)), F.count("ptr")).first()
        nodes = nodes or n
        if not open_ends or reach > 2 * nodes:
            return held.table.select("node", "last", "hops", "low", "behind")
        ahead = held.table.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("last").alias("_last"), F.col("hops").alias("_hops"), F.col("low").alias("_low"), F.col("behind").alias("_behind"))
        far = held.table.join(ahead, "ptr", "left")
        held.put(
            far.select(
                "node",
                F.col("_ptr").alias("ptr"),
                F.coalesce("last", "_last").alias("last"),
                (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
                F.least("low", F.coalesce("_low", F.col("low"))).alias("low"),
                (F.col("behind") + F.coalesce("_behind", F.lit(0))).alias("behind"),
            )
        )
        reach *= 2


def reached(links: DataFrame, by: str, node: str, next: str, starts: Column) -> DataFrame:
    """Nodes (by, node) that a start of the same key leads to by its next ones, in rounds that double the reach."""
    held = State(links.select(by, node, F.col(next).alias("_ptr"), starts.alias("_in")))
    while held.table.where("_ptr is not null").head(1):
        hit = held.table.where("_in and _ptr is not null").select(by, F.col("_ptr").alias(node), F.lit(True).alias("_hit")).distinct()
        ahead = held.table.select(by, F.col(node).alias("_ptr"), F.col("_ptr").alias("_far"))
        far = held.table.join(ahead, [by, "_ptr"], "left").join(hit, [by, node], "left")
        held.put(far.select(by, node, F.col("_far").alias("_ptr"), (F.col("_in") | F.coalesce("_hit", F.lit(False))).alias("_in")))
    return held.table.where("_in").select(by, node)
