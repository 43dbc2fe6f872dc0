"""Connected components over an edge table, without collecting nodes or edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.work import dropped, new_path, saved


#: Edges (two numbers each) that one task may take at most.
FEW_EDGES = 500_000


def forest(batches, first: str = "a", second: str = "b"):
    """Of one partition's edges, a spanning forest: each node with the smallest id of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(first).to_pylist(), batch.column(second).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in up if root(x) != x]
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], names=["a", "b"])


def _labels(stars: DataFrame) -> DataFrame:
    """Of edges from each node to its component's smallest id, the component of every node."""
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Of edges (a, b) of longs: (node, component), component being the smallest id reachable.

    Alternates large-star and small-star steps: every node links its larger neighbours, then its
    smaller ones, to the smallest node it knows. The minimum of a node is aggregated before it is
    shuffled, and joins on a node with very many edges are plain equi-joins that AQE may split.
    Nulls and loops are dropped. Nodes without edges have no row. Stops when the edges no longer change.
    Edges that are few once each partition has made a forest of its own are settled by one more forest, in one task.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    at = new_path(spark, "edges")
    edges = saved(edges.mapInArrow(forest, "a long, b long"), "edges", at)
    if edges.count() <= FEW_EDGES:
        trees = saved(edges.coalesce(1).mapInArrow(forest, "a long, b long"), "trees")
        dropped(spark, at)
        return _labels(trees)
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        last, at = at, new_path(spark, "edges")
        edges = saved(small.where("a <> b").distinct(), "edges", at)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(spark, last)
        if state == seen:
            return _labels(edges)
        seen = state
    raise RuntimeError(f"components still change after {rounds} rounds")
