"""Exact nearest neighbours between two tables of points, and rows made between neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strandline.operators.rounds import State

#: Points that a cell should hold about, and cells at most.
PER_CELL, MOST_CELLS = 512, 4096
#: Distances that a task computes at once, and points that ask the same task about a cell about.
AT_ONCE, ASKING = 1 << 21, 20_000


def _numbers(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(column).to_numpy()


def _in_cells(points: DataFrame, tree: list[tuple[str, np.ndarray]]) -> DataFrame:
    """Adds a point's cell: its part of the first axis, of the second one within that, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for column, bounds in tree:
                cell = cell * (bounds.shape[1] + 1) + (bounds[cell] <= _numbers(batch, column)[:, None]).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "_cell"])

    return points.mapInArrow(run, StructType([*points.schema.fields, StructField("_cell", LongType())]))


def _tree(points: DataFrame, columns: list[str], sets: int) -> list[tuple[str, np.ndarray]]:
    """Axes from the widest on, each with the inner bounds of parts of about equal numbers of points, a row of them for every cell of the axes before."""
    shown = points.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(c).alias(c) for c in columns]).first()
    cells = min(MOST_CELLS, (shown["n"] or 0) / max(sets, 1) / PER_CELL)
    axes = sorted((c for c in columns if shown[c]), key=lambda c: -shown[c])[: int(log2(max(cells, 1)))]
    parts = max(2, round(cells ** (1 / len(axes)))) if axes else 1
    tree: list[tuple[str, np.ndarray]] = []
    for c in axes:
        bounds = np.full((parts ** len(tree), parts - 1), np.inf)
        for row in _in_cells(points.select(*columns), tree).groupBy("_cell").agg(F.percentile_approx(c, [k / parts for k in range(1, parts)], 10_000).alias("at")).collect():
            at = sorted(set(row["at"]))
            bounds[row["_cell"], : len(at)] = at
        tree.append((c, bounds))
    return tree


def _to_ask(live: DataFrame, columns: list[str], cells: list, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """The cells that points (with reach, which is infinite while it isn't known, and the number of cells seen) look into next.

    They are seen from the nearest box on: first one, then all within reach, or while that isn't known three times as many and one.
    """
    number = np.array(cells, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, AT_ONCE // len(number))
            for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
                reach, seen, gap = _numbers(part, "_reach"), _numbers(part, "_seen"), 0.0
                for i, c in enumerate(columns):
                    x = _numbers(part, c)[:, None]
                    beyond = np.fmax(np.fmax(low[:, i] - x, x - high[:, i]), 0.0)
                    gap = gap + beyond * beyond
                gap = np.sqrt(gap)
                ask = (gap <= reach[:, None]) & (seen > 0)[:, None]
                ask[np.arange(len(gap)), gap.argmin(1)] = seen == 0
                far = np.flatnonzero((seen > 1) | ((seen > 0) & np.isinf(reach)))
                if len(far):
                    rank = gap[far].argsort(1, kind="stable").argsort(1)
                    last = np.where(np.isinf(reach[far]), 3 * seen[far] + 1, len(number))
                    ask[far] = (gap[far] <= reach[far, None]) & (rank >= seen[far, None]) & (rank < last[:, None])
                rows, at = np.nonzero(ask)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows)) for c in part.columns], pa.array(number[at])], names=[*part.schema.names, "_cell"])

    return live.mapInArrow(run, StructType([*live.schema.fields, StructField("_cell", LongType())]))


def _search(asked: DataFrame, points: DataFrame, by: list[str], columns: list[str], need: int, tasks: int) -> DataFrame:
    """The nearest points (_id, d, other) of its cell to each asking one, as many as are needed and none beyond its reach.

    A cell and the points that ask about it meet in one task; where many ask, they are dealt to several.
    """
    kind = StructType([asked.schema["_id"], StructField("d", DoubleType()), StructField("other", points.schema["_other"].dataType)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, other = left.column("_id").combine_chunks(), right.column("_other").combine_chunks()
        rank = np.empty(len(other), np.int64)
        rank[pc.sort_indices(other, null_placement="at_start").to_numpy()] = np.arange(len(other))
        out = [pa.table([ids.slice(0, 0), pa.array([], pa.float64()), other.slice(0, 0)], names=["_id", "d", "other"])]
        step = max(1, AT_ONCE // max(len(other), 1))
        for k in range(0, len(ids) if len(other) else 0, step):
            part, d = left.slice(k, step), 0.0
            for c in columns:
                off = _numbers(part, c)[:, None] - _numbers(right, c)
                d = d + off * off
            # places are in the order of distances, not of their squares: the root makes some unequal squares equal
            d, reach = np.sqrt(d), _numbers(part, "_reach").copy()
            unknown = np.isinf(reach)
            if len(other) > need and unknown.any():
                reach[unknown] = np.partition(d[unknown], need - 1, axis=1)[:, need - 1]
            rows, at = np.nonzero(~(d > reach[:, None]))
            order = np.lexsort((rank[at], d[rows, at], rows))
            rows, at = rows[order], at[order]
            first = np.arange(len(rows)) - np.searchsorted(rows, rows) < need
            rows, at = rows[first], at[first]
            out.append(pa.table([ids.take(pa.array(rows + k)), pa.array(d[rows, at]), other.take(pa.array(at))], names=["_id", "d", "other"]))
        return pa.concat_tables(out)

    place = [*by, "_cell"]
    many = F.broadcast(asked.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("_many")).where("_many > 1"))
    share = F.coalesce("_many", F.lit(1).cast("long"))
    lefts = asked.join(many, place, "left").select("_id", *place, *columns, "_reach", F.pmod(F.xxhash64("_id"), share).alias("_share"))
    rights = points.join(many, place, "left").select("_other", *place, *columns, F.explode(F.sequence(F.lit(0).cast("long"), share - 1)).alias("_share"))
    place = [*place, "_share"]
    return lefts.repartition(tasks, *place).groupBy(*place).cogroup(rights.repartition(tasks, *place).groupBy(*place)).applyInArrow(run, kind)


def nearest(left: DataFrame, right: DataFrame, key: str, other: str, columns: list[str], k: int, by: list[str] | None = None, apart: bool = False) -> DataFrame:
    """The k right points nearest to each left point in all columns: by, key, rank (from 1), other, distance; the lower other on ties.

    by: columns that both sides must share. apart: a right point whose other is the left one's key doesn't count. Equal points are
    searched once. Points are dealt to cells of about equal numbers, cut axis by axis where the values are, so that a cell is small on
    every axis. Each point looks into the cell whose box is nearest, then into all those whose boxes are not farther than its k-th
    point there. Rows with a null or NaN in a column, or a null in by, have no neighbours and are none.
    """
    by = by or []
    fine = lambda d: d.where(" and ".join([f"{c} is not null and not isnan({c})" for c in columns] + [f"{c} is not null" for c in by]) if columns else "true")
    cast = [F.col(c).cast("double").alias(c) for c in columns]
    lefts = fine(left.select(*by, F.col(key).alias("_key"), *cast))
    rights = fine(right.select(*by, F.col(other).alias("_other"), *cast))
    need = k + (1 if apart else 0)
    place = [*by, *columns]
    w = Window.partitionBy(*place).orderBy("_other")
    merged = rights.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= need).drop("_r")  # no point needs more of equal ones
    points = State(merged)
    sets = points.table.select(F.approx_count_distinct(F.struct(*by))).first()[0] if by else 1
    points.put(_in_cells(points.table, _tree(points.table, columns, sets)))
    boxes = points.table.groupBy("_cell").agg(F.array(*[F.min(c) for c in columns]).alias("low"), F.array(*[F.max(c) for c in columns]).alias("high")).orderBy("_cell").collect()
    cells, low, high = [b["_cell"] for b in boxes], np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])
    tasks = min(512, max(points.spark.sparkContext.defaultParallelism, len(cells) // 4))
    best_type = f"array<struct<d double, other {dict(rights.dtypes)['_other']}>>"
    asked = lefts.select(*place).distinct().select(F.monotonically_increasing_id().alias("_id"), *place)
    held = State(asked.select("*", F.array().cast(best_type).alias("best"), F.lit(0).cast("long").alias("_seen"), F.lit(not cells).alias("done")))
    while held.table.where("not done").head(1):
        live, rest = held.table.where("not done"), held.table.where("done")
        kth = F.when(F.size("best") >= need, F.element_at("best", need)["d"])
        reach = F.when(kth.isNull() | F.isnan(kth), F.lit(float("inf"))).otherwise(kth)
        to_ask = State(_to_ask(live.select("_id", *place, reach.alias("_reach"), "_seen").repartition(tasks, "_id"), columns, cells, low, high))
        new = _search(to_ask.table, points.table, by, columns, need, tasks)
        old = live.select("_id", F.explode("best").alias("b")).select("_id", "b.d", "b.other")
        first = new.union(old).withColumn("_r", F.row_number().over(Window.partitionBy("_id").orderBy("d", "other"))).where(F.col("_r") <= need)
        best = first.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("found"))
        out = live.join(best, "_id", "left").withColumns({"best": F.coalesce(F.col("found"), F.array().cast(best_type)), "_known": (F.col("_seen") > 0) & (reach < float("inf")), "_seen": F.when(F.col("_seen") > 0, 3 * F.col("_seen") + 1).otherwise(1)})
        out = out.withColumn("done", F.col("_known") | (F.col("_seen") >= len(cells)))
        held.put(out.select(*rest.columns).unionByName(rest))
        to_ask.drop()
    points.drop()
    answers = held.table.select(*place, "best")
    # a left row may repeat: its neighbours are ranked within one search
    rank = F.row_number().over(Window.partitionBy(*by, "_key", "_copy").orderBy("d", "other"))
    pairs = lefts.withColumn("_copy", F.monotonically_increasing_id()).join(answers, place).select(*by, "_key", "_copy", F.explode("best").alias("b")).select(*by, "_key", "_copy", "b.d", "b.other")
    pairs = pairs.where("_key <> other") if apart else pairs
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, F.col("_key").alias(key), F.col("rank").cast("long").alias("rank"), F.col("other").alias(other), F.col("d").alias("distance"))


def between_neighbours(points: DataFrame, key: str, columns: list[str], copies: int = 1, k: int = 5) -> DataFrame:
    """Points made between each point and its nearest ones (keys are whole numbers): from_key, copy, to_key and columns.

    Each point makes so many; the neighbour and the place between are taken by whole-number formulas of key and copy, so that runs are alike.
    A point without neighbours makes none.
    """
    near = nearest(points, points.withColumnRenamed(key, "_to"), key, "_to", columns, k, apart=True)
    many = near.groupBy(key).agg(F.max("rank").alias("_n"))
    made = many.select(key, "_n", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    made = made.withColumns({"rank": F.pmod(F.col(key) * 7919 + F.col("copy") * 31, F.col("_n")) + 1, "_at": F.pmod(F.col(key) * 104729 + F.col("copy") * 7907, F.lit(1000)) / 1000})
    a = points.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    b = points.select(F.col(key).alias("_to"), *[F.col(c).cast("double").alias(f"_{c}") for c in columns])
    made = made.join(near.select(key, "rank", "_to"), [key, "rank"]).join(a, key).join(b, "_to")
    return made.select(F.col(key).alias("from_key"), F.col("copy").cast("long").alias("copy"), F.col("_to").alias("to_key"), *[(F.col(c) + F.col("_at") * (F.col(f"_{c}") - F.col(c))).alias(c) for c in columns])
