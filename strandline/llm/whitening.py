"""Whitening of vectors by their covariance, each distinct vector being worked on once.

Vectors become whole numbers, equal ones are grouped, and a group's size (or one) is its weight in the fit: sums, then a
weighted product of the centred vectors with themselves in every task, added up by Spark. Each distinct vector is whitened
once and joined back to the rows that hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.work import Scope, new_path, saved, small_batches

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors that at least this share of the rows hold are joined back by broadcast: there can't be more of them than 1 / share.
HOT_SHARE = 1 / 1024
#: Components with less than this share of the greatest eigenvalue, a dimension, are rounding only.
_ROUNDING = 1e-12


@dataclass
class Whitening:
    """n vectors with per-dimension sums; unit eigenvectors (columns) and eigenvalues of their covariance, falling; its trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole_numbers(vector: Column) -> Column:
    """floor(1024 * c) + 100000 of each entry c; null for a vector that is null or empty or holds a null or an entry that isn't finite."""
    c = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT))


def _matrix(batch: pa.RecordBatch, column: str, dimensions: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, dimensions)


def _sums(dimensions: int):
    """Weight and exact sums of a task's vectors: (dimension, sum), the weight with dimension -1."""

    def run(batches):
        total, n = np.zeros(dimensions, np.int64), 0
        for batch in batches:
            w = batch.column("w").to_numpy()
            total += w @ _matrix(batch, "x", dimensions)
            n += int(w.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dimensions, dtype=np.int32)), pa.array(np.append(n, total))], names=["i", "s"])

    return run


def _products(mean: np.ndarray, column: str):
    """The weighted product of a task's centred vectors with themselves, one row for each row of the matrix."""
    dimensions = len(mean)

    def run(batches):
        total = np.zeros((dimensions, dimensions))
        for batch in batches:
            centred = _matrix(batch, column, dimensions) - mean
            total += (centred * batch.column("w").to_numpy()[:, None]).T @ centred
        rows = pa.array(np.arange(0, total.size + 1, dimensions, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions, dtype=np.int32)), pa.ListArray.from_arrays(rows, pa.array(total.ravel()))], names=["i", "g"])

    return run


def _covariance(distinct: DataFrame, column: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of weighted vectors about mean; the driver gets its entries."""
    parts = distinct.select("w", column).mapInArrow(_products(mean, column), "i int, g array<double>")
    cells = parts.select("i", F.posexplode("g").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((len(mean), len(mean)))
    out[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy()
    return out / n


def fit(distinct: DataFrame, dimensions: int) -> Whitening | None:
    """Fits on a table of vectors x (arrays of whole numbers) with weights w; None if there are none or all are equal."""
    found = dict(distinct.select("w", "x").mapInArrow(_sums(dimensions), "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())
    if not found:
        return None
    n, sums = int(found[-1]), [int(found[k]) for k in range(dimensions)]
    v = _covariance(distinct, "x", np.array([s / n for s in sums]), n)
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > max(values[0], 0.0) * dimensions * _ROUNDING).sum())
    return Whitening(n, sums, vectors[:, :rank], values[:rank], float(np.trace(v))) if rank else None


def _whitened(found: Whitening, dimensions: int, components: int):
    """Each distinct vector's components over the roots of their eigenvalues, and the exact sum of squares of n * x - sums."""
    mean = np.array([s / found.n for s in found.sums])
    onto = found.vectors[:, :components] / np.sqrt(found.values[:components])
    k = onto.shape[1]

    def run(batches):
        for batch in batches:
            x = _matrix(batch, "x", dimensions)
            reach = max(abs(found.n * int(v) - s) for c, s in zip((x.min(0), x.max(0)), (found.sums,) * 2, strict=True) for v, s in zip(c, s, strict=True))
            if reach * reach * dimensions < 1 << 63:
                apart = found.n * x - np.array(found.sums)
                deviation = pa.array((apart * apart).sum(1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([sum((found.n * int(v) - s) ** 2 for v, s in zip(row, found.sums, strict=True)) for row in x], pa.decimal128(38, 0))
            z = (x - mean) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k, dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("w"), batch.column("copies"), deviation, lists], names=["x", "w", "copies", "deviation", "z"])

    return run


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weight: str = "count", hot_share: float = HOT_SHARE) -> DataFrame:
    """For each row: key, n, deviation decimal(38,0), z (whitened components, falling by eigenvalue), explained (their shares), identity_error.

    weight: "count" fits on all rows, "one" on each distinct vector once; n, sums and covariance are over that fit list.
    Rows whose vector is null or empty, or holds null or an entry that isn't finite, are dropped; so are vectors shorter than
    the longest one left, as their other entries are missing. There are as many components as eigenvalues above rounding, at
    most ``components``; where all vectors are equal, or no row is left, the result is empty. Keys may be null or repeated;
    other columns are left out. identity_error is measured on the whitened vectors of the fit list.
    """
    if weight not in ("count", "one"):
        raise ValueError(weight)
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[key].dataType.simpleString()
    empty = spark.createDataFrame([], f"{key} {kind}, n long, deviation decimal(38,0), z array<double>, explained array<double>, identity_error double")
    rows = df.select(F.col(key).alias("key"), whole_numbers(F.col(vector)).alias("x")).where("x is not null")
    with Scope(spark) as scope:
        distinct = scope.saved(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "distinct-vectors")
        dimensions = distinct.agg(F.max(F.size("x"))).first()[0]
        if not dimensions:
            return empty
        distinct = distinct.where(F.size("x") == dimensions).withColumn("w", F.col("copies") if weight == "count" else F.lit(1).cast("long"))
        found = fit(distinct, dimensions)
        if found is None:
            return empty
        done = saved(distinct.mapInArrow(_whitened(found, dimensions, components), "x array<long>, w long, copies long, deviation decimal(38,0), z array<double>"), "whitened-vectors", new_path(spark, "whitened-vectors"))
    k = min(components, len(found.values))
    mean = done.select(*[F.sum(F.col("z")[i] * F.col("w")).alias(f"m{i}") for i in range(k)]).first()
    identity = _covariance(done, "z", np.array([mean[i] / found.n for i in range(k)]), found.n)
    error = float(np.abs(identity - np.eye(k)).max())
    n_rows = done.agg(F.sum("copies")).first()[0]
    is_hot = F.col("copies") >= n_rows * hot_share
    hot = F.broadcast(done.where(is_hot).select("x", "deviation", "z"))
    back = rows.join(hot, "x").unionByName(rows.join(hot.select("x"), "x", "left_anti").join(done.where(~is_hot).select("x", "deviation", "z"), "x"))
    explained = F.array(*[F.lit(float(v) / found.trace) for v in found.values[:k]])
    return back.select(F.col("key").alias(key), F.lit(found.n).cast("long").alias("n"), "deviation", "z", explained.alias("explained"), F.lit(error).alias("identity_error"))
