"""Clusters of a weighted graph by the eigenvectors of its normalised similarity."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.rounds import State

#: Vectors carried along beyond those that are wanted.
_MORE = 3


def _products(table: DataFrame, names: list[str]) -> np.ndarray:
    """Sums of products of columns (a small square matrix), by one aggregate."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = table.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"p{i}_{j}"] or 0.0
    return out


def spectral_vectors(edges: DataFrame, count: int, tolerance: float = 1e-4, rounds: int = 300, seed: int = 3) -> DataFrame:
    """The first eigenvectors of D^-1/2 W D^-1/2 of an undirected graph (a, b, weight): node, v0, v1, ...

    Each edge is given once or from both sides, equal ones are added up, and loops don't count. A few vectors more are carried along,
    which brings the wanted ones apart sooner. In every round the vectors of all nodes are sent along the edges and added up, and are
    turned and made orthogonal by the matrices of their products, which alone come to the driver. It ends when none of the wanted
    eigenvalues changes by tolerance or more; raises after so many rounds.
    """
    both = edges.where("a <> b").select("a", "b", F.col("weight").cast("double").alias("w"))
    both = both.union(both.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    degree = both.groupBy("a").agg(F.sum("w").alias("degree"))
    scaled = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("degree").alias("_d")), "b")
    links = State(scaled.select("a", "b", (F.col("w") / F.sqrt(F.col("degree") * F.col("_d"))).alias("w")))
    carried = count + _MORE
    names, olds = [f"v{i}" for i in range(carried)], [f"o{i}" for i in range(carried)]
    start = [((F.pmod(F.xxhash64("a", F.lit(seed + i)), F.lit(1 << 20)) / float(1 << 20)) - 0.5).alias(n) for i, n in enumerate(names)]
    # the first vector is known: the roots of the degrees
    held = State(degree.select(F.col("a").alias("node"), F.sqrt("degree").alias("v0"), *start[1:]))
    now = _combined(held.table, names, _factor(_products(held.table, names)))
    known = np.zeros(count)
    for _ in range(rounds):
        sent = links.table.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])
        # half of the vector itself is added, so that only the greatest eigenvalues count, whatever their signs
        both_sides = sent.withColumnRenamed("a", "node").join(now.select("node", *[F.col(n).alias(o) for n, o in zip(names, olds, strict=True)]), "node")
        held.put(both_sides.select("node", *[((F.col(n) + F.col(o)) / 2).alias(n) for n, o in zip(names, olds, strict=True)], *olds))
        products = _products(held.table, [*names, *olds])
        values, turn = np.linalg.eigh((products[:carried, carried:] + products[carried:, :carried]) / 2)
        values, turn = values[::-1][:count], turn[:, ::-1]
        now = _combined(held.table, names, turn @ _factor(turn.T @ products[:carried, :carried] @ turn))
        if np.abs(values - known).max() < tolerance:
            links.drop()
            return now.select("node", *names[:count])
        known = values
    raise RuntimeError(f"an eigenvalue still changes by {tolerance} after {rounds} rounds")


def _factor(products: np.ndarray) -> np.ndarray:
    """A matrix that makes vectors with these products orthonormal, one after the other."""
    slight = 1e-14 * np.trace(products) * np.eye(len(products))
    return np.linalg.inv(np.linalg.cholesky(products + slight)).T


def _combined(table: DataFrame, names: list[str], q: np.ndarray) -> DataFrame:
    return table.select("node", *[sum((F.col(m) * float(q[i, j]) for i, m in enumerate(names)), F.lit(0.0)).alias(n) for j, n in enumerate(names)])


def spectral_clusters(edges: DataFrame, clusters: int, tolerance: float = 1e-4, seed: int = 1) -> DataFrame:
    """Nodes of a graph in so many clusters: node, cluster (numbered by their least nodes). Nodes without an edge are left out.

    k-means on the first eigenvectors, each node's put to length one.
    """
    names = [f"v{i}" for i in range(clusters)]
    v = spectral_vectors(edges, clusters, tolerance)
    length = F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)))
    x = VectorAssembler(inputCols=names, outputCol="features").transform(v.select("node", *[(F.col(n) / length).alias(n) for n in names])).select("node", "features")
    found = KMeans(k=clusters, seed=seed, maxIter=50).fit(x).transform(x).select("node", "prediction")
    order = sorted((r["least"], r["prediction"]) for r in found.groupBy("prediction").agg(F.min("node").alias("least")).collect())
    number = F.create_map(*[F.lit(v) for k, (_, p) in enumerate(order) for v in (p, k)])
    return found.select("node", number[F.col("prediction")].alias("cluster"))
