"""Choosing a model's parameters, and what each of its features is worth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.parts import bounds_below


def fold_products(df: DataFrame, by: list[str], fold: str, columns: list[str]) -> DataFrame:
    """Sums of products of all pairs of columns, with a column of ones first, by group and fold: by, fold, products (upper triangle, row by row)."""
    named = ["_one", *columns]
    d = df.withColumn("_one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(named) for b in named[i:]]
    return d.groupBy(*by, fold).agg(F.array(*[F.sum(F.col(a).cast("double") * F.col(b).cast("double")) for a, b in pairs]).alias("products"))


def _square(products, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = products
    return out + np.triu(out, 1).T


def ridge(products: np.ndarray, features: list[int], penalty: float, target: int = -1) -> np.ndarray:
    """Weights (constant first) of a column (the last) on some features, from sums of products; the constant has no penalty."""
    use = [0, *features]
    a = products[np.ix_(use, use)] + penalty * np.diag([0.0, *np.ones(len(features))])
    return np.linalg.lstsq(a, products[use, target], rcond=None)[0]


def _error(products: np.ndarray, features: list[int], weights: np.ndarray) -> float:
    """Sum of squared errors of weights on the rows that the sums of products are of."""
    use = [0, *features]
    return float(products[-1, -1] - 2 * weights @ products[use, -1] + weights @ products[np.ix_(use, use)] @ weights)


def search(df: DataFrame, by: str, fold: str, features: list[str], target: str, trials: list[tuple[int, float]]) -> DataFrame:
    """For each group and trial: by, features, penalty, rmse over its folds, and best (the first of the least).

    A trial is a number of leading features and a ridge penalty. The table is read once: sums of products by fold serve
    every trial, as the sums of the other folds fit it and those of its own fold give its error. Groups are worked on side by side.
    """
    size = len(features) + 2

    def run(batches):
        for batch in batches:
            rows = []
            for group, parts in zip(batch[by], batch["parts"], strict=True):
                per_fold = [_square(p["products"], size) for p in parts]
                total = sum(per_fold)
                scores = []
                for n, penalty in trials:
                    own = list(range(1, n + 1))
                    sse = sum(_error(p, own, ridge(total - p, own, penalty)) for p in per_fold) if len(per_fold) > 1 else np.nan
                    scores.append(np.sqrt(max(sse, 0.0) / total[0, 0]))
                least = int(np.nanargmin(scores)) if np.isfinite(scores).any() else -1
                rows += [(group, n, penalty, None if np.isnan(s) else float(s), i == least) for i, ((n, penalty), s) in enumerate(zip(trials, scores, strict=True))]
            yield pd.DataFrame(rows, columns=[by, "features", "penalty", "rmse", "best"])

    sums = fold_products(df, [by], fold, [*features, target])
    grouped = sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(fold, "products"))).alias("parts"))  # one entry a fold
    return grouped.mapInPandas(run, f"{by} {dict(df.dtypes)[by]}, features int, penalty double, rmse double, best boolean")


def members(df: DataFrame, by: str, fold: str, features: list[str], targets: list[str], penalty: float) -> DataFrame:
    """Ridge regressions of each group, one without each fold and all targets at once: by, member (the fold left out), weights (a list for each target).

    They come from one pass over the table, as do the trials of search. A group of one fold has none.
    """
    size = 1 + len(features) + len(targets)

    def run(batches):
        for batch in batches:
            rows = []
            for group, parts in zip(batch[by], batch["parts"], strict=True):
                per_fold = {p[fold]: _square(p["products"], size) for p in parts}
                total = sum(per_fold.values())
                own = list(range(1, len(features) + 1))
                rows += [(group, k, [ridge(total - p, own, penalty, 1 + len(features) + t).tolist() for t in range(len(targets))]) for k, p in per_fold.items() if len(per_fold) > 1]
            yield pd.DataFrame(rows, columns=[by, "member", "weights"])

    sums = fold_products(df, [by], fold, [*features, *targets])
    grouped = sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(fold, "products"))).alias("parts"))  # one entry a fold
    return grouped.mapInPandas(run, f"{by} {dict(df.dtypes)[by]}, member int, weights array<array<double>>")


def forecast(df: DataFrame, models: DataFrame, by: str, features: list[str], targets: list[str]) -> DataFrame:
    """Rows with the mean and the spread (deviation) of what their group's members say of each target, and the members' number; groups without members have nulls."""
    grouped = models.groupBy(by).agg(F.collect_list("weights").alias("_w"))  # a few members a group
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    said = lambda t: F.transform("_w", lambda w: F.aggregate(F.zip_with(w[t], x, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))
    out = df.join(grouped, by, "left").withColumns({f"_{c}": said(t) for t, c in enumerate(targets)} | {"members": F.when(F.col("_w").isNotNull(), F.size("_w"))})
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    for c in targets:
        out = out.withColumn(f"{c}_mean", mean(F.col(f"_{c}")))
        m = F.col(f"{c}_mean")
        out = out.withColumn(f"{c}_spread", F.sqrt(F.aggregate(F.col(f"_{c}"), F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(f"_{c}")))  # noqa: B023
    return out.drop("_w", *[f"_{c}" for c in targets])


#: Parts that a table is cut into to number its rows in an order.
_PARTS = 1024


def numbered(df: DataFrame, order: Column, name: str, then: str | None = None) -> DataFrame:
    """Rows with their number (from 0) in an order over the whole table: ranks within parts of the order, after the counts of the parts before.

    order is a whole number that spreads over its values evenly or not; parts end at its quantiles. Rows of equal order are
    numbered by then, or in no stated way.
    """
    d = df.withColumn("_o", order)
    at = d.agg(F.percentile_approx("_o", [k / _PARTS for k in range(1, _PARTS)], 10_000)).first()[0] or []
    d = d.withColumn("_part", bounds_below(F.col("_o"), sorted(set(at))))
    counts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # at most _PARTS rows
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_o", *([then] if then else []))) - 1
    return d.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_o", "_part", "_own", "_before")


def influence(df: DataFrame, key: str, features: list[str], target: str, weights: list[float], shuffle: Column) -> DataFrame:
    """What a linear model (constant first) loses when one feature's values are dealt to other rows: feature, rmse, shuffled, change.

    key numbers the rows (unique whole numbers), shuffle is a whole number that orders them anew; the row that is i-th by key gets the value of the
    row that is i-th by shuffle. Both numberings are made in parts and joined, so no column is collected.
    """
    d = df.select(key, *[F.col(c).cast("double").alias(c) for c in [*features, target]]).withColumn("_s", shuffle)
    d = numbered(numbered(d, F.col(key), "_i"), F.col("_s"), "_j", key)
    other = d.select(F.col("_j").alias("_i"), *[F.col(c).alias(f"_{c}") for c in features])
    predicted = lambda swapped: sum((w * F.col(f"_{c}" if c == swapped else c) for c, w in zip(features, weights[1:], strict=True)), F.lit(weights[0]))
    error = lambda swapped: F.sqrt(F.avg((F.col(target) - predicted(swapped)) * (F.col(target) - predicted(swapped))))
    found = d.join(other, "_i").agg(error(None).alias("rmse"), *[error(c).alias(f"_{c}") for c in features])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{c}").alias("shuffled")) for c in features])).alias("r")
    return found.select("rmse", rows).select("r.feature", "rmse", "r.shuffled", (F.col("r.shuffled") - F.col("rmse")).alias("change"))


def least_squares(df: DataFrame, features: list[str], target: str) -> list[float]:
    """Weights (constant first) of a target on features over the whole table, from one pass."""
    products = fold_products(df.withColumn("_all", F.lit(0)), [], "_all", [*features, target]).first()
    return ridge(_square(products["products"], len(features) + 2), list(range(1, len(features) + 1)), 0.0).tolist()
