"""Learning jobs on tables: clustering, components, classifiers, a regression for each transect."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)


def clusters(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """k-means classes, numbered by the mean of the first column."""
    x = assembled(df, columns)
    found = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="_p").fit(x).transform(x)
    rank = found.groupBy("_p").agg(F.avg(columns[0]).alias("m")).select("_p", (F.row_number().over(Window.orderBy("m", "_p")) - 1).alias("cluster"))
    return found.join(F.broadcast(rank), "_p").drop("_p", "features")


def elbow(df: DataFrame, columns: list[str], ks: list[int], seed: int = 1) -> list[tuple[int, float, float]]:
    """For each k: cost and silhouette."""
    x = assembled(df, columns).cache()
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(x)
        out.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(x)))))
    x.unpersist()
    return out


def principal_components(df: DataFrame, columns: list[str], share: float = 0.9) -> tuple[DataFrame, list[float]]:
    """Scores on as many components as explain the share, signs fixed by each one's largest loading; and all shares."""
    x = assembled(df, columns)
    model = PCA(k=len(columns), inputCol="features", outputCol="_s").fit(x)
    explained = [float(v) for v in model.explainedVariance]
    keep = int(np.searchsorted(np.cumsum(explained), share)) + 1
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] > 0 else -1.0 for j in range(keep)]
    scored = model.transform(x).withColumn("_a", vector_to_array("_s"))
    return scored.select(*df.columns, *[(F.col("_a")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(keep)]), explained


def perceptron(train: DataFrame, test: DataFrame, columns: list[str], label: str, hidden: tuple[int, ...] = (16, 8, 4), seed: int = 1) -> DataFrame:
    """Test rows with the class that a multilayer perceptron predicts; labels are 0, 1, ..."""
    classes = int(train.agg(F.max(label)).first()[0]) + 1
    fit = MultilayerPerceptronClassifier(layers=[len(columns), *hidden, classes], labelCol=label, featuresCol="features", maxIter=60, seed=seed).fit(assembled(train, columns))
    return fit.transform(assembled(test, columns)).select(*test.columns, F.col("prediction").cast("int").alias("predicted"))


def ridge_by_group(df: DataFrame, by: str, order: str, value: str, lags: int = 10, penalty: float = 1.0, train: float = 0.8) -> DataFrame:
    """A ridge regression of each group's next value on its last ones, in closed form: (by, n_test, rmse, naive_rmse).

    Groups are series of one transect; they are fitted side by side.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values(order)[value].to_numpy(float)
        out = {by: [rows[by].iloc[0]], "n_test": [0], "rmse": [None], "naive_rmse": [None]}
        if len(y) > 3 * lags:
            x = np.lib.stride_tricks.sliding_window_view(y, lags)[:-1]
            t = y[lags:]
            cut = int(len(t) * train)
            mean, scale = x[:cut].mean(0), x[:cut].std(0) + 1e-9
            z = (x - mean) / scale
            w = np.linalg.solve(z[:cut].T @ z[:cut] + penalty * np.eye(lags), z[:cut].T @ (t[:cut] - t[:cut].mean()))
            e = t[cut:] - (z[cut:] @ w + t[:cut].mean())
            out |= {"n_test": [len(e)], "rmse": [float(np.sqrt((e * e).mean()))], "naive_rmse": [float(np.sqrt(((t[cut:] - x[cut:, -1]) ** 2).mean()))]}
        return pd.DataFrame(out)

    return df.groupBy(by).applyInPandas(fit, f"{by} bigint, n_test bigint, rmse double, naive_rmse double")
