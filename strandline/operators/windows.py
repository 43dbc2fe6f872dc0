"""Window operators over ordered series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def moving_average(x: Column, w: WindowSpec, size: int) -> Column:
    """Centred mean of size rows with zeros beyond the ends; the first and last row keep their value.

    An even size covers size/2 rows before and size/2 - 1 after.
    """
    frame = w.rowsBetween(-(size // 2), size - 1 - size // 2)
    edge = F.lag(F.lit(1)).over(w).isNull() | F.lead(F.lit(1)).over(w).isNull()
    return F.when(edge, x).otherwise(F.sum(x).over(frame) / size)


def outliers_to_null(x: Column, partition: WindowSpec, sigmas: float = 2.0) -> Column:
    """Null where outside the mean by more than so many population standard deviations."""
    return F.when(F.abs(x - F.avg(x).over(partition)) <= sigmas * F.stddev_pop(x).over(partition), x)


def filled(df: DataFrame, by: list[str], order: str, value: str, limit: int = 10) -> DataFrame:
    """Linear fill of nulls between known rows of a series, by row position; at most limit rows from either known end.

    Leading and trailing nulls within the limit take the nearest known value.
    """
    w = Window.partitionBy(*by).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(value).alias("v")))
    d = df.withColumn("_n", F.row_number().over(w))
    d = d.withColumns({"_p": F.last(known, ignorenulls=True).over(w), "_q": F.last(known, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc(order)))})
    n, p, q = F.col("_n"), F.col("_p"), F.col("_q")
    near = (n - p["n"] <= limit) | (q["n"] - n <= limit)
    inside = p["v"] + (q["v"] - p["v"]) * (n - p["n"]) / (q["n"] - p["n"])
    new = F.when(F.col(value).isNotNull(), F.col(value)).when(p.isNotNull() & q.isNotNull() & near, inside).when(p.isNull() & (q["n"] - n <= limit), q["v"]).when(q.isNull() & (n - p["n"] <= limit), p["v"])
    return d.withColumn(value, new).drop("_n", "_p", "_q")


def exponential_mean(df: DataFrame, by: list[str], order: str, value: str, out: str, span: int = 10) -> DataFrame:
    """Recursive exponential mean m = m + a (x - m), a = 2 / (span + 1), from the first value; nulls keep the mean.

    A value's weight falls below what a double resolves after a number of rows that the span gives. A series is cut into blocks of so many
    rows: a row's mean is the weighted sum over its own block so far, and over the block before by that one's sum. All frames only grow.
    """
    a = 2 / (span + 1)
    rows = max(1, int(np.ceil(np.log(1e-20) / np.log(1 - a)))) if a < 1 else 1
    x, given = F.col(value).cast("double"), F.col(value).isNotNull()
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("_n", F.count(value).over(w) - 1)  # number among the known rows
    j = F.col("_n") % rows
    grown = F.when(given, x * F.when(F.col("_n") == 0, 1.0).otherwise(a) * F.pow(F.lit(1 - a), (rows - 1 - j).cast("double")))
    block = Window.partitionBy(*by, F.floor(F.col("_n") / rows)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_sum", F.sum(grown).over(block))
    # the sum at the last known row of the block before
    full = given & (j == rows - 1)
    earlier = F.last(F.when(full, F.col("_sum")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_earlier", earlier)
    mean = F.col("_sum") / F.pow(F.lit(1 - a), (rows - 1 - j).cast("double")) + F.coalesce("_earlier", F.lit(0.0)) * F.pow(F.lit(1 - a), (j + 1).cast("double"))
    d = d.withColumn("_m", F.when(given, mean))
    return d.withColumn(out, F.last("_m", ignorenulls=True).over(w)).drop("_n", "_sum", "_earlier", "_m")


def trailing(df: DataFrame, by: list[str], time: str, reach: int, values: list[str]) -> DataFrame:
    """Rows with the mean and population deviation (value_mean, value_std) of each value over [time - reach, time] of their series; time is a whole number.

    Time is cut into pieces of the reach. A row's span is its own piece's rows up to it and the earlier piece's from its start on; both are frames that
    only grow, and their means and variances are put together.
    """
    piece = F.floor(F.col(time) / reach)
    late = F.explode(F.array(F.struct(piece.alias("p"), F.lit(True).alias("own"), F.col(time).alias("t")), F.struct((piece + 1).alias("p"), F.lit(False).alias("own"), (F.col(time) + reach).alias("t")))).alias("_k")
    d = df.select("*", late).select(*df.columns, F.col("_k.p").alias("_p"), F.col("_k.own").alias("_own"), F.col("_k.t").alias("_at"))
    up = Window.partitionBy(*by, "_p").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "_p").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    for side, kept, w in (("o", F.col("_own"), up), ("e", ~F.col("_own"), down)):
        part = lambda c: F.when(kept, F.col(c))  # noqa: E731, B023
        d = d.withColumns({f"_{side}{f}_{c}": g(part(c)).over(w) for c in values for f, g in (("n", F.count), ("s", F.sum), ("v", F.var_pop))})
    out = d.where("_own")
    for c in values:
        n1, s1, v1, n2, s2, v2 = (F.coalesce(F.col(f"_{s}{f}_{c}"), F.lit(0)) for s in "oe" for f in "nsv")
        n, gap = F.nullif(n1 + n2, F.lit(0)), F.coalesce(F.try_divide(s1, n1) - F.try_divide(s2, n2), F.lit(0.0))
        variance = (n1 * v1 + n2 * v2) / n + gap * gap * (n1 / n) * (n2 / n)
        out = out.withColumns({f"{c}_mean": (s1 + s2) / n, f"{c}_std": F.sqrt(variance)})
    return out.select(*df.columns, *[f"{c}_{k}" for c in values for k in ("mean", "std")])


def runs(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Numbers of runs of equal flags in order (column run)."""
    w = Window.partitionBy(*by).orderBy(order)
    turn = F.when(F.coalesce(F.lag(flag).over(w) == F.col(flag), F.lit(False)), 0).otherwise(1)
    return df.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(w)).drop("_turn")


#: Days of all series that one task takes about.
DAYS_A_TASK = 1_000_000


def days_spanned(df: DataFrame, by: list[str], day: str) -> int:
    """Number of days from each series' first to its last, of all series."""
    spans = df.groupBy(*by).agg((F.datediff(F.max(day), F.min(day)) + 1).alias("n"))
    return spans.agg(F.sum("n")).first()[0] or 0


def daily_linear(df: DataFrame, by: list[str], day: str, value: str, days: int | None = None) -> DataFrame:
    """A row for every day from a series' first to its last, linear in time between its days (one row a day).

    Series are dealt to as many tasks as their days need (days, counted if not given): days are made after the shuffle, so its size
    doesn't tell how many a task gets. Windows over the series that follow need no other shuffle and sort no more than that.
    """
    days = days_spanned(df, by, day) if days is None else days
    df = df.repartition(max(days // DAYS_A_TASK + 1, df.sparkSession.sparkContext.defaultParallelism), *by)
    w = Window.partitionBy(*by).orderBy(day)
    d = df.select(*by, day, F.col(value).alias("_v"), F.lead(day).over(w).alias("_next"), F.lead(value).over(w).alias("_nv"))
    last = F.coalesce(F.date_sub("_next", 1), F.col(day))
    d = d.select("*", F.explode(F.sequence(F.col(day), last)).alias("_d"))
    v = F.when(F.col("_next").isNull(), F.col("_v")).otherwise(F.col("_v") + (F.col("_nv") - F.col("_v")) * F.datediff("_d", day) / F.datediff("_next", day))
    return d.select(*by, F.col("_d").alias(day), v.alias(value))
