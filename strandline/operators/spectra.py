"""Least-squares spectra of unevenly sampled series, as sums over observations and a frequency grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2 * 3.141592653589793


def sums(series: DataFrame, by: list[str], time: str, values: list[str], frequencies: Column) -> DataFrame:
    """For each key and frequency: centred products of cos, sin and the values, from which all spectra follow.

    frequencies: an array column; each row meets each of its frequencies once and products are summed before they are shuffled.
    """
    x = series.select(*by, time, *values, F.explode(frequencies).alias("f"))
    x = x.select(*by, "f", *values, F.cos(TWO_PI * F.col("f") * F.col(time)).alias("c"), F.sin(TWO_PI * F.col("f") * F.col(time)).alias("s"))
    parts = {"cc": ("c", "c"), "ss": ("s", "s"), "cs": ("c", "s")} | {f"{v}_{p}": (v, p) for v in values for p in "cs"} | {f"{v}_{w}": (v, w) for i, v in enumerate(values) for w in values[i:]}
    return x.groupBy(*by, "f").agg(F.count(F.lit(1)).alias("n"), *[(F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)).alias(name) for name, (a, b) in parts.items()])


def cross_power(u: str, v: str) -> Column:
    """Cross-spectrum of two values with a floating mean, not normalized; with u = v the power."""
    c = F.col
    det = c("cc") * c("ss") - c("cs") * c("cs")
    return (c("ss") * c(f"{u}_c") * c(f"{v}_c") + c("cc") * c(f"{u}_s") * c(f"{v}_s") - c("cs") * (c(f"{u}_c") * c(f"{v}_s") + c(f"{u}_s") * c(f"{v}_c"))) / det


def best_slope(spectra: DataFrame, by: list[str], low: float, high: float, step: float) -> DataFrame:
    """Beach slope at which the tide-corrected series x + z/slope has the least energy over the given frequencies.

    spectra: sums() over values x and z. Energy is quadratic in 1/slope, so three spectra serve every candidate.
    """
    e = spectra.groupBy(*by).agg(F.sum(cross_power("x", "x")).alias("xx"), F.sum(cross_power("x", "z")).alias("xz"), F.sum(cross_power("z", "z")).alias("zz"))
    count = int(round((high - low) / step))
    slopes = F.transform(F.sequence(F.lit(0), F.lit(count)), lambda k: low + k * step)
    energy = F.transform(slopes, lambda s: F.struct((F.col("xx") + 2 * F.col("xz") / s + F.col("zz") / (s * s)).alias("energy"), s.alias("slope")))
    return e.select(*by, F.array_min(energy).alias("m")).select(*by, "m.slope", "m.energy")
