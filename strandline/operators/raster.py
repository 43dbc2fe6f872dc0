"""Operators on pixel tables that go beyond single pixels: objects and contours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.nearest import nearest
from strandline.operators.rounds import settled


def objects(mask: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected sets of mask pixels (image_id, row, col) by their four neighbours: adds label, the smallest row * 2^20 + col of the set.

    Labels spread to neighbours and then jump along rows of equal label until nothing changes; images are independent.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])

    def step(state: DataFrame) -> DataFrame:
        sent = state.select("image_id", "label", F.explode(steps).alias("s"), "row", "col").select("image_id", "label", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
        near = sent.groupBy("image_id", "row", "col").agg(F.min("label").alias("near"))
        state = state.join(near.hint("merge"), ["image_id", "row", "col"])
        # all pixels of a label take the least label that any of them met
        least = state.groupBy("image_id", "label").agg(F.min("near").alias("least"))
        return state.join(least.hint("merge"), ["image_id", "label"]).select("image_id", "row", "col", F.col("least").alias("label"))

    state = mask.select("image_id", "row", "col", (F.col("row") * (1 << 20) + F.col("col")).alias("label"))
    return settled(state, step, F.xxhash64("image_id", "row", "col", "label"), rounds)


def contour_segments(pixels: DataFrame, band: str, level: float) -> DataFrame:
    """Segments of the line at a level (image_id, row, col of the cell, xa, ya, xb, yb) by marching squares.

    Each 2 x 2 cell is made by looking along the row and the next row; cells with a null corner have none. Where
    two opposite corners are above, the mean of the corners decides how they are joined.
    """
    w = Window.partitionBy("image_id", "row").orderBy("col")
    p = pixels.select("image_id", "row", "col", F.col(band).alias("v")).withColumns({"right": F.lead("v").over(w), "next": F.lead("col").over(w)})
    p = p.where(F.col("next") == F.col("col") + 1)
    below = p.select("image_id", (F.col("row") - 1).alias("row"), "col", F.col("v").alias("d"), F.col("right").alias("c"))
    q = p.join(below, ["image_id", "row", "col"]).select("image_id", "row", "col", F.col("v").alias("a"), F.col("right").alias("b"), "c", "d").dropna()
    at = lambda u, v: (level - F.col(u)) / (F.col(v) - F.col(u))
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    point = {"t": (x + at("a", "b"), y), "r": (x + 1, y + at("b", "c")), "b": (x + at("d", "c"), y + 1), "l": (x, y + at("a", "d"))}
    seg = lambda u, v: F.struct(point[u][0].alias("xa"), point[u][1].alias("ya"), point[v][0].alias("xb"), point[v][1].alias("yb"))
    code = sum((F.when(F.col(k) >= level, bit).otherwise(0) for k, bit in (("a", 1), ("b", 2), ("c", 4), ("d", 8))), F.lit(0))
    high = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= level
    one = {1: ("l", "t"), 2: ("t", "r"), 3: ("l", "r"), 4: ("r", "b"), 6: ("t", "b"), 7: ("l", "b")}
    cases = F.when(F.lit(False), F.array(seg("l", "t")))
    for k, (u, v) in one.items():
        cases = cases.when(code.isin(k, 15 - k), F.array(seg(u, v)))
    cases = cases.when(code == 5, F.when(high, F.array(seg("t", "r"), seg("l", "b"))).otherwise(F.array(seg("l", "t"), seg("r", "b"))))
    cases = cases.when(code == 10, F.when(high, F.array(seg("l", "t"), seg("r", "b"))).otherwise(F.array(seg("t", "r"), seg("l", "b"))))
    return q.select("image_id", "row", "col", F.explode(cases).alias("s")).select("image_id", "row", "col", "s.*")


def box_deviations(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Full images with the deviation of each band over a pixel and its eight neighbours (s and the band's name), mirrored at the edges.

    Sums and sums of squares are taken along rows and then along columns, so no pixel is copied or joined; the two
    windows are the only shuffles.
    """
    along, down = Window.partitionBy("image_id", "row").orderBy("col"), Window.partitionBy("image_id", "col").orderBy("row")
    three = lambda c, w: F.coalesce(F.lag(c).over(w), F.col(c)) + F.col(c) + F.coalesce(F.lead(c).over(w), F.col(c))
    p = pixels.withColumns({f"_q{b}": F.col(b) * F.col(b) for b in bands})
    p = p.withColumns({f"_s{b}": three(b, along) for b in bands} | {f"_r{b}": three(f"_q{b}", along) for b in bands})
    p = p.withColumns({f"_t{b}": three(f"_s{b}", down) / 9 for b in bands} | {f"_u{b}": three(f"_r{b}", down) / 9 for b in bands})
    deviation = lambda b: F.sqrt(F.greatest(F.col(f"_u{b}") - F.col(f"_t{b}") * F.col(f"_t{b}"), F.lit(0.0)))
    return p.select(*pixels.columns, *[deviation(b).alias(f"s{b}") for b in bands])


def first_below(transects: DataFrame, cells: DataFrame, size_x: float, size_y: float, threshold: float, nodes: int = 50) -> DataFrame:
    """Where each transect (transect_id, x0, y0, x1, y1) first meets a cell (row, col, v) under a threshold: transect_id, x, y, dist from its start.

    Cell (row, col) covers x from col * size_x and y from row * size_y; values under 0 are no data. So many nodes are sampled from end to
    end; between the neighbours of the first under the threshold it is sought again at about every metre. A transect on which only the
    last node is under the threshold, or none, has no row.
    """
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    t = transects.select("transect_id", "x0", "y0", "x1", "y1", length.alias("len"))
    known = cells.where("v >= 0").where(F.col("v") < threshold).select(F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"))

    def sampled(points: DataFrame) -> DataFrame:
        """Of points at a share of their transect, those in a cell under the threshold."""
        at = points.withColumns({"x": F.col("x0") + F.col("share") * (F.col("x1") - F.col("x0")), "y": F.col("y0") + F.col("share") * (F.col("y1") - F.col("y0"))})
        return at.withColumns({"_row": F.floor(F.col("y") / size_y), "_col": F.floor(F.col("x") / size_x)}).join(known.hint("merge"), ["_row", "_col"])

    coarse = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("k")).withColumn("share", F.col("k") / (nodes - 1))
    first = sampled(coarse).groupBy("transect_id").agg(F.min("k").alias("k")).where(F.col("k") < nodes - 1)
    low, high = F.greatest(F.col("k") - 1, F.lit(0)) / (nodes - 1), (F.col("k") + 1) / (nodes - 1)
    near = t.join(first.hint("merge"), "transect_id").withColumns({"low": low, "high": high}).withColumn("n", F.floor((F.col("high") - F.col("low")) * F.col("len")))
    fine = near.where("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    fine = fine.withColumn("share", F.col("low") + F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(0.0) * (F.col("high") - F.col("low")))
    found = sampled(fine).groupBy("transect_id").agg(F.min_by(F.struct("x", "y", (F.col("share") * F.col("len")).alias("dist")), "i").alias("p"))
    return found.select("transect_id", "p.x", "p.y", "p.dist")


def principal_axes(pixels: DataFrame, bands: list[str], by: str = "image_id") -> DataFrame:
    """Of each image, the means of its bands and the direction of their greatest variance: by, mean, axis, its largest part being positive.

    Sums of products come from one aggregate; the eigenvectors are found from one row an image.
    """
    pairs = [(a, b) for i, a in enumerate(bands) for b in bands[i:]]
    known = pixels.dropna(subset=bands)
    means = known.groupBy(by).agg(F.array(*[F.avg(c) for c in bands]).alias("mean"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov"))

    def run(batches):
        for batch in batches:
            axes = []
            for cov in batch["cov"]:
                v = np.zeros((len(bands), len(bands)))
                v[np.triu_indices(len(bands))] = cov
                axis = np.linalg.eigh(v + np.triu(v, 1).T)[1][:, -1]
                axes.append((axis * np.sign(axis[np.abs(axis).argmax()])).tolist())
            yield pd.DataFrame({by: batch[by], "mean": batch["mean"], "axis": axes})

    return means.mapInPandas(run, f"{by} {dict(pixels.dtypes)[by]}, mean array<double>, axis array<double>")


def pan_sharpened(pixels: DataFrame, bands: list[str], pan: str, by: str = "image_id") -> DataFrame:
    """Images (image_id, row, col, bands, pan) whose first principal component is replaced by the pan band: image_id, row, col, bands.

    The pan band is first given the component's distribution: its m-th value from below becomes the component's m-th, equal ones
    the last of theirs. As only that component changes, a pixel moves along the principal axis by the difference. Mask a pixel
    by nulls: where a band or pan is null it has no part in sums and ranks, and all its bands come out null.
    """
    columns = [by, "row", "col"]
    given = pixels.select(*columns, *[F.col(c).cast("double").alias(c) for c in bands], F.col(pan).cast("double").alias("_pan"))
    known = given.dropna()
    p = known.join(principal_axes(known, bands, by), by)
    first = sum(((F.col(c) - F.col("mean")[i]) * F.col("axis")[i] for i, c in enumerate(bands)), F.lit(0.0))
    upto = F.count(F.lit(1)).over(Window.partitionBy(by).orderBy("_pan").rangeBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("_first", first).withColumns({"_m": upto, "_r": F.row_number().over(Window.partitionBy(by).orderBy("_first"))})
    ranked = p.select(by, F.col("_r").cast("long").alias("_m"), F.col("_first").alias("_matched"))
    moved = F.col("_matched") - F.col("_first")
    done = p.join(ranked, [by, "_m"]).select(*columns, *[(F.col(c) + moved * F.col("axis")[i]).alias(c) for i, c in enumerate(bands)])
    return given.select(*columns).join(done, columns, "left")


def evaluated(pixels: DataFrame, truth: str, predicted: str, by: str = "image_id") -> DataFrame:
    """Of each image, how a class (0 or 1) is predicted and how far the line around it lies from the true one.

    Columns: by, n, accuracy, precision, recall, kappa, n_true and n_predicted (segments of either line), mean_distance and
    max_distance from the predicted line's ends of segments to the nearest of the true line's, and back_distance (the greatest from
    the true line to the predicted one), in pixels. Without a class or a line what needs it is null. Pixels without truth or
    prediction don't count.
    """
    p = pixels.select(by, "row", "col", F.col(truth).cast("double").alias("t"), F.col(predicted).cast("double").alias("p")).dropna()
    both, t, q = (F.sum(c) for c in (F.col("t") * F.col("p"), F.col("t"), F.col("p")))
    n = F.count(F.lit(1))
    counts = p.groupBy(by).agg(n.alias("n"), both.alias("_b"), t.alias("_t"), q.alias("_p"))
    right = (F.col("n") - F.col("_t") - F.col("_p") + 2 * F.col("_b")) / F.col("n")
    chance = (F.col("_t") * F.col("_p") + (F.col("n") - F.col("_t")) * (F.col("n") - F.col("_p"))) / (F.col("n") * F.col("n"))
    counts = counts.select(by, "n", right.alias("accuracy"), F.try_divide("_b", "_p").alias("precision"), F.try_divide("_b", "_t").alias("recall"), F.try_divide(right - chance, 1 - chance).alias("kappa"))
    image = p.withColumnRenamed(by, "image_id")
    ends = F.explode(F.array(F.struct(F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.col("xb").alias("x"), F.col("yb").alias("y")))).alias("e")

    def line(column: str, name: str) -> tuple[DataFrame, DataFrame]:
        s = contour_segments(image, column, 0.5)
        points = s.select("image_id", ends).select("image_id", "e.x", "e.y").distinct()
        # an end's place makes its number: lines of a class run through the middles between pixels
        return s.groupBy("image_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), points.withColumn(name, (F.col("y") * 2).cast("long") * (1 << 31) + (F.col("x") * 2).cast("long"))

    n_true, true = line("t", "true")
    n_predicted, found = line("p", "predicted")
    there = nearest(found, true, "predicted", "true", ["x", "y"], 1, by=["image_id"]).groupBy("image_id").agg(F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))
    back = nearest(true, found, "true", "predicted", ["x", "y"], 1, by=["image_id"]).groupBy("image_id").agg(F.max("distance").alias("back_distance"))
    out = counts.withColumnRenamed(by, "image_id")
    for other in (n_true, n_predicted, there, back):
        out = out.join(other, "image_id", "left")
    return out.fillna(0, ["n_true", "n_predicted"]).withColumnRenamed("image_id", by)
