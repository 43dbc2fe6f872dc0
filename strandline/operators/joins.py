"""As-of, range and spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, tolerance: float) -> DataFrame:
    """Left rows with the right row of the same key nearest in time (numbers), the earlier on ties; nulls beyond the tolerance.

    Both sides are merged per key and time, so a key is sorted once; right columns are prefixed ``r_``.
    """
    names = [c for c in right.columns if c not in by]
    row = F.struct(*[F.col(c).alias(c) for c in names])
    merged = left.select("*", F.col(time).alias("_t"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_r"), F.lit(1).alias("_side"))
    other = right.select(*[F.col(k) for k in by], F.col(right_time).alias("_t"), row.alias("_r"), F.lit(0).alias("_side"))
    merged = merged.unionByName(other, allowMissingColumns=True)
    # right rows come before left rows of the same time in both directions; both frames grow from a window's start, so each is one pass
    before = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_r", ignorenulls=True)
    found = merged.withColumns({"_before": last.over(before), "_after": last.over(after)}).where("_side = 1")
    back, ahead = F.col("_t") - F.col(f"_before.{right_time}"), F.col(f"_after.{right_time}") - F.col("_t")
    best = F.when(ahead.isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    found = found.withColumn("_best", best)
    near = F.abs(F.col(f"_best.{right_time}") - F.col("_t")) <= tolerance
    return found.select(*left.columns, *[F.when(near, F.col(f"_best.{c}")).alias(f"r_{c}") for c in names])


#: Parts of a series that are sorted on their own, and intervals between its samples that are broadcast at most.
SERIES_PARTS = 256
BROADCAST_INTERVALS = 300_000


def intervals(series: DataFrame, time: str, value: str) -> DataFrame:
    """The intervals between a series' samples: prev_time, prev, next_time, next; one before the first sample and one after the last have nulls.

    The series is cut into parts of time that are sorted on their own; a part's last interval ends at the first sample of the next part that has any.
    """
    low, high = series.agg(F.min(time).cast("double"), F.max(time).cast("double")).first()
    width = ((high or 0.0) - (low or 0.0)) / SERIES_PARTS or 1.0
    s = series.select(F.col(time).alias("prev_time"), F.col(value).alias("prev"), F.floor((F.col(time) - F.lit(low or 0.0)) / width).alias("_part"))
    w = Window.partitionBy("_part").orderBy("prev_time")
    s = s.withColumn("_next", F.lead(F.struct("prev_time", "prev")).over(w))
    heads = s.groupBy("_part").agg(F.min(F.struct("prev_time", "prev")).alias("_head"))
    heads = heads.select("_part", "_head", F.lead("_head").over(Window.orderBy("_part")).alias("_later"))  # at most SERIES_PARTS + 1 rows
    s = s.join(F.broadcast(heads), "_part").withColumn("_next", F.coalesce("_next", "_later"))
    s = s.select("prev_time", "prev", F.col("_next.prev_time").alias("next_time"), F.col("_next.prev").alias("next"))
    first = heads.where("_part = 0").select(F.lit(None).cast(s.schema["prev_time"].dataType).alias("prev_time"), F.lit(None).cast(s.schema["prev"].dataType).alias("prev"), F.col("_head.prev_time").alias("next_time"), F.col("_head.prev").alias("next"))
    return s.union(first)


def bracketed(left: DataFrame, right: DataFrame, time: str, right_time: str, value: str, bucket: float | None = None) -> DataFrame:
    """Left rows with the right samples at or before and strictly after their time, however far: prev_time, prev, next_time, next.

    One series serves all left rows. Its intervals are dealt to time buckets (of a given width, or about one sample to each) and joined on the bucket:
    by a broadcast if they are few, else by a join in which AQE may split a bucket that many left rows share.
    """
    n, low, high = right.where(F.col(right_time).isNotNull()).agg(F.count(F.lit(1)), F.min(right_time).cast("double"), F.max(right_time).cast("double")).first()
    width = bucket or ((high - low) / n if n and high > low else 1.0)
    low, high = low or 0.0, high or 0.0
    dealt = lambda t: F.floor((F.greatest(F.least(t.cast("double"), F.lit(high)), F.lit(low)) - F.lit(low)) / width)
    spread = intervals(right.where(F.col(right_time).isNotNull()), right_time, value)
    start, end = F.coalesce(F.col("prev_time").cast("double"), F.lit(low)), F.coalesce(F.col("next_time").cast("double"), F.lit(high))
    spread = spread.select("*", F.explode(F.sequence(dealt(start), dealt(end))).alias("_b"))
    if 2 * n <= BROADCAST_INTERVALS:
        spread = F.broadcast(spread)
    inside = (F.col("prev_time").isNull() | (F.col(time) >= F.col("prev_time"))) & (F.col("next_time").isNull() | (F.col(time) < F.col("next_time")))
    keyed = left.withColumn("_left", dealt(F.col(time)))
    return keyed.join(spread, (F.col("_left") == F.col("_b")) & inside, "left").drop("_left", "_b")


def interpolated(bracket: DataFrame, time: str) -> Column:
    """Linear value between bracketing samples; null outside the series."""
    t = F.col(time)
    return F.when(F.col("next_time").isNotNull(), F.col("prev") + (F.col("next") - F.col("prev")) * (t - F.col("prev_time")) / (F.col("next_time") - F.col("prev_time")))


def in_intervals(left: DataFrame, intervals: DataFrame, time: str, start: str, end: str, order: str, columns: list[str], bucket: float | None = None) -> DataFrame:
    """Left rows tagged by the interval [start, end] that holds their time, the one with the highest order; nulls where none does.

    Intervals are taken by size: of each size (powers of four), time is cut into buckets at most half as long as any of them, so in a bucket an
    interval starts, ends or covers the whole. Left rows are merged with the starts and ends in their bucket and sorted; the highest order that
    has started, or is yet to end, is a maximum over a frame that only grows. No pairs are made, however many intervals lie over one another.
    bucket has no effect: widths follow from the intervals.
    """
    long = (F.col("_e") - F.col("_s")).cast("double")
    given = intervals.where(F.col(start) <= F.col(end)).select(F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"), F.struct(F.col(order).alias("_o"), *[F.col(c).alias(c) for c in columns]).alias("_i"))
    given = given.withColumn("_size", F.when(long > 0, F.floor(F.log2(long) / 2)))
    sizes = [r[0] for r in given.select("_size").distinct().collect()]  # a few: powers of four between the shortest and the longest
    kind = given.schema["_i"].dataType
    rows = left.select("*", F.col(time).cast("double").alias("_t"), F.lit(None).cast(kind).alias("_best"))
    for size in sizes:
        mine = given.where(F.col("_size").eqNullSafe(F.lit(size).cast("long")))
        if size is None:  # points
            bucket = lambda t: t
            events = mine.select(F.col("_s").alias("_b"), F.col("_s").alias("_t"), F.lit(None).cast(kind).alias("_begun"), F.lit(None).cast(kind).alias("_open"), F.col("_i").alias("_whole"))
        else:
            bucket = lambda t, width=4.0**size / 2: F.floor(t / width).cast("double")
            first, last = bucket(F.col("_s")), bucket(F.col("_e"))
            touched = mine.select("*", F.explode(F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda k: k.cast("double"))).alias("_b"))
            when = lambda c: F.when(c, F.col("_i"))
            begins, ends = F.col("_b") == first, F.col("_b") == last
            events = touched.select("_b", F.when(begins, F.col("_s")).otherwise(F.col("_e")).alias("_t"), when(begins).alias("_begun"), when(ends & ~begins).alias("_open"), when(~begins & ~ends).alias("_whole"))
        merged = rows.withColumns({"_b": bucket(F.col("_t")), "_is_left": F.lit(True)}).unionByName(events.withColumn("_is_left", F.lit(False)), allowMissingColumns=True)
        up = Window.partitionBy("_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        down = Window.partitionBy("_b").orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        best = F.greatest("_best", F.max("_begun").over(up), F.max("_open").over(down), F.max("_whole").over(Window.partitionBy("_b")))
        rows = merged.withColumn("_best", best).where("_is_left").select(*rows.columns)
    return rows.select(*left.columns, *[F.col(f"_best.{c}").alias(c) for c in columns])


def by_cell(left: DataFrame, right: DataFrame, cells: list[str]) -> DataFrame:
    """Inner join of two sides on the grid cells that they are dealt to.

    Both are sorted: sizes are estimated from files, which know nothing of the copies that dealing makes, so a side that looks small isn't broadcast.
    """
    return left.join(right.hint("merge"), cells)


def segments(vertices: DataFrame, line: str = "line_id", seq: str = "seq") -> DataFrame:
    """Consecutive vertices of lines as segments (line, seq, xa, ya, xb, yb)."""
    w = Window.partitionBy(line).orderBy(seq)
    return vertices.select(line, seq, F.col("x").alias("xa"), F.col("y").alias("ya"), F.lead("x").over(w).alias("xb"), F.lead("y").over(w).alias("yb")).where("xb is not null")


def crossings(transects: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """Points where transects (x0, y0 to x1, y1) cross line segments, once for each transect and segment.

    Both sides are dealt to the grid cells that their boxes touch and joined on the cell; touching end points count.
    Columns: transect_id, line_id, seq, x, y, dist (from the transect's start), len (the transect's).
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    t = transects.select("transect_id", "x0", "y0", "x1", "y1", span(F.col("x0"), F.col("x1")).alias("_cx")).select("*", span(F.col("y0"), F.col("y1")).alias("_cy"))
    s = lines.select("line_id", "seq", "xa", "ya", "xb", "yb", span(F.col("xa"), F.col("xb")).alias("_cx")).select("*", span(F.col("ya"), F.col("yb")).alias("_cy"))
    j = by_cell(t, s, ["_cx", "_cy"])
    den = "((x1 - x0) * (yb - ya) - (y1 - y0) * (xb - xa))"
    j = j.where(f"{den} <> 0").withColumns({"u": F.expr(f"((xa - x0) * (yb - ya) - (ya - y0) * (xb - xa)) / {den}"), "v": F.expr(f"((xa - x0) * (y1 - y0) - (ya - y0) * (x1 - x0)) / {den}")})
    j = j.where("u between 0 and 1 and v between 0 and 1").dropDuplicates(["transect_id", "line_id", "seq"])
    return j.select("transect_id", "line_id", "seq", F.expr("x0 + u * (x1 - x0)").alias("x"), F.expr("y0 + u * (y1 - y0)").alias("y"), F.expr("u * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))").alias("dist"), F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("len"))


def first_crossings(found: DataFrame) -> DataFrame:
    """Of a transect's crossings with a line, the nearest to its start; the lower segment on ties."""
    return found.groupBy("transect_id", "line_id").agg(F.min_by(F.struct("x", "y", "dist", "len"), F.struct("dist", "seq")).alias("p")).select("transect_id", "line_id", "p.x", "p.y", "p.dist", "p.len")


def point_to_segment(px: Column, py: Column, xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = xb - xa, yb - ya
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - xa) * dx + (py - ya) * dy) / (dx * dx + dy * dy)))
    return F.hypot(px - xa - t * dx, py - ya - t * dy)
