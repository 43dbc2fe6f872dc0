"""Operators that settle in rounds over all transects at once: cliffs along profiles, transects that cross."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.joins import by_cell
from strandline.operators.rounds import State

#: A cliff is steeper or higher than this, on a coast that is higher than LOW_COAST, with its top farther than NEAR_PEAK from the highest point.
CLIFF_SLOPE, CLIFF_HEIGHT, LOW_COAST, NEAR_PEAK = 0.6, 15.0, 10.0, 10.0


def _above_chord(z: str, at: str, first: str, last: str) -> Column:
    """Height of a profile's sample over the chord between two of its samples (structs of at and z)."""
    rise = (F.col(f"{last}.z") - F.col(f"{first}.z")) / (F.col(f"{last}.at") - F.col(f"{first}.at"))
    return F.col(z) - F.col(f"{first}.z") - (F.col(at) - F.col(f"{first}.at")) * rise


def cliffs(profile: DataFrame, by: str, at: str, z: str) -> DataFrame:
    """Of each profile (samples z at distances at): toe, top, height, slope and whether they make a cliff.

    Seaward of its lowest sample a profile doesn't count. In each round the top moves seaward to the sample highest over the chord from
    the toe to the profile's end, then the toe landward to the one lowest under the chord from the lowest sample to the top, until
    neither moves. All profiles take part in a round until none changes. Profiles of one sample have no row.
    """
    samples = profile.where(F.col(z).isNotNull()).select(by, F.col(at).cast("double").alias("at"), F.col(z).cast("double").alias("z"))
    point = F.struct("at", "z")
    limits = samples.groupBy(by).agg(F.min_by(point, F.struct("z", "at")).alias("low"), F.max_by(point, F.struct("z", -F.col("at"))).alias("peak"), F.max(point).alias("end"))
    limits = limits.where("low.at < end.at")
    state = limits.select(by, "low", "peak", "end", F.col("low").alias("toe"), F.col("end").alias("top"))
    # profiles are cut and dealt once; in a round only transects that still move are joined with theirs, where they lie
    inside = samples.join(limits.select(by, F.col("low.at").alias("_from")), by).where(F.col("at") >= F.col("_from")).drop("_from").repartition(by).persist()
    held = State(state.withColumn("moving", F.lit(True)))
    while held.table.where("moving").head(1):
        live, rest = held.table.where("moving"), held.table.where("not moving")
        over = inside.join(live, by).withColumn("d", _above_chord("z", "at", "toe", "end")).where("at >= toe.at and at < end.at")
        best = over.groupBy(by).agg(F.max_by(F.struct("at", "z", "d"), F.struct("d", -F.col("at"))).alias("b"))
        s = live.join(best, by, "left").withColumn("up", F.coalesce((F.col("b.d") > 0.001) & (F.col("b.at") < F.col("top.at")), F.lit(False)))
        s = s.withColumn("top", F.when(F.col("up"), F.struct("b.at", "b.z")).otherwise(F.col("top"))).drop("b")
        under = inside.join(s, by).where("top.at > low.at and at < top.at").withColumn("d", _above_chord("z", "at", "low", "top"))
        best = under.groupBy(by).agg(F.min_by(F.struct("at", "z", "d"), F.struct("d", "at")).alias("b"))
        s = s.join(best, by, "left").withColumn("down", F.coalesce((F.col("b.d") < -0.001) & (F.col("b.at") > F.col("toe.at")), F.lit(False)))
        s = s.withColumn("toe", F.when(F.col("down"), F.struct("b.at", "b.z")).otherwise(F.col("toe"))).withColumn("moving", F.col("up") | F.col("down"))
        held.put(s.select(*rest.columns).unionByName(rest))
    inside.unpersist()
    state = held.table
    height = F.col("top.z") - F.col("toe.z")
    slope = F.try_divide(height, F.col("top.at") - F.col("toe.at"))
    is_cliff = (F.col("peak.z") >= LOW_COAST) & (F.abs(F.col("top.at") - F.col("peak.at")) >= NEAR_PEAK) & ((slope > CLIFF_SLOPE) | (height > CLIFF_HEIGHT))
    return state.select(by, F.col("toe.at").alias("toe"), F.col("top.at").alias("top"), height.alias("height"), F.round(slope, 6).alias("slope"), F.coalesce(is_cliff, F.lit(False)).alias("cliff"))


def crossing_pairs(transects: DataFrame, cell: float, by: str | None = None) -> DataFrame:
    """Pairs of transects (transect_id, x0, y0, x1, y1) that cross or touch, each from both sides: transect_id, len, other, other_len.

    by: a column whose values part the transects into sets that don't meet one another; it stays in the pairs.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    keys = [by] if by else []
    own = ["transect_id", "x0", "y0", "x1", "y1"]
    dealt = transects.select(*keys, *own, F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))).alias("len"), span(F.col("x0"), F.col("x1")).alias("cx")).select("*", span(F.col("y0"), F.col("y1")).alias("cy"))
    other = dealt.select(*keys, "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in (*own, "len")])
    side = lambda ax, ay, bx, by, px, py: f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"
    across = [side("x0", "y0", "x1", "y1", f"o_x{k}", f"o_y{k}") for k in (0, 1)]
    back = [side("o_x0", "o_y0", "o_x1", "o_y1", f"x{k}", f"y{k}") for k in (0, 1)]
    boxes = " and ".join(f"greatest({c}0, {c}1) >= least(o_{c}0, o_{c}1) and least({c}0, {c}1) <= greatest(o_{c}0, o_{c}1)" for c in "xy")
    pairs = by_cell(dealt, other, [*keys, "cx", "cy"]).where("transect_id <> o_transect_id").where(f"{boxes} and {across[0]} * {across[1]} <= 0 and {back[0]} * {back[1]} <= 0")
    return pairs.select(*keys, "transect_id", "len", F.col("o_transect_id").alias("other"), F.col("o_len").alias("other_len")).distinct()


def uncrossed(transects: DataFrame, cell: float = 20.0) -> DataFrame:
    """Transects (transect_id, x0, y0, x1, y1) of which no two cross: the shortest stays (the lower id on ties), those that cross it go, and so on.

    In a round every transect that is shorter than all it still crosses stays, wherever it is, and those go. So one that goes always
    crosses one that stays. As many rounds are needed as such choices depend on one another along a run of transects.
    """
    pairs = crossing_pairs(transects, cell)
    nothing = F.lit(None)
    held = State(pairs.withColumn("gone", F.lit(False)))
    while held.table.where("not gone").head(1):
        live, lost = held.table.where("not gone"), held.table.where("gone")
        least = live.groupBy("transect_id", "len").agg(F.min(F.struct("other_len", "other")).alias("m"))
        stays = least.where(F.struct("len", "transect_id") < F.col("m")).select("transect_id")
        out = live.join(stays, "transect_id").select(F.col("other").alias("transect_id")).distinct()
        left = live.join(out, "transect_id", "left_anti").join(out.select(F.col("transect_id").alias("other")), "other", "left_anti").select(*lost.columns)
        marked = out.select("transect_id", *[nothing.cast(lost.schema[c].dataType).alias(c) for c in ("len", "other", "other_len")], F.lit(True).alias("gone"))
        held.put(left.unionByName(lost).unionByName(marked))
    return transects.join(held.table.select("transect_id").distinct(), "transect_id", "left_anti")


def respaced(transects: DataFrame, by: str, cell: float = 20.0, thin: int = 2) -> DataFrame:
    """Transects of lines (by, transect_id in order along a line, x0, y0, x1, y1) with runs of crossing ones spread out and thinned.

    A run is of neighbours that all cross some transect of their line. Its ends (x1, y1) are set evenly from that of its first
    transect to that of the first one behind it; a run at a line's end ends before the last transect, which stays as it is. Of a
    run every thin-th transect is kept, from its first.
    """
    hit = crossing_pairs(transects, cell, by).select(by, "transect_id").distinct().withColumn("hit", F.lit(True))
    w = Window.partitionBy(by).orderBy("transect_id")
    t = transects.join(hit, [by, "transect_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    # the last transect of a line ends a run that reaches it
    t = t.withColumn("hit", F.col("hit") & F.lead("transect_id").over(w).isNotNull())
    starts = F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False))
    t = t.withColumn("run", F.when(F.col("hit"), F.sum(starts.cast("int")).over(w)))
    behind = F.first(F.when(~F.col("hit"), F.struct("x1", "y1")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    r = Window.partitionBy(by, "run").orderBy("transect_id")
    t = t.withColumn("b", behind).withColumns({"j": F.row_number().over(r) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(by, "run")), "a": F.first(F.struct("x1", "y1")).over(r)})
    share = F.when(F.col("n") > 1, F.col("j") / (F.col("n") - 1)).otherwise(0.0)
    moved = lambda c: F.when(F.col("hit"), F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}"))).otherwise(F.col(c)).alias(c)
    return t.where(~F.col("hit") | (F.col("j") % thin == 0)).select(by, "transect_id", "x0", "y0", moved("x1"), moved("y1"), "hit")
