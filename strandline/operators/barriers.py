"""Barriers along profiles (samples z at distances at, seaward end first): front and back, crest, widths, slopes, volume, and sections at a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.rounds import State

#: A sample counts as off the chord beyond this height; the back toe is sought so far behind the front top.
OFF_CHORD, BACK_LIMIT = 0.001, 300.0


def _profiles(profile: DataFrame, by: str, at: str, z: str) -> DataFrame:
    """Samples at or above sea level, each with the one before; every transect's in one partition, where it stays for all rounds."""
    s = profile.where(F.col(z).isNotNull() & (F.col(z) >= 0)).select(by, F.col(at).cast("double").alias("at"), F.col(z).cast("double").alias("z"))
    w = Window.partitionBy(by).orderBy("at")
    return s.withColumn("prev", F.lag(F.struct("at", "z")).over(w))


def _extremes(samples: DataFrame, state: DataFrame, by: str, start: str, end: str, low: str) -> DataFrame:
    """The samples highest over and lowest under the chord from start to end, of those from low to end: hi, lo (at, z, d); the nearest to the sea on ties."""
    chord = (F.col(f"{end}.z") - F.col(f"{start}.z")) / (F.col(f"{end}.at") - F.col(f"{start}.at"))
    d = F.col("z") - F.col(f"{start}.z") - (F.col("at") - F.col(f"{start}.at")) * chord
    over = samples.join(state.select(by, start, end, low), by).where((F.col("at") >= F.col(f"{low}.at")) & (F.col("at") <= F.col(f"{end}.at"))).withColumn("d", d)
    point = F.struct("at", "z", "d")
    return over.groupBy(by).agg(F.max_by(point, F.struct("d", -F.col("at"))).alias("hi"), F.min_by(point, F.struct("d", "at")).alias("lo"))


def _to(point: str) -> Column:
    return F.struct(F.col(f"{point}.at").alias("at"), F.col(f"{point}.z").alias("z"))


def _fronts(samples: DataFrame, by: str, level: float) -> DataFrame:
    """Front toe and top of each transect that can have a barrier: by, first, peak, last, toe, top."""
    point = F.struct("at", "z")
    limits = samples.groupBy(by).agg(F.min(point).alias("first"), F.max(point).alias("last"), F.max_by(point, F.struct("z", -F.col("at"))).alias("peak"))
    limits = limits.where(f"peak.z >= {level} and peak.at > first.at")
    held = State(limits.select(by, "first", "peak", "last", F.col("first").alias("toe"), F.col("peak").alias("top"), F.lit(False).alias("raised"), F.lit(True).alias("moving"), F.lit(True).alias("fits")))
    while held.table.where("moving").head(1):
        live, rest = held.table.where("moving"), held.table.where("not moving")
        # top: over the chord from the first sample; the peak where that is the first sample itself
        s = live.join(_extremes(samples, live, by, "first", "top", "first"), by, "left")
        s = s.withColumn("new", F.when(F.col("hi.at") == F.col("first.at"), F.col("peak")).otherwise(_to("hi")))
        s = s.withColumns({"fits": F.col("new.at") != F.col("last.at"), "up": (F.col("new.at") < F.col("top.at")) & (F.col("hi.d") > OFF_CHORD) & (F.col("new.z") > level)})
        s = s.withColumn("top", F.when(F.col("fits") & F.col("up"), F.col("new")).otherwise(F.col("top"))).drop("hi", "lo", "new")
        # toe: under the chord to the new top
        s = s.join(_extremes(samples, s, by, "first", "top", "first"), by, "left")
        s = s.withColumn("down", (F.col("lo.at") > F.col("toe.at")) & (F.col("lo.d") < -OFF_CHORD)).withColumn("toe", F.when(F.col("down"), _to("lo")).otherwise(F.col("toe"))).drop("hi", "lo")
        # once, a toe below the level goes to the sample nearest to it, or the one before if that is above
        s = s.withColumn("raise", (F.col("toe.z") < level) & ~F.col("raised"))
        near = samples.join(s.where("raise").select(by, "toe", "top"), by).where("at between toe.at and top.at")
        near = near.groupBy(by).agg(F.min_by(F.struct("at", "z", "prev"), F.struct(F.abs(F.col("z") - level), "at")).alias("n"))
        s = s.join(near, by, "left")
        s = s.withColumn("toe", F.when(F.col("raise"), F.when((F.col("n.z") > level) & F.col("n.prev").isNotNull(), F.col("n.prev")).otherwise(_to("n"))).otherwise(F.col("toe")))
        s = s.select(by, "first", "peak", "last", "toe", "top", (F.col("raised") | F.col("raise")).alias("raised"), (F.col("fits") & (F.col("up") | F.col("down") | F.col("raise"))).alias("moving"), "fits")
        held.put(s.unionByName(rest))
    return held.table.where("fits and top.at > toe.at and top.at < last.at").select(by, "first", "last", "toe", "top")


def _backs(samples: DataFrame, fronts: DataFrame, by: str) -> DataFrame:
    """Adds back_top and back_toe, the latter at most about BACK_LIMIT behind the front top."""
    near = samples.join(fronts.select(by, "top"), by).groupBy(by).agg(F.min_by(F.struct("at", "z"), F.struct(F.abs(F.col("at") - F.col("top.at") - BACK_LIMIT), "at")).alias("limit"))
    start = fronts.join(near, by).withColumn("limit", F.when(F.col("limit.at") > F.col("top.at"), F.col("limit")).otherwise(F.col("last")))
    held = State(start.select(by, "first", "last", "toe", "top", "limit", F.col("top").alias("back_top"), F.col("limit").alias("back_toe"), F.lit(True).alias("moving")))
    while held.table.where("moving").head(1):
        live, rest = held.table.where("moving"), held.table.where("not moving")
        s = live.join(_extremes(samples, live, by, "top", "limit", "back_top"), by, "left")
        s = s.withColumn("down", (F.col("lo.at") < F.col("back_toe.at")) & (F.col("lo.d") < -OFF_CHORD) & (F.col("lo.at") > F.col("back_top.at")))
        s = s.withColumn("back_toe", F.when(F.col("down"), _to("lo")).otherwise(F.col("back_toe"))).drop("hi", "lo")
        s = s.join(_extremes(samples, s, by, "top", "back_toe", "top"), by, "left")
        s = s.withColumn("up", (F.col("hi.at") != F.col("back_top.at")) & (F.col("hi.at") < F.col("back_toe.at")) & (F.col("hi.d") > OFF_CHORD))
        s = s.withColumn("back_top", F.when(F.col("up"), _to("hi")).otherwise(F.col("back_top"))).withColumn("moving", F.col("down") | F.col("up"))
        held.put(s.select(*rest.columns).unionByName(rest))
    return held.table.where("back_top.at <> last.at").drop("limit", "moving")


def barriers(profile: DataFrame, by: str, at: str, z: str, level: float) -> DataFrame:
    """Transects with a barrier: front_toe, front_top, back_top, back_toe, crest_at, crest, heights, widths, slopes and volume.

    level is mean high water. Samples below 0 or without a value don't count; cut profiles at a cliff's toe before. From the highest
    sample, the front top moves seaward and its toe landward while a sample lies off their chord; a toe below the level
    is raised to it once. The back toe and top follow likewise within BACK_LIMIT. Crest and volume are those of the samples from the
    front toe up to the back toe; the volume is what stands over the line between the two ends, at even spacing. All transects
    take part in a round; only those that still move are joined with their samples, which stay where they are.
    """
    samples = _profiles(profile, by, at, z).repartition(by).persist()
    found = _backs(samples, _fronts(samples, by, level), by)
    inside = samples.join(found.select(by, "toe", "back_toe"), by).where(F.col("at") >= F.col("toe.at")).where(F.col("at") < F.col("back_toe.at"))
    spacing = samples.where("prev is not null").groupBy(by).agg(F.min_by(F.col("at") - F.col("prev.at"), "at").alias("dx"))
    point = F.struct("at", "z")
    body = inside.groupBy(by).agg(F.max_by(point, F.struct("z", -F.col("at"))).alias("c"), F.sum("z").alias("sz"), F.min_by("z", "at").alias("z0"), F.max(point).alias("e"))
    out = found.join(body, by).join(spacing, by)
    rise = lambda a, b: F.col(f"{a}.z") - F.col(f"{b}.z")
    run = lambda a, b: F.col(f"{a}.at") - F.col(f"{b}.at")
    done = out.select(
        by,
        F.col("toe.at").alias("front_toe"),
        F.col("top.at").alias("front_top"),
        F.col("back_top.at").alias("back_top"),
        F.col("back_toe.at").alias("back_toe"),
        F.col("c.at").alias("crest_at"),
        F.col("c.z").alias("crest"),
        rise("top", "toe").alias("front_height"),
        rise("back_top", "back_toe").alias("back_height"),
        F.abs(run("toe", "back_toe")).alias("toe_width"),
        F.abs(run("top", "back_top")).alias("top_width"),
        (rise("top", "toe") / run("top", "toe")).alias("front_slope"),
        F.try_divide(rise("back_top", "back_toe"), run("back_top", "back_toe")).alias("back_slope"),
        (F.col("sz") * F.col("dx") - 0.5 * (F.col("z0") + F.col("e.z")) * F.abs(F.col("e.at") - F.col("toe.at"))).alias("volume"),
    )
    done = State(done).table
    samples.unpersist()
    return done


#: What a section that is open at one end has for width and volume.
OPEN = -9999.0


def sections(profile: DataFrame, by: str, at: str, z: str, levels: list[float]) -> DataFrame:
    """Of each profile at each level: by, level, crossings, width and volume between the first two crossings.

    The volume is the sum of the heights over the level of the samples in between, times the spacing. Without a crossing both
    are 0, with one they are OPEN. Samples must stand at even distances.
    """
    s = profile.where(F.col(z).isNotNull()).select(by, F.col(at).cast("double").alias("at"), F.col(z).cast("double").alias("z"), F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level"))
    wl = Window.partitionBy(by, "level").orderBy("at")
    s = s.withColumns({"nat": F.lead("at").over(wl), "nz": F.lead("z").over(wl)})
    crosses = ((F.col("z") < F.col("level")) & (F.col("nz") >= F.col("level"))) | ((F.col("z") >= F.col("level")) & (F.col("nz") < F.col("level")))
    s = s.withColumn("cut", F.when(crosses, F.col("at") + (F.col("level") - F.col("z")) / (F.col("nz") - F.col("z")) * (F.col("nat") - F.col("at"))))
    s = s.withColumn("k", F.count("cut").over(wl) - F.when(F.col("cut").isNotNull(), 1).otherwise(0))  # crossings before this sample
    first = lambda k: F.min(F.when((F.col("k") == k) & F.col("cut").isNotNull(), F.col("cut")))
    g = s.groupBy(by, "level").agg(F.count("cut").alias("crossings"), first(0).alias("c0"), first(1).alias("c1"), F.sum(F.when(F.col("k") == 1, F.col("z") - F.col("level"))).alias("over"), F.min(F.col("nat") - F.col("at")).alias("dx"))
    pick = lambda v: F.when(F.col("crossings") == 0, 0.0).when(F.col("crossings") == 1, OPEN).otherwise(v)
    return g.select(by, "level", "crossings", pick(F.col("c1") - F.col("c0")).alias("width"), pick(F.col("over") * F.col("dx")).alias("volume"))
