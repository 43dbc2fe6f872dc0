"""Queries on surveys, forecasts of position and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import windows
from strandline.registry import register
from strandline.sources import tables as T


@register(T.sql("""SELECT transect_id, year, round(-(dist - lag(dist) OVER w) / (year - lag(year) OVER w), 6) AS rate, round((error + lag(error) OVER w) / (year - lag(year) OVER w), 6) AS rate_error,
  round(-(last_value(dist) OVER f - first_value(dist) OVER f) / (last_value(year) OVER f - first_value(year) OVER f), 6) AS overall FROM v_survey WINDOW w AS (PARTITION BY transect_id ORDER BY year), f AS (PARTITION BY transect_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "v_survey"))
def endpoint_rates(spark, sf_dir):
    """Rates between consecutive surveys and from the first to the last, with errors."""
    w = Window.partitionBy("transect_id").orderBy("year")
    f = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.col("year") - F.lag("year").over(w)
    overall = F.try_divide(-(F.last("dist").over(f) - F.first("dist").over(f)), F.last("year").over(f) - F.first("year").over(f))
    return T.survey(spark, sf_dir).select("transect_id", "year", F.round(-(F.col("dist") - F.lag("dist").over(w)) / gap, 6).alias("rate"), F.round((F.col("error") + F.lag("error").over(w)) / gap, 6).alias("rate_error"), F.round(overall, 6).alias("overall"))


@register(T.sql(""", f AS (SELECT *, dist > 25.5 AS flag FROM v_survey), t AS (SELECT *, CASE WHEN flag = lag(flag) OVER w THEN 0 ELSE 1 END AS turn FROM f WINDOW w AS (PARTITION BY year ORDER BY transect_id)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY year ORDER BY transect_id) AS run FROM t)
SELECT year, min(transect_id) AS first_id, max(transect_id) AS last_id, count(*) AS n, round(avg(dist), 6) AS dist FROM r WHERE flag GROUP BY year, run HAVING count(*) >= 2""", "v_survey"))
def runs_to_lines(spark, sf_dir):
    """Runs of at least two neighbouring transects on which a flag holds."""
    r = windows.runs(T.survey(spark, sf_dir).withColumn("flag", F.col("dist") > 25.5), ["year"], "transect_id", "flag").where("flag")
    return r.groupBy("year", "run").agg(F.min("transect_id").alias("first_id"), F.max("transect_id").alias("last_id"), F.count(F.lit(1)).alias("n"), F.round(F.avg("dist"), 6).alias("dist")).where("n >= 2").drop("run")


def future(surveys, years, slope, depth, sea_level, rate):
    """Positions in future years: change by sea-level rise over the slope and by the historic rate from the latest survey.

    surveys: transect_id, year, dist; slope, depth: columns; sea_level, rate: functions of a year column. Needs two surveys.
    """
    last = surveys.groupBy("transect_id").agg(F.count(F.lit(1)).alias("n"), F.max("year").alias("year0"), F.max_by("dist", "year").alias("dist0"), F.regr_slope("dist", "year").alias("trend")).where("n >= 2")
    y = last.select("*", F.explode(F.array(*[F.lit(v).cast("long") for v in years])).alias("year"))
    change = -(sea_level(F.col("year")) - sea_level(F.col("year0"))) / slope + F.col("trend") * rate * (F.col("year") - F.col("year0")) / depth
    return y.withColumn("dist", F.col("dist0") + change)


_LEVEL = "(0.004::DOUBLE * ({y} - 2000) + 0.00003::DOUBLE * ({y} - 2000) * ({y} - 2000))"
_FUTURE = f"""l AS (SELECT transect_id, count(*) AS n, max(year) AS year0, arg_max(dist, year) AS dist0, regr_slope(dist, year) AS trend FROM v_survey GROUP BY transect_id),
y AS (SELECT *, unnest([2030, 2050, 2100]) AS year FROM l WHERE n >= 2),
f AS (SELECT transect_id, year, year0, dist0, dist0 - ({_LEVEL.format(y='year')} - {_LEVEL.format(y='year0')}) / 0.05 + trend * {{rate}} * (year - year0) / 2 AS dist FROM y)"""


def _level(y):
    return 0.004 * (y - 2000) + 0.00003 * (y - 2000) * (y - 2000)


@register(T.sql(f""", {_FUTURE.format(rate='1')} SELECT transect_id, year::BIGINT AS year, round(dist, 5) AS dist, round(greatest(dist, dist0 - 40), 5) AS capped FROM f""", "v_survey"))
def future_position(spark, sf_dir):
    """Future positions, and those held by a defence 40 m landward of the latest one."""
    f = future(T.survey(spark, sf_dir), [2030, 2050, 2100], F.lit(0.05), F.lit(2), _level, F.lit(1))
    return f.select("transect_id", "year", F.round("dist", 5).alias("dist"), F.round(F.greatest(F.col("dist"), F.col("dist0") - 40), 5).alias("capped"))


@register(T.sql(f""", r AS (SELECT unnest([0.0, 0.5, 1.0, 1.5]::DOUBLE[]) AS rate), {_FUTURE.replace('FROM y)', 'FROM y, r)').format(rate='rate')}
SELECT transect_id, year::BIGINT AS year, round(min(dist), 5) AS low, round(max(dist), 5) AS high FROM f GROUP BY ALL""", "v_survey"))
def future_envelope(spark, sf_dir):
    """Least and greatest future position over calibration rates, a zero rate among them."""
    rated = T.survey(spark, sf_dir)
    f = future(rated, [2030, 2050, 2100], F.lit(0.05), F.lit(2), _level, F.lit(0)).select("*", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.5, 1.0, 1.5)])).alias("r"))
    d = F.col("dist") + F.col("trend") * F.col("r") * (F.col("year") - F.col("year0")) / 2
    return f.groupBy("transect_id", "year").agg(F.round(F.min(d), 5).alias("low"), F.round(F.max(d), 5).alias("high"))


@register(T.sql(f""", x AS (SELECT transect_id, year, lag(year) OVER w AS p FROM v_survey WINDOW w AS (PARTITION BY transect_id ORDER BY year))
SELECT transect_id, year, round(1.8 + ((year + p) / 2 - 1990) / 110 * (9.0 - 1.8), 6) AS rate, round({_LEVEL.format(y='year')} - {_LEVEL.format(y='p')}, 8) AS rise FROM x WHERE p IS NOT NULL""", "v_survey"))
def sea_level_rates(spark, sf_dir):
    """Sea-level rate at each interval's mid-year, between a historic and a future rate."""
    w = Window.partitionBy("transect_id").orderBy("year")
    x = T.survey(spark, sf_dir).withColumn("p", F.lag("year").over(w)).where("p is not null")
    return x.select("transect_id", "year", F.round(1.8 + ((F.col("year") + F.col("p")) / 2 - 1990) / 110 * (9.0 - 1.8), 6).alias("rate"), F.round(_level(F.col("year")) - _level(F.col("p")), 8).alias("rise"))


@register(T.sql(""", m AS (SELECT transect_id, max(seq) AS m FROM v_profile GROUP BY transect_id)
SELECT transect_id, round(greatest(0.001, sum((m - seq) * seq * z) / nullif(sum((m - seq) * seq * seq), 0)), 8) AS slope FROM v_profile JOIN m USING (transect_id) GROUP BY transect_id""", "v_profile"))
def profile_slope(spark, sf_dir):
    """Weighted least-squares slope through the origin of each profile, at least 0.001."""
    p = T.profile(spark, sf_dir)
    m = p.groupBy("transect_id").agg(F.max("seq").alias("m"))
    w = F.col("m") - F.col("seq")
    s = F.try_divide(F.sum(w * F.col("seq") * F.col("z")), F.sum(w * F.col("seq") * F.col("seq")).cast("double"))
    return p.join(m, "transect_id").groupBy("transect_id").agg(F.round(F.greatest(F.lit(0.001), s), 8).alias("slope"))


_CROSS = """n AS (SELECT *, lead(z) OVER (PARTITION BY transect_id ORDER BY seq) AS nz FROM v_profile),
c AS (SELECT transect_id, seq + (10 - z) / (nz - z) AS pos, nz > z AS rising, row_number() OVER (PARTITION BY transect_id ORDER BY seq) AS k FROM n WHERE (z < 10 AND nz >= 10) OR (z >= 10 AND nz < 10))"""


@register(T.sql(f""", {_CROSS} SELECT transect_id, count(*) AS n, round(min(pos), 6) AS first_at, round(min(pos) FILTER (rising), 6) AS first_rising FROM c GROUP BY transect_id""", "v_profile"))
def level_crossings(spark, sf_dir):
    """Where each profile crosses a level: how often, and first."""
    return _crossings(spark, sf_dir).groupBy("transect_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("at"), 6).alias("first_at"), F.round(F.min(F.when(F.col("rising"), F.col("at"))), 6).alias("first_rising"))


def _crossings(spark, sf_dir):
    w = Window.partitionBy("transect_id").orderBy("seq")
    n = T.profile(spark, sf_dir).withColumn("nz", F.lead("z").over(w))
    c = n.where("(z < 10 and nz >= 10) or (z >= 10 and nz < 10)")
    return c.select("transect_id", (F.col("seq") + (10 - F.col("z")) / (F.col("nz") - F.col("z"))).alias("at"), (F.col("nz") > F.col("z")).alias("rising"), F.row_number().over(w).alias("k"))


@register(T.sql(f""", {_CROSS}, p AS (SELECT *, lead(pos) OVER (PARTITION BY transect_id ORDER BY k) - pos AS width FROM c)
SELECT transect_id, count(width) AS n_gaps, round(sum(width), 6) AS width FROM p WHERE rising AND width IS NOT NULL GROUP BY transect_id""", "v_profile"))
def barrier_width(spark, sf_dir):
    """Width above a level: pairs of rising and falling crossings."""
    p = _crossings(spark, sf_dir).withColumn("width", F.lead("at").over(Window.partitionBy("transect_id").orderBy("k")) - F.col("at"))
    return p.where("rising and width is not null").groupBy("transect_id").agg(F.count("width").alias("n_gaps"), F.round(F.sum("width"), 6).alias("width"))


@register(T.sql(""", s AS (SELECT *, abs(lead(z) OVER (PARTITION BY transect_id ORDER BY seq) - z) AS slope FROM v_profile)
SELECT transect_id, round(quantile_cont(slope, 0.95) FILTER (z BETWEEN -1 AND 10) - quantile_cont(slope, 0.05) FILTER (z BETWEEN -1 AND 10), 6) AS slope_range, round(stddev_pop(z), 6) AS roughness FROM s GROUP BY transect_id""", "v_profile"))
def roughness(spark, sf_dir):
    """Spread of slopes in a band of elevations, and of elevations."""
    w = Window.partitionBy("transect_id").orderBy("seq")
    s = T.profile(spark, sf_dir).withColumn("slope", F.abs(F.lead("z").over(w) - F.col("z")))
    q = F.percentile(F.when(F.col("z").between(-1, 10), F.col("slope")), [0.05, 0.95])
    return s.groupBy("transect_id").agg(F.round(q[1] - q[0], 6).alias("slope_range"), F.round(F.stddev_pop("z"), 6).alias("roughness"))


@register(T.sql(""", y AS (SELECT transect_id, year, dist, dist - lag(dist) OVER w AS change FROM v_survey WINDOW w AS (PARTITION BY transect_id ORDER BY year))
SELECT transect_id, min(year) FILTER (change < 0) AS first_erosion, round(max(change), 6) AS max_change, round(max(dist) FILTER (year = 1998) - max(dist) FILTER (year = 1996), 6) AS change_96_98, round(arg_max(dist, year), 6) AS latest FROM y GROUP BY transect_id""", "v_survey"))
def year_lookups(spark, sf_dir):
    """Values at years, changes between them, and the first year of erosion."""
    w = Window.partitionBy("transect_id").orderBy("year")
    y = T.survey(spark, sf_dir).withColumn("change", F.col("dist") - F.lag("dist").over(w))
    at = lambda v: F.max(F.when(F.col("year") == v, F.col("dist")))
    return y.groupBy("transect_id").agg(F.min(F.when(F.col("change") < 0, F.col("year"))).alias("first_erosion"), F.round(F.max("change"), 6).alias("max_change"), F.round(at(1998) - at(1996), 6).alias("change_96_98"), F.round(F.max_by("dist", "year"), 6).alias("latest"))


@register(T.sql("""SELECT a.transect_id, a.day, a.y, b.y AS up, c.y AS down FROM v_daily a LEFT JOIN v_daily b ON b.transect_id = a.transect_id + 1 AND b.day = a.day LEFT JOIN v_daily c ON c.transect_id = a.transect_id - 1 AND c.day = a.day""", "v_daily"))
def neighbours(spark, sf_dir):
    """Series with those of the neighbouring transects on the same day."""
    d = T.daily(spark, sf_dir)
    other = lambda shift, name: d.select((F.col("transect_id") + shift).alias("transect_id"), "day", F.col("y").alias(name))
    return d.join(other(-1, "up"), ["transect_id", "day"], "left").join(other(1, "down"), ["transect_id", "day"], "left")
