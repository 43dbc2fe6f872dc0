"""Queries on waves and storms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import joins, windows
from strandline.registry import register
from strandline.sources import tables as T

_CIRC = "((degrees(atan2(avg(sin(radians(dir))){o}, avg(cos(radians(dir))){o})) % 360) + 360) % 360"


@register(T.sql(f"""SELECT event_id, round(avg(hs) OVER w, 8) AS hs_mean, round(stddev_pop(hs) OVER w, 5) AS hs_std, round({_CIRC.format(o=' OVER w')}, 4) AS dir_mean
FROM v_wave WINDOW w AS (PARTITION BY cell_id ORDER BY t RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW)""", "v_wave"))
def trailing_wave(spark, sf_dir):
    """Mean, deviation and mean direction over the five days up to each row.

    Time is cut into pieces of five days; a row also stands in the next piece, five days later. There the five days up to an own row are the
    own rows up to its time and the earlier piece's from its time on: two frames that only grow, so work doesn't depend on how dense rows are.
    """
    found = windows.trailing(T.wave(spark, sf_dir).withColumns({"_t": T.micros("t"), "_s": F.sin(F.radians("dir")), "_c": F.cos(F.radians("dir"))}), ["cell_id"], "_t", 5 * 86400 * 10**6, ["hs", "_s", "_c"])
    direction = F.pmod(F.degrees(F.atan2("_s_mean", "_c_mean")), F.lit(360.0))
    return found.select("event_id", F.round("hs_mean", 8).alias("hs_mean"), F.round("hs_std", 5).alias("hs_std"), F.round(direction, 4).alias("dir_mean"))


@register(T.sql(f"""SELECT cell_id, t::DATE AS day, count(*) AS n, round(avg(hs), 6) AS hs, round({_CIRC.format(o='')}, 4) AS dir, round(max(tp), 6) AS tp_max FROM v_wave GROUP BY ALL""", "v_wave"))
def wave_daily(spark, sf_dir):
    """Daily means, directions averaged on the circle."""
    return T.wave(spark, sf_dir).groupBy("cell_id", F.to_date("t").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hs"), 6).alias("hs"), F.round(S.circular_mean(F.col("dir")), 4).alias("dir"), F.round(F.max("tp"), 6).alias("tp_max"))


@register(T.sql(f"""SELECT t::DATE AS day, round(avg(hs), 6) AS hs, round({_CIRC.format(o='')}, 4) AS dir, round(sqrt(-2 * ln(least(1.0, sqrt(avg(sin(radians(dir))) ** 2 + avg(cos(radians(dir))) ** 2)))), 6) AS dir_std,
 round(var_pop(hs), 6) AS variance, round(avg(hs), 6) AS mean FROM v_wave GROUP BY ALL""", "v_wave"))
def grid_mean(spark, sf_dir):
    """Mean over all cells a day, with circular mean and deviation of direction."""
    return T.wave(spark, sf_dir).groupBy(F.to_date("t").alias("day")).agg(F.round(F.avg("hs"), 6).alias("hs"), F.round(S.circular_mean(F.col("dir")), 4).alias("dir"), F.round(S.circular_std(F.col("dir")), 6).alias("dir_std"), F.round(F.var_pop("hs"), 6).alias("variance"), F.round(F.avg("hs"), 6).alias("mean"))


@register(T.sql(""", m AS (SELECT cell_id, hs, avg(hs) OVER (PARTITION BY cell_id) AS a FROM v_wave),
s AS (SELECT cell_id, count(*) AS n, any_value(a) AS mean, avg((hs - a) ** 2) AS m2, avg((hs - a) ** 3) AS m3, avg((hs - a) ** 4) AS m4 FROM m GROUP BY cell_id)
SELECT cell_id, n, round(mean, 6) AS mean, round(m2, 6) AS variance, round(m3 / m2 ** 1.5, 6) AS skew, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM s""", "v_wave"))
def wave_moments(spark, sf_dir):
    """Moments of wave height in each cell."""
    return T.wave(spark, sf_dir).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hs"), 6).alias("mean"), F.round(F.var_pop("hs"), 6).alias("variance"), F.round(F.skewness("hs"), 6).alias("skew"), F.round(F.kurtosis("hs"), 6).alias("kurtosis"))


_ALPHA = "CASE WHEN dir - 90 > 180 THEN dir - 450 WHEN dir - 90 <= -180 THEN dir + 270 ELSE dir - 90 END"
_COS, _SIN = "cos(radians(alpha))", "sin(radians(alpha))"
_MU = f"0.015 * tp ** 0.2 * hs ** 2.4 * abs({_COS}) ** 0.2 * (1.2 * {_SIN} * {_SIN} - {_COS} * {_COS})"
_QS = f"0.15 * hs ** 2.4 * tp ** 0.2 * abs({_COS}) ** 1.2 * {_SIN}"


def _climate(spark, sf_dir):
    w = T.wave(spark, sf_dir).withColumn("alpha", S.incidence(F.col("dir"), F.lit(90.0)))
    onshore = F.abs("alpha") > 90
    return w.withColumns({"mu": F.when(onshore, S.diffusivity(F.col("hs"), F.col("tp"), F.col("alpha"))), "qs": F.when(onshore, S.transport(F.col("hs"), F.col("tp"), F.col("alpha")))})


@register(T.sql(f""", a AS (SELECT *, {_ALPHA} AS alpha FROM v_wave),
m AS (SELECT cell_id, CASE WHEN abs(alpha) > 90 THEN {_MU} END AS mu, CASE WHEN abs(alpha) > 90 THEN {_QS} END AS qs FROM a)
SELECT cell_id, count(mu) AS n_onshore, round(avg(mu), 6) AS mu, round(avg(qs), 6) AS qs, round(sum(mu) / sum(abs(mu)), 6) AS stability FROM m GROUP BY cell_id""", "v_wave"))
def wave_climate(spark, sf_dir):
    """Diffusivity, net transport and stability of onshore waves in each cell."""
    return _climate(spark, sf_dir).groupBy("cell_id").agg(F.count("mu").alias("n_onshore"), F.round(F.avg("mu"), 6).alias("mu"), F.round(F.avg("qs"), 6).alias("qs"), F.round(F.try_divide(F.sum("mu"), F.sum(F.abs("mu"))), 6).alias("stability"))


@register(T.sql("""SELECT floor(dir / 10)::BIGINT AS sector, CASE WHEN hs < 0.25 THEN 'a' WHEN hs < 0.5 THEN 'b' WHEN hs < 0.75 THEN 'c' WHEN hs < 1 THEN 'd' ELSE 'e' END AS height, count(*) AS n
FROM v_wave GROUP BY CUBE (1, 2)""", "v_wave"))
def wave_rose(spark, sf_dir):
    """Rows by sector of ten degrees and height class, with all margins."""
    h = F.when(F.col("hs") < 0.25, "a").when(F.col("hs") < 0.5, "b").when(F.col("hs") < 0.75, "c").when(F.col("hs") < 1, "d").otherwise("e")
    return T.wave(spark, sf_dir).select(F.floor(F.col("dir") / 10).alias("sector"), h.alias("height")).cube("sector", "height").agg(F.count(F.lit(1)).alias("n"))


@register(T.sql(""", b AS (SELECT floor(hs / 0.1)::BIGINT AS k, count(*) AS n FROM v_wave GROUP BY 1), r AS (SELECT unnest(range(min(k), max(k) + 1)) AS k FROM b)
SELECT r.k AS bin, coalesce(n, 0) AS n FROM r LEFT JOIN b USING (k)""", "v_wave"))
def height_histogram(spark, sf_dir):
    """Counts in bins of 0.1 m, empty ones too."""
    b = T.wave(spark, sf_dir).groupBy(F.floor(F.col("hs") / 0.1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    r = b.agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    return r.join(b, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register(T.sql("""SELECT event_id, hs > quantile_cont(hs, 0.95) OVER (PARTITION BY cell_id) AS storm FROM v_wave""", "v_wave"))
def storm_flag(spark, sf_dir):
    """Whether a wave is above the 95th percentile of its own cell."""
    p = T.wave(spark, sf_dir).groupBy("cell_id").agg(F.percentile("hs", 0.95).alias("p"))
    return T.wave(spark, sf_dir).join(p, "cell_id").select("event_id", (F.col("hs") > F.col("p")).alias("storm"))


@register(T.sql("""SELECT w.event_id, max(s.storm_id) AS storm_id, round(arg_max(s.gust, s.storm_id), 6) AS gust FROM v_wave w LEFT JOIN v_storm s ON w.t BETWEEN s.start AND s."end" GROUP BY w.event_id""", "v_wave", "v_storm"))
def storm_join(spark, sf_dir):
    """Waves with the storm at their time; of several the later catalogue row."""
    w = T.wave(spark, sf_dir).select("event_id", F.unix_micros("t").alias("n"))
    s = T.storm(spark, sf_dir).select("storm_id", F.unix_micros("start").alias("s"), F.unix_micros("end").alias("e"), "gust")
    return joins.in_intervals(w, s, "n", "s", "e", "storm_id", ["storm_id", "gust"]).select("event_id", "storm_id", F.round("gust", 6).alias("gust"))


@register(T.sql(f""", a AS (SELECT *, {_ALPHA} AS alpha, hs > quantile_cont(hs, 0.95) OVER (PARTITION BY cell_id) AS storm FROM v_wave)
SELECT cell_id, CASE WHEN storm THEN 'stormy' ELSE 'fair' END AS weather, count(*) AS n, round(avg({_QS}), 6) AS mean, round(quantile_cont({_QS}, 0.25), 6) AS q1, round(median({_QS}), 6) AS median, round(quantile_cont({_QS}, 0.75), 6) AS q3 FROM a GROUP BY ALL""", "v_wave"))
def storm_split(spark, sf_dir):
    """Distribution of transport in fair and stormy rows of each cell."""
    w = T.wave(spark, sf_dir)
    p = w.groupBy("cell_id").agg(F.percentile("hs", 0.95).alias("p"))
    w = w.join(p, "cell_id").withColumns({"weather": F.when(F.col("hs") > F.col("p"), "stormy").otherwise("fair"), "q": S.transport(F.col("hs"), F.col("tp"), S.incidence(F.col("dir"), F.lit(90.0)))})
    q = F.percentile("q", [0.25, 0.5, 0.75])
    return w.groupBy("cell_id", "weather").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 6).alias("mean"), F.round(q[0], 6).alias("q1"), F.round(q[1], 6).alias("median"), F.round(q[2], 6).alias("q3"))


@register(T.sql("""SELECT year(start) - CASE WHEN month(start) < 9 THEN 1 ELSE 0 END AS season, count(*) AS n, min(start) AS first_start, max("end") AS last_end, round(max(gust), 6) AS gust_max, round(min(gust), 6) AS gust_min, round(avg(gust), 6) AS gust_mean, round(median(gust), 6) AS gust_median FROM v_storm GROUP BY ALL""", "v_storm"))
def storm_season(spark, sf_dir):
    """Storm seasons that begin in September."""
    s = (F.year("start") - F.when(F.month("start") < 9, 1).otherwise(0)).cast("long")
    return T.storm(spark, sf_dir).groupBy(s.alias("season")).agg(F.count(F.lit(1)).alias("n"), F.min("start").cast("timestamp_ntz").alias("first_start"), F.max("end").cast("timestamp_ntz").alias("last_end"), F.round(F.max("gust"), 6).alias("gust_max"), F.round(F.min("gust"), 6).alias("gust_min"), F.round(F.avg("gust"), 6).alias("gust_mean"), F.round(F.median("gust"), 6).alias("gust_median"))


@register(T.sql("""SELECT event_id, round(2.14 * tanh(0.4 * hs), 6) AS senechal, round(0.1 / (hs / (9.81 * tp * tp / (2 * pi()))), 5) AS iribarren, round(0.1 / sqrt(hs / (9.81 * tp * tp / (2 * pi()))), 5) AS iribarren_standard FROM v_wave WHERE hs > 0.01""", "v_wave"))
def runup(spark, sf_dir):
    """Runup and Iribarren number of each wave on a slope of 0.1."""
    w = T.wave(spark, sf_dir).where("hs > 0.01")
    slope, hs, tp = F.lit(0.1), F.col("hs"), F.col("tp")
    return w.select("event_id", F.round(S.runup_senechal(hs), 6).alias("senechal"), F.round(S.iribarren(slope, hs, tp), 5).alias("iribarren"), F.round(S.iribarren(slope, hs, tp, standard=True), 5).alias("iribarren_standard"))


@register(T.sql(f"""SELECT event_id, round(avg(hs) OVER w, 6) AS hs_mean, round({_CIRC.format(o=' OVER w')}, 4) AS dir_mean, count(*) OVER w AS n
FROM v_wave WINDOW w AS (PARTITION BY cell_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", "v_wave"))
def rolling_directions(spark, sf_dir):
    """Mean height and mean direction of each row and the nine before it, of fewer at a series' start."""
    w = Window.partitionBy("cell_id").orderBy("t", "event_id").rowsBetween(-9, 0)
    s, c = F.avg(F.sin(F.radians("dir"))).over(w), F.avg(F.cos(F.radians("dir"))).over(w)
    return T.wave(spark, sf_dir).select("event_id", F.round(F.avg("hs").over(w), 6).alias("hs_mean"), F.round(F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)), 4).alias("dir_mean"), F.count(F.lit(1)).over(w).alias("n"))
