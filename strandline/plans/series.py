"""Queries on position series: pairing, rates, smoothing, interpolation, classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import joins, windows
from strandline.registry import register
from strandline.sources import tables as T

_DAILY_KIND = "d AS (SELECT transect_id, kind, acq_ts::DATE AS day, avg(dist) AS dist FROM v_obs GROUP BY ALL)"


def _daily_kind(spark, sf_dir):
    """Observations on equal days averaged."""
    return T.obs(spark, sf_dir).groupBy("transect_id", "kind", F.to_date("acq_ts").alias("day")).agg(F.avg("dist").alias("dist"))


@register(T.sql(f""", {_DAILY_KIND},
j AS (SELECT v.transect_id, v.day, v.dist AS ve, w.day AS wl_day, w.dist AS wl, row_number() OVER (PARTITION BY v.transect_id, v.day ORDER BY abs(w.day - v.day), w.day) AS r
      FROM d v LEFT JOIN d w ON w.kind = 'WL' AND v.transect_id = w.transect_id AND abs(w.day - v.day) <= 2 WHERE v.kind = 'VE')
SELECT transect_id, day, wl_day, round(wl - ve, 6) AS width FROM j WHERE r = 1""", "v_obs"))
def beach_width(spark, sf_dir):
    """Width from each edge position to the waterline nearest in time, within two days."""
    d = _daily_kind(spark, sf_dir).withColumn("n", F.unix_date("day"))
    ve, wl = d.where("kind = 'VE'").select("transect_id", "day", "dist", "n"), d.where("kind = 'WL'").select("transect_id", "day", "dist", F.col("n").alias("wn"))
    j = joins.nearest_in_time(ve, wl, ["transect_id"], "n", "wn", 2)
    return j.select("transect_id", "day", F.col("r_day").alias("wl_day"), F.round(F.col("r_dist") - F.col("dist"), 6).alias("width"))


_RATE = f"""WITH {{v}}, x AS (SELECT transect_id, kind, epoch_us(acq_ts) / 86400000000 AS d, dist, event_id,
  row_number() OVER (PARTITION BY transect_id, kind ORDER BY acq_ts DESC, event_id DESC) AS r FROM v_obs),
a AS (SELECT transect_id, kind, count(*) AS n, regr_slope(dist, d) AS slope, regr_sxx(dist, d) AS sxx, regr_syy(dist, d) AS syy, regr_sxy(dist, d) AS sxy,
  CASE WHEN count(*) FILTER (r <= 2) = 2 THEN (max(dist) FILTER (r = 1) - max(dist) FILTER (r = 2)) / (max(d) FILTER (r = 1) - max(d) FILTER (r = 2)) END AS last2, max(d) - min(d) AS span FROM x GROUP BY ALL)
SELECT transect_id, kind, n, round(CASE WHEN n > 1 THEN slope * 365.2425 END, 2) AS rate, round(last2 * 365.2425, 2) AS recent_rate, round(span / 365.2425, 4) AS years,
  round(CASE WHEN n >= 3 THEN ({S.t975_sql('n - 2')}) * sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) * 365.2425 END, 2) AS margin FROM a"""


@register(_RATE.replace("{v}", "v_obs AS (" + T.CTES["v_obs"] + ")"))
def change_rate(spark, sf_dir):
    """Least-squares rate a year of each series with its 95 % margin, and the rate between the last two rows."""
    w = Window.partitionBy("transect_id", "kind").orderBy(F.desc("acq_ts"), F.desc("event_id"))
    x = T.obs(spark, sf_dir).select("transect_id", "kind", (T.micros() / 86400000000).alias("d"), "dist", F.row_number().over(w).alias("r"))
    pick = lambda c, k: F.max(F.when(F.col("r") == k, F.col(c)))
    a = x.groupBy("transect_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("dist", "d").alias("slope"), F.regr_sxx("dist", "d").alias("sxx"), F.regr_syy("dist", "d").alias("syy"), F.regr_sxy("dist", "d").alias("sxy"), F.try_divide(pick("dist", 1) - pick("dist", 2), pick("d", 1) - pick("d", 2)).alias("last2"), (F.max("d") - F.min("d")).alias("span"))
    margin = S.t975(F.col("n") - 2) * F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx")) * S.DAYS_A_YEAR
    return a.select("transect_id", "kind", "n", F.round(F.when(F.col("n") > 1, F.col("slope") * S.DAYS_A_YEAR), 2).alias("rate"), F.round(F.col("last2") * S.DAYS_A_YEAR, 2).alias("recent_rate"), F.round(F.col("span") / S.DAYS_A_YEAR, 4).alias("years"), F.round(F.when(F.col("n") >= 3, margin), 2).alias("margin"))


@register(T.sql("""SELECT t.event_id, round(CASE WHEN n.date IS NULL THEN NULL ELSE p.tide + (n.tide - p.tide) * (epoch_us(t.acq_ts) - epoch_us(p.date)) / (epoch_us(n.date) - epoch_us(p.date)) END, 6) AS tide
FROM v_obs t ASOF LEFT JOIN v_tide p ON p.date <= t.acq_ts ASOF LEFT JOIN v_tide n ON n.date > t.acq_ts WHERE p.date IS NOT NULL""", "v_obs", "v_tide"))
def tide_at_image(spark, sf_dir):
    """Tide at each observation, linear between the samples at or before and after it."""
    return _tides(spark, sf_dir).where("prev is not null").select("event_id", F.round("tide", 6).alias("tide"))


def _tides(spark, sf_dir):
    o = T.obs(spark, sf_dir).withColumn("n", T.micros())
    t = T.tide(spark, sf_dir).select(T.micros("date").alias("d"), "tide")
    b = joins.bracketed(o, t, "n", "d", "tide")
    return b.withColumn("tide", joins.interpolated(b, "n"))


@register(T.sql("""SELECT t.event_id, round(n.tide, 6) AS next_tide FROM v_obs t ASOF JOIN v_tide n ON n.date > t.acq_ts""", "v_obs", "v_tide"))
def next_tide(spark, sf_dir):
    """First tide sample strictly after each observation."""
    return _tides(spark, sf_dir).where("next is not null").select("event_id", F.round("next", 6).alias("next_tide"))


@register(T.sql(""", x AS (SELECT t.*, p.tide + (n.tide - p.tide) * (epoch_us(t.acq_ts) - epoch_us(p.date)) / (epoch_us(n.date) - epoch_us(p.date)) AS tide
  FROM v_obs t ASOF JOIN v_tide p ON p.date <= t.acq_ts ASOF JOIN v_tide n ON n.date > t.acq_ts WHERE t.kind = 'WL'),
z AS (SELECT min(tide) AS lo, min(tide) + (max(tide) - min(tide)) / 3 AS a, max(tide) - (max(tide) - min(tide)) / 3 AS b, max(tide) AS hi FROM v_tide)
SELECT event_id, round(dist + tide / 0.1, 6) AS corrected, CASE WHEN tide BETWEEN lo AND a THEN 'lower' WHEN tide BETWEEN a AND b THEN 'middle' WHEN tide BETWEEN b AND hi THEN 'upper' END AS zone FROM x, z""", "v_obs", "v_tide"))
def tidal_correction(spark, sf_dir):
    """Waterlines moved to the datum by the tide at their time, with the third of the tidal range they stand in."""
    t = _tides(spark, sf_dir).where("kind = 'WL' and prev is not null and next is not null")
    z = T.tide(spark, sf_dir).agg(F.min("tide").alias("lo"), F.max("tide").alias("hi"))
    z = z.select("lo", (F.col("lo") + (F.col("hi") - F.col("lo")) / 3).alias("a"), (F.col("hi") - (F.col("hi") - F.col("lo")) / 3).alias("b"), "hi")
    x = t.join(F.broadcast(z))  # one row
    return x.select("event_id", F.round(S.tidal_correction(F.col("dist"), F.col("tide")), 6).alias("corrected"), S.tide_zone(F.col("tide"), F.col("lo"), F.col("a"), F.col("b"), F.col("hi")).alias("zone"))


@register(T.sql("""SELECT min(tide) AS lo, round(min(tide) + (max(tide) - min(tide)) / 3, 6) AS first_third, round(max(tide) - (max(tide) - min(tide)) / 3, 6) AS second_third, max(tide) AS hi FROM v_tide""", "v_tide"))
def tide_thirds(spark, sf_dir):
    """Limits of the thirds of the tidal range."""
    lo, hi = F.min("tide"), F.max("tide")
    return T.tide(spark, sf_dir).agg(lo.alias("lo"), F.round(lo + (hi - lo) / 3, 6).alias("first_third"), F.round(hi - (hi - lo) / 3, 6).alias("second_third"), hi.alias("hi"))


@register(T.sql(""", n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY transect_id) AS c FROM v_daily WINDOW w AS (PARTITION BY transect_id ORDER BY day))
SELECT transect_id, day, round(CASE WHEN i = 1 OR i = c THEN y ELSE sum(y) OVER (PARTITION BY transect_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 END, 6) AS odd,
  round(CASE WHEN i = 1 OR i = c THEN y ELSE sum(y) OVER (PARTITION BY transect_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 END, 6) AS even FROM n""", "v_daily"))
def moving_average(spark, sf_dir):
    """Centred moving averages of an odd and an even number of rows."""
    w = Window.partitionBy("transect_id").orderBy("day")
    return T.daily(spark, sf_dir).select("transect_id", "day", F.round(windows.moving_average(F.col("y"), w, 7), 6).alias("odd"), F.round(windows.moving_average(F.col("y"), w, 4), 6).alias("even"))


@register(T.sql(""", m AS (SELECT *, CASE WHEN abs(y - avg(y) OVER p) <= 2 * stddev_pop(y) OVER p THEN y END AS v, row_number() OVER (PARTITION BY transect_id ORDER BY day) AS n FROM v_daily WINDOW p AS (PARTITION BY transect_id)),
b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN n END) OVER (PARTITION BY transect_id ORDER BY n) AS pn, min(CASE WHEN v IS NOT NULL THEN n END) OVER (PARTITION BY transect_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qn FROM m)
SELECT b.transect_id, b.day, b.v IS NULL AS was_outlier, round(CASE WHEN b.v IS NOT NULL THEN b.v WHEN p.v IS NOT NULL AND q.v IS NOT NULL AND (b.n - pn <= 10 OR qn - b.n <= 10) THEN p.v + (q.v - p.v) * (b.n - pn) / (qn - pn)
  WHEN p.v IS NULL AND qn - b.n <= 10 THEN q.v WHEN q.v IS NULL AND b.n - pn <= 10 THEN p.v END, 6) AS y
FROM b LEFT JOIN m p ON p.transect_id = b.transect_id AND p.n = pn LEFT JOIN m q ON q.transect_id = b.transect_id AND q.n = qn""", "v_daily"))
def outlier_fill(spark, sf_dir):
    """Values beyond two standard deviations dropped and filled linearly."""
    d = T.daily(spark, sf_dir)
    d = d.withColumn("y", windows.outliers_to_null(F.col("y"), Window.partitionBy("transect_id"))).withColumn("was_outlier", F.col("y").isNull())
    return windows.filled(d, ["transect_id"], "day", "y").select("transect_id", "day", "was_outlier", F.round("y", 6).alias("y"))


@register(T.sql(""", s AS (SELECT *, quantile_cont(y, 0.05) OVER p AS p5, quantile_cont(y, 0.25) OVER p AS p25, regr_slope(y, (day - DATE '1990-01-01')) OVER p AS rate FROM v_daily WINDOW p AS (PARTITION BY transect_id)),
r AS (SELECT DISTINCT transect_id, rate FROM s), q AS (SELECT quantile_cont(rate, 0.05) AS r5, quantile_cont(rate, 0.25) AS r25 FROM r)
SELECT transect_id, day, CASE WHEN y <= p5 THEN 3 WHEN y < p25 THEN 2 ELSE 1 END AS percent_class, CASE WHEN rate <= r5 THEN 3 WHEN rate < r25 THEN 2 ELSE 1 END AS slope_class,
  greatest(CASE WHEN y <= p5 THEN 3 WHEN y <= p25 THEN 2 ELSE 1 END, CASE WHEN rate <= r5 THEN 3 WHEN rate < r25 THEN 2 ELSE 1 END) AS combined FROM s, q""", "v_daily"))
def impact_class(spark, sf_dir):
    """Classes 1 to 3 by position and by rate against 5th and 25th percentiles, and the worse of both."""
    p = Window.partitionBy("transect_id")
    d = T.daily(spark, sf_dir).withColumn("n", F.datediff("day", F.lit("1990-01-01")).cast("double"))
    s = d.withColumns({"p5": F.percentile("y", 0.05).over(p), "p25": F.percentile("y", 0.25).over(p), "rate": F.regr_slope("y", "n").over(p)})
    rates = d.groupBy("transect_id").agg(F.regr_slope("y", "n").alias("rate")).agg(F.percentile("rate", 0.05).alias("r5"), F.percentile("rate", 0.25).alias("r25"))
    s = s.join(F.broadcast(rates))  # one row
    cls = lambda x, a, b, upto=False: F.when(F.col(x) <= F.col(a), 3).when((F.col(x) <= F.col(b)) if upto else (F.col(x) < F.col(b)), 2).otherwise(1)
    return s.select("transect_id", "day", cls("y", "p5", "p25").alias("percent_class"), cls("rate", "r5", "r25").alias("slope_class"), F.greatest(cls("y", "p5", "p25", True), cls("rate", "r5", "r25")).alias("combined"))


def _every_day(spark, sf_dir):
    # spans are counted on the rows as they are given, which need no sums by day
    given = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("transect_id"), F.to_date("l_shipdate").alias("day"))
    return windows.daily_linear(T.daily(spark, sf_dir), ["transect_id"], "day", "y", windows.days_spanned(given, ["transect_id"], "day"))


@register(T.sql(""", l AS (SELECT transect_id, day, y, lead(day) OVER w AS nd, lead(y) OVER w AS ny FROM v_daily WINDOW w AS (PARTITION BY transect_id ORDER BY day))
SELECT transect_id, d::DATE AS day, round(CASE WHEN nd IS NULL THEN y ELSE y + (ny - y) * (d::DATE - day) / (nd - day) END, 6) AS y
FROM (SELECT *, unnest(generate_series(day::TIMESTAMP, coalesce(nd - 1, day)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM l)""", "v_daily"))
def daily_interp(spark, sf_dir):
    """Every day of each series, linear in time."""
    return _every_day(spark, sf_dir).select("transect_id", "day", F.round("y", 6).alias("y"))


@register(T.sql(""", l AS (SELECT transect_id, day, y, lead(day) OVER w AS nd, lead(y) OVER w AS ny FROM v_daily WINDOW w AS (PARTITION BY transect_id ORDER BY day)),
i AS (SELECT transect_id, d::DATE AS day, CASE WHEN nd IS NULL THEN y ELSE y + (ny - y) * (d::DATE - day) / (nd - day) END AS y
  FROM (SELECT *, unnest(generate_series(day::TIMESTAMP, coalesce(nd - 1, day)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM l)),
t AS (SELECT *, row_number() OVER o - 1 AS n, CASE WHEN count(*) OVER f = 365 THEN avg(y) OVER f END AS trend FROM i WINDOW o AS (PARTITION BY transect_id ORDER BY day), f AS (PARTITION BY transect_id ORDER BY day ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)),
s AS (SELECT *, avg(y - trend) OVER (PARTITION BY transect_id, n % 365) AS raw FROM t),
c AS (SELECT *, raw - avg(raw) OVER (PARTITION BY transect_id) AS seasonal FROM s)
SELECT transect_id, count(*) AS n_days, round(var_pop(seasonal) / (var_pop(seasonal) + var_pop(y - trend - seasonal)), 5) AS strength FROM c WHERE trend IS NOT NULL GROUP BY transect_id""", "v_daily"))
def seasonal_strength(spark, sf_dir):
    """Share of the seasonal part in each daily series' variance: trend by a centred year, season by day of the cycle."""
    i = _every_day(spark, sf_dir)
    o = Window.partitionBy("transect_id").orderBy("day")
    i = i.withColumns({"n": F.row_number().over(o) - 1, "upto": F.sum("y").over(o)})
    t = i.withColumn("trend", F.when(F.col("n") >= 182, (F.lead("upto", 182).over(o) - F.coalesce(F.lag("upto", 183).over(o), F.lit(0.0))) / 365))
    s = t.withColumn("raw", F.avg(F.col("y") - F.col("trend")).over(Window.partitionBy("transect_id", F.col("n") % 365)))
    c = s.withColumn("seasonal", F.col("raw") - F.avg("raw").over(Window.partitionBy("transect_id"))).where("trend is not null")
    v, r = F.var_pop("seasonal"), F.var_pop(F.col("y") - F.col("trend") - F.col("seasonal"))
    return c.groupBy("transect_id").agg(F.count(F.lit(1)).alias("n_days"), F.round(v / (v + r), 5).alias("strength"))


@register(T.sql("""SELECT transect_id, day, round(avg(y) OVER (PARTITION BY transect_id ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling,
  round(coalesce(lag(y, 10) OVER (PARTITION BY transect_id ORDER BY day), avg(y) OVER (PARTITION BY transect_id)), 6) AS lagged,
  round((y - lag(y) OVER (PARTITION BY transect_id ORDER BY day)) / (86400 * (day - lag(day) OVER (PARTITION BY transect_id ORDER BY day))) * 1e6, 4) AS change FROM v_daily""", "v_daily"))
def rolling_features(spark, sf_dir):
    """Rolling mean of ten rows, the value ten rows before (the mean where there is none), and the rate of change (per 1e6 s)."""
    w = Window.partitionBy("transect_id").orderBy("day")
    return T.daily(spark, sf_dir).select("transect_id", "day", F.round(F.avg("y").over(w.rowsBetween(-9, 0)), 6).alias("rolling"), F.round(F.coalesce(F.lag("y", 10).over(w), F.avg("y").over(Window.partitionBy("transect_id"))), 6).alias("lagged"), F.round((F.col("y") - F.lag("y").over(w)) / (86400 * F.datediff("day", F.lag("day").over(w))) * 1e6, 4).alias("change"))


@register(T.sql("""SELECT transect_id, day, round(list_reduce(list(y::DOUBLE) OVER (PARTITION BY transect_id ORDER BY day), lambda m, x: m + 2.0::DOUBLE / 11 * (x - m)), 6) AS mean FROM v_daily""", "v_daily"))
def exponential_mean(spark, sf_dir):
    """Recursive exponential mean of each daily series, span 10."""
    return windows.exponential_mean(T.daily(spark, sf_dir), ["transect_id"], "day", "y", "mean").select("transect_id", "day", F.round("mean", 6).alias("mean"))


@register(T.sql(""", n AS (SELECT *, row_number() OVER w AS r, lead(y, 1) OVER w AS a, count(*) OVER (PARTITION BY transect_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS c,
  avg(y) OVER (PARTITION BY transect_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m FROM v_daily WINDOW w AS (PARTITION BY transect_id ORDER BY day))
SELECT transect_id, day, y AS target, round(m, 6) AS input_mean FROM n WHERE c = 10""", "v_daily"))
def sequences(spark, sf_dir):
    """Overlapping windows of ten rows with the next row as target; shown by the windows' mean."""
    w = Window.partitionBy("transect_id").orderBy("day").rowsBetween(-10, -1)
    s = T.daily(spark, sf_dir).select("transect_id", "day", F.col("y").alias("target"), F.collect_list("y").over(w).alias("inputs")).where("size(inputs) = 10")
    return s.select("transect_id", "day", "target", F.round(F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x) / 10, 6).alias("input_mean"))


@register(T.sql(f""", x AS (SELECT transect_id, day, y, (day - DATE '1990-01-01')::DOUBLE AS t FROM v_daily),
f AS (SELECT transect_id, count(*) AS n, avg(t) AS mt, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy FROM x GROUP BY transect_id)
SELECT x.transect_id, x.day, round(a + b * t, 5) AS fit, round(({S.t975_sql('n - 2')}) * sqrt((syy - sxy * sxy / sxx) / (n - 2)) * sqrt(1 / n + (t - mt) * (t - mt) / sxx), 5) AS band, round(b * 365.25, 5) AS per_year FROM x JOIN f USING (transect_id)""", "v_daily"))
def trend_band(spark, sf_dir):
    """Linear trend of each series with its 95 % confidence band."""
    x = T.daily(spark, sf_dir).withColumn("t", F.datediff("day", F.lit("1990-01-01")).cast("double"))
    f = x.groupBy("transect_id").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("mt"), F.regr_slope("y", "t").alias("b"), F.regr_intercept("y", "t").alias("a"), F.regr_sxx("y", "t").alias("sxx"), F.regr_syy("y", "t").alias("syy"), F.regr_sxy("y", "t").alias("sxy"))
    j = x.join(f, "transect_id")
    band = S.t975(F.col("n") - 2) * F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2)) * F.sqrt(1 / F.col("n") + (F.col("t") - F.col("mt")) * (F.col("t") - F.col("mt")) / F.col("sxx"))
    return j.select("transect_id", "day", F.round(F.col("a") + F.col("b") * F.col("t"), 5).alias("fit"), F.round(band, 5).alias("band"), F.round(F.col("b") * 365.25, 5).alias("per_year"))


@register(T.sql("""SELECT transect_id, dayofyear(day)::BIGINT AS doy, year(day)::BIGINT AS year, y, count(*) OVER w AS n_years, round(avg(y) OVER w, 6) AS stacked
FROM v_daily WINDOW w AS (PARTITION BY transect_id, dayofyear(day))""", "v_daily"))
def annual_stack(spark, sf_dir):
    """All years of a series stacked by day of the year: each value with the mean of that day in every year and their number."""
    d = T.daily(spark, sf_dir).select("transect_id", F.dayofyear("day").cast("long").alias("doy"), F.year("day").cast("long").alias("year"), "y")
    w = Window.partitionBy("transect_id", "doy")
    return d.withColumns({"n_years": F.count(F.lit(1)).over(w), "stacked": F.round(F.avg("y").over(w), 6)})


@register(T.sql(""", r AS (SELECT transect_id, day, dense_rank() OVER (PARTITION BY transect_id ORDER BY day DESC) AS r, min(day) OVER (PARTITION BY transect_id) AS oldest FROM v_daily)
SELECT transect_id, any_value(oldest) AS oldest, max(day) FILTER (r = 1) AS youngest, max(day) FILTER (r = 2) AS second_youngest FROM r GROUP BY transect_id""", "v_daily"))
def youngest_dates(spark, sf_dir):
    """First, last and second-last day of each series."""
    w = Window.partitionBy("transect_id").orderBy(F.desc("day"))
    d = T.daily(spark, sf_dir).withColumn("r", F.dense_rank().over(w))
    return d.groupBy("transect_id").agg(F.min("day").alias("oldest"), F.max(F.when(F.col("r") == 1, F.col("day"))).alias("youngest"), F.max(F.when(F.col("r") == 2, F.col("day"))).alias("second_youngest"))


@register(T.sql(""", y AS (SELECT transect_id, year(day) AS yr, CASE WHEN month(day) BETWEEN 3 AND 8 THEN 'summer' ELSE 'winter' END AS season, regr_slope(y, (day - DATE '1990-01-01')::DOUBLE) * 365.2425 AS rate FROM v_daily GROUP BY ALL)
SELECT transect_id, season, count(rate) AS n_years, round(avg(rate), 5) AS rate FROM y GROUP BY ALL""", "v_daily"))
def seasonal_rates(spark, sf_dir):
    """Mean over years of the rates within March to August and September to February."""
    d = T.daily(spark, sf_dir).withColumns({"yr": F.year("day"), "season": F.when(F.month("day").between(3, 8), "summer").otherwise("winter"), "t": F.datediff("day", F.lit("1990-01-01")).cast("double")})
    y = d.groupBy("transect_id", "yr", "season").agg((F.regr_slope("y", "t") * S.DAYS_A_YEAR).alias("rate"))
    return y.groupBy("transect_id", "season").agg(F.count("rate").alias("n_years"), F.round(F.avg("rate"), 5).alias("rate"))


@register(T.sql(""", a AS (SELECT transect_id, day, y - median(y) OVER (PARTITION BY transect_id) AS a FROM v_daily)
SELECT transect_id, month(day) AS month, count(*) AS n, round(avg(a), 6) AS anomaly FROM a GROUP BY ALL""", "v_daily"))
def monthly_anomaly(spark, sf_dir):
    """Mean difference from the series' median by month."""
    d = T.daily(spark, sf_dir).withColumn("a", F.col("y") - F.median("y").over(Window.partitionBy("transect_id")))
    return d.groupBy("transect_id", F.month("day").cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("anomaly"))
