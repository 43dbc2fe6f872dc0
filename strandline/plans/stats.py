"""Queries that sum up errors, skill and classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.registry import register
from strandline.sources import tables as T


@register(T.sql("""SELECT coalesce(sat, 'Total') AS sat, coalesce(strftime(acq_ts, '%Y-%m-%d'), 'Total') AS day, count(*) AS n, round(avg(abs(dist - 50)), 6) AS mae, round(sqrt(avg((dist - 50) ** 2)), 6) AS rmse,
  count(*) FILTER (abs(dist - 50) <= 3) AS within_3, count(*) FILTER (abs(dist - 50) <= 10) AS within_10, count(*) FILTER (abs(dist - 50) <= 15) AS within_15 FROM v_obs GROUP BY ROLLUP (sat, strftime(acq_ts, '%Y-%m-%d'))""", "v_obs"))
def accuracy_table(spark, sf_dir):
    """Errors by satellite and date with totals."""
    o = T.obs(spark, sf_dir).select("sat", F.date_format("acq_ts", "yyyy-MM-dd").alias("day"), (F.col("dist") - 50).alias("e"))
    r = o.rollup("sat", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), *[F.count_if(F.abs("e") <= k).alias(f"within_{k}") for k in (3, 10, 15)])
    return r.withColumns({"sat": F.coalesce("sat", F.lit("Total")), "day": F.coalesce("day", F.lit("Total"))})


@register(T.sql(""", x AS (SELECT sat, kind, (epoch_us(acq_ts) % 86400000000) / 86400000000 AS d, dist FROM v_obs)
SELECT sat, kind, count(*) AS n, round(regr_slope(dist, d), 5) AS slope, round(regr_intercept(dist, d), 5) AS intercept, round(regr_r2(dist, d), 8) AS r2, round(corr(dist, d), 8) AS r, round(sqrt(avg((dist - d) ** 2)), 6) AS rmse FROM x GROUP BY GROUPING SETS ((sat), (kind), ())""", "v_obs"))
def regression_sets(spark, sf_dir):
    """Regressions by satellite, by kind and pooled."""
    x = T.obs(spark, sf_dir).select("sat", "kind", ((T.micros() % 86400000000) / 86400000000).alias("d"), "dist")
    return x.groupingSets([["sat"], ["kind"], []], "sat", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("dist", "d"), 5).alias("slope"), F.round(F.regr_intercept("dist", "d"), 5).alias("intercept"), F.round(F.regr_r2("dist", "d"), 8).alias("r2"), F.round(F.corr("dist", "d"), 8).alias("r"), F.round(F.sqrt(F.avg((F.col("dist") - F.col("d")) * (F.col("dist") - F.col("d")))), 6).alias("rmse"))


@register(T.sql("""SELECT sat, count(*) AS n, round(avg(dist), 6) AS mean, round(quantile_cont(dist, 0.25), 6) AS q1, round(median(dist), 6) AS median, round(quantile_cont(dist, 0.75), 6) AS q3, round(count(*) FILTER (abs(dist - 50) <= 10) / count(*), 6) AS share_10 FROM v_obs GROUP BY sat""", "v_obs"))
def error_distribution(spark, sf_dir):
    """Quartiles and shares by satellite."""
    q = F.percentile("dist", [0.25, 0.5, 0.75])
    return T.obs(spark, sf_dir).groupBy("sat").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dist"), 6).alias("mean"), F.round(q[0], 6).alias("q1"), F.round(q[1], 6).alias("median"), F.round(q[2], 6).alias("q3"), F.round(F.count_if(F.abs(F.col("dist") - 50) <= 10) / F.count(F.lit(1)), 6).alias("share_10"))


@register(T.sql(""", b AS (SELECT kind, floor(dist * 2)::BIGINT AS b, count(*) AS n FROM v_obs GROUP BY ALL), g AS (SELECT unnest(range(0, 51)) * 4 AS g)
SELECT kind, g AS x, round(sum(n * exp(-0.5 * ((g - (b / 2 + 0.25)) / 5) ** 2)) / (sum(n) * 5 * sqrt(2 * pi())), 8) AS density FROM b, g GROUP BY ALL""", "v_obs"))
def density(spark, sf_dir):
    """Gaussian density of positions on a grid, from counts in bins of half a metre."""
    b = T.obs(spark, sf_dir).groupBy("kind", F.floor(F.col("dist") * 2).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    x = b.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(50)), lambda k: (k * 4).cast("long"))).alias("x"))
    z = (F.col("x") - (F.col("b") / 2 + 0.25)) / 5
    return x.groupBy("kind", "x").agg(F.round(F.sum(F.col("n") * F.exp(-0.5 * z * z)) / (F.sum("n") * 5 * F.sqrt(F.lit(2 * 3.141592653589793))), 8).alias("density"))


@register("""WITH f AS (SELECT vec_id, label, i AS v, list_sum(embedding[8 * i + 1:8 * i + 8]::DOUBLE[]) / 8 AS x FROM embeddings, (SELECT unnest(range(8)) AS i))
SELECT a.label % 2 AS class, a.v AS v1, b.v AS v2, round(corr(a.x, b.x), 7) AS r, round(regr_slope(b.x, a.x), 7) AS slope, count(*) AS n FROM f a JOIN f b USING (vec_id) GROUP BY ALL""")
def correlation_matrix(spark, sf_dir):
    """Pearson correlation and slope of all pairs of the means of the vectors' eighths by class."""
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("class"), F.array(*[T.block_mean(k, 8) for k in range(8)]).alias("x"))
    pairs = e.select("class", F.posexplode("x").alias("v1", "a"), "x").select("class", "v1", "a", F.posexplode("x").alias("v2", "b"))
    return pairs.groupBy("class", F.col("v1").cast("long").alias("v1"), F.col("v2").cast("long").alias("v2")).agg(F.round(F.corr("a", "b"), 7).alias("r"), F.round(F.regr_slope("b", "a"), 7).alias("slope"), F.count(F.lit(1)).alias("n"))


@register(T.sql(""", d AS (SELECT transect_id, acq_ts::DATE AS day, avg(dist) AS dist FROM v_obs GROUP BY ALL), w AS (SELECT t::DATE AS day, avg(hs) AS hs FROM v_wave GROUP BY ALL)
SELECT transect_id, count(*) AS n, round(regr_r2(dist, hs), 7) AS r2 FROM d JOIN w USING (day) GROUP BY transect_id""", "v_obs", "v_wave"))
def wave_position_r2(spark, sf_dir):
    """Share of each transect's positions that daily wave height explains."""
    d = T.obs(spark, sf_dir).groupBy("transect_id", F.to_date("acq_ts").alias("day")).agg(F.avg("dist").alias("dist"))
    w = T.wave(spark, sf_dir).groupBy(F.to_date("t").alias("day")).agg(F.avg("hs").alias("hs"))
    return d.join(w, "day").groupBy("transect_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_r2("dist", "hs"), 7).alias("r2"))


@register(T.sql(""", p AS (SELECT *, avg(y) OVER (PARTITION BY transect_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f, row_number() OVER (PARTITION BY transect_id ORDER BY day) AS r FROM v_daily),
s AS (SELECT transect_id, sqrt(avg((y - f) ** 2)) AS rmse, sqrt(avg((y - f) ** 2) FILTER (r BETWEEN 6 AND 15)) AS rmse_10, corr(y, f) AS r, stddev_pop(f) / stddev_pop(y) AS ratio, sqrt(avg((y - f) ** 2)) / stddev_pop(y) AS scaled, max(y) - min(y) AS span FROM p WHERE r > 5 GROUP BY transect_id)
SELECT transect_id, round(rmse, 6) AS rmse, round(rmse_10, 6) AS rmse_10, round(r, 6) AS r, round(ratio, 6) AS ratio, round(scaled, 6) AS scaled, round(100 * rmse / span, 6) AS percent, rmse > quantile_cont(rmse, 0.75) OVER () AS flagged FROM s""", "v_daily"))
def forecast_skill(spark, sf_dir):
    """Skill of a five-row mean as forecast: errors over all and over the first ten rows, correlation, spread, share of the range."""
    w = Window.partitionBy("transect_id").orderBy("day")
    p = T.daily(spark, sf_dir).withColumns({"f": F.avg("y").over(w.rowsBetween(-5, -1)), "r": F.row_number().over(w)}).where("r > 5")
    e = (F.col("y") - F.col("f")) * (F.col("y") - F.col("f"))
    s = p.groupBy("transect_id").agg(F.sqrt(F.avg(e)).alias("rmse"), F.sqrt(F.avg(F.when(F.col("r") <= 15, e))).alias("rmse_10"), F.corr("y", "f").alias("c"), (F.stddev_pop("f") / F.stddev_pop("y")).alias("ratio"), (F.sqrt(F.avg(e)) / F.stddev_pop("y")).alias("scaled"), (F.max("y") - F.min("y")).alias("span"))
    limit = s.agg(F.percentile("rmse", 0.75).alias("q"))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return s.join(F.broadcast(limit)).select("transect_id", r6("rmse", "rmse"), r6("rmse_10", "rmse_10"), r6("c", "r"), r6("ratio", "ratio"), r6("scaled", "scaled"), r6(100 * F.col("rmse") / F.col("span"), "percent"), (F.col("rmse") > F.col("q")).alias("flagged"))


@register("SELECT quality AS actual, count(*) FILTER (toxic = 0) AS predicted_0, count(*) FILTER (toxic = 1) AS predicted_1, round(count(*) FILTER (toxic = quality) / count(*), 6) AS recall FROM labels GROUP BY quality")
def confusion(spark, sf_dir):
    """Confusion table of two class columns."""
    c = T.table(spark, sf_dir, "labels")
    return c.groupBy(F.col("quality").alias("actual")).agg(F.count_if(F.col("toxic") == 0).alias("predicted_0"), F.count_if(F.col("toxic") == 1).alias("predicted_1"), F.round(F.count_if(F.col("toxic") == F.col("quality")) / F.count(F.lit(1)), 6).alias("recall"))


@register(T.sql(""", s AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM v_daily)
SELECT transect_id, day, round((y - m) / s, 6) AS z, percent_rank() OVER (PARTITION BY transect_id ORDER BY day) < 0.8 AS train FROM v_daily, s""", "v_daily"))
def scaled_split(spark, sf_dir):
    """Standard scores of the whole table, and the first 80 % of each series as training rows."""
    d = T.daily(spark, sf_dir)
    s = d.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    return d.join(F.broadcast(s)).select("transect_id", "day", F.round((F.col("y") - F.col("m")) / F.col("s"), 6).alias("z"), (F.percent_rank().over(Window.partitionBy("transect_id").orderBy("day")) < 0.8).alias("train"))


@register(T.sql(""", m AS (SELECT transect_id, avg(y) AS y, count(*) AS n FROM v_daily GROUP BY ALL), c AS (SELECT *, y >= 125 AS high, row_number() OVER (PARTITION BY y >= 125 ORDER BY md5(transect_id::VARCHAR), transect_id) AS r, count(*) OVER (PARTITION BY y >= 125) AS size FROM m)
SELECT transect_id, high FROM c WHERE r <= (SELECT min(size) FROM c) AND n >= 18""", "v_daily"))
def balanced_sample(spark, sf_dir):
    """Two classes cut to the size of the smaller, in order of a hash; series of under 18 rows don't count."""
    m = T.daily(spark, sf_dir).groupBy("transect_id").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).withColumn("high", F.col("y") >= 125)
    size = m.groupBy("high").count().agg(F.min("count").alias("size"))
    # ranks are taken within 4096 parts of each class by the hash's first digits, after the counts of the parts before
    m = m.withColumn("hash", F.md5(F.col("transect_id").cast("string"))).withColumn("part", F.substring("hash", 1, 3))
    before = F.sum("n_part").over(Window.partitionBy("high").orderBy("part")) - F.col("n_part")
    parts = m.groupBy("high", "part").agg(F.count(F.lit(1)).alias("n_part")).withColumn("before", before).select("high", "part", "before")
    own = F.row_number().over(Window.partitionBy("high", "part").orderBy("hash", "transect_id"))
    c = m.withColumn("own", own).join(F.broadcast(parts), ["high", "part"]).withColumn("r", F.col("own") + F.col("before"))
    return c.join(F.broadcast(size)).where("r <= size and n >= 18").select("transect_id", "high")


@register(T.sql(""", d AS (SELECT transect_id, day, y FROM v_daily), r AS (SELECT transect_id, regr_slope(y, (day - DATE '1990-01-01')::DOUBLE) * 365.2425 AS rate FROM d GROUP BY ALL)
SELECT count(*) FILTER (rate < 0) AS n_eroding, round(avg(rate) FILTER (rate < 0), 6) AS mean_eroding, count(*) FILTER (rate > -50 AND rate < 50) AS n_plausible, count(*) AS n FROM r""", "v_daily"))
def site_summary(spark, sf_dir):
    """Number and mean of eroding rates."""
    r = T.daily(spark, sf_dir).withColumn("t", F.datediff("day", F.lit("1990-01-01")).cast("double")).groupBy("transect_id").agg((F.regr_slope("y", "t") * 365.2425).alias("rate"))
    return r.agg(F.count_if(F.col("rate") < 0).alias("n_eroding"), F.round(F.avg(F.when(F.col("rate") < 0, F.col("rate"))), 6).alias("mean_eroding"), F.count_if((F.col("rate") > -50) & (F.col("rate") < 50)).alias("n_plausible"), F.count(F.lit(1)).alias("n"))


@register(T.sql(""", s AS (SELECT transect_id, dist, cume_dist() OVER (PARTITION BY transect_id ORDER BY dist) AS q FROM (SELECT DISTINCT transect_id, dist FROM v_obs WHERE kind = 'VE')), t AS (SELECT transect_id, dist AS target, cume_dist() OVER (PARTITION BY transect_id ORDER BY dist) AS q FROM (SELECT DISTINCT transect_id, dist FROM v_obs WHERE kind = 'WL'))
SELECT s.transect_id, s.dist, min(t.target) AS matched FROM s JOIN t ON s.transect_id = t.transect_id AND t.q >= s.q - 1e-12 GROUP BY ALL""", "v_obs"))
def quantile_match(spark, sf_dir):
    """Edge positions mapped to the waterline positions of equal cumulative frequency."""
    o = T.obs(spark, sf_dir)
    w = Window.partitionBy("transect_id").orderBy("dist")
    side = lambda kind: o.where(F.col("kind") == kind).select("transect_id", "dist").distinct().withColumn("q", F.cume_dist().over(w))
    s, t = side("VE"), side("WL")
    merged = s.select("transect_id", "dist", F.lit(None).cast("double").alias("target"), (F.col("q") - 1e-12).alias("q")).union(t.select("transect_id", F.lit(None).cast("double"), F.col("dist"), "q"))
    after = Window.partitionBy("transect_id").orderBy(F.desc("q"), F.desc("target"))
    m = merged.withColumn("matched", F.last("target", ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, 0)))
    return m.where("dist is not null and matched is not null").select("transect_id", "dist", "matched")


@register(T.sql(""", r AS (SELECT transect_id, regr_slope(dist, epoch_us(acq_ts) / 86400000000 - 19700) FILTER (kind = 'VE') * 365.2425 AS ve, regr_slope(dist, epoch_us(acq_ts) / 86400000000 - 19700) FILTER (kind = 'WL') * 365.2425 AS wl FROM v_obs GROUP BY transect_id)
SELECT transect_id, round(ve, 5) AS ve_rate, round(wl, 5) AS wl_rate FROM r WHERE ve > -50 AND ve < 50 AND wl > -190 AND wl < 190""", "v_obs"))
def plausible_rates(spark, sf_dir):
    """Rates of vegetation edge and waterline; transects with one out of its range are left out."""
    day = T.micros() / 86400000000 - 19700
    rate = lambda kind: F.regr_slope(F.when(F.col("kind") == kind, F.col("dist")), day) * 365.2425
    r = T.obs(spark, sf_dir).groupBy("transect_id").agg(rate("VE").alias("ve"), rate("WL").alias("wl"))
    masked = r.withColumns({"ve": F.when((F.col("ve") > -50) & (F.col("ve") < 50), F.col("ve")), "wl": F.when((F.col("wl") > -190) & (F.col("wl") < 190), F.col("wl"))}).dropna()
    return masked.select("transect_id", F.round("ve", 5).alias("ve_rate"), F.round("wl", 5).alias("wl_rate"))
