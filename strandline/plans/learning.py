"""Queries on spectra, learning, objects and contours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.scalars import rounded
from strandline.operators import graphs, learn, nearest, raster, spectra, tuning
from strandline.operators.rounds import State
from strandline.registry import register
from strandline.sources import tables as T

_SPECTRUM = """x AS (SELECT transect_id, y, (day - DATE '1995-01-01')::DOUBLE AS t FROM v_daily), g AS (SELECT *, unnest(range(1, 13)) / 365 AS f FROM x),
k AS (SELECT *, cos(2 * pi() * f * t) AS c, sin(2 * pi() * f * t) AS s FROM g),
m AS (SELECT transect_id, f, avg(y * y) - avg(y) ** 2 AS yy, avg(y * c) - avg(y) * avg(c) AS yc, avg(y * s) - avg(y) * avg(s) AS ys, avg(c * c) - avg(c) ** 2 AS cc, avg(s * s) - avg(s) ** 2 AS ss, avg(c * s) - avg(c) * avg(s) AS cs FROM k GROUP BY ALL)"""


@register(T.sql(f""", {_SPECTRUM} SELECT transect_id, round(f * 365)::BIGINT AS per_year, round((ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (cc * ss - cs * cs) / yy, 8) AS power FROM m""", "v_daily"))
def periodogram(spark, sf_dir):
    """Share of each series' variance at one to twelve cycles a year, with a floating mean."""
    d = T.daily(spark, sf_dir).select("transect_id", F.col("y").alias("x"), F.datediff("day", F.lit("1995-01-01")).cast("double").alias("t"))
    s = spectra.sums(d, ["transect_id"], "t", ["x"], F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: k / 365))
    return s.select("transect_id", F.round(F.col("f") * 365).cast("long").alias("per_year"), F.round(spectra.cross_power("x", "x") / F.col("x_x"), 8).alias("power"))


@register(T.sql(f""", w AS (SELECT t.transect_id, epoch_us(t.acq_ts) / 86400000000 - 19700 AS t, t.dist AS x, p.tide + (n.tide - p.tide) * (epoch_us(t.acq_ts) - epoch_us(p.date)) / (epoch_us(n.date) - epoch_us(p.date)) AS z
  FROM v_obs t ASOF JOIN v_tide p ON p.date <= t.acq_ts ASOF JOIN v_tide n ON n.date > t.acq_ts WHERE t.kind = 'WL'),
g AS (SELECT *, unnest([0.9, 1.0, 1.1, 1.9, 2.0]::DOUBLE[]) AS f FROM w), k AS (SELECT *, cos(2 * pi() * f * t) AS c, sin(2 * pi() * f * t) AS s FROM g),
m AS (SELECT transect_id, f, count(*) AS n, avg(x * c) - avg(x) * avg(c) AS xc, avg(x * s) - avg(x) * avg(s) AS xs, avg(z * c) - avg(z) * avg(c) AS zc, avg(z * s) - avg(z) * avg(s) AS zs, avg(c * c) - avg(c) ** 2 AS cc, avg(s * s) - avg(s) ** 2 AS ss, avg(c * s) - avg(c) * avg(s) AS cs FROM k GROUP BY ALL HAVING count(*) >= 10),
e AS (SELECT transect_id, sum((ss * xc * xc + cc * xs * xs - 2 * cs * xc * xs) / (cc * ss - cs * cs)) AS xx, sum((ss * xc * zc + cc * xs * zs - cs * (xc * zs + xs * zc)) / (cc * ss - cs * cs)) AS xz, sum((ss * zc * zc + cc * zs * zs - 2 * cs * zc * zs) / (cc * ss - cs * cs)) AS zz FROM m GROUP BY ALL),
q AS (SELECT *, 0.001::DOUBLE + unnest(range(0, 167)) * 0.003::DOUBLE AS slope FROM e)
SELECT transect_id, round(arg_min(slope, xx + 2 * xz / slope + zz / (slope * slope)), 6) AS slope FROM q GROUP BY transect_id""", "v_obs", "v_tide"))
def beach_slope(spark, sf_dir):
    """Slope of each transect at which tide-corrected waterlines have the least tidal energy."""
    from strandline.plans.series import _tides

    w = _tides(spark, sf_dir).where("kind = 'WL' and prev is not null and next is not null").select("transect_id", (T.micros() / 86400000000 - 19700).alias("t"), F.col("dist").alias("x"), F.col("tide").alias("z"))
    s = spectra.sums(w, ["transect_id"], "t", ["x", "z"], F.array(*[F.lit(f) for f in (0.9, 1.0, 1.1, 1.9, 2.0)])).where("n >= 10")
    return spectra.best_slope(s, ["transect_id"], 0.001, 0.499, 0.003).select("transect_id", F.round("slope", 6).alias("slope"))


def _features(spark, sf_dir):
    """Eight features of each vector: the means of its eighths."""
    e = T.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("label") % 2).cast("int").alias("cls"), *[T.block_mean(k, 8).alias(f"x{k}") for k in range(8)]).dropna()


NAMES = [f"x{k}" for k in range(8)]


@register()
def kmeans_classes(spark, sf_dir):
    """Rows of each of three k-means classes."""
    return learn.clusters(_features(spark, sf_dir), NAMES, 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x0"), 6).alias("x0"))


@register()
def rocky_coast(spark, sf_dir):
    """Transects in two classes by the roughness of their slopes and elevations up to a level; the class of rougher elevations is rocky."""
    w = Window.partitionBy("transect_id").orderBy("seq")
    low = T.profile(spark, sf_dir).withColumn("slope", F.lead("z").over(w) - F.col("z")).where("z between -20 and 2")
    rough = low.groupBy("transect_id").agg(F.stddev_pop("z").alias("elevation"), F.stddev_pop("slope").alias("slope")).dropna()
    found = learn.clusters(State(rough).table, ["elevation", "slope"], 2)  # written once, read by each pass
    return found.select("transect_id", F.round("elevation", 6).alias("elevation"), F.round("slope", 6).alias("slope"), (F.col("cluster") == 1).alias("rocky"))


@register()
def pca_scores(spark, sf_dir):
    """Scores on the components that explain 90 %."""
    scores, _ = learn.principal_components(_features(spark, sf_dir), NAMES)
    return scores.select("vec_id", *[F.round(c, 6).alias(c) for c in scores.columns if c.startswith("pc")])


@register()
def perceptron_confusion(spark, sf_dir):
    """Confusion of a perceptron on held-out rows."""
    f = _features(spark, sf_dir)
    held = F.pmod(F.xxhash64("vec_id"), F.lit(10)) < 3
    p = learn.perceptron(f.where(~held), f.where(held), NAMES, "cls")
    return p.groupBy("cls", "predicted").agg(F.count(F.lit(1)).alias("n"))


@register()
def ridge_fleet(spark, sf_dir):
    """A forecast model for each transect and its error."""
    return learn.ridge_by_group(T.daily(spark, sf_dir), "transect_id", "day", "y").select("transect_id", "n_test", F.round("rmse", 6).alias("rmse"), F.round("naive_rmse", 6).alias("naive_rmse"))


def _quarters(spark, sf_dir):
    """Four features of each vector: the means of its quarters."""
    e = T.table(spark, sf_dir, "embeddings").where(F.forall("embedding", lambda v: v.isNotNull()))
    return e.select("vec_id", (F.col("label") % 2).cast("int").alias("cls"), *[T.block_mean(k, 16).alias(f"x{k}") for k in range(4)])


_FOUR = [f"x{k}" for k in range(4)]
_QUARTERS = """f AS (SELECT vec_id, label % 2 AS cls, list_sum(embedding[1:16]::DOUBLE[]) / 16 AS x0, list_sum(embedding[17:32]::DOUBLE[]) / 16 AS x1, list_sum(embedding[33:48]::DOUBLE[]) / 16 AS x2, list_sum(embedding[49:64]::DOUBLE[]) / 16 AS x3 FROM embeddings),
d AS (SELECT a.vec_id AS from_key, b.vec_id AS to_key, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2 + (a.x3 - b.x3) ** 2) AS d FROM f a JOIN f b ON a.vec_id <> b.vec_id AND a.cls = b.cls),
r AS (SELECT *, row_number() OVER (PARTITION BY from_key ORDER BY d, to_key) AS rank FROM d)"""


@register(f"""WITH {_QUARTERS} SELECT from_key AS vec_id, rank, to_key AS near, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def nearest_rows(spark, sf_dir):
    """The five nearest rows of the same class to each row, in four dimensions."""
    f = _quarters(spark, sf_dir)
    out = nearest.nearest(f, f.withColumnRenamed("vec_id", "near"), "vec_id", "near", _FOUR, 5, by=["cls"], apart=True)
    return out.select("vec_id", "rank", "near", F.round("distance", 6).alias("distance"))


@register(f"""WITH {_QUARTERS}, n AS (SELECT *, least(count(*) OVER (PARTITION BY from_key), 5) AS n FROM r),
c AS (SELECT n.*, c AS copy, ((from_key * 104729 + c * 7907) % 1000) / 1000 AS at_share FROM n, (SELECT unnest([0, 1]) AS c) WHERE rank = (from_key * 7919 + c * 31) % n + 1)
SELECT from_key, copy::BIGINT AS copy, to_key, round(a.x0 + at_share * (b.x0 - a.x0), 6) AS x0, round(a.x1 + at_share * (b.x1 - a.x1), 6) AS x1, round(a.x2 + at_share * (b.x2 - a.x2), 6) AS x2, round(a.x3 + at_share * (b.x3 - a.x3), 6) AS x3
FROM c JOIN f a ON a.vec_id = from_key JOIN f b ON b.vec_id = to_key WHERE a.cls = 1""")
def oversampled_rows(spark, sf_dir):
    """Two rows made between each row of the second class and its nearest ones."""
    f = _quarters(spark, sf_dir).where("cls = 1")
    out = nearest.between_neighbours(f, "vec_id", _FOUR, copies=2)
    return out.select("from_key", "copy", "to_key", *[rounded(F.col(c), 6).alias(c) for c in _FOUR])


@register()
def coast_clusters(spark, sf_dir):
    """Three clusters of the graph of nearest rows."""
    f = _quarters(spark, sf_dir)
    near = nearest.nearest(f, f.withColumnRenamed("vec_id", "near"), "vec_id", "near", _FOUR, 10, apart=True)
    edges = near.select(F.col("vec_id").alias("a"), F.col("near").alias("b"), F.exp(-200 * F.col("distance") * F.col("distance")).alias("weight"))
    return graphs.spectral_clusters(edges, 3, tolerance=1e-3).withColumnRenamed("node", "vec_id")


def _lagged(spark, sf_dir, lags: list[int]):
    """Daily values with earlier ones of their series."""
    w = Window.partitionBy("transect_id").orderBy("day")
    return T.daily(spark, sf_dir).select("transect_id", "day", "y", *[F.lag("y", k).over(w).alias(f"lag{k}") for k in lags]).dropna()


TRIALS = [(n, p) for n in (1, 2, 3, 5, 10) for p in (0.0, 1.0, 100.0, 10_000.0, 1_000_000.0)]


@register()
def parameter_search(spark, sf_dir):
    """Number of lags and penalty of the ridge regression that forecasts each transect best, of 25 trials over three folds of years."""
    d = _lagged(spark, sf_dir, list(range(1, 11))).withColumn("fold", F.year("day") % 3)
    found = tuning.search(d, "transect_id", "fold", [f"lag{k}" for k in range(1, 11)], "y", TRIALS)
    return found.where("best").select("transect_id", "features", "penalty", F.round("rmse", 6).alias("rmse"))


@register()
def forecast_ensemble(spark, sf_dir):
    """Two series of each transect in their last year, forecast from the last three values of both by five regressions: mean and spread."""
    i = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("transect_id"), F.to_date("l_shipdate").alias("day"))
    d = i.agg(F.sum("l_quantity").alias("y"), (F.sum("l_extendedprice") / 1000).alias("z"))
    w = Window.partitionBy("transect_id").orderBy("day")
    features = [f"{c}{k}" for c in "yz" for k in (1, 2, 3)]
    d = d.select("*", *[F.lag(f[0], int(f[1])).over(w).alias(f) for f in features], (F.year(F.max("day").over(Window.partitionBy("transect_id"))) == F.year("day")).alias("ahead")).dropna()
    models = tuning.members(d.where("not ahead").withColumn("fold", F.dayofyear("day") % 5), "transect_id", "fold", features, ["y", "z"], 10.0)
    found = tuning.forecast(d.where("ahead"), models, "transect_id", features, ["y", "z"])
    return found.select("transect_id", "day", "members", *[F.round(c, 5).alias(c) for c in ("y_mean", "y_spread", "z_mean", "z_spread")])


@register(T.sql(""", l AS (SELECT transect_id, day, y, lag(y, 1) OVER w AS lag1, lag(y, 10) OVER w AS lag10 FROM v_daily WINDOW w AS (PARTITION BY transect_id ORDER BY day)),
d AS (SELECT *, transect_id * 100000 + (day - DATE '1970-01-01') AS key FROM l WHERE lag10 IS NOT NULL),
s AS (SELECT avg(y) AS my, avg(lag1) AS m1, avg(lag10) AS m2, covar_pop(lag1, lag1) AS s11, covar_pop(lag1, lag10) AS s12, covar_pop(lag10, lag10) AS s22, covar_pop(lag1, y) AS s1, covar_pop(lag10, y) AS s2 FROM d),
b AS (SELECT *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY key) AS i, row_number() OVER (ORDER BY (key * 2654435761) % 4294967296) AS j FROM d),
x AS (SELECT r.y, r.lag1, r.lag10, o.lag1 AS other1, o.lag10 AS other10 FROM r JOIN r o ON o.j = r.i),
e AS (SELECT sqrt(avg((y - my - b1 * (lag1 - m1) - b2 * (lag10 - m2)) ** 2)) AS rmse, sqrt(avg((y - my - b1 * (other1 - m1) - b2 * (lag10 - m2)) ** 2)) AS lag1, sqrt(avg((y - my - b1 * (lag1 - m1) - b2 * (other10 - m2)) ** 2)) AS lag10 FROM x, b)
SELECT 'lag1' AS feature, round(rmse, 6) AS rmse, round(lag1, 6) AS shuffled, round(lag1 - rmse, 6) AS change FROM e UNION ALL SELECT 'lag10', round(rmse, 6), round(lag10, 6), round(lag10 - rmse, 6) FROM e""", "v_daily"))
def feature_influence(spark, sf_dir):
    """What a regression on the last and the tenth last value loses when either is dealt to other rows."""
    d = _lagged(spark, sf_dir, [1, 10]).withColumn("key", F.col("transect_id") * 100_000 + F.unix_date("day"))
    # key * 2654435761 % 2^32 by halves of the factor, as the whole product may pass 64 bits
    low = F.col("key") % 4294967296
    shuffle = (low * 40503 % 4294967296 * 65536 + low * 31153) % 4294967296
    found = tuning.influence(d, "key", ["lag1", "lag10"], "y", tuning.least_squares(d, ["lag1", "lag10"], "y"), shuffle)
    return found.select("feature", *[F.round(c, 6).alias(c) for c in ("rmse", "shuffled", "change")])


@register(T.sql(""", m AS (SELECT *, CASE WHEN a <= 0.2 THEN a * 0.7 + b * b END AS pan FROM v_pixel), k AS (SELECT * FROM m WHERE pan IS NOT NULL),
s AS (SELECT image_id, avg(a) AS ma, avg(b) AS mb, 0.5::DOUBLE * atan2(2 * covar_pop(a, b), covar_pop(a, a) - covar_pop(b, b)) AS angle FROM k GROUP BY image_id),
v AS (SELECT *, CASE WHEN (CASE WHEN abs(cos(angle)) >= abs(sin(angle)) THEN cos(angle) ELSE sin(angle) END) < 0 THEN -1 ELSE 1 END AS sign FROM s),
p AS (SELECT k.*, sign * cos(angle) AS ca, sign * sin(angle) AS cb, (a - ma) * sign * cos(angle) + (b - mb) * sign * sin(angle) AS first FROM k JOIN v USING (image_id)),
r AS (SELECT *, count(*) OVER (PARTITION BY image_id ORDER BY pan RANGE UNBOUNDED PRECEDING) AS m, row_number() OVER (PARTITION BY image_id ORDER BY first) AS r FROM p)
SELECT m.image_id, m.row, m.col, round(x.a + (o.first - x.first) * x.ca, 5) AS a, round(x.b + (o.first - x.first) * x.cb, 5) AS b FROM m LEFT JOIN r x ON x.image_id = m.image_id AND x.row = m.row AND x.col = m.col LEFT JOIN r o ON o.image_id = x.image_id AND o.r = x.m""", "v_pixel"))
def pan_sharpened(spark, sf_dir):
    """Images whose first principal component is replaced by a pan band; clouds stay out."""
    p = T.pixel(spark, sf_dir).withColumn("pan", F.when(F.col("a") <= 0.2, F.col("a") * 0.7 + F.col("b") * F.col("b")))
    return raster.pan_sharpened(p, ["a", "b"], "pan").select("image_id", "row", "col", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


@register()
def image_evaluation(spark, sf_dir):
    """How a perceptron trained on a third of the images finds a class in every image, and how far its line lies from the true one."""
    p = T.pixel(spark, sf_dir).withColumn("truth", (F.col("a") + F.col("b") * F.col("b") * 4 > 0.05).cast("int"))
    found = learn.perceptron(p.where(F.pmod(F.xxhash64("image_id"), F.lit(3)) == 0), p, ["a", "b"], "truth", hidden=(8, 4))
    # pixels are joined and classified once; counts, lines and both searches read what was written
    out = raster.evaluated(State(found.select("image_id", "row", "col", "truth", "predicted")).table, "truth", "predicted")
    return out.select("image_id", "n", "n_true", "n_predicted", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "kappa", "mean_distance", "max_distance", "back_distance")])


@register("WITH RECURSIVE" + T.sql(""", m AS MATERIALIZED (SELECT image_id, "row", col, "row" * 1048576 + col AS id FROM v_pixel WHERE a > 0.1),
r AS (SELECT image_id, id AS root, "row", col FROM m UNION SELECT r.image_id, r.root, m."row", m.col FROM r JOIN m ON m.image_id = r.image_id AND abs(m."row" - r."row") + abs(m.col - r.col) = 1),
l AS (SELECT image_id, "row", col, min(root) AS label FROM r GROUP BY ALL)
SELECT image_id, label, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 4""", "v_pixel").removeprefix("WITH"))
def large_objects(spark, sf_dir):
    """Connected sets of at least four mask pixels."""
    o = raster.objects(T.pixel(spark, sf_dir).where("a > 0.1").select("image_id", "row", "col"))
    return o.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


@register(T.sql(""", q AS MATERIALIZED (SELECT * FROM v_pixel),
c AS (SELECT a.image_id, a.a AS a, b.a AS b, c.a AS c, d.a AS d FROM q a JOIN q b ON b.image_id = a.image_id AND b."row" = a."row" AND b.col = a.col + 1 JOIN q c ON c.image_id = a.image_id AND c."row" = a."row" + 1 AND c.col = a.col + 1 JOIN q d ON d.image_id = a.image_id AND d."row" = a."row" + 1 AND d.col = a.col),
k AS (SELECT *, (a >= 0)::INT + 2 * (b >= 0)::INT + 4 * (c >= 0)::INT + 8 * (d >= 0)::INT AS code, -a / (b - a) AS t, -b / (c - b) AS r, -d / (c - d) AS u, -a / (d - a) AS l, (a + b + c + d) / 4 >= 0 AS high FROM c),
s AS (SELECT *, sqrt(l * l + t * t) AS lt, sqrt((1 - t) ** 2 + r * r) AS tr, sqrt(1 + (r - l) ** 2) AS lr, sqrt((1 - u) ** 2 + (1 - r) ** 2) AS rb, sqrt((u - t) ** 2 + 1) AS tb, sqrt(u * u + (1 - l) ** 2) AS lb FROM k WHERE code NOT IN (0, 15)),
g AS (SELECT image_id, CASE WHEN code IN (5, 10) THEN 2 ELSE 1 END AS n, CASE WHEN code IN (1, 14) THEN lt WHEN code IN (2, 13) THEN tr WHEN code IN (3, 12) THEN lr WHEN code IN (4, 11) THEN rb WHEN code IN (6, 9) THEN tb WHEN code IN (7, 8) THEN lb WHEN (code = 5) = high THEN tr + lb ELSE lt + rb END AS length FROM s)
SELECT image_id, sum(n)::BIGINT AS n, round(sum(length), 6) AS length FROM g GROUP BY image_id""", "v_pixel"))
def contour_lengths(spark, sf_dir):
    """Segments and length of each image's line at zero."""
    s = raster.contour_segments(T.pixel(spark, sf_dir), "a", 0.0)
    return s.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))), 6).alias("length"))
