"""Queries on vegetation edges and what lies around them: zones, slopes, surveys, defences, thresholds, waves near the shore."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import joins, morphology, windows
from strandline.operators.raster import box_deviations
from strandline.registry import register
from strandline.sources import tables as T

#: A transition zone counts if it begins within so many metres of the edge; metres added to its mean width for a slope's reach.
ZONE_REACH = 100
SLOPE_MARGIN = 5
#: What a defence lets erode before it holds.
DEFENCE_ALLOWANCE = 40
GRAVITY = 9.81

# an edge position along the profile (one sample a metre) of each survey, and the zone as samples near zero
_ZONE = f"""e AS (SELECT transect_id, year, 10 * dist AS edge FROM v_survey),
z AS (SELECT transect_id, seq, seq - row_number() OVER (PARTITION BY transect_id ORDER BY seq) AS run FROM v_profile WHERE abs(z) <= 10),
i AS (SELECT transect_id, min(seq) AS first, max(seq) AS last FROM z GROUP BY transect_id, run HAVING count(*) > 1),
n AS (SELECT e.transect_id, year, edge, arg_min(last - first, (abs(first - edge), first)) FILTER (abs(first - edge) <= {ZONE_REACH}) AS width
      FROM e LEFT JOIN i ON i.transect_id = e.transect_id GROUP BY ALL)"""


def zone_widths(profile, surveys):
    """Width of the zone interval nearest to each survey's edge along its transect; null where none begins within reach."""
    edge = surveys.select("transect_id", "year", (10 * F.col("dist")).alias("edge"))
    flagged = profile.withColumn("inside", F.abs("z") <= 10)
    runs = windows.runs(flagged, ["transect_id"], "seq", "inside").where("inside")
    spans = runs.groupBy("transect_id", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).where("last > first")
    off = F.abs(F.col("first") - F.col("edge"))
    near = F.when(off <= ZONE_REACH, F.struct(off.alias("off"), "first"))
    met = edge.join(spans.select("transect_id", "first", "last"), "transect_id", "left")
    return met.groupBy("transect_id", "year", "edge").agg(F.min_by(F.when(off <= ZONE_REACH, F.col("last") - F.col("first")), near).alias("width"))


@register(T.sql(f""", {_ZONE}
SELECT transect_id, year, width, round(avg(width) OVER (PARTITION BY transect_id), 6) AS mean_width FROM n""", "v_survey", "v_profile"))
def zone_width(spark, sf_dir):
    """Width of the transition zone at each survey's edge, and its mean over a transect's surveys."""
    found = zone_widths(T.profile(spark, sf_dir), T.survey(spark, sf_dir))
    mean = F.avg("width").over(Window.partitionBy("transect_id"))
    return found.select("transect_id", "year", "width", F.round(mean, 6).alias("mean_width"))


@register(T.sql(f""", {_ZONE},
m AS (SELECT transect_id, avg(edge) AS edge, coalesce(avg(width), 0) + {SLOPE_MARGIN} AS reach FROM n GROUP BY transect_id),
s AS (SELECT transect_id, seq, CASE WHEN z < 24 THEN abs(z - lag(z) OVER (PARTITION BY transect_id ORDER BY seq)) END AS slope FROM v_profile)
SELECT m.transect_id, round(max(slope), 6) AS max_slope, round(avg(slope), 6) AS mean_slope
FROM m JOIN s ON s.transect_id = m.transect_id AND seq BETWEEN edge - reach AND edge + reach GROUP BY m.transect_id""", "v_survey", "v_profile"))
def edge_slope(spark, sf_dir):
    """Greatest and mean slope around the mean edge, as far as the mean zone width and a margin reach; nodata samples don't count."""
    profile = T.profile(spark, sf_dir)
    zones = zone_widths(profile, T.survey(spark, sf_dir))
    mean = zones.groupBy("transect_id").agg(F.avg("edge").alias("edge"), (F.coalesce(F.avg("width"), F.lit(0)) + SLOPE_MARGIN).alias("reach"))
    step = F.abs(F.col("z") - F.lag("z").over(Window.partitionBy("transect_id").orderBy("seq")))
    slopes = profile.select("transect_id", "seq", F.when(F.col("z") < 24, step).alias("slope"))
    around = slopes.join(mean, "transect_id").where("seq between edge - reach and edge + reach")
    return around.groupBy("transect_id").agg(F.round(F.max("slope"), 6).alias("max_slope"), F.round(F.avg("slope"), 6).alias("mean_slope"))


@register(T.sql("""SELECT o.event_id, CASE WHEN s.acq_ts IS NULL THEN 0 ELSE 1 END AS pos_error
FROM v_obs o LEFT JOIN (SELECT DISTINCT acq_ts FROM v_obs WHERE dist > 99) s ON s.acq_ts = o.acq_ts""", "v_obs"))
def flagged_observations(spark, sf_dir):
    """All observations of an image (its date and time) are flagged if one of them was selected: here those beyond 99 m."""
    o = T.obs(spark, sf_dir)
    selected = o.where("dist > 99").select("acq_ts", F.lit(1).alias("pos_error")).distinct()
    return o.join(selected, "acq_ts", "left").select("event_id", F.coalesce("pos_error", F.lit(0)).alias("pos_error"))


_HIT = """g AS (SELECT line_id, cls, seq, x AS xa, y AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM v_coast WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
j AS (SELECT *, (x1 - x0) * (yb - ya) - (y1 - y0) * (xb - xa) AS den FROM v_transect, g WHERE cls = {cls} AND xb IS NOT NULL
      AND greatest(xa, xb) >= least(x0, x1) AND least(xa, xb) <= greatest(x0, x1) AND greatest(ya, yb) >= least(y0, y1) AND least(ya, yb) <= greatest(y0, y1)),
u AS (SELECT *, ((xa - x0) * (yb - ya) - (ya - y0) * (xb - xa)) / den AS u, ((xa - x0) * (y1 - y0) - (ya - y0) * (x1 - x0)) / den AS v FROM j WHERE den <> 0),
h AS (SELECT transect_id, line_id, seq, x0 + u * (x1 - x0) AS x, y0 + u * (y1 - y0) AS y, u * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS dist
      FROM u WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1)"""


def _hits(spark, sf_dir, cls: int):
    lines = T.coast(spark, sf_dir).where(F.col("cls") == cls)
    return joins.crossings(T.transect(spark, sf_dir), joins.segments(lines), 20.0)


@register(T.sql(f""", {_HIT.format(cls=1)}, f AS (SELECT transect_id, arg_min(x, (dist, line_id, seq)) AS x, arg_min(y, (dist, line_id, seq)) AS y FROM h GROUP BY transect_id),
s AS (SELECT line_id, seq, x AS sx, y AS sy, 1950 + line_id % 60 AS year FROM v_coast WHERE cls = 2),
d AS (SELECT transect_id, line_id, seq, year, sqrt((x - sx) ** 2 + (y - sy) ** 2) AS d FROM f JOIN s ON sx BETWEEN x - 25 AND x + 25 AND sy BETWEEN y - 25 AND y + 25)
SELECT transect_id, arg_min(line_id, (d, line_id, seq)) AS survey, arg_min(year, (d, line_id, seq)) AS year, round(min(d), 6) AS d FROM d WHERE d <= 25 GROUP BY transect_id""", "v_coast", "v_transect"))
def survey_attributes(spark, sf_dir):
    """Attributes of the surveyed line (class 2) nearest to where a transect first meets a line of class 1, within 25 m."""
    first = _hits(spark, sf_dir, 1).groupBy("transect_id").agg(F.min_by(F.struct("x", "y"), F.struct("dist", "line_id", "seq")).alias("p")).select("transect_id", "p.x", "p.y")
    cell = lambda c: F.floor(F.col(c) / 25)
    around = lambda c: F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: cell(c) + k))
    surveys = T.coast(spark, sf_dir).where("cls = 2").select("line_id", "seq", F.col("x").alias("sx"), F.col("y").alias("sy"), (1950 + F.col("line_id") % 60).alias("year"))
    surveys = surveys.select("*", around("sx").alias("cx")).select("*", around("sy").alias("cy"))
    d = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    met = joins.by_cell(first.withColumns({"cx": cell("x"), "cy": cell("y")}), surveys, ["cx", "cy"]).withColumn("d", d).where("d <= 25")
    best = met.groupBy("transect_id").agg(F.min_by(F.struct("line_id", "year", "d"), F.struct("d", "line_id", "seq")).alias("b"))
    return best.select("transect_id", F.col("b.line_id").alias("survey"), "b.year", F.round("b.d", 6).alias("d"))


@register(T.sql(f""", {_HIT.format(cls=4)}, f AS (SELECT transect_id, min(dist) AS dist FROM h GROUP BY transect_id)
SELECT t.transect_id, round(dist, 6) AS defence, round(dist + {DEFENCE_ALLOWANCE}, 6) AS furthest FROM v_transect t LEFT JOIN f USING (transect_id)""", "v_coast", "v_transect"))
def nearest_defence(spark, sf_dir):
    """First defence (a line of class 4) from a transect's start, and how far erosion may go; nulls where there is none."""
    first = _hits(spark, sf_dir, 4).groupBy("transect_id").agg(F.min("dist").alias("dist"))
    out = T.transect(spark, sf_dir).select("transect_id").join(first, "transect_id", "left")
    return out.select("transect_id", F.round("dist", 6).alias("defence"), F.round(F.col("dist") + DEFENCE_ALLOWANCE, 6).alias("furthest"))


#: Width of a density's kernel and of its grid, and the prominence that a peak needs.
BANDWIDTH = 0.01
PROMINENCE = 0.5
_DENSITY = f"""p AS (SELECT image_id, a > 0.1 AS veg, least(greatest(a - b, -0.95), 0.95) AS x FROM v_pixel),
s AS (SELECT image_id, veg, count(*) OVER (PARTITION BY image_id, veg) AS n, x, unnest(range(floor(x * 100)::BIGINT - 8, floor(x * 100)::BIGINT + 10)) AS g FROM p),
k AS (SELECT image_id, veg, g, round(sum(exp(-0.5 * ((g / 100 - x) / {BANDWIDTH}) ** 2)) / any_value(n) / ({BANDWIDTH} * sqrt(2 * pi())), 9) AS density FROM s GROUP BY ALL),
w AS (SELECT *, CASE WHEN lag(g) OVER o = g - 1 THEN lag(density) OVER o ELSE 0 END AS before, CASE WHEN lead(g) OVER o = g + 1 THEN lead(density) OVER o ELSE 0 END AS after FROM k WINDOW o AS (PARTITION BY image_id, veg ORDER BY g))"""


@register(T.sql(f""", {_DENSITY},
q AS (SELECT c.image_id, c.veg, c.g, c.density, c.before, c.after, max(h.g) FILTER (h.g < c.g) AS lo, min(h.g) FILTER (h.g > c.g) AS hi
      FROM w c LEFT JOIN w h ON h.image_id = c.image_id AND h.veg = c.veg AND h.density > c.density WHERE NOT c.veg AND c.density > c.before AND c.density > c.after GROUP BY ALL),
b AS (SELECT q.image_id, q.g, q.density,
        coalesce(CASE WHEN count(*) FILTER (m.g < q.g AND m.g > coalesce(lo, -1000)) < q.g - coalesce(lo, -1000) - 1 THEN 0 ELSE min(m.density) FILTER (m.g < q.g AND m.g > coalesce(lo, -1000)) END, 0) AS left_low,
        coalesce(CASE WHEN count(*) FILTER (m.g > q.g AND m.g < coalesce(hi, 1000)) < coalesce(hi, 1000) - q.g - 1 THEN 0 ELSE min(m.density) FILTER (m.g > q.g AND m.g < coalesce(hi, 1000)) END, 0) AS right_low
      FROM q JOIN w m ON m.image_id = q.image_id AND m.veg = q.veg GROUP BY q.image_id, q.g, q.density, q.lo, q.hi),
r AS (SELECT image_id, max(g) FILTER (density - greatest(left_low, right_low) >= {PROMINENCE}) AS bare, min(g) FILTER (density - greatest(left_low, right_low) >= {PROMINENCE}) AS lowest FROM b GROUP BY image_id),
v AS (SELECT image_id, arg_min(g, (-density, g)) AS veg FROM k WHERE veg GROUP BY image_id)
SELECT v.image_id, veg / 100 AS veg_peak, CASE WHEN lowest < 0 THEN bare ELSE lowest END / 100 AS bare_peak,
  round(0.2 * veg / 100 + 0.8 * CASE WHEN lowest < 0 THEN bare ELSE lowest END / 100, 6) AS threshold FROM v JOIN r USING (image_id) WHERE bare IS NOT NULL""", "v_pixel"))
def weighted_peaks(spark, sf_dir):
    """Threshold of each image from the peaks of two classes' densities, weighted 0.2 (vegetation) and 0.8 (bare ground).

    Vegetation has its highest point. Of bare ground's peaks of enough prominence the rightmost counts if one is below zero, else the leftmost.
    """
    p = T.pixel(spark, sf_dir).select("image_id", (F.col("a") > 0.1).alias("veg"), F.least(F.greatest(F.col("a") - F.col("b"), F.lit(-0.95)), F.lit(0.95)).alias("x"))
    at = F.floor(F.col("x") * 100)
    spread = p.select("image_id", "veg", "x", F.explode(F.sequence(at - 8, at + 9)).alias("g"))
    part = F.exp(-0.5 * F.pow((F.col("g") / 100 - F.col("x")) / BANDWIDTH, 2))
    n = p.groupBy("image_id", "veg").agg(F.count(F.lit(1)).alias("n"))
    k = spread.groupBy("image_id", "veg", "g").agg(F.sum(part).alias("s")).join(n, ["image_id", "veg"])
    k = k.select("image_id", "veg", "g", F.round(F.col("s") / F.col("n") / (BANDWIDTH * math.sqrt(2 * math.pi)), 9).alias("density"))
    veg = k.where("veg").groupBy("image_id").agg(F.min_by("g", F.struct(-F.col("density"), "g")).alias("veg"))
    # a density is a grid of under 200 points: peaks and their bases are found inside one row
    line = k.where("not veg").groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("g", "density"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(-110), F.lit(110)), lambda g: F.coalesce(F.try_element_at("m", g.cast("long")), F.lit(0.0)))
    line = line.select("image_id", F.explode(F.array(grid)).alias("d"))  # made once a row, however often the lambdas below read it
    side = "aggregate({part}, named_struct('low', d[i], 'on', true), (s, y) -> if(s.on and y <= d[i], named_struct('low', least(s.low, y), 'on', true), named_struct('low', s.low, 'on', false))).low"
    left, right = side.format(part="reverse(slice(d, 1, i))"), side.format(part="slice(d, i + 2, size(d))")
    peaks = F.expr(f"filter(sequence(1, size(d) - 2), i -> d[i] > d[i - 1] and d[i] > d[i + 1] and d[i] - greatest({left}, {right}) >= {PROMINENCE})")
    found = line.select("image_id", F.transform(peaks, lambda i: i - 110).alias("g")).where("size(g) > 0")
    bare = F.when(F.array_min("g") < 0, F.array_max("g")).otherwise(F.array_min("g"))
    out = veg.join(found, "image_id").withColumn("bare", bare)
    return out.select("image_id", (F.col("veg") / 100).alias("veg_peak"), (F.col("bare") / 100).alias("bare_peak"), F.round(0.2 * F.col("veg") / 100 + 0.8 * F.col("bare") / 100, 6).alias("threshold"))


@register(T.sql(f""", o AS (SELECT event_id, cell_id * 36 + 18 AS shore, dir, tp, CASE WHEN dir > cell_id * 36 + 18 AND dir < cell_id * 36 + 198 THEN 0 ELSE hs END AS h0 FROM v_wave),
d AS (SELECT *, unnest(range(0, floor(h0 * 30)::BIGINT + 1)) AS k, {GRAVITY} * tp * tp / (2 * pi()) AS l0, radians(CASE WHEN shore < 90 THEN shore + 270 - dir ELSE shore - 90 - dir END) AS theta0 FROM o),
l AS (SELECT *, 3 * h0 - k / 10 AS h, l0 * tanh((4 * pi() * pi() * (3 * h0 - k / 10) / (tp * tp * {GRAVITY})) ** 0.75) ** (2.0 / 3) AS l FROM d WHERE 3 * h0 - k / 10 > 0.001),
c AS (SELECT *, tanh(2 * pi() * h / l) AS c, (4 * pi() * h / l / sinh(4 * pi() * h / l) + 1) / 2 AS n FROM l),
s AS (SELECT *, asin(c * sin(theta0)) AS theta, h0 * sqrt(1 / (2 * n * c)) * sqrt(abs(cos(theta0) / cos(asin(c * sin(theta0))))) AS near FROM c),
b AS (SELECT event_id, min(k) AS k, arg_min(near, k) AS near, arg_min(theta, k) AS theta FROM s WHERE near > 0.78 * h GROUP BY event_id)
SELECT o.event_id, round(CASE WHEN b.k IS NULL THEN 0 ELSE near END, 5) AS height, round(3 * h0 - b.k / 10, 5) AS depth, round(degrees(theta), 4) AS angle FROM o LEFT JOIN b USING (event_id)""", "v_wave"))
def nearshore_waves(spark, sf_dir):
    """Waves carried from deep water to where they break: shoaling and refraction at depths falling by 0.1 m from three times their height.

    Waves that run offshore, and those that don't break, have height 0. One row a wave; depths are tried inside the row.
    """
    w = T.wave(spark, sf_dir)
    shore = F.col("cell_id") * 36 + 18
    away = (F.col("dir") > shore) & (F.col("dir") < shore + 180)
    theta0 = F.radians(F.when(shore < 90, shore + 270 - F.col("dir")).otherwise(shore - 90 - F.col("dir")))
    o = w.select("event_id", "tp", F.when(away, 0.0).otherwise(F.col("hs")).alias("h0"), theta0.alias("theta0"))
    length0 = GRAVITY * F.col("tp") * F.col("tp") / (2 * math.pi)

    def at(k):
        h = 3 * F.col("h0") - k / 10
        length = length0 * F.pow(F.tanh(F.pow(4 * math.pi * math.pi * h / (F.col("tp") * F.col("tp") * GRAVITY), F.lit(0.75))), F.lit(2.0 / 3))
        speed = F.tanh(2 * math.pi * h / length)
        kh = 4 * math.pi * h / length
        group = (kh / F.sinh(kh) + 1) / 2
        theta = F.asin(speed * F.sin("theta0"))
        near = F.col("h0") * F.sqrt(1 / (2 * group * speed)) * F.sqrt(F.abs(F.cos("theta0") / F.cos(theta)))
        return F.struct(h.alias("h"), near.alias("near"), theta.alias("theta"))

    steps = F.filter(F.sequence(F.lit(0).cast("long"), F.floor(F.col("h0") * 30)), lambda k: 3 * F.col("h0") - k / 10 > 0.001)
    broken = F.get(F.filter(F.transform(steps, at), lambda s: s["near"] > 0.78 * s["h"]), F.lit(0))
    out = o.select("event_id", broken.alias("b"))
    return out.select("event_id", F.round(F.coalesce("b.near", F.lit(0.0)), 5).alias("height"), F.round("b.h", 5).alias("depth"), F.round(F.degrees("b.theta"), 4).alias("angle"))


@register(T.sql(""", q AS MATERIALIZED (SELECT * FROM v_pixel),
c AS (SELECT image_id, "row", col, a, b, coalesce(lag(a) OVER w, a) AS a0, coalesce(lead(a) OVER w, a) AS a2, coalesce(lag(b) OVER w, b) AS b0, coalesce(lead(b) OVER w, b) AS b2 FROM q WINDOW w AS (PARTITION BY image_id, "row" ORDER BY col)),
d AS (SELECT *, a0 + a + a2 AS sa, a0 * a0 + a * a + a2 * a2 AS qa, b0 + b + b2 AS sb, b0 * b0 + b * b + b2 * b2 AS qb FROM c),
e AS (SELECT *, coalesce(lag(sa) OVER w, sa) + sa + coalesce(lead(sa) OVER w, sa) AS ta, coalesce(lag(qa) OVER w, qa) + qa + coalesce(lead(qa) OVER w, qa) AS ua,
  coalesce(lag(sb) OVER w, sb) + sb + coalesce(lead(sb) OVER w, sb) AS tb, coalesce(lag(qb) OVER w, qb) + qb + coalesce(lead(qb) OVER w, qb) AS ub FROM d WINDOW w AS (PARTITION BY image_id, col ORDER BY "row"))
SELECT image_id, "row", col, round(a, 6) AS f0, round(b, 6) AS f1, round(a - b, 6) AS f2, round((a - b) / (abs(a) + abs(b) + 0.5) * 1.5, 6) AS f3,
  round((a - b) / nullif(abs(a) + abs(b), 0), 5) AS f4, round(sqrt(greatest(ua / 9 - (ta / 9) ** 2, 0)), 6) AS f5, round(sqrt(greatest(ub / 9 - (tb / 9) ** 2, 0)), 6) AS f6 FROM e""", "v_pixel"))
def feature_vectors(spark, sf_dir):
    """Features of each pixel: both bands, their difference, two indices, and both bands' neighbourhood deviations."""
    place = ["image_id", "row", "col"]
    v = box_deviations(T.pixel(spark, sf_dir), ["a", "b"])
    a, b = F.col("a"), F.col("b")
    size = F.abs(a) + F.abs(b)
    features = [F.round(a, 6), F.round(b, 6), F.round(a - b, 6), F.round((a - b) / (size + 0.5) * 1.5, 6), F.round(F.try_divide(a - b, F.nullif(size, F.lit(0))), 5), F.round("sa", 6), F.round("sb", 6)]
    return v.select(*place, *[f.alias(f"f{k}") for k, f in enumerate(features)])


#: Costs of a missed event and of a false alarm, and the level that counts as one.
MISSED, FALSE_ALARM = 100, 1


@register(T.sql(f""", p AS (SELECT transect_id, y, lag(y) OVER (PARTITION BY transect_id ORDER BY day) AS guess FROM v_daily),
s AS (SELECT transect_id, count(*) AS n, sqrt(avg((y - guess) ** 2)) AS rmse, stddev_pop(y) AS so, stddev_pop(guess) AS sp, corr(y, guess) AS r,
        avg(CASE WHEN y > 50 AND guess <= 50 THEN {MISSED} WHEN y <= 50 AND guess > 50 THEN {FALSE_ALARM} ELSE 0 END) AS cost FROM p WHERE guess IS NOT NULL GROUP BY transect_id)
SELECT transect_id, n, round(sqrt((rmse / so) ** 2 + (1 - r) ** 2 + (1 - sp / so) ** 2), 5) AS skill_loss, round(cost, 6) AS cost FROM s WHERE n > 2""", "v_daily"))
def skill_losses(spark, sf_dir):
    """Losses of guessing each row by the one before: error, correlation and spread as one distance; and the mean cost of missed events and false alarms."""
    guess = F.lag("y").over(Window.partitionBy("transect_id").orderBy("day"))
    p = T.daily(spark, sf_dir).select("transect_id", "y", guess.alias("guess")).where("guess is not null")
    error = F.col("y") - F.col("guess")
    cost = F.when((F.col("y") > 50) & (F.col("guess") <= 50), MISSED).when((F.col("y") <= 50) & (F.col("guess") > 50), FALSE_ALARM).otherwise(0)
    s = p.groupBy("transect_id").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.stddev_pop("y").alias("so"), F.stddev_pop("guess").alias("sp"),
        F.corr("y", "guess").alias("r"), F.avg(cost).alias("cost"),
    )
    loss = F.sqrt(F.pow(F.col("rmse") / F.col("so"), 2) + F.pow(1 - F.col("r"), 2) + F.pow(1 - F.col("sp") / F.col("so"), 2))
    return s.where("n > 2").select("transect_id", "n", F.round(loss, 5).alias("skill_loss"), F.round("cost", 6).alias("cost"))


@register(T.sql(""", f AS (SELECT cell_id, t::DATE AS day, avg(hs) AS hs, avg(tp) AS tp, avg(sin(radians(dir))) AS s, avg(cos(radians(dir))) AS c, count(*) AS n
  FROM v_wave WHERE t >= (SELECT max(t) - INTERVAL 10 DAY FROM v_wave) GROUP BY ALL)
SELECT transect_id, day, n, round(hs, 6) AS hs, round(tp, 6) AS tp, round(sqrt(s * s + c * c), 5) AS steadiness FROM v_transect JOIN f ON cell_id = transect_id % 10""", "v_wave", "v_transect"))
def future_waves(spark, sf_dir):
    """Wave features of the forecast period (the last ten days) for each transect, from its grid cell: daily means and steadiness of direction."""
    w = T.wave(spark, sf_dir)
    last = w.agg((F.max("t") - F.expr("interval 10 days")).alias("since"))
    ahead = w.join(F.broadcast(last)).where("t >= since")  # one row
    mean = lambda f: F.avg(f(F.radians("dir")))
    f = ahead.groupBy("cell_id", F.to_date("t").alias("day")).agg(F.avg("hs").alias("hs"), F.avg("tp").alias("tp"), mean(F.sin).alias("s"), mean(F.cos).alias("c"), F.count(F.lit(1)).alias("n"))
    t = T.transect(spark, sf_dir).select("transect_id", (F.col("transect_id") % 10).alias("cell_id"))
    return t.join(f, "cell_id").select("transect_id", "day", "n", F.round("hs", 6).alias("hs"), F.round("tp", 6).alias("tp"), F.round(F.hypot("s", "c"), 5).alias("steadiness"))


@register()
def cliffs(spark, sf_dir):
    """Toe and top of each transect's profile, and whether they make a cliff."""
    return morphology.cliffs(T.profile(spark, sf_dir), "transect_id", "seq", "z")


@register("WITH RECURSIVE" + T.sql(""", p AS MATERIALIZED (SELECT a.transect_id AS id, b.transect_id AS other, sqrt((a.x1 - a.x0) * (a.x1 - a.x0) + (a.y1 - a.y0) * (a.y1 - a.y0)) AS len FROM v_transect a JOIN v_transect b ON a.transect_id <> b.transect_id
  AND greatest(a.x0, a.x1) >= least(b.x0, b.x1) AND least(a.x0, a.x1) <= greatest(b.x0, b.x1) AND greatest(a.y0, a.y1) >= least(b.y0, b.y1) AND least(a.y0, a.y1) <= greatest(b.y0, b.y1)
  AND ((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) * ((a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0)) <= 0
  AND ((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) * ((b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0)) <= 0),
c AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY any_value(len), id) AS r, list(other) AS others FROM p GROUP BY id),
walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT c.r, CASE WHEN list_has_any(w.kept, c.others) THEN w.kept ELSE list_append(w.kept, c.id) END FROM walk w JOIN c ON c.r = w.r + 1)
SELECT transect_id FROM v_transect WHERE transect_id NOT IN (SELECT id FROM c) OR transect_id IN (SELECT unnest(kept) FROM walk WHERE r = (SELECT count(*) FROM c))""", "v_transect").removeprefix("WITH"))
def uncrossed_transects(spark, sf_dir):
    """Transects that are left when, of those that cross, the shortest stay."""
    return morphology.uncrossed(T.transect(spark, sf_dir)).select("transect_id")
