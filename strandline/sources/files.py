"""Readers and writers of coastal files: GeoJSON lines, KML areas, tide, wave, storm and catalogue tables, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURES = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_lines(spark: SparkSession, path: str, id_property: str = "id", min_length: float = 0.0) -> DataFrame:
    """Vertices (line_id, part, seq, x, y) of the lines of GeoJSON files, multi-part lines taken apart; shorter parts are dropped."""
    f = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _FEATURES)["features"]).alias("f"))
    f = f.select(F.col("f.properties")[id_property].alias("line_id"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    single = F.array(F.from_json("c", "array<array<double>>"))
    f = f.where(F.col("kind").isin("LineString", "MultiLineString")).withColumn("parts", F.when(F.col("kind") == "LineString", single).otherwise(F.from_json("c", "array<array<array<double>>>")))
    p = f.select("line_id", F.posexplode("parts").alias("part", "points"))
    steps = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: F.hypot(b[0] - a[0], b[1] - a[1]))
    length = F.when(F.size("points") > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    p = p.where(length >= min_length)
    return p.select("line_id", "part", F.posexplode("points").alias("seq", "p")).select("line_id", F.col("part").cast("long").alias("part"), F.col("seq").cast("long").alias("seq"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def write_lines(vertices: DataFrame, path: str) -> None:
    """One JSON feature a line, its vertices in order of seq; a folder of such files is read by line."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    v = vertices.groupBy("line_id").agg(points.alias("points"))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("id"), F.col("line_id").cast("string")).alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("points").alias("coordinates")).alias("geometry"))
    v.select(F.to_json(feature).alias("value")).write.text(path)


def read_line_rows(spark: SparkSession, path: str, id_property: str = "id") -> DataFrame:
    """Vertices (line_id, seq, x, y) of a folder that write_lines made: one feature a row of text."""
    kind = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<double>>>>"
    f = spark.read.text(path).select(F.from_json("value", kind).alias("f"))
    p = f.select(F.col("f.properties")[id_property].alias("line_id"), F.posexplode("f.geometry.coordinates").alias("seq", "p"))
    return p.select("line_id", F.col("seq").cast("long").alias("seq"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def write_points(points: DataFrame, path: str, x: str = "x", y: str = "y", z: str | None = None) -> None:
    """One JSON feature a point; all other columns are its properties."""
    place = F.array(*[F.col(c).cast("double") for c in (x, y, z) if c])
    rest = [c for c in points.columns if c not in (x, y, z)]
    properties = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c).cast("string") for c in rest]))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Point").alias("type"), place.alias("coordinates")).alias("geometry"))
    points.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_points(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Points (x, y, z or null, and named properties as text) of a folder that write_points made."""
    kind = "struct<properties: map<string, string>, geometry: struct<coordinates: array<double>>>"
    f = spark.read.text(path).select(F.from_json("value", kind).alias("f"))
    c = F.col("f.geometry.coordinates")
    return f.select(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"), F.get(c, F.lit(2)).alias("z"), *[F.col("f.properties")[p].alias(p) for p in properties])


def write_labels(pixels: DataFrame, path: str) -> None:
    """Labelled pixels (site, class name, features): a folder for each site and class."""
    pixels.write.partitionBy("site", "class").parquet(path)


def read_labels(spark: SparkSession, path: str, classes: dict[str, int], sites: list | None = None, missing: float = 1e-9) -> DataFrame:
    """Labelled pixels of the wanted sites and classes with the class's number as label.

    Rows without any feature are dropped; a single feature that is missing or not a number becomes a very small one. Only the folders
    of wanted sites and classes are read.
    """
    p = spark.read.parquet(path).where(F.col("class").isin(list(classes)))
    p = p.where(F.col("site").isin(sites)) if sites is not None else p
    features = [c for c in p.columns if c not in ("site", "class") and dict(p.dtypes)[c] == "double"]
    some = F.greatest(*[F.nanvl(c, F.lit(None)).isNotNull().cast("int") for c in features]) == 1
    number = F.create_map(*[F.lit(v) for pair in classes.items() for v in pair])
    return p.where(some).withColumns({c: F.coalesce(F.nanvl(c, F.lit(None)), F.lit(missing)) for c in features} | {"label": number[F.col("class")]})


def read_area(spark: SparkSession, path: str) -> DataFrame:
    """Vertices (seq, lon, lat) of the first block of coordinates in KML files."""
    text = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_extract("value", r"<coordinates>\s*([^<]*?)\s*</coordinates>", 1)).alias("c"))
    p = text.where("c <> ''").select(F.posexplode(F.split("c", r"\s+")).alias("seq", "p"))
    return p.select(F.col("seq").cast("long").alias("seq"), F.split("p", ",")[0].cast("double").alias("lon"), F.split("p", ",")[1].cast("double").alias("lat"))


def bounds(points: DataFrame, x: str, y: str, by: list[str] | None = None, margin: float = 0.0) -> DataFrame:
    """Smallest axis-parallel rectangle of points, grown by a margin."""
    return points.groupBy(*(by or [])).agg((F.min(x) - margin).alias("x0"), (F.min(y) - margin).alias("y0"), (F.max(x) + margin).alias("x1"), (F.max(y) + margin).alias("y1"))


def read_tides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("date timestamp, tide double").csv(path, header=True)


def wave_time(value: Column, hours_since_1950: bool) -> Column:
    """Time of a wave sample: seconds since 1970 or hours since 1950, by institution."""
    return F.timestamp_seconds(value * 3600 - 631152000) if hours_since_1950 else F.timestamp_seconds(value)


def read_storms(spark: SparkSession, path: str) -> DataFrame:
    """Storm catalogue with its row numbers as they stand in order of start and name."""
    s = spark.read.schema("Name string, Start string, End string, WindGust int").csv(path, header=True)
    day = lambda c: F.to_date(c, "dd/MM/yyyy")
    return s.select(F.col("Name").alias("name"), day("Start").alias("start"), day("End").alias("end"), F.col("WindGust").alias("gust"), F.datediff(day("End"), day("Start")).alias("days"))


def catalogue(images: DataFrame, default_accuracy: float = 12.0) -> DataFrame:
    """Image catalogue: date from the first eight characters of a file's name, a default where accuracy is missing."""
    return images.withColumns({"acq_date": F.to_date(F.substring("file", 1, 8), "yyyyMMdd"), "acc_georef": F.coalesce(F.col("acc_georef").cast("double"), F.lit(default_accuracy))})


def cells(raster: DataFrame, nodata: float, place: DataFrame | None = None) -> DataFrame:
    """Raster cells (raster_id, row, col, v) with nodata as null; with the middle x, y of each where rasters' places (raster_id, x0, dx, y0, dy) are given."""
    out = raster.withColumn("v", F.when(F.col("v") != nodata, F.col("v")))
    if place is None:
        return out
    middle = lambda o, k, d: (F.col(o) + (F.col(k) + 0.5) * F.col(d))
    return out.join(place, "raster_id").withColumns({"x": middle("x0", "col", "dx"), "y": middle("y0", "row", "dy")}).drop("x0", "dx", "y0", "dy")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A folder of CSV files (step, value) as one column per run; runs are named by their files."""
    r = spark.read.schema("step int, value double").csv(path, header=True).withColumn("run", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    return r.groupBy("step").pivot("run").agg(F.first("value"))


def rounded_lists(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Elements of list columns rounded."""
    to = lambda d: lambda x: F.round(x, d)
    return df.withColumns({c: F.transform(c, to(d)) for c, d in digits.items()})


def write_results(df: DataFrame, path: str, by: str, lists: dict[str, int]) -> None:
    """Results with rounded lists as JSON text, a folder for each value of ``by``; a later run replaces only the folders it writes."""
    out = rounded_lists(df, lists).withColumns({c: F.to_json(c) for c in lists})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def between_lines(lines: DataFrame, first: str, second: str) -> DataFrame:
    """Rings between two kinds of line of a run (run, kind, points): the first line, then the second reversed; with their area."""
    side = lambda kind, name: lines.where(F.col("kind") == kind).select("run", F.col("points").alias(name))
    j = side(first, "a").join(side(second, "b"), "run")
    ring = F.concat("a", F.reverse("b"), F.slice("a", 1, 1))
    shoelace = F.aggregate(F.sequence(F.lit(1), F.size("ring") - 1), F.lit(0.0), lambda s, k: s + F.get("ring", k - 1)["x"] * F.get("ring", k)["y"] - F.get("ring", k)["x"] * F.get("ring", k - 1)["y"])
    return j.select("run", ring.alias("ring")).select("run", "ring", (F.abs(shoelace) / 2).alias("area"))


def per_transect_matrix(df: DataFrame, row: str, transect: str, value: str, transects: list[int]) -> DataFrame:
    """A column for each of the named transects."""
    return df.groupBy(row).pivot(transect, transects).agg(F.first(value))


def unprocessed(catalogue_rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no earlier run has finished."""
    return catalogue_rows.join(done.select(*keys).distinct(), keys, "left_anti")
