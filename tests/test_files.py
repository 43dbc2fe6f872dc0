"""Round trips of files."""

from datetime import date

from pyspark.sql import functions as F

from strandline.sources import files


def test_geojson_round_trip(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"a"},"geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]}},{"type":"Feature","properties":{"id":"b"},"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,0]],[[5,5],[5,9],[9,9]]]}}]}')
    v = files.read_lines(spark, str(tmp_path / "in.json"), min_length=2)
    assert sorted(map(tuple, v.collect())) == [("a", 0, 0, 0.0, 0.0), ("a", 0, 1, 3.0, 4.0), ("b", 1, 0, 5.0, 5.0), ("b", 1, 1, 5.0, 9.0), ("b", 1, 2, 9.0, 9.0)]
    files.write_lines(v.drop("part"), str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).select(F.concat(F.lit('{"features":['), "value", F.lit("]}")).alias("value"))
    text.coalesce(1).write.text(str(tmp_path / "again"))
    assert '"LineString","coordinates":[[5.0,5.0],[5.0,9.0],[9.0,9.0]]' in "".join(r.value for r in text.collect())


def test_kml_and_bounds(spark, tmp_path):
    (tmp_path / "a.kml").write_text("<kml><coordinates> -3.1,56.0,0 -3.0,56.2,0\n-2.9,55.9,0 </coordinates><coordinates>9,9</coordinates></kml>")
    p = files.read_area(spark, str(tmp_path / "a.kml"))
    assert [tuple(r) for r in p.orderBy("seq").collect()] == [(0, -3.1, 56.0), (1, -3.0, 56.2), (2, -2.9, 55.9)]
    assert tuple(files.bounds(p, "lon", "lat").first()) == (-3.1, 55.9, -2.9, 56.2)


def test_storms_catalogue_and_runs(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Name,Start,End,WindGust\nAda,01/02/2020,03/02/2020,99\n")
    assert tuple(files.read_storms(spark, str(tmp_path / "s.csv")).first()) == ("Ada", date(2020, 2, 1), date(2020, 2, 3), 99, 2)
    c = files.catalogue(spark.createDataFrame([("20210304_x.tif", None), ("20210305_y.tif", 4.0)], "file string, acc_georef double"))
    assert [(r.acq_date, r.acc_georef) for r in c.orderBy("file").collect()] == [(date(2021, 3, 4), 12.0), (date(2021, 3, 5), 4.0)]
    (tmp_path / "runs").mkdir()
    for name, v in (("r1", 0.5), ("r2", 0.7)):
        (tmp_path / "runs" / f"{name}.csv").write_text(f"step,value\n1,{v}\n")
    assert files.read_runs(spark, str(tmp_path / "runs")).first().asDict() == {"step": 1, "r1": 0.5, "r2": 0.7}


def test_wave_times(spark):
    r = spark.range(1).select(files.wave_time(F.lit(0), False).cast("long").alias("a"), files.wave_time(F.lit(24), True).cast("string").alias("b")).first()
    assert r.a == 0 and r.b.startswith("1950-01-02")


def test_results_replace_only_their_own_folder(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda rows: spark.createDataFrame(rows, "site string, id int, d array<double>")
    files.write_results(frame([("a", 1, [1.234]), ("b", 2, [2.0])]), path, "site", {"d": 2})
    files.write_results(frame([("a", 3, [5.0])]), path, "site", {"d": 2})
    assert sorted((r.site, r.id, r.d) for r in spark.read.parquet(path).collect()) == [("a", 3, "[5.0]"), ("b", 2, "[2.0]")]


def test_ring_between_lines(spark):
    rows = [(1, "old", [(0.0, 0.0), (10.0, 0.0)]), (1, "new", [(0.0, 2.0), (10.0, 2.0)])]
    df = spark.createDataFrame(rows, "run int, kind string, points array<struct<x: double, y: double>>")
    r = files.between_lines(df, "old", "new").first()
    assert r.area == 20.0 and len(r.ring) == 5
    assert files.unprocessed(df, df.where("kind = 'old'"), ["run", "kind"]).count() == 1
