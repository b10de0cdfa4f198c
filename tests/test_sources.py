"""Readers and writers on files, tiled layouts and files read in byte ranges."""

import json
import pathlib

import pandas as pd
import pytest
from oracle import SF
from pyspark.sql import functions as F

from terrastock.functions import geo
from terrastock.operators import detection
from terrastock.plans import views
from terrastock.sources import readers, tiles, writers
from terrastock.streaming import drops


def square(x, y, h=0.5):
    return [[x - h, y - h], [x + h, y - h], [x + h, y + h], [x - h, y + h], [x - h, y - h]]


def write(path, features, **layout):
    path.write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name"}, "features": features}, **layout))
    return str(path)


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


@pytest.mark.parametrize("layout", [{}, {"indent": 1}, {"separators": (",", ":")}])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, layout):
    made = [feature("Polygon", [square(k, 0)], id=k, note='a {brace} and "quotes"', h=None if k % 3 else k / 2) for k in range(500)]
    path = write(tmp_path / "f.geojson", made, **layout)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = readers.read_footprints(spark, path, {"id": "id", "note": "name", "h": "height"})
        rows = got.select("*", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r["p"] for r in rows}) > 4
    whole = readers.read_footprints(spark, path, {"id": "id", "note": "name", "h": "height"}, split=False).collect()
    assert sorted(map(str, whole)) == sorted(str(r).replace(f", p={r['p']})", ")") for r in rows) and len(whole) == 500


def test_no_feature_is_lost_unseen(spark, tmp_path):
    late = [{"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}, "type": "Feature"}] * 3
    path = write(tmp_path / "late.geojson", late)
    with pytest.raises(Exception, match="read the file whole"):
        readers.read_features(spark, path).collect()
    assert readers.read_features(spark, path, split=False).count() == 3
    word = write(tmp_path / "word.geojson", [feature("Point", [1, 2], sort="Feature")])
    with pytest.raises(Exception, match="read the file whole"):
        readers.read_features(spark, word).collect()


def test_points_nesting_and_what_is_left_out(spark, tmp_path):
    path = write(tmp_path / "p.geojson", [feature("Point", [k, 2.5], n=k) for k in range(3)])
    assert sorted((r["lon"], r["lat"], r["m"]) for r in readers.read_point_features(spark, path, {"n": "m"}).collect()) == [(0.0, 2.5, "0"), (1.0, 2.5, "1"), (2.0, 2.5, "2")]
    mixed = write(tmp_path / "m.geojson", [feature("Point", [0, 0]), feature("MultiPolygon", [[square(0, 0)]]), {"type": "Feature", "properties": {}, "geometry": None}])
    with pytest.raises(Exception, match="not a point"):
        readers.read_point_features(spark, mixed).collect()
    assert [tuple(r) for r in readers.left_out(readers.read_features(spark, mixed)).collect()] == [("MultiPolygon", 1)]
    texts = [json.dumps(c) for c in (square(1, 1), [square(1, 1), square(0, 0)[:4]], [[square(2, 2), [[0, 0]]]])]
    got = [r["r"] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(readers.outer_ring(F.col("c")).alias("r")).collect()]
    assert [r[0]["lon"] for r in got] == [0.5, 0.5, 1.5] and [len(r) for r in got] == [5, 5, 5]


@pytest.fixture(scope="module")
def tiled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiles"))
    fps = views.footprints(spark, SF).select("bldg_id", "ring").unionByName(spark.createDataFrame([(9001, [(x, y) for x, y in square(10, 10, 0.01)])], "bldg_id int, ring array<struct<lon:double,lat:double>>"))
    tiles.write_tiles(fps, path, parts=2)
    return path, fps


@pytest.mark.parametrize("area", [(-122.4, 37.6, -122.3, 37.7), [(-122.45, 37.55), (-122.05, 37.6), (-122.3, 37.8)], (9.0, 9.0, 11.0, 11.0), (50.0, 50.0, 50.1, 50.1)])
def test_reading_an_area_opens_its_tiles_only(spark, tiled, area):
    path, fps = tiled
    got = tiles.read_area(spark, path, area)
    plan = got._jdf.queryExecution().explainString(got._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) if hasattr(got, "_jvm") else got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "dynamicpruning" in plan and "PushedFilters: [IsNotNull(min_lon)" in plan
    box = not isinstance(area[0], tuple)
    x0, y0, x1, y1 = area if box else (min(x for x, _ in area), min(y for _, y in area), max(x for x, _ in area), max(y for _, y in area))
    b = geo.ring_bbox(F.col("ring"))
    near = fps.where((b["min_lon"] <= x1) & (b["max_lon"] >= x0) & (b["min_lat"] <= y1) & (b["max_lat"] >= y0))
    if not box:
        near = near.where(geo.rings_intersect(F.col("ring"), F.array(*(geo.point(F.lit(x), F.lit(y)) for x, y in [*area, area[0]]))))
    assert sorted(r["bldg_id"] for r in got.collect()) == sorted(r["bldg_id"] for r in near.collect())


def test_pruned_folders_are_not_read(spark, tiled):
    path, _ = tiled
    got = tiles.read_area(spark, path, (9.5, 9.5, 10.5, 10.5))
    assert [r["bldg_id"] for r in got.collect()] == [9001]
    folders = {f.parent.name for f in pathlib.Path(path).glob("*/*.parquet")}
    read = {r["f"].split("/")[-2] for r in spark.read.parquet(path).join(tiles.tiles_of_area(spark, (9.5, 9.5, 10.5, 10.5)).where("quadkey >= 0"), "quadkey", "left_semi").select(F.input_file_name().alias("f")).collect()}
    assert len(folders) > 1 and len(read) == 1


def test_linked_tiles_take_the_largest_file(spark, tiled):
    path, _ = tiled
    key = tiles.tiles_of_area(spark, (10, 10, 10, 10)).first()["quadkey"]
    links = spark.createDataFrame([(key, "small", "10KB"), (key, "large", "1.5MB"), (key + 1, "other", "1GB")], "quadkey long, url string, size string")
    assert [(r["bldg_id"], r["url"]) for r in tiles.read_linked_tiles(spark, path, links, (9.9, 9.9, 10.1, 10.1)).collect()] == [(9001, "large")]


def test_layers_without_rows_are_not_written(spark, tmp_path):
    ring = F.array(*(geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in square(0, 0)))
    df = spark.range(3).withColumn("ring", ring)
    many = F.array(F.array(ring), F.array(ring, ring))
    layers = {"one": (df, writers.ring_geometry(), "Polygon"), "none": (df.limit(0), writers.ring_geometry(), "Polygon"), "many": (df.coalesce(1), writers.multi_polygon_json(many), "MultiPolygon")}
    assert writers.write_layers(layers, str(tmp_path)) == ["one", "many"]
    assert not (tmp_path / "none").exists()
    read = [json.loads(f.read_text()) for f in (tmp_path / "many").glob("part-*") if f.stat().st_size]
    assert [x["geometry"]["coordinates"] for c in read for x in c["features"]] == [[[square(0, 0)], [square(0, 0), square(0, 0)]]] * 3
    assert readers.read_footprints(spark, str(tmp_path / "one")).count() == 3  # written files are read in byte ranges again


def test_lines_points_graphs_and_predictions_are_written(spark, tmp_path):
    line = F.array(geo.point(F.lit(1.0), F.lit(2.0)), geo.point(F.lit(3.0), F.lit(4.5)))
    writers.write_lines(spark.range(2).withColumn("line", line), str(tmp_path / "lines"), ["id"])
    got = sorted((json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "lines")).collect()), key=lambda f: f["properties"]["id"])
    assert got[1] == feature("LineString", [[1.0, 2.0], [3.0, 4.5]], id=1)
    writers.write_points(spark.range(1).selectExpr("id", "1.25D as lon", "2.5D as lat"), str(tmp_path / "points"), ["id"])
    assert json.loads(spark.read.text(str(tmp_path / "points")).first()["value"])["geometry"] == {"type": "Point", "coordinates": [1.25, 2.5]}
    writers.write_graph(spark.sql("select 1 as node_id, 'POINT (1 2)' as geometry"), spark.sql("select 7 as uniqueid, 'LINESTRING (1 2, 3 4)' as geometry"), str(tmp_path / "graph"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "graph/edges")).collect()] == ["uniqueid, geometry", '7, "LINESTRING (1 2, 3 4)"']
    writers.write_predictions(spark.sql("select 'a' as image, 'flat' as prediction, 0.5 as probability, 1 as more"), str(tmp_path / "pred"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "pred")).collect()] == [("a", "flat", "0.5")]


def test_lists_annotations_and_labelled_images(spark, tmp_path):
    (tmp_path / "tall.csv").write_text("Latitude,Longitude,Nfloors,BldgHeight,ConsYear\n1.5,2.5,30,400.5,1999\nbad,2,3,4,5\n")
    assert [tuple(r) for r in readers.read_tall_buildings(spark, str(tmp_path / "tall.csv")).collect()] == [(1.5, 2.5, 30, 400.5, 1999)]
    (tmp_path / "list.csv").write_text("BldgUniqueID,CentroidX,CentroidY,StructureUse\nA1,1.5,2.5,RES1\n")
    assert tuple(readers.read_download_list(spark, str(tmp_path / "list.csv")).first()) == ("A1", 1.5, 2.5, "RES1")
    (tmp_path / "coco.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.png"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "area": 9.0, "iscrowd": 0, "bbox": [1, 2, 3, 3]}], "categories": [{"id": 2, "name": "floor", "supercategory": "part"}]}, indent=1))
    images, annotations, categories = readers.read_annotations(spark, str(tmp_path / "coco.json"))
    assert (images.first()["file_name"], annotations.first()["bbox"], categories.first()["supercategory"]) == ("a.png", [1.0, 2.0, 3.0, 3.0], "part")
    for name in ("flat/a.png", "gabled/b.JPG", "gabled/c.txt"):
        (tmp_path / "img" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / name).write_bytes(b"x")
    assert sorted(r["label"] for r in readers.labelled_images(spark, str(tmp_path / "img")).collect()) == ["flat", "gabled"]


def test_tags_of_map_elements(spark):
    rows = [({"start_date": "~1987-05", "height": "10 m", "building:levels": "3", "roof:levels": "1"},), ({"year_of_construction": "20", "building:levels": "x"},), ({"building:height": "3.04"},)]
    df = spark.createDataFrame(rows, "tags map<string,string>")
    got = [tuple(r) for r in df.select(*(c.alias(k) for k, c in readers.osm_attributes(F.col("tags")).items())).collect()]
    assert got == [(1987, 32.8, 4), (None, None, None), (None, 10.0, None)]


def test_predictions_come_from_a_model_outside(spark):
    class Longest:
        def predict(self, images):
            for b in images:
                yield pd.DataFrame({"image": b["image"], "prediction": [str(len(x)) for x in b["image"]], "probability": 0.5})

    got = detection.predict(spark.createDataFrame([("a",), ("abc",)], "image string"), Longest).collect()
    assert sorted((r["image"], r["prediction"]) for r in got) == [("a", "1"), ("abc", "3")]


def test_dropped_files_are_a_stream(spark, tmp_path):
    """Files that arrive between two runs of the stream are matched once each."""
    rings = spark.createDataFrame([(7, [(x, y) for x, y in square(1, 1)])], "bldg_id int, ring array<struct<lon:double,lat:double>>")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = []
    for batch in ([(1, 1.0, 1.0), (2, 5.0, 5.0)], [(3, 1.2, 0.8)]):
        spark.createDataFrame(batch, "k long, lon double, lat double").write.mode("append").parquet(source)
        points = drops.stream_points(spark, source, "k long, lon double, lat double")
        drops.stream_matches(points, rings).select("k", "bldg_id").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        seen.append(sorted(tuple(r) for r in spark.read.parquet(out).collect()))
    assert seen == [[(1, 7)], [(1, 7), (3, 7)]]
