import json

import pytest
from pyspark.sql import functions as F

from terrastock.functions import geo, parse
from terrastock.operators import detection, fusion, graph
from terrastock.sources import readers, writers

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]


def ring(points=SQUARE):
    return F.array(*(geo.point(F.lit(x), F.lit(y)) for x, y in points))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_ring(spark):
    c = one(spark, geo.ring_centroid(ring()), geo.point_in_ring(F.lit(0.5), F.lit(0.5), ring()), geo.point_in_ring(F.lit(1.5), F.lit(0.5), ring()), geo.spherical_area_ft2(ring()))
    assert (round(c[0]["lon"], 9), round(c[0]["lat"], 9)) == (0.5, 0.5)
    assert c[1] and not c[2]
    assert c[3] == pytest.approx((geo.AREA_RADIUS_FT * 3.14159265 / 180) ** 2, rel=0.06)  # the midpoint rule is coarse for a ring this large


def test_distance_is_symmetric(spark):
    a = one(spark, geo.haversine_ft(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)), geo.haversine_ft(F.lit(3.0), F.lit(4.0), F.lit(1.0), F.lit(2.0)), geo.haversine_ft(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)))
    assert a[0] == pytest.approx(a[1]) and a[2] == 0


def test_tile_round_trip(spark):
    x, y = geo.tile_x(F.lit(-122.3), 12), geo.tile_y(F.lit(37.8), 12)
    w, n, e, s = one(spark, geo.tile_lon(x, 12), geo.tile_lat(y, 12), geo.tile_lon(x + 1, 12), geo.tile_lat(y + 1, 12))
    assert w <= -122.3 < e and s < 37.8 <= n


def test_parse(spark):
    got = one(spark, parse.parse_year(F.lit("c 1987-02")), parse.parse_year(F.lit("c. 1987-02")), parse.parse_height_ft(F.lit("10 m")), parse.structure_class(F.lit("M")), parse.file_size_bytes(F.lit("12.5MB")), parse.convert_units(F.lit(1.0), F.lit("parsec"), "m"))
    assert tuple(got) == (1987, None, 32.8, "RM1", 12500000.0, None)


def test_attributes():
    assert fusion.requested_attributes("hazuseq") == sorted(fusion.LOSS_MODEL)
    assert fusion.requested_attributes(["RoofShape", "nothing"]) == ["roofshape"]
    with pytest.raises(ValueError, match="known"):
        fusion.requested_attributes(["nothing"])


def test_polygon_and_maps():
    assert readers.bbox_polygon((0, 0, 1, 1))[0] == readers.bbox_polygon((0, 0, 1, 1))[-1]
    with pytest.raises(ValueError, match="even"):
        readers.bbox_polygon((1, 2, 3))
    assert readers.attribute_map("erabuilt:YEAR\nLengthUnit:m") == ({"YEAR": "erabuilt"}, "m")
    assert readers.clean_property("structure_number_008") == "structure_number"


def test_features_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "Gable")], "id int, roofshape string").withColumn("ring", ring())
    lines = [json.loads(r["value"]) for r in writers.features(df, F.concat(F.lit("["), writers.ring_json(F.col("ring")), F.lit("]")), "Polygon").collect()]
    assert [x["properties"]["roofshape"] for x in sorted(lines, key=lambda x: x["properties"]["id"])] == ["NA", "Gable"]
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": lines}))
    back = readers.read_footprints(spark, str(path), {"id": "bldg"}).collect()
    assert sorted(r["bldg"] for r in back) == ["1", "2"] and all(len(r["ring"]) == 5 for r in back)


def test_osm(spark):
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(SQUARE[:4])], "node_id long, lon double, lat double")
    ways = spark.createDataFrame([(1, [0, 1, 2, 3, 0], {"height": "3"}), (2, [0, 9, 1, 0], {})], "way_id long, nodes array<long>, tags map<string,string>")
    got = readers.osm_footprints(nodes, ways).collect()
    assert [r["way_id"] for r in got] == [1] and [(p["lon"], p["lat"]) for p in got[0]["ring"]] == SQUARE


def test_contraction(spark):
    path = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("c", "x"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    got = sorted((r["edges"], r["end_low"], r["end_high"]) for r in graph.contract_degree2(spark.createDataFrame(path, "u string, v string")).collect() if r["end_low"])
    assert got == [(1, "c", "x"), (2, "a", "c"), (2, "c", "e")]


def test_nms(spark):
    rows = [("i", 1, 0.0, 0.0, 10.0, 10.0, 0.9, "w"), ("i", 2, 1.0, 1.0, 10.0, 10.0, 0.8, "w"), ("i", 3, 20.0, 20.0, 30.0, 30.0, 0.7, "w"), ("j", 4, 0.0, 0.0, 10.0, 10.0, 0.1, "w")]
    boxes = spark.createDataFrame(rows, "image string, box_id long, x1 double, y1 double, x2 double, y2 double, score double, label string")
    assert sorted(r["box_id"] for r in detection.non_maximum_suppression(boxes).collect()) == [1, 3, 4]


def test_seven_places_by_the_exact_value(spark):
    """Numbers next to a half of the seventh place: their shortest text ends in 5, their value lies to either side."""
    ties = [54.57347025, 103.94040645, -102.02421695, -100.19100005, 37.00390625, -122.01171875, 0.00000005, 9.99999995, 0.0, -0.0, -1e-9, 1e-12, 123456789.12345675, 3e9]
    rows = spark.createDataFrame([(x, k) for k, x in enumerate(ties)], "x double, k int").orderBy("k")
    got = rows.select(geo.wkt_point(F.col("x"), F.col("x")).alias("p"), geo.wkt_line(F.array(geo.point(F.col("x"), F.col("x")))).alias("l"), graph.node_key(geo.point(F.col("x"), F.col("x"))).alias("n")).collect()
    text = [f"{x:.7f} {x:.7f}" for x in ties]
    assert [r["p"] for r in got] == [f"POINT ({t})" for t in text]
    assert [r["l"] for r in got] == [f"LINESTRING ({t})" for t in text] and [r["n"] for r in got] == text
