import json
import pathlib

import pytest
from pyspark.sql import functions as F

from terrastock.functions import geo, parse
from terrastock.sources import writers


@pytest.fixture(scope="module")
def inventory(spark):
    rows = [(1, 40.5, -100.25, 2.5, 'a "quoted" one', None), (2, 41.0, -101.0, None, "plain", 7)]
    ring = F.array(*(geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (1, 1), (0, 0))))
    return spark.createDataFrame(rows, "id long, Latitude double, Longitude double, h double, name string, n int").withColumn("ring", ring)


def test_features_keep_native_values(inventory, tmp_path):
    path = writers.write_inventory(inventory.repartition(2), str(tmp_path / "out.geojson"), "m")
    whole = [json.loads(f.read_text()) for f in sorted(pathlib.Path(path).glob("part-*")) if f.stat().st_size]
    got = sorted((x for c in whole for x in c["features"]), key=lambda f: f["properties"]["id"])
    assert got[0]["properties"] == {"id": 1, "Latitude": 40.5, "Longitude": -100.25, "h": 2.5, "name": 'a "quoted" one', "n": "NA", "type": "Building"}
    assert got[1]["properties"]["h"] == "NA" and got[1]["properties"]["n"] == 7
    assert got[0]["geometry"] == {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]}
    for header in whole:  # every file is a collection of its own
        assert header["type"] == "FeatureCollection" and header["units"] == {"length": "m"} and header["crs"]["properties"]["name"].endswith("CRS84")


def test_extensions(inventory, tmp_path):
    with pytest.warns(UserWarning):
        assert writers.write_inventory(inventory, str(tmp_path / "out.shp")).endswith("out.geojson")
    path = writers.write_inventory(inventory, str(tmp_path / "out.csv"))
    foot = inventory.sparkSession.read.option("header", True).option("escape", '"').csv(path).orderBy("id").first()["Footprint"]
    assert foot.startswith('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[') and foot.endswith(']},"properties":{}}')
    assert json.loads(foot)["geometry"]["coordinates"][0][1] == [1.0, 0.0]


def test_circle_and_angles(spark):
    row = spark.range(1).select(geo.circle(F.lit(10.0), F.lit(20.0), 100).alias("c"), *(geo.angle_from_heading(F.lit(x), F.lit(y), F.lit(h)).alias(n) for n, x, y, h in (("right", 1.0, 0.0, 0.0), ("left", -1.0, 0.0, 0.0), ("back", 0.0, -1.0, 0.0)))).first()
    assert len(row["c"]) == 100 and row["c"][0]["lon"] == 10.0 and row["c"][0]["lat"] > 20 and row["c"][0]["lat"] == pytest.approx(row["c"][99]["lat"], abs=1e-12)
    assert row["right"] == pytest.approx(90) and row["left"] == pytest.approx(-90) and abs(row["back"]) == pytest.approx(180)


def test_base64_with_and_without_padding(spark):
    got = spark.createDataFrame([("_-8=",), ("_-8",), ("YWJj",), ("",)], "s string").select(F.hex(parse.url_safe_base64(F.col("s"))).alias("h")).collect()
    assert [r["h"] for r in got] == ["FFEF", "FFEF", "616263", ""]
