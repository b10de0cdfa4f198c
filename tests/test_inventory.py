"""An inventory written and read again."""

import json
import pathlib

import pytest
from oracle import SF

from terrastock.plans import inventory
from terrastock.plans.registry_shapes import REGION
from terrastock.sources import readers


def test_inventory_from_end_to_end(spark, tmp_path):
    rows = {r["id"]: r for r in inventory.regional_inventory(*inventory.inputs(spark, SF), REGION).collect()}
    path = inventory.write_regional_inventory(*inventory.inputs(spark, SF), REGION, str(tmp_path / "out.geojson"), ["repaircost", "numstories"])
    whole = [json.loads(f.read_text()) for f in pathlib.Path(path).glob("part-*") if f.stat().st_size]
    got = {x["properties"]["id"]: x for c in whole for x in c["features"]}
    assert set(got) == set(rows) and len(rows) > 20
    for k, x in got.items():
        assert set(x["properties"]) == {"id", "Latitude", "Longitude", "PlanArea", "NumberOfStories", "ReplacementCost", "type"}
        assert (x["properties"]["PlanArea"], x["properties"]["ReplacementCost"]) == (rows[k]["PlanArea"], rows[k]["ReplacementCost"])
    back = readers.read_footprints(spark, path, {"NumberOfStories": "numstories"}).collect()
    assert sorted(int(r["numstories"]) for r in back) == sorted(r["NumberOfStories"] for r in rows.values())
    table = inventory.write_regional_inventory(*inventory.inputs(spark, SF), REGION, str(tmp_path / "out.csv"), "hazuseq")
    assert spark.read.option("header", True).option("escape", '"').csv(table).columns == ["id", "Latitude", "Longitude", "PlanArea", "StructureType", "NumberOfStories", "OccupancyClass", "ReplacementCost", "Footprint"]


def test_unknown_attributes(spark):
    with pytest.raises(ValueError, match="none of the requested"):
        inventory.regional_inventory(*inventory.inputs(spark, SF), REGION, ["colour"])
