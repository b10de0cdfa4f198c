"""Writers of inventories: CSV, GeoJSON features and graph tables. Nulls become NA only here."""

from __future__ import annotations

import json
import warnings
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastock.operators.fusion import HEADERS


def ring_json(ring: Column) -> Column:
    return F.to_json(F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))


def inventory_columns(df: DataFrame) -> DataFrame:
    """Headers and order of an inventory: id, Latitude, Longitude, PlanArea, attributes, Footprint last."""
    named = df.withColumnsRenamed({a: h for a, h in HEADERS.items() if a in df.columns})
    front = [c for c in ("id", "Latitude", "Longitude", "PlanArea") if c in named.columns]
    images = {"satellite_images", "street_images", "ring"}
    rest = [c for c in named.columns if c not in front and c not in images]
    # fixed values: order and signs of a footprint's text
    foot = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":['), ring_json(F.col("ring")), F.lit(']},"properties":{}}'))
    return named.select(*front, *rest, foot.alias("Footprint"))


def write_csv(df: DataFrame, path: str) -> None:
    inventory_columns(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def point_json(lon: str, lat: str) -> Column:
    return F.format_string("[%.7f,%.7f]", lon, lat)


def line_json(line: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(line, lambda p: F.format_string("[%.7f,%.7f]", p["lon"], p["lat"])), ","), F.lit("]"))


def features(df: DataFrame, geometry: Column, kind: str, properties: list[str] | None = None) -> DataFrame:
    """(value): one GeoJSON feature for each row, a line of text each, so that writing needs no single task."""
    held = properties or [c for c in df.columns if c != "ring"]
    value = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    known = F.concat_ws(",", *(F.concat(F.to_json(F.array(F.lit(c))).substr(F.lit(2), F.char_length(F.to_json(F.array(F.lit(c)))) - 2), F.lit(":"), F.when(F.col(c).isNull(), F.lit('"NA"')).otherwise(value(c))) for c in held))
    return df.select(F.concat(F.lit('{"type":"Feature","properties":{'), known, F.lit(f'}},"geometry":{{"type":"{kind}","coordinates":'), geometry, F.lit("}}")).alias("value"))


def collection_header(units: str = "ft") -> str:
    """The metadata of a collection of features, as a JSON object without them."""
    # fixed values: names of the coordinate system and of its fields
    return json.dumps({"type": "FeatureCollection", "generated": datetime.now().isoformat(" "), "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}, "units": {"length": units}})


def ring_geometry(ring: str = "ring") -> Column:
    return F.concat(F.lit("["), ring_json(F.col(ring)), F.lit("]"))


def multi_polygon_json(polygons: Column) -> Column:
    """Coordinates of a MultiPolygon: an array of polygons, each an array of rings."""
    return F.to_json(F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"])))))


def write_collection(df: DataFrame, path: str, geometry: Column, kind: str, properties: list[str] | None = None, units: str = "ft") -> None:
    """Write feature collections: every file of the folder ``path`` is a whole one, with the metadata, that any reader of
    such files opens, and no task has to see them all. ``kind`` is the type of geometry whose coordinates are given."""
    opening = collection_header(units)[:-1] + ', "features": ['

    def whole(batches):
        import pyarrow as pa

        before = None
        for b in batches:
            lines = b.column(0).to_pylist()
            if not lines:
                continue
            out = [opening] if before is None else [before + ","]
            yield pa.RecordBatch.from_arrays([pa.array(out + [f"{x}," for x in lines[:-1]])], names=["value"])
            before = lines[-1]
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([before, "]}"])], names=["value"])

    features(df, geometry, kind, properties).mapInArrow(whole, "value string").write.mode("overwrite").text(path)


def write_layers(layers: dict[str, tuple[DataFrame, Column, str]], path: str, units: str = "ft") -> list[str]:
    """Write each layer (rows, geometry, kind) that has rows as feature collections below ``path``; gives the names written."""
    written = []
    for name, (df, geometry, kind) in layers.items():
        if not df.isEmpty():
            write_collection(df, f"{path}/{name}", geometry, kind, [c for c in df.columns if c not in ("ring", "line", "lon", "lat")], units)
            written.append(name)
    return written


def write_inventory(df: DataFrame, path: str, units: str = "ft") -> str:
    """Write an inventory as CSV or GeoJSON by the path's extension, any other being replaced by geojson; gives the path.

    Either is a folder of files; each GeoJSON file is a whole feature collection of ``type`` Building with the inventory's
    header names.
    """
    stem, _, extension = path.rpartition(".")
    if extension.lower() == "csv":
        write_csv(df, path)
        return path
    if extension.lower() != "geojson":
        warnings.warn("output format unknown, writing geojson", stacklevel=2)
        path = f"{stem or path}.geojson"
    named = df.withColumnsRenamed({a: h for a, h in HEADERS.items() if a in df.columns}).withColumn("type", F.lit("Building"))
    write_collection(named, path, ring_geometry(), "Polygon", [c for c in named.columns if c != "ring"], units)
    return path


def write_features(df: DataFrame, path: str) -> None:
    features(df, F.concat(F.lit("["), ring_json(F.col("ring")), F.lit("]")), "Polygon").write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges of a network as CSV, fields parted by a comma and a blank."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("header", True).option("sep", ", ").csv(f"{path}/{name}")


def write_lines(df: DataFrame, path: str, properties: list[str], line: str = "line") -> None:
    features(df, line_json(line), "LineString", properties).write.mode("overwrite").text(path)


def write_points(df: DataFrame, path: str, properties: list[str]) -> None:
    features(df, point_json("lon", "lat"), "Point", properties).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("image", "prediction", "probability").write.mode("overwrite").option("header", True).csv(path)
