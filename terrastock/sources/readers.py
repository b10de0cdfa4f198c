"""Readers of footprints, structures, roads, boxes and lists; lazy scans with explicit schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrastock.functions import geo

POINT = "struct<lon:double,lat:double>"


def bbox_polygon(values: tuple[float, ...]) -> list[tuple[float, float]]:
    """Two corners, or three and more vertices, as a closed polygon."""
    if len(values) < 4 or len(values) % 2:
        raise ValueError("an even number of at least four coordinates is needed")
    pts = list(zip(values[::2], values[1::2], strict=True))
    if len(pts) == 2:
        (x0, y0), (x1, y1) = pts
        pts = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return pts if pts[0] == pts[-1] else [*pts, pts[0]]


def attribute_map(text: str) -> tuple[dict[str, str], str]:
    """``target:source`` lines as {source: target}, and the unit of length (ft unless given)."""
    pairs = dict(tuple(p.strip() for p in line.split(":", 1)) for line in text.splitlines() if ":" in line)
    return {v: k for k, v in pairs.items() if k != "LengthUnit"}, pairs.get("LengthUnit", "ft")


def clean_property(name: str) -> str:
    """A property's name without its last part that holds digits."""
    parts = name.split("_")
    for k in range(len(parts) - 1, -1, -1):
        if re.search("[0-9]", parts[k]):
            return "_".join(parts[:k] + parts[k + 1 :])
    return name


def outer_ring(coordinates: Column) -> Column:
    """The ring of a polygon given as JSON text of coordinates nested two, three or four deep: of several rings the longest,
    the first of those as long."""
    four = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    deep = F.coalesce(F.when(F.size(F.flatten(F.flatten(four))) > 0, four), F.from_json(coordinates, "array<array<array<double>>>"))
    flat = F.from_json(coordinates, "array<array<double>>")
    longest = F.get(F.array_sort(deep, lambda a, b: F.size(b) - F.size(a)), F.lit(0))
    return F.transform(F.coalesce(longest, flat), lambda p: geo.point(p[0], p[1]))


def _whole_features(spark: SparkSession, path: str) -> DataFrame:
    """(geometry, properties) as JSON text from files read whole, one task each."""
    schema = "features array<struct<geometry:string,properties:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.geometry", "f.properties")


def _split_features(spark: SparkSession, path: str) -> DataFrame:
    """(geometry, properties) as JSON text from files read in byte ranges, so that one large file is many tasks' work.

    A feature begins at its type, which must be its first field, as writers of such files have it; what follows its closing
    brace is left alone. A piece that is no feature, but for each file's head, is an error, so that none is lost: such
    files are read whole.
    """
    mark = '"Feature"'
    pieces = spark.read.option("lineSep", mark).text(path).select("value")
    fields = F.from_json(F.concat(F.lit('{"type":' + mark), F.col("value")), "map<string,string>")
    read = pieces.select("value", fields.alias("m"))
    head = F.col("value").rlike("^[\\s\ufeff]*\\{")  # what follows a feature's type is a comma or a brace that closes
    wrong = F.raise_error(F.concat(F.lit("not a feature that begins with its type, read the file whole: "), F.substring("value", 1, 80)))
    sure = F.when(head, F.lit(None)).when(F.map_contains_key("m", "geometry"), F.col("m")).otherwise(wrong.cast("map<string,string>"))
    return read.select(sure.alias("m")).where("m is not null").select(F.element_at("m", "geometry").alias("geometry"), F.element_at("m", "properties").alias("properties"))


def read_features(spark: SparkSession, path: str, renames: dict[str, str] | None = None, split: bool = True) -> DataFrame:
    """(geometry_type, coordinates as JSON text, properties...) of feature collections; features without a geometry are
    left out. Files are read in byte ranges unless ``split`` is off; see ``_split_features``."""
    rows = _split_features(spark, path) if split else _whole_features(spark, path)
    told = rows.select(F.from_json("geometry", "type string, coordinates string").alias("g"), F.from_json("properties", "map<string,string>").alias("properties")).where("g.type is not null")
    named = [F.element_at("properties", source).alias(target) for source, target in (renames or {}).items()]
    return told.select(F.col("g.type").alias("geometry_type"), F.col("g.coordinates").alias("coordinates"), *(named or ["properties"]))


def read_footprints(spark: SparkSession, path: str, renames: dict[str, str] | None = None, split: bool = True) -> DataFrame:
    """Polygon features with a ring of at least four points; MultiPolygons are left out (``left_out`` counts them)."""
    rows = read_features(spark, path, renames, split).where("geometry_type = 'Polygon'").withColumn("ring", outer_ring(F.col("coordinates")))
    return rows.where(F.size("ring") >= 4).drop("coordinates", "geometry_type")


def left_out(features: DataFrame) -> DataFrame:
    """(geometry_type, n) of features that are neither polygons nor points."""
    return features.where(~F.col("geometry_type").isin("Polygon", "Point")).groupBy("geometry_type").agg(F.count("*").alias("n"))


def read_point_features(spark: SparkSession, path: str, renames: dict[str, str] | None = None, split: bool = True) -> DataFrame:
    """(lon, lat, properties...) of a collection of points; an error where any feature is something else."""
    rows = read_features(spark, path, renames, split)
    sure = F.when(F.col("geometry_type") == "Point", F.from_json("coordinates", "array<double>")).otherwise(F.raise_error(F.concat(F.lit("not a point: "), "geometry_type")).cast("array<double>"))
    return rows.withColumn("__p", sure).select(F.get("__p", F.lit(0)).alias("lon"), F.get("__p", F.lit(1)).alias("lat"), *(c for c in rows.columns if c not in ("geometry_type", "coordinates")))


def osm_footprints(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(way_id, ring, tags): node coordinates looked up for each way, in order; only complete closed ways."""
    at = ways.select("way_id", "tags", F.posexplode("nodes").alias("pos", "node_id"), F.size("nodes").alias("want"))
    found = at.join(nodes, "node_id").groupBy("way_id").agg(F.first("tags").alias("tags"), F.first("want").alias("want"), F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    ring = F.transform("p", lambda x: geo.point(x["lon"], x["lat"]))
    return found.where(F.size("p") == F.col("want")).select("way_id", ring.alias("ring"), "tags").where((F.size("ring") >= 4) & (F.get("ring", F.lit(0)) == F.element_at("ring", -1)))


def osm_attributes(tags: Column) -> dict[str, Column]:
    """Year, height and stories of a map of tags; stories count the roof's levels too."""
    from terrastock.functions import parse

    get = lambda k: F.element_at(tags, k)
    levels = lambda k: parse.clean_number(get(k)).try_cast("int")
    return {
        "erabuilt": parse.parse_year(F.coalesce(get("start_date"), get("building:start_date"), get("year_of_construction"))),
        "buildingheight": parse.parse_height_ft(F.coalesce(get("height"), get("building:height"))),
        "numstories": F.when(levels("building:levels").isNotNull(), levels("building:levels") + F.coalesce(levels("roof:levels"), F.lit(0))),
    }


def largest_file_by_tile(links: DataFrame) -> DataFrame:
    """Of the files of each tile (quadkey, url, size text) the largest; ties go to the smaller url."""
    from terrastock.functions import parse

    order = Window.partitionBy("quadkey").orderBy(F.desc(parse.file_size_bytes(F.col("size"))), "url")
    return links.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def exif_position(rows: DataFrame) -> DataFrame:
    """(image, lat, lon, heading) of (image, lat_d, lat_m, lat_s, lat_ref, lon_d, lon_m, lon_s, lon_ref, heading)."""
    side = lambda k: geo.dms_to_decimal(F.col(f"{k}_d"), F.col(f"{k}_m"), F.col(f"{k}_s"), F.col(f"{k}_ref"))
    return rows.select("image", side("lat").alias("lat"), side("lon").alias("lon"), "heading")


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of an annotation file."""
    schema = "images array<struct<id:long,file_name:string>>, annotations array<struct<id:long,image_id:long,category_id:long,area:double,iscrowd:int,bbox:array<double>>>, categories array<struct<id:long,name:string,supercategory:string>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return tuple(whole.select(F.inline(k)) for k in ("images", "annotations", "categories"))


def labelled_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, label) of image files in folders named by their label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.where(F.lower("path").rlike(r"\.(jpe?g|png|bmp)$")).select("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("label"))


def new_rows(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't cached yet."""
    return rows.join(cache.select(key), key, "left_anti")


def in_box(rows: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside a box; on stored columns the four bounds reach the scan."""
    return rows.where((F.col(lon) >= min_lon) & (F.col(lon) <= max_lon) & (F.col(lat) >= min_lat) & (F.col(lat) <= max_lat))


def read_boxed(spark: SparkSession, path: str, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Footprints stored with their boxes (min_lon, min_lat, max_lon, max_lat) that meet a box; the scan skips by the boxes' ranges."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("min_lon") <= max_lon) & (F.col("max_lon") >= min_lon) & (F.col("min_lat") <= max_lat) & (F.col("max_lat") >= min_lat))


def read_tall_buildings(spark: SparkSession, path: str) -> DataFrame:
    """Reference table of tall buildings; lines that don't fit the schema are dropped."""
    return spark.read.schema("latitude double, longitude double, floors int, height double, year int").option("header", True).option("mode", "DROPMALFORMED").csv(path)


def read_download_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("BldgUniqueID string, CentroidX double, CentroidY double, StructureUse string").option("header", True).csv(path)


def chunk_of(key: Column, chunks: int) -> Column:
    """A chunk from 0 that depends on the key only."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % chunks


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(part, line, properties) of LineString and MultiLineString features, each part a row of its own."""
    rows = read_features(spark, path)
    flat = F.from_json("coordinates", "array<array<double>>")
    parts = F.when(F.col("geometry_type") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>")).when(F.col("geometry_type") == "LineString", F.array(flat))
    each = rows.select("properties", F.posexplode(parts).alias("part", "c"))
    return each.select("part", F.transform("c", lambda p: geo.point(p[0], p[1])).alias("line"), "properties")
