"""Footprints laid out by map tile, and reads of an area that open its tiles only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastock.functions import geo
from terrastock.operators import areas

ZOOM = 9


def tile_of(lon: str, lat: str, zoom: int = ZOOM):
    """The quadkey of a place."""
    return geo.quadkey(geo.tile_x(F.col(lon), zoom), geo.tile_y(F.col(lat), zoom), zoom)


def write_tiles(footprints: DataFrame, path: str, zoom: int = ZOOM, ring: str = "ring", parts: int = 1) -> None:
    """Footprints in one folder for each tile, by the tile of their envelope's middle, with their envelopes beside them.

    Rows are dealt by tile before they are written, a tile to ``parts`` tasks, so that a tile is that many files.
    """
    box = geo.ring_bbox(F.col(ring))
    rows = footprints.withColumn("__b", box).select("*", *(F.col(f"__b.{c}").alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))).drop("__b")
    middle = rows.withColumns({"__x": (F.col("min_lon") + F.col("max_lon")) / 2, "__y": (F.col("min_lat") + F.col("max_lat")) / 2})
    keyed = middle.withColumn("quadkey", tile_of("__x", "__y", zoom)).drop("__x", "__y")
    salt = F.pmod(F.xxhash64("min_lon", "min_lat", "max_lon", "max_lat"), F.lit(parts))
    keyed.repartition("quadkey", salt).write.mode("overwrite").partitionBy("quadkey").parquet(path)


def tiles_of_area(spark: SparkSession, area: areas.Box | areas.Polygon, zoom: int = ZOOM, reach: float = 0.0) -> DataFrame:
    """(quadkey) of the tiles that an area's envelope meets, widened by ``reach`` degrees."""
    x0, y0, x1, y1 = area if isinstance(area[0], (int, float)) else areas.bounds_of(area)
    held = geo.tile_range(*(F.lit(float(v)) for v in (x0 - reach, y0 - reach, x1 + reach, y1 + reach)), zoom)
    return spark.range(1).select(F.explode(held).alias("t")).select(geo.quadkey(F.col("t.x"), F.col("t.y"), zoom).alias("quadkey"))


def read_area(spark: SparkSession, path: str, area: areas.Box | areas.Polygon, zoom: int = ZOOM, reach: float = 0.1, ring: str = "ring") -> DataFrame:
    """Footprints of tiled files that meet an area. The join with the area's tiles prunes the folders that are opened, and
    the envelopes prune row groups inside them. ``reach`` is at least half of the largest footprint, in degrees, since a
    footprint is filed by its middle."""
    polygon = None if isinstance(area[0], (int, float)) else area
    x0, y0, x1, y1 = area if polygon is None else areas.bounds_of(polygon)
    rows = spark.read.parquet(path)
    near = rows.where((F.col("min_lon") <= x1) & (F.col("max_lon") >= x0) & (F.col("min_lat") <= y1) & (F.col("max_lat") >= y0))
    # an area's tiles are as many as its size over a tile's, whatever the data hold
    met = near.join(F.broadcast(tiles_of_area(spark, area, zoom, reach).where("quadkey >= 0")), "quadkey", "left_semi")  # a condition lets the join prune
    met = met if polygon is None else met.where(geo.rings_intersect(F.col(ring), areas.ring_of(polygon)))
    return met.drop("quadkey", "min_lon", "min_lat", "max_lon", "max_lat")


def read_linked_tiles(spark: SparkSession, path: str, links: DataFrame, area: areas.Box | areas.Polygon, zoom: int = ZOOM, reach: float = 0.1) -> DataFrame:
    """As ``read_area``, for the tiles that a table of links (quadkey, url, size) names too: of each tile's files the largest
    counts, and its ``url`` is given with every row."""
    from terrastock.sources.readers import largest_file_by_tile

    wanted = largest_file_by_tile(links.join(tiles_of_area(spark, area, zoom, reach), "quadkey", "left_semi")).select("quadkey", "url")
    x0, y0, x1, y1 = area if isinstance(area[0], (int, float)) else areas.bounds_of(area)
    rows = spark.read.parquet(path).where((F.col("min_lon") <= x1) & (F.col("max_lon") >= x0) & (F.col("min_lat") <= y1) & (F.col("max_lat") >= y0))
    return rows.join(wanted, "quadkey").drop("min_lon", "min_lat", "max_lon", "max_lat")
