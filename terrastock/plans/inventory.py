"""An inventory of buildings from end to end: footprints of an area, fused with structures, under the headers of inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastock.functions import geo
from terrastock.operators import areas, fusion, spatial
from terrastock.plans import views
from terrastock.plans.registry import ORACLE, query
from terrastock.plans.registry_shapes import _BORDER, REGION
from terrastock.sources import writers


def regional_inventory(footprints: DataFrame, structures: DataFrame, area: areas.Polygon, attributes: str | list[str] = "all", cell: float = 0.02) -> DataFrame:
    """Buildings whose middle lies in an area, with the first structure of each footprint's envelope: (id, Latitude,
    Longitude, PlanArea, attributes by their headers, ring).

    ``footprints``: (bldg_id, ring, attributes...); ``structures``: (struct_id, lon, lat, attributes...). A structure's
    attribute counts before the footprint's; attributes that neither has are left out. Areas are in whole thousands of
    square feet, coordinates in six places.
    """
    wanted = fusion.requested_attributes(attributes)
    middle = geo.once(geo.ring_centroid(F.col("ring")), lambda m: geo.point(F.round(m["lon"], 6), F.round(m["lat"], 6)))
    # the middle is worked out once for the border's edges, and once more for the rows that stay
    inside = geo.once(middle, lambda m: geo.point_in_ring(m["lon"], m["lat"], areas.ring_of(area)))
    ours = footprints.where(inside).withColumn("__m", middle)
    own = [c for c in wanted if c in structures.columns]
    first = spatial.first_in_rings(ours.select("bldg_id", "ring"), structures.select("struct_id", "lon", "lat", *(F.col(c).alias(f"s_{c}") for c in own)), "bldg_id", "struct_id", cell)
    met = ours.hint("merge").join(first, "bldg_id", "left")
    value = lambda c: F.coalesce(*(F.col(n) for n in (f"s_{c}", c) if n in met.columns))
    held = [c for c in wanted if c in own or c in footprints.columns]
    area_ft2 = F.round(geo.spherical_area_ft2(F.col("ring")) / 1000).cast("long") * 1000
    return met.select(F.col("bldg_id").alias("id"), F.col("__m.lat").alias("Latitude"), F.col("__m.lon").alias("Longitude"), area_ft2.alias("PlanArea"), *(value(c).alias(fusion.HEADERS[c]) for c in held), "ring")


def write_regional_inventory(footprints: DataFrame, structures: DataFrame, area: areas.Polygon, path: str, attributes: str | list[str] = "all", units: str = "ft") -> str:
    """The same, written as CSV or GeoJSON by the path's extension; gives the path."""
    return writers.write_inventory(regional_inventory(footprints, structures, area, attributes), path, units)


def inputs(s, d) -> tuple[DataFrame, DataFrame]:
    """Footprints and structures of the test tables."""
    points = views.points(s, d, "customer", "c_custkey as struct_id", "c_acctbal as repaircost")
    return views.footprints(s, d), points.select("struct_id", "lon", "lat", "repaircost")


@query(f"""WITH border(cx, cy, dx, dy) AS (VALUES {_BORDER}), n AS ({ORACLE["nsi_point_in_envelope"]}), c AS ({ORACLE["ring_centroid"]}), a AS ({ORACLE["spherical_area"]})
SELECT n.bldg_id AS id, c.lat AS "Latitude", c.lon AS "Longitude", a.area_kft2 * 1000 AS "PlanArea", p_brand AS "StructureType", n.numstories AS "NumberOfStories", n.occupancy AS "OccupancyClass", n.repaircost AS "ReplacementCost"
FROM n JOIN c USING (bldg_id) JOIN a USING (bldg_id) JOIN part ON p_partkey = n.bldg_id WHERE (SELECT count(*) FROM border WHERE (cy > c.lat) <> (dy > c.lat) AND c.lon < (dx - cx) * (c.lat - cy) / nullif(dy - cy, 0) + cx) % 2 = 1""")
def inventory_of_region(s, d):
    """From footprints and structures to the rows of an inventory."""
    return regional_inventory(*inputs(s, d), REGION).drop("ring")
