"""Tables and derived views of the test data; the arithmetic is the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastock.functions import geo
from terrastock.operators.shared import dealt

OFFSET = {"customer": 0, "supplier": 3001, "part": 5003, "events": 7001, "orders": 0}
KEY = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "events": "event_id", "orders": "o_orderkey"}
LON, LAT = "cast(-122.5 as double) + ((({k}) + {o}) * 7919 % 10007) / cast(20014 as double)", "cast(37.5 as double) + ((({k}) + {o}) * 104729 % 10009) / cast(20018 as double)"


def lon_sql(key: str, name: str) -> str:
    return LON.format(k=f"cast({key} as bigint)", o=OFFSET[name])


def lat_sql(key: str, name: str) -> str:
    return LAT.format(k=f"cast({key} as bigint)", o=OFFSET[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, name: str, *more: str) -> DataFrame:
    """(key, lon, lat, more...) of a base table."""
    k = KEY[name]
    return table(spark, sf_dir, name).selectExpr(k, f"{lon_sql(k, name)} as lon", f"{lat_sql(k, name)} as lat", *more)


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square footprints about the points of parts: (bldg_id, ring, repaircost, numstories, occupancy, constype)."""
    p = points(spark, sf_dir, "part", "p_size", "p_retailprice", "p_type", "p_brand").withColumn("h", (1 + F.col("p_size")) / F.lit(2000.0))
    corner = lambda sx, sy: geo.point(F.col("lon") + sx * F.col("h"), F.col("lat") + sy * F.col("h"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    # a stored ring is read where it is used; one not dealt yet would be drawn again for each use of a vertex
    return dealt(p.select(F.col("p_partkey").alias("bldg_id"), ring.alias("ring"), F.col("p_retailprice").alias("repaircost"), F.col("p_size").alias("numstories"), F.col("p_type").alias("occupancy"), F.col("p_brand").alias("constype")), "bldg_id")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, line, cls, name) of orders: vertices from their items in order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lon = f"{lon_sql('l_orderkey', 'orders')} + ((l_partkey % 11) - 5) / cast(1000 as double)"
    lat = f"{lat_sql('l_orderkey', 'orders')} + ((l_suppkey % 11) - 5) / cast(1000 as double)"
    placed = items.selectExpr("l_orderkey as line_id", "struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as o", f"{lon} as lon", f"{lat} as lat")
    drawn = placed.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("o", "lon", "lat"))).alias("v"))
    line = F.transform("v", lambda x: geo.point(x["lon"], x["lat"]))
    cls = "element_at(array('S1100','S1200','S1400','S1500','S1740'), cast(substr(o_orderpriority, 1, 1) as int))"
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey as line_id", f"{cls} as cls")
    return drawn.where(F.size("v") >= 2).select("line_id", line.alias("line"), F.get("v", F.lit(0))["o"]["l_partkey"].alias("first_part")).join(orders, "line_id")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.selectExpr(
        "l_orderkey as image", "cast(l_linenumber * 1000000 + l_partkey as bigint) as box_id", "cast(l_partkey * 13 % 500 as double) as x1", "cast(l_suppkey * 37 % 500 as double) as y1",
        "cast(l_partkey * 13 % 500 + 5 as double) + l_quantity as x2", "cast(l_suppkey * 37 % 500 + 5 as double) + l_quantity as y2", "1 - l_discount as score", "l_returnflag as label",
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, truth, pred, toxic) of labelled documents: predicted good where long."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("truth"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("pred"), "toxic")


#: Cosines and sines of four turns, as whole numbers over a whole number, so that all engines turn alike.
TURNS = ((3, 4, 5), (5, 12, 13), (8, 15, 17), (20, 21, 29))
#: Corners of a footprint with a wing and a cut corner, in shares of its width and height.
CORNERS = ((0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.25, 1.0), (0.0, 0.75), (0.0, 0.0))


def turned_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bldg_id, ring): footprints with a wing, turned by one of four angles, at the points of parts."""
    of = lambda k: F.element_at(F.array(*(F.lit(float(t[k])) for t in TURNS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = points(spark, sf_dir, "part", "p_size").withColumns({"c": of(0) / of(2), "s": of(1) / of(2), "w": (10 + F.col("p_size")) / F.lit(100000.0), "h": (5 + F.col("p_partkey") % 23) / F.lit(100000.0)})
    corner = lambda x, y: geo.point(F.col("lon") + F.col("c") * (F.col("w") * x) - F.col("s") * (F.col("h") * y), F.col("lat") + F.col("s") * (F.col("w") * x) + F.col("c") * (F.col("h") * y))
    return dealt(p.select(F.col("p_partkey").alias("bldg_id"), F.array(*(corner(F.lit(x), F.lit(y)) for x, y in CORNERS)).alias("ring")), "bldg_id")
