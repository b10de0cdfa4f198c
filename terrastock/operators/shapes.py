"""Shapes of footprints: the run of a roof from the two main directions of its footprint."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastock.functions import geo


def slope_clusters(slopes: Column, tolerance: float = 0.3) -> Column:
    """For each of an array of slopes the number of its cluster: the first whose first slope is within a relative tolerance,
    or a new one. Equal slopes, vertical ones too, are one cluster, null slopes stand for vertical ones."""
    alike = lambda s, h: F.when(s.isNull() | h.isNull(), s.isNull() & h.isNull()).otherwise((s == h) | (F.abs(s - h) < tolerance * F.abs(h)))
    start = F.struct(F.slice(slopes, 1, 0).alias("heads"), F.slice(F.array(F.lit(0)), 1, 0).alias("ids"))

    def put(state: Column, s: Column) -> Column:
        at = F.array_position(F.transform(state["heads"], lambda h: alike(s, h)), F.lit(True)).cast("int")
        found = at > 0
        heads = F.when(found, state["heads"]).otherwise(F.concat(state["heads"], F.array(s)))
        return F.struct(heads.alias("heads"), F.concat(state["ids"], F.array(F.when(found, at - 1).otherwise(F.size(state["heads"])))).alias("ids"))

    return F.aggregate(slopes, start, put)["ids"]


def ring_segments(footprints: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, i, x1, y1, x2, y2, slope, length, cluster): edges of rings in feet about their first vertex; slope null where vertical."""
    origin = F.col(ring)[0]
    flat = F.transform(ring, lambda p: geo.local_ft(origin["lon"], origin["lat"], p["lon"], p["lat"]))
    heads = lambda xy: F.zip_with(F.slice(xy, 1, F.size(xy) - 1), F.slice(xy, 2, F.size(xy)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    edges = footprints.where(F.size(ring) >= 4).select(key, flat.alias("__xy")).select(key, heads(F.col("__xy")).alias("__e"))
    slope = lambda e: (e["y2"] - e["y1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0))
    told = edges.withColumn("__c", slope_clusters(F.transform("__e", slope)))
    rows = told.select(key, F.posexplode(F.zip_with("__e", "__c", lambda e, c: F.struct(e.alias("e"), c.alias("cluster")))).alias("i", "z")).select(key, "i", "z.e.*", "z.cluster")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return rows.withColumns({"slope": dy / F.nullif(dx, F.lit(0.0)), "length": F.sqrt(dx * dx + dy * dy)})


def main_directions(segments: DataFrame, key: str) -> DataFrame:
    """(key, cluster, rank, total): the two clusters with the largest total length, 1 and 2, of those with several edges;
    ties go to the later one."""
    per = segments.groupBy(key, "cluster").agg(F.sum("length").alias("total"), F.count("*").alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("total", 6)), F.desc("cluster")))
    return per.withColumn("rank", rank).where("rank <= 2").select(key, "cluster", "rank", "total")


def roof_runs(footprints: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, run): the shortest side, in feet, of the quadrilateral that the outermost edges of a footprint's two main
    directions enclose; null for footprints without two such directions. Of edges that run almost north the slopes may
    be far apart, and such edges then be of different directions."""
    segs = ring_segments(footprints, key, ring)
    # of a footprint's edges and directions no estimate tells how many they are
    own = segs.hint("merge").join(main_directions(segs, key), [key, "cluster"])
    # how far an edge's ends lie to the side of its own direction
    turn = F.coalesce(F.lit(pi / 2) - F.atan("slope"), F.lit(0.0))
    side = lambda x, y: F.col(x) * F.cos(turn) - F.col(y) * F.sin(turn)
    off = own.withColumns({"lo": F.round(F.least(side("x1", "y1"), side("x2", "y2")), 6), "hi": F.round(F.greatest(side("x1", "y1"), side("x2", "y2")), 6), "edge": F.struct("x1", "y1", "x2", "y2")})
    lines = off.groupBy(key, "rank").agg(F.min_by("edge", F.struct("lo", "i")).alias("least"), F.min_by("edge", F.struct(-F.col("hi"), F.col("i"))).alias("most"))
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    both = lines.groupBy(key).agg(pick("least", 1).alias("a"), pick("most", 1).alias("b"), pick("least", 2).alias("c"), pick("most", 2).alias("d"))

    def meet(p: str, q: str) -> Column:
        l1, l2 = F.col(p), F.col(q)
        c1, c2 = l1["x1"] * l1["y2"] - l1["y1"] * l1["x2"], l2["x1"] * l2["y2"] - l2["y1"] * l2["x2"]
        dx1, dy1, dx2, dy2 = l1["x1"] - l1["x2"], l1["y1"] - l1["y2"], l2["x1"] - l2["x2"], l2["y1"] - l2["y2"]
        det = F.nullif(dx1 * dy2 - dy1 * dx2, F.lit(0.0))
        return F.struct(((c1 * dx2 - dx1 * c2) / det).alias("x"), ((c1 * dy2 - dy1 * c2) / det).alias("y"))

    corners = both.select(key, meet("a", "c").alias("ac"), meet("a", "d").alias("ad"), meet("b", "d").alias("bd"), meet("b", "c").alias("bc"))
    long = lambda p, q: F.sqrt(F.pow(F.col(p)["x"] - F.col(q)["x"], F.lit(2.0)) + F.pow(F.col(p)["y"] - F.col(q)["y"], F.lit(2.0)))
    sides = [long("ac", "ad"), long("ad", "bd"), long("bd", "bc"), long("bc", "ac")]
    whole = F.when(sides[0].isNotNull() & sides[2].isNotNull(), F.least(*sides))
    return footprints.select(key).hint("merge").join(corners.select(key, whole.alias("run")), key, "left")
