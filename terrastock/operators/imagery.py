"""Street images: pairing with footprints, the line of a building's front, depth profiles and the heights read off them."""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, cos, isfinite, pi, sin, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from terrastock.functions import geo
from terrastock.operators import spatial


def footprints_by_image(footprints: DataFrame, images: DataFrame, radius_ft: float, key: str = "bldg_id", image: str = "image") -> DataFrame:
    """(image, n, footprints, nearest_ft): footprints (key, lon, lat) gathered by the nearest image (image, rlon, rlat) within
    a radius, ties to the smaller image; footprints in their order. Images without one aren't listed."""
    nearest = spatial.nearest_within(footprints.select(key, "lon", "lat"), images.select(image, "rlon", "rlat"), radius_ft, key, image)
    return nearest.groupBy(image).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("footprints"), F.min("dist_ft").alias("nearest_ft"))


def columns_in_view(bearing: Column, heading: Column, width: Column, half: float = 10.0, shift: float = 0.25) -> Column:
    """(left, right, wraps): columns of a panorama that show a bearing, ``half`` degrees to each side, in the image whose
    left ``shift`` has been moved to its right end. ``wraps`` is true where the range runs over the edge; then left is
    larger than right and the view is two pieces, from left to the end and from the start to right.
    """
    turn = geo.floored_mod(bearing - heading + 180, 360.0)  # 0 at the panorama's left edge, which looks back
    at = lambda d: F.floor(geo.floored_mod(geo.floored_mod(turn + d, 360.0) / 360 - shift, 1.0) * width).cast("long")
    left, right = at(-half), at(half)
    return F.struct(left.alias("left"), right.alias("right"), (left > right).alias("wraps"))


def view_rows(height: Column, share: float = 0.7) -> Column:
    """Rows that a view keeps: the upper share of the image."""
    return F.floor(height * share).cast("long")


def decode_uint16(column: Column | str) -> Column:
    """Numbers of binary data of little-endian 16-bit whole numbers; a last odd byte counts for nothing."""

    @pandas_udf("array<int>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 2 * 2], "<u2").astype(np.int32))

    return run(column)


def decode_float32(column: Column | str) -> Column:
    """Numbers of binary data of little-endian 32-bit floats; last bytes short of a number count for nothing."""

    @pandas_udf("array<double>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4").astype(np.float64))

    return run(column)


#: Depth that stands for none, and the step from one row to the next from which a profile breaks.
NO_DEPTH, BREAK = 255.0, 0.1


def profile_pieces(profiles: DataFrame, key: str, at: str = "y", depth: str = "depth") -> DataFrame:
    """(key, y, depth, piece): the rows of profiles that lie in unbroken pieces without missing depths.

    A row is smooth if its step to the next is below ``BREAK``; stretches of smooth rows are pieces, those with a missing
    depth go whole. The last row of a profile, which has no next, is of no piece.
    """
    along = Window.partitionBy(key).orderBy(at)
    told = profiles.withColumn("__next", F.lead(depth).over(along)).where("__next is not null").withColumn("__s", F.abs(F.col("__next") - F.col(depth)) < BREAK)
    turned = F.when(F.col("__s") == F.lag("__s", 1, True).over(along), 0).otherwise(1)
    marked = told.withColumn("__new", turned).withColumn("piece", F.sum("__new").over(along))
    whole = F.max((F.col(depth) == NO_DEPTH).cast("int")).over(Window.partitionBy(key, "piece"))
    return marked.withColumn("__none", whole).where(F.col("__s") & (F.col("__none") == 0)).select(key, at, depth, "piece")


def profile_fits(profiles: DataFrame, key: str, at: str = "y", depth: str = "depth") -> DataFrame:
    """(key, piece, slope, intercept, residual): the line, of those fitted to each piece of a profile, that is taken for all.

    A line's residual is the sum of its squared errors over all kept rows of the profile, which sums of powers give. In
    order of pieces, a line is taken if its residual is below that of the piece before; the last one taken stays.
    """
    kept = profile_pieces(profiles, key, at, depth)
    x, y = F.col(at).cast("double"), F.col(depth).cast("double")
    mean_x, mean_y = F.avg(x), F.avg(y)
    # about the profile's own mean, for precision
    mid = kept.groupBy(key).agg(mean_x.alias("__mx"), mean_y.alias("__my"))
    own = kept.join(mid, key).select(key, "piece", (x - F.col("__mx")).alias("x"), (y - F.col("__my")).alias("y"), "__mx", "__my")
    per = own.groupBy(key, "piece").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.first("__mx").alias("mx"), F.first("__my").alias("my"))
    whole = per.groupBy(key).agg(*(F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy", "syy")))
    slope = F.coalesce((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0)), F.lit(0.0))
    lines = per.withColumn("slope", slope).withColumn("b", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).join(whole, key)
    a, b = F.col("slope"), F.col("b")
    residual = F.col("t_syy") - 2 * a * F.col("t_sxy") - 2 * b * F.col("t_sy") + a * a * F.col("t_sxx") + 2 * a * b * F.col("t_sx") + b * b * F.col("t_n")
    told = lines.withColumn("residual", F.round(residual, 9))
    last = F.lag("residual").over(Window.partitionBy(key).orderBy("piece"))
    taken = told.withColumn("__t", F.coalesce(F.col("residual") < last, F.lit(True)))
    values = ["piece", "slope", "intercept", "residual"]
    named = taken.where("__t").withColumn("intercept", b + F.col("my") - a * F.col("mx"))
    return named.groupBy(key).agg(F.max_by(F.struct(*values), "piece").alias("v")).select(key, "v.*")


def facade_heights(fits: DataFrame, facades: DataFrame, key: str) -> DataFrame:
    """(key, eave, ridge, pitch): heights in feet from the depths that a profile's line gives at the top and the bottom of a
    facade, and the angles that the image shows them at.

    ``facades``: (key, rows of the profile, top and bottom as rows of the image, image_height, eave_rows, roof_rows, run).
    The eave is round(1), the ridge round(1) and the pitch round(2), as inventories have them.
    """
    met = facades.join(fits.select(key, "slope", "intercept"), key)
    angle = lambda y: (F.col("image_height") / 2 - F.col(y)) / (F.col("image_height") / 2) * pi / 2
    depth = lambda y: F.col("slope") * y + F.col("intercept")
    eave = (depth(F.lit(0)) * F.sin(angle("top")) - depth(F.col("rows") - 1) * F.sin(angle("bottom"))) * geo.FT_PER_M
    told = met.withColumn("__e", eave).withColumn("__r", (F.col("eave_rows") + F.col("roof_rows")) * F.col("__e") / F.nullif(F.col("eave_rows"), F.lit(0)))
    return told.select(key, F.bround("__e", 1).alias("eave"), F.bround("__r", 1).alias("ridge"), F.bround((F.col("__r") - F.col("__e")) / F.nullif(F.col("run"), F.lit(0.0)), 2).alias("pitch"))


def eave_box(facade: Column, roof: Column) -> Column:
    """The box of a facade that begins where its roof ends: (x1, y1, x2, y2), y downwards."""
    return F.struct(facade["x1"].alias("x1"), roof["y2"].alias("y1"), facade["x2"].alias("x2"), facade["y2"].alias("y2"))


Point = tuple[float, float]
RADIAN = pi / 180


def _feet(p: Point, q: Point) -> float:
    y0, x0, y1, x1 = (v * RADIAN for v in (*p, *q))
    a = sin((y1 - y0) / 2) ** 2 + cos(y0) * cos(y1) * sin((x1 - x0) / 2) ** 2
    return 2 * geo.RADIUS_FT * asin(sqrt(a))


def _slope(p: Point, q: Point) -> float:
    return np.inf if q[0] == p[0] else (q[1] - p[1]) / (q[0] - p[0])


def front_line(ring: list[Point], seen: list[tuple[Point, Point]], camera: Point) -> tuple[Point, Point] | None:
    """The line of a building's front from the edges that a camera sees; points are (latitude, longitude), the ring is closed.

    Of edges within half of the first one's slope and the others the longer set stays. Its edge with the vertex nearest to
    the camera is the front; it is drawn out to the two vertices furthest apart, north and south or east and west: where
    such a vertex isn't its own, to where it meets the unseen edge there. None where slopes aren't finite or level.
    """
    if not seen:
        return None
    line = seen[0]
    if len(seen) > 1:
        slopes = [_slope(*e) for e in seen]
        if not all(map(isfinite, slopes)) or slopes[0] == 0:
            return None
        like = [abs((s - slopes[0]) / slopes[0]) < 0.5 for s in slopes]
        sets = [[e for e, k in zip(seen, like, strict=True) if k is own] for own in (True, False)]
        long = [sum(_feet(*e) for e in s) for s in sets]
        kept = sets[0] if long[0] > long[1] else sets[1]
        front = min(kept, key=lambda e: min(_feet(camera, e[0]), _feet(camera, e[1])))
        ends = [e[0] for e in kept] + [e[1] for e in kept]
        pairs = [(max(ends, key=lambda p: p[0]), min(ends, key=lambda p: p[0])), (min(ends, key=lambda p: p[1]), max(ends, key=lambda p: p[1]))]
        rough = pairs[0] if _feet(*pairs[0]) > _feet(*pairs[1]) else pairs[1]

        def drawn_out(v: Point) -> Point:
            at = ring.index(v)
            before = ring[at - 1] if at else ring[-2]
            other = ring[at + 1] if (before, v) in kept or (v, before) in kept else before
            m, n = _slope(*front), _slope(v, other)
            if not isfinite(n):
                return v[0], m * (v[0] - front[0][0]) + front[0][1]
            x = (m * front[0][0] - n * other[0] - front[0][1] + other[1]) / (m - n) if m != n else np.nan
            return x, m * (x - front[0][0]) + front[0][1]

        line = tuple(v if v in front else drawn_out(v) for v in rough)
    slope = _slope(*line)
    return line if all(map(isfinite, (*line[0], *line[1], slope))) and round(abs(slope), 4) != 0 else None


def front_lines(views: DataFrame, key: str) -> DataFrame:
    """(key, lat1, lon1, lat2, lon2) of (key, ring, seen, lon, lat): the front of each footprint for its camera, null where it
    has none. ``seen``: the visible edges as an array of (a, b)."""
    kind = next(f.dataType for f in views.schema if f.name == key).simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = lambda p: (p["lat"], p["lon"])
        for b in batches:
            lines = [front_line([at(p) for p in r], [(at(e["a"]), at(e["b"])) for e in s], (y, x)) for r, s, x, y in zip(b["ring"], b["seen"], b["lon"], b["lat"], strict=True)]
            flat = [(None,) * 4 if v is None else (*map(float, v[0]), *map(float, v[1])) for v in lines]
            yield pd.DataFrame([(k, *v) for k, v in zip(b[key], flat, strict=True)], columns=[key, "lat1", "lon1", "lat2", "lon2"])

    return views.select(key, "ring", "seen", "lon", "lat").mapInPandas(run, f"{key} {kind}, lat1 double, lon1 double, lat2 double, lon2 double")


def seen_edges(ring: Column, camera: Column) -> Column:
    """The edges of a closed ring whose middle no other edge hides from a camera."""

    def free(e: Column, edges: Column) -> Column:
        middle = geo.point((e["a"]["lon"] + e["b"]["lon"]) / 2, (e["a"]["lat"] + e["b"]["lat"]) / 2)
        return ~F.exists(edges, lambda o: ((o["a"] != e["a"]) | (o["b"] != e["b"])) & geo.segments_intersect(camera, middle, o["a"], o["b"]))

    return geo.once(geo.segments(ring), lambda edges: F.filter(edges, lambda e: free(e, edges)))


def camera_parameters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, foot_lat, foot_lon, distance_ft, plane_lat1, plane_lon1, plane_lat2, plane_lon2, fov, scale_ft, heading) of a
    camera (lat, lon) that looks at a line (lat1, lon1, lat2, lon2): the foot of the perpendicular from the camera to it,
    the plane of the image, which reaches from the end further from the foot as far to the other side, the field of view
    in tens of degrees, at most 120, then with the plane that this shows, feet in each of 640 columns, and the bearing.

    Null where the line is level or upright in degrees.
    """
    m = (F.col("lon1") - F.col("lon2")) / F.nullif(F.col("lat1") - F.col("lat2"), F.lit(0.0))
    slope = F.nullif(m, F.lit(0.0))
    x = slope / (1 + slope * slope) * (F.col("lat") / slope + slope * F.col("lat1") + F.col("lon") - F.col("lon1"))
    feet = lambda a, b: geo.haversine_ft(F.col(a[1]), F.col(a[0]), F.col(b[1]), F.col(b[0]))
    foot, cam, ends = ("foot_lat", "foot_lon"), ("lat", "lon"), (("lat1", "lon1"), ("lat2", "lon2"))
    at = rows.select(*keys, *cam, *ends[0], *ends[1], slope.alias("__m"), x.alias("foot_lat")).withColumn("foot_lon", F.col("__m") * (F.col("foot_lat") - F.col("lat1")) + F.col("lon1"))
    at = at.withColumns({"distance_ft": feet(cam, foot), "__d1": feet(foot, ends[0]), "__d2": feet(foot, ends[1])})
    first = F.col("__d1") >= F.col("__d2")
    at = at.withColumns({"__a": F.when(first, F.col("lat1")).otherwise(F.col("lat2")), "__b": F.when(first, F.col("lon1")).otherwise(F.col("lon2")), "__e": F.greatest("__d1", "__d2")})
    wide = F.ceil(2 * F.degrees(F.atan2("__e", "distance_ft")) / 10) * 10
    at = at.withColumns({"__w": wide, "__c": 2 * F.col("foot_lat") - F.col("__a"), "__f": 2 * F.col("foot_lon") - F.col("__b")})
    # beyond 120 degrees the plane is drawn in to what 120 show
    share = F.col("distance_ft") * F.tan(F.lit(pi / 3)) / (feet(("__a", "__b"), ("__c", "__f")) / 2)
    at = at.withColumn("__s", F.when(F.col("__w") > 120, share).otherwise(1.0))
    side = lambda f, v, sign: F.when(F.col("__w") > 120, F.col(f) + sign * F.col("__s") * (F.col(f) - F.col(v))).otherwise(F.col(v) if sign < 0 else 2 * F.col(f) - F.col(v))
    at = at.withColumns({"plane_lat1": side("foot_lat", "__a", -1), "plane_lon1": side("foot_lon", "__b", -1), "plane_lat2": side("foot_lat", "__a", 1), "plane_lon2": side("foot_lon", "__b", 1)})
    out = {"fov": F.least(F.col("__w"), F.lit(120)).cast("long"), "scale_ft": feet(("plane_lat1", "plane_lon1"), ("plane_lat2", "plane_lon2")) / 640, "heading": F.bround(geo.bearing_deg(F.col("lon"), F.col("lat"), F.col("foot_lon"), F.col("foot_lat")), 2)}
    return at.withColumns(out).select(*keys, "foot_lat", "foot_lon", "distance_ft", "plane_lat1", "plane_lon1", "plane_lat2", "plane_lon2", *out)
