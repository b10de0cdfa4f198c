"""Geometry as column expressions. A ring or line is an array of (lon, lat) structs; all is row by row."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: units and radii that results are defined with
FT_PER_M = 3.28084
RADIUS_FT = 3958.8 * 5280
RADIUS_KM_FT = 6371.0 * 3280.84
AREA_RADIUS_FT = 20925721.784777
EQUATOR_M = 40075000.0
METERS_PER_DEGREE = 111111.0


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def floored_mod(x: Column, y: float) -> Column:
    return x - y * F.floor(x / y)


def _half_chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def haversine_ft(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return 2 * RADIUS_FT * F.asin(F.sqrt(_half_chord(lon1, lat1, lon2, lat2)))


def haversine_km_ft(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Feet by the radius in kilometres and the two-argument arc tangent."""
    a = _half_chord(lon1, lat1, lon2, lat2)
    return 2 * RADIUS_KM_FT * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def segments(line: Column) -> Column:
    """Consecutive point pairs (a, b) of a line; none for fewer than two points."""
    heads = F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))
    return F.zip_with(heads, F.slice(line, 2, F.size(line)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def line_length_ft(line: Column) -> Column:
    return _total(segments(line), lambda s: haversine_ft(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"]))


def ring_bbox(ring: Column) -> Column:
    side = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(side(F.array_min, "lon").alias("min_lon"), side(F.array_min, "lat").alias("min_lat"), side(F.array_max, "lon").alias("max_lon"), side(F.array_max, "lat").alias("max_lat"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once: inside functions on arrays a column's expression would be for each item."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centre of a closed ring, taken about its first point for precision."""
    return once(ring, _centroid)


def _centroid(ring: Column) -> Column:
    lon0, lat0 = ring[0]["lon"], ring[0]["lat"]
    x, y = (lambda p: p["lon"] - lon0), (lambda p: p["lat"] - lat0)
    cross = lambda s: x(s["a"]) * y(s["b"]) - x(s["b"]) * y(s["a"])
    twice = _total(segments(ring), cross)
    mean = lambda f: _total(segments(ring), lambda s: (f(s["a"]) + f(s["b"])) * cross(s)) / (3 * twice)
    return point(lon0 + mean(x), lat0 + mean(y))


def spherical_area_ft2(ring: Column) -> Column:
    """Area of a closed ring on the sphere, from colatitudes and azimuths about the pole of longitude and latitude 0."""
    phi, lam = (lambda p: F.radians(p["lat"])), (lambda p: F.radians(p["lon"]))

    def chord(p: Column) -> Column:
        a, b = F.sin(phi(p) / 2), F.sin(lam(p) / 2)
        return a * a + F.cos(phi(p)) * b * b

    colat = lambda p: 2 * F.atan2(F.sqrt(chord(p)), F.sqrt(1 - chord(p)))
    azimuth = lambda p: floored_mod(F.atan2(F.cos(phi(p)) * F.sin(lam(p)), F.sin(phi(p))), 2 * pi)
    polar = F.transform(ring, lambda p: F.struct(azimuth(p).alias("lon"), colat(p).alias("lat")))

    def part(s: Column) -> Column:
        turn = floored_mod(s["b"]["lon"] - s["a"]["lon"] + pi, 2 * pi) - pi
        return (1 - F.cos((s["a"]["lat"] + s["b"]["lat"]) / 2)) * turn

    share = F.abs(_total(segments(polar), part)) / (4 * pi)
    return F.least(share, 1 - share) * 4 * pi * AREA_RADIUS_FT**2


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting to the east over the edges of a closed ring."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"])

    return F.size(F.filter(segments(ring), lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180) / 360 * 2**zoom).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    return F.floor((1 - F.asinh(F.tan(F.radians(lat))) / pi) / 2 * 2**zoom).cast("long")


def tile_lon(x: Column, zoom: int) -> Column:
    return x / float(2**zoom) * 360 - 180


def tile_lat(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(pi - 2 * pi * y / float(2**zoom))))


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Base-4 digits of the interleaved bits of a tile, read as a decimal number, so leading zeros vanish."""
    digit = lambda i: (2 * F.shiftright(y, i).bitwiseAND(F.lit(1)) + F.shiftright(x, i).bitwiseAND(F.lit(1))) * F.lit(10**i).cast("long")
    total = digit(0)
    for i in range(1, zoom):
        total = total + digit(i)
    return total.cast("long")


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return floored_mod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))), 360.0)


def orientation(p: Column, q: Column, r: Column) -> Column:
    """0 on one line, 1 clockwise, 2 counter-clockwise."""
    v = (q["lat"] - p["lat"]) * (r["lon"] - q["lon"]) - (q["lon"] - p["lon"]) * (r["lat"] - q["lat"])
    return F.when(v > 0, 1).when(v < 0, 2).otherwise(0)


def segments_intersect(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segments ab and cd meet, touching and overlapping included."""
    on = lambda p, q, r: q["lon"].between(F.least(p["lon"], r["lon"]), F.greatest(p["lon"], r["lon"])) & q["lat"].between(F.least(p["lat"], r["lat"]), F.greatest(p["lat"], r["lat"]))
    o1, o2, o3, o4 = orientation(a, b, c), orientation(a, b, d), orientation(c, d, a), orientation(c, d, b)
    return ((o1 != o2) & (o3 != o4)) | ((o1 == 0) & on(a, c, b)) | ((o2 == 0) & on(a, d, b)) | ((o3 == 0) & on(c, a, d)) | ((o4 == 0) & on(c, b, d))


def circle(lon: Column, lat: Column, radius_ft: float, points: int = 100) -> Column:
    """A closed ring of ``points`` vertices, first and last alike, at a radius in degrees of both axes; from the north on."""
    r, step = F.degrees(F.lit(radius_ft / AREA_RADIUS_FT)), 2 * pi / (points - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: point(lon + r * F.sin(step * i), lat + r * F.cos(step * i)))


def padded_bbox(ring: Column, share: float = 0.1) -> Column:
    """The ring's box with a share of its own width and height added on each side."""
    b = ring_bbox(ring)
    w, h = b["max_lon"] - b["min_lon"], b["max_lat"] - b["min_lat"]
    return F.struct((b["min_lon"] - share * w).alias("min_lon"), (b["min_lat"] - share * h).alias("min_lat"), (b["max_lon"] + share * w).alias("max_lon"), (b["max_lat"] + share * h).alias("max_lat"))


def tile_range(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, zoom: int) -> Column:
    """Array of (x, y): all tiles that a box meets."""
    xs, ys = F.sequence(tile_x(min_lon, zoom), tile_x(max_lon, zoom)), F.sequence(tile_y(max_lat, zoom), tile_y(min_lat, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def best_zoom(longest_ft: Column) -> Column:
    """The zoom at which 640 pixels hold a length, rounded up only from nine tenths on."""
    exact = F.log2(F.lit(40075 * 3280.84) / (longest_ft * 256 / 640))
    return F.when(exact - F.floor(exact) < 0.9, F.floor(exact)).otherwise(F.round(exact)).cast("long")


def three_point_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Degrees from ray ba to ray bc, against the clock, at least 0."""
    angle = F.degrees(F.atan2(cy - by, cx - bx) - F.atan2(ay - by, ax - bx))
    return F.when(angle < 0, angle + 360).otherwise(angle)


def angle_from_heading(x: Column, y: Column, heading: Column) -> Column:
    """The clockwise angle of a point as seen from the origin along a heading, negative to its left."""
    zero = F.lit(0.0)
    angle = 360 - three_point_angle(F.sin(F.radians(heading)), F.cos(F.radians(heading)), zero, zero, x, y)
    return F.when(angle <= 180, angle).otherwise(angle - 360)


def buffered_bbox(ring: Column, meters: float) -> Column:
    b, d = ring_bbox(ring), meters / METERS_PER_DEGREE
    return F.struct((b["min_lon"] - d).alias("min_lon"), (b["min_lat"] - d).alias("min_lat"), (b["max_lon"] + d).alias("max_lon"), (b["max_lat"] + d).alias("max_lat"))


def dms_to_decimal(deg: Column, minute: Column, second: Column, hemisphere: Column) -> Column:
    return (deg + minute / 60 + second / 3600) * F.when(hemisphere.isin("S", "W"), -1).otherwise(1)


def local_ft(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Feet east and north of a point, by the cosine of the mean latitude."""
    per = EQUATOR_M * FT_PER_M / 360
    return F.struct(((lon - lon0) * per * F.cos(F.radians((lat + lat0) / 2))).alias("x"), ((lat - lat0) * per).alias("y"))


def view_columns(heading: Column, width: Column) -> Column:
    """Columns of a panorama that show an angle from the heading, ten degrees to both sides."""
    at = F.bround(heading, -1)
    edge = lambda d: F.rint((at + d + 180) / 360 * width)
    return F.struct(edge(-10).alias("left"), edge(10).alias("right"))


def rounded(x: Column | str, places: int) -> Column:
    """A number times a power of ten, rounded with halves away from zero, and divided again, as SQL rounds; no decimal text is made."""
    y = (F.col(x) if isinstance(x, str) else x) * float(10**places)
    whole = F.rint(y)
    return F.when(F.abs(y - whole) == 0.5, F.signum(y) * (F.floor(F.abs(y)) + 1)).otherwise(whole) / float(10**places)


def seven_places(x: Column) -> Column:
    """A number's text with seven places, rounded by its exact value, halves to even, as C and SQL print it. Formatting by
    ``format_string`` rounds the shortest decimal text instead, which turns some numbers just below a half upwards."""
    return F.call_function("format_number", x, F.lit("0.0000000"))


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), seven_places(lon), F.lit(" "), seven_places(lat), F.lit(")"))


def wkt_line(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat(seven_places(p["lon"]), F.lit(" "), seven_places(p["lat"]))), ", "), F.lit(")"))


def split_line(start: Column, end: Column, parts: Column, part: Column) -> Column:
    """The ``part``-th (from 0) of equal parts of a segment."""
    at = lambda f: point(start["lon"] + (end["lon"] - start["lon"]) * f, start["lat"] + (end["lat"] - start["lat"]) * f)
    return F.array(at(part / parts), at((part + 1) / parts))


def clip_segment(a: Column, b: Column, min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """The part (a, b) of a segment inside a box, null where it stays outside: the parameter's range is cut at each side."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    low, high, inside = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for p, d, lo, hi in ((a["lon"], dx, min_lon, max_lon), (a["lat"], dy, min_lat, max_lat)):
        s, t = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        low.append(F.least(s, t))
        high.append(F.greatest(s, t))
        inside = inside & ((d != 0) | p.between(lo, hi))
    t0, t1 = F.greatest(*low), F.least(*high)
    at = lambda t: point(a["lon"] + t * dx, a["lat"] + t * dy)
    return F.when(inside & (t0 <= t1), F.struct(at(t0).alias("a"), at(t1).alias("b")))


def rings_intersect(r: Column, s: Column) -> Column:
    """Whether two closed rings share a point: edges that meet, or one ring inside the other."""
    meet = F.exists(segments(r), lambda e: F.exists(segments(s), lambda f: segments_intersect(e["a"], e["b"], f["a"], f["b"])))
    return meet | point_in_ring(r[0]["lon"], r[0]["lat"], s) | point_in_ring(s[0]["lon"], s[0]["lat"], r)


def field_of_view(width: Column, distance: Column) -> Column:
    """Degrees that show a width at a distance, rounded up to tens, at most 120."""
    return F.least(F.ceil(2 * F.degrees(F.atan2(width / 2, distance)) / 10) * 10, F.lit(120)).cast("long")


def roof_pitch(eave: Column, ridge: Column, run: Column) -> Column:
    """Rise of a roof over its run, to two places; null without a run."""
    return F.round((ridge - eave) / F.nullif(run, F.lit(0.0)), 2)
