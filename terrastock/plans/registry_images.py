"""Queries over images and rasters: anchors, parts of rasters, pairing, depth profiles, fronts, weighted draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastock.functions import geo, parse
from terrastock.operators import anchors, detection, draws, imagery, metrics, rasters
from terrastock.plans import views
from terrastock.plans.registry import _BOXES, _HAV, _PTS, D, query
from terrastock.plans.registry_shapes import _TURNED

_KINDS = ", ".join(f"({k}, {s}, {D(repr(w))}, {D(repr(h))})" for k, s, w, h in anchors.kinds())
_ASSIGNED = f"""{_BOXES}, kinds(kind, stride, hw, hh) AS (VALUES {_KINDS}), sized AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, least(x2 - x1, 2 * hw) * least(y2 - y1, 2 * hh) AS shared FROM boxes, kinds),
near AS (SELECT * FROM sized WHERE shared >= {D(0.39)} * (area + 4 * hw * hh - shared)),
cols AS (SELECT *, unnest(range(greatest(0, cast(floor((x1 - hw) / stride) AS bigint)), least(512 // stride, cast(ceil((x2 + hw) / stride) AS bigint) + 1))) AS col FROM near),
cells AS (SELECT *, unnest(range(greatest(0, cast(floor((y1 - hh) / stride) AS bigint)), least(512 // stride, cast(ceil((y2 + hh) / stride) AS bigint) + 1))) AS "row" FROM cols),
laid AS (SELECT *, (col + 0.5::double) * stride - hw AS ax1, ("row" + 0.5::double) * stride - hh AS ay1, (col + 0.5::double) * stride + hw AS ax2, ("row" + 0.5::double) * stride + hh AS ay2 FROM cells),
over AS (SELECT *, greatest(least(x2, ax2) - greatest(x1, ax1), 0) * greatest(least(y2, ay2) - greatest(y1, ay1), 0) AS both_ FROM laid),
met AS (SELECT *, both_ / (area + (ax2 - ax1) * (ay2 - ay1) - both_) AS iou FROM over WHERE both_ / (area + (ax2 - ax1) * (ay2 - ay1) - both_) >= {D(0.4)}),
best AS (SELECT image, kind, col, "row", box_id, iou FROM met QUALIFY row_number() OVER (PARTITION BY image, kind, col, "row" ORDER BY iou DESC, box_id) = 1)"""


def _sized(s, d):
    boxes = views.boxes(s, d)
    images = boxes.select("image").distinct().withColumns({"width": F.lit(512), "height": F.lit(512)})
    return boxes, images


@query(f"""WITH {_ASSIGNED} SELECT image, box_id, count(*) FILTER (WHERE iou >= {D(0.5)}) AS shown, count(*) FILTER (WHERE iou < {D(0.5)}) AS ignored, count(DISTINCT kind) AS kinds, round(max(iou), 6) AS best FROM best GROUP BY 1, 2""")
def anchors_of_boxes(s, d):
    """How many anchors of the pyramid are assigned to each box, and how many of them show it."""
    got = anchors.assigned_anchors(*_sized(s, d))
    return got.groupBy("image", "box_id").agg(F.count_if(F.col("state") == 1).alias("shown"), F.count_if(F.col("state") == -1).alias("ignored"), F.count_distinct("kind").alias("kinds"), F.round(F.max("iou"), 6).alias("best"))


_LOSS = "-{a} * pow(1 - {r}, 2) * ln({r})"


@query(f"""WITH {_ASSIGNED}, per AS (SELECT image, count(*) FILTER (WHERE iou >= {D(0.5)}) AS shown, count(*) FILTER (WHERE iou < {D(0.5)}) AS ignored, sum(CASE WHEN iou >= {D(0.5)} THEN {_LOSS.format(a=D(0.25), r='(0.25::double + iou / 2)')} ELSE 0 END) AS own FROM best GROUP BY 1),
i AS (SELECT DISTINCT l_orderkey AS image FROM lineitem), n AS (SELECT sum(cnt) AS anchors FROM (SELECT (512 // stride) * (512 // stride) AS cnt FROM kinds))
SELECT image, coalesce(shown, 0) AS shown, coalesce(ignored, 0) AS ignored, round((coalesce(own, 0) + (anchors - coalesce(shown, 0) - coalesce(ignored, 0)) * ({_LOSS.format(a=D(0.75), r=D(0.99))})) / greatest(coalesce(shown, 0), 1), 5) AS loss FROM i CROSS JOIN n LEFT JOIN per USING (image)""")
def losses_of_images(s, d):
    """Focal loss of each image, where anchors score a quarter and half of their overlap, all others 0.01."""
    boxes, images = _sized(s, d)
    got = anchors.image_losses(anchors.assigned_anchors(boxes, images), images, 0.25 + F.col("iou") / 2, 0.01)
    return got.withColumn("loss", F.round("loss", 5))


_CELLS = f"cells AS (SELECT DISTINCT c_nationkey AS image, least(cast(floor((lat - {D(37.5)}) / {D(0.025)}) AS bigint), 19) AS r, least(cast(floor((lon - {D(-122.5)}) / {D(0.025)}) AS bigint), 19) AS c FROM customer_pts)"


def _cells(s, d):
    """Cells of 1/40 degree that hold customers, an image for each nation."""
    at = lambda x, lo: F.least(F.floor((F.col(x) - lo) / 0.025), F.lit(19))
    return views.points(s, d, "customer", "c_nationkey as image").select("image", at("lat", 37.5).alias("row"), at("lon", -122.5).alias("col"))


_PARTS = f"""WITH RECURSIVE {_PTS['customer']}, {_CELLS}, reach AS (SELECT image, r, c, r AS r0, c AS c0 FROM cells UNION SELECT a.image, b.r, b.c, a.r0, a.c0 FROM reach a JOIN cells b ON a.image = b.image AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
named AS (SELECT image, r, c, min(r0 * 100 + c0) AS part FROM reach GROUP BY 1, 2, 3), parts AS (SELECT image, part // 100 AS part_row, part % 100 AS part_col, count(*) AS cells, min(r) AS min_row, min(c) AS min_col, max(r) AS max_row, max(c) AS max_col FROM named GROUP BY image, part)"""
_BOXED = ("cells", "min_row", "min_col", "max_row", "max_col")


@query(f"{_PARTS} SELECT * FROM parts")
def parts_of_rasters(s, d):
    """Connected parts of the cells that customers of each nation occupy."""
    return rasters.connected_parts(_cells(s, d)).select("image", F.col("part.row").alias("part_row"), F.col("part.first").alias("part_col"), *_BOXED)


@query(f"{_PARTS} SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY image ORDER BY cells DESC, part_row, part_col) = 1")
def largest_parts(s, d):
    """The largest connected part of each raster, its area and box."""
    return rasters.largest_parts(_cells(s, d)).select("image", F.col("part.row").alias("part_row"), F.col("part.first").alias("part_col"), *_BOXED)


_TURN = "(({x}) - {y} * floor(({x}) / {y}))"
_SPIN = _TURN.format(x="bearing - heading + 180", y=D(360))


def _at(d: int) -> str:
    inner = _TURN.format(x=f"{_SPIN} + {d}", y=D(360))
    return f"cast(floor({_TURN.format(x=f'{inner} / {D(360)} - {D(0.25)}', y=D(1))} * 4096) AS bigint)"


_PAIRED = f"""{_PTS['customer']}, {_PTS['supplier']}, p AS (SELECT c_custkey, s_suppkey, c.lon AS lon, c.lat AS lat, s.lon AS rlon, s.lat AS rlat, s_nationkey * 14 AS heading, {_HAV.format(a='c.', b='s.')} AS d FROM customer_pts c, supplier_pts s WHERE abs(c.lat - s.lat) < 0.05),
n AS (SELECT * FROM p WHERE d <= 15000 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) = 1)"""
_BEARING = "degrees(atan2(sin(radians(lon - rlon)) * cos(radians(lat)), cos(radians(rlat)) * sin(radians(lat)) - sin(radians(rlat)) * cos(radians(lat)) * cos(radians(lon - rlon))))"


@query(f"""WITH {_PAIRED} SELECT s_suppkey AS image, count(*) AS n, string_agg(c_custkey::varchar, ',' ORDER BY c_custkey) AS buildings, round(min(d), 4) AS nearest_ft FROM n GROUP BY 1""")
def buildings_by_image(s, d):
    """Each image with the buildings that it is the nearest one to."""
    images = views.points(s, d, "supplier").select(F.col("s_suppkey").alias("image"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    got = imagery.footprints_by_image(views.points(s, d, "customer"), images, 15000, "c_custkey")
    return got.select("image", "n", F.array_join("footprints", ",").alias("buildings"), F.round("nearest_ft", 4).alias("nearest_ft"))


@query(f"""WITH {_PAIRED}, b AS (SELECT *, {_TURN.format(x=_BEARING, y=D(360))} AS bearing FROM n), v AS (SELECT s_suppkey AS image, c_custkey, {_at(-10)} AS left_, {_at(10)} AS right_ FROM b)
SELECT image, c_custkey, left_ AS "left", right_ AS "right", left_ > right_ AS wraps, cast(floor((1000 + image % 7) * {D(0.7)}) AS bigint) AS "rows" FROM v""")
def views_of_buildings(s, d):
    """V9: columns and rows of a panorama that show each building, round its edge too."""
    images = views.points(s, d, "supplier", "s_nationkey * 14 as heading").select(F.col("s_suppkey").alias("image"), "heading", F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    homes = views.points(s, d, "customer")
    got = imagery.footprints_by_image(homes, images, 15000, "c_custkey").select("image", F.explode("footprints").alias("c_custkey"))
    met = got.join(images, "image").join(homes, "c_custkey")
    seen = imagery.columns_in_view(geo.bearing_deg(F.col("rlon"), F.col("rlat"), F.col("lon"), F.col("lat")), F.col("heading"), F.lit(4096))
    return met.select("image", "c_custkey", seen.alias("v"), imagery.view_rows(1000 + F.col("image") % 7).alias("rows")).select("image", "c_custkey", "v.*", "rows")


def _profiles(s, d):
    """A depth profile for each user: depths of events in their order, a break where the step is large, none where it is 255."""
    e = views.table(s, d, "events")
    from pyspark.sql import Window

    along = Window.partitionBy("user_id").orderBy("event_id")
    depth = F.when(F.col("event_id") % 17 == 0, 255.0).otherwise(F.floor(F.col("event_id") / 40) * 3 + F.col("value") / 2000)
    return e.select("user_id", (F.row_number().over(along) - 1).alias("y"), depth.alias("depth"))


_PROFILE = f"""f AS (SELECT user_id, row_number() OVER w - 1 AS y, CASE WHEN event_id % 17 = 0 THEN 255::double ELSE floor(event_id / {D(40)}) * 3 + value / 2000 END AS depth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, abs(lead(depth) OVER w - depth) < {D(0.1)} AS smooth, lead(depth) OVER w AS nxt FROM f WINDOW w AS (PARTITION BY user_id ORDER BY y)), h AS (SELECT * FROM g WHERE nxt IS NOT NULL),
i AS (SELECT *, CASE WHEN smooth = lag(smooth, 1, true) OVER w THEN 0 ELSE 1 END AS b FROM h WINDOW w AS (PARTITION BY user_id ORDER BY y)), j AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY y) AS piece FROM i),
kept AS (SELECT * FROM j WHERE smooth QUALIFY max(CASE WHEN depth = 255 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, piece) = 0)"""


@query(f"WITH {_PROFILE} SELECT user_id, cast(piece AS bigint) AS piece, count(*) AS n, cast(min(y) AS bigint) AS first, cast(max(y) AS bigint) AS last FROM kept GROUP BY 1, 2")
def pieces_of_profiles(s, d):
    """V6: unbroken pieces of depth profiles."""
    got = imagery.profile_pieces(_profiles(s, d), "user_id")
    return got.groupBy("user_id", "piece").agg(F.count("*").alias("n"), F.min("y").cast("long").alias("first"), F.max("y").cast("long").alias("last"))


@query()
def heights_of_facades(s, d):
    """Eave, ridge and pitch by the line of each profile, where the profile has a piece; tested against a plain loop."""
    profiles = _profiles(s, d)
    rows = profiles.groupBy("user_id").agg(F.count("*").alias("rows"))
    facades = rows.select("user_id", "rows", F.lit(200).alias("top"), (200 + F.col("rows")).alias("bottom"), F.lit(1000).alias("image_height"), F.col("rows").alias("eave_rows"), (F.col("user_id") % 50 + 5).alias("roof_rows"), (F.col("user_id") % 30 + 12).cast("double").alias("run"))
    return imagery.facade_heights(imagery.profile_fits(profiles, "user_id"), facades, "user_id")


@query("SELECT event_id, event_id % 65536 AS a, event_id * 7 % 65536 AS b, 65535 - event_id % 65536 AS c, cast(cast(value AS FLOAT) AS DOUBLE) AS x, cast(cast(-value / 3 AS FLOAT) AS DOUBLE) AS y FROM events")
def decoded_numbers(s, d):
    """X11: little-endian bytes of whole numbers and floats, made of events by hexadecimal text, read back."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def floats(v):
        import numpy as np

        return v.map(lambda x: np.array([np.float32(x), np.float32(-x / 3)], "<f4").tobytes())

    k = F.col("event_id")
    low_high = lambda x: F.concat(F.lpad(F.hex((x % 256).cast("long")), 2, "0"), F.lpad(F.hex(F.floor(x / 256)), 2, "0"))
    shorts = F.unhex(F.concat(*(low_high(x) for x in (k % 65536, k * 7 % 65536, 65535 - k % 65536))))
    got = views.table(s, d, "events").select("event_id", imagery.decode_uint16(shorts).alias("shorts"), imagery.decode_float32(floats("value")).alias("floats"))
    return got.select("event_id", *(F.get("shorts", F.lit(i)).cast("long").alias(n) for i, n in enumerate("abc")), *(F.get("floats", F.lit(i)).alias(n) for i, n in enumerate("xy")))


@query()
def fronts_of_footprints(s, d):
    """the front of each turned footprint for the image nearest to it; tested against cases drawn by hand."""
    fps = views.turned_footprints(s, d)
    middle = fps.select("bldg_id", F.inline(F.array(geo.ring_centroid(F.col("ring")))))
    images = views.points(s, d, "supplier").select(F.col("s_suppkey").alias("image"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    near = imagery.footprints_by_image(middle, images, 15000).select("image", F.explode("footprints").alias("bldg_id"))
    met = near.join(images, "image").hint("merge").join(fps, "bldg_id").withColumnsRenamed({"rlon": "lon", "rlat": "lat"})
    seen = imagery.seen_edges(F.col("ring"), geo.point(F.col("lon"), F.col("lat")))
    return imagery.front_lines(met.withColumn("seen", seen), "bldg_id")


@query()
def parts_drawn_by_size(s, d):
    """A part for each order, the larger the likelier; tested by shares, alike in every run."""
    orders = views.table(s, d, "orders").select("o_orderkey")
    return draws.weighted_draws(views.table(s, d, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", orders, "o_orderkey", seed=5)


_FEET = "2 * 3958.8::double * 5280 * asin(sqrt(pow(sin(radians({q0} - {p0}) / 2), 2) + cos(radians({p0})) * cos(radians({q0})) * pow(sin(radians({q1} - {p1}) / 2), 2)))"


def _feet(p: str, q: str) -> str:
    (p0, p1), (q0, q1) = p.split(), q.split()
    return _FEET.format(p0=p0, p1=p1, q0=q0, q1=q1)


_HEAD = "degrees(atan2(sin(radians(fy - lon)) * cos(radians(fx)), cos(radians(lat)) * sin(radians(fx)) - sin(radians(lat)) * cos(radians(fx)) * cos(radians(fy - lon))))"


@query(f"""WITH {_TURNED[: _TURNED.index("rs AS (")].rstrip().rstrip(",")}, e AS (SELECT t.bldg_id, ring[1].lat AS lat1, ring[1].lon AS lon1, ring[2].lat AS lat2, ring[2].lon AS lon2, p.lat - ((t.bldg_id % 9) + 1) / {D(20000)} AS lat, p.lon - ((t.bldg_id % 7) + 1) / {D(20000)} AS lon FROM turned t JOIN tp p USING (bldg_id)),
m AS (SELECT *, (lon1 - lon2) / (lat1 - lat2) AS m FROM e), f AS (SELECT *, m / (1 + m * m) * (lat / m + m * lat1 + lon - lon1) AS fx FROM m), g AS (SELECT *, m * (fx - lat1) + lon1 AS fy FROM f),
d AS (SELECT *, {_feet('lat lon', 'fx fy')} AS dist, {_feet('fx fy', 'lat1 lon1')} AS d1, {_feet('fx fy', 'lat2 lon2')} AS d2 FROM g), s AS (SELECT *, CASE WHEN d1 >= d2 THEN lat1 ELSE lat2 END AS a, CASE WHEN d1 >= d2 THEN lon1 ELSE lon2 END AS b, greatest(d1, d2) AS ext FROM d),
w AS (SELECT *, ceil(2 * degrees(atan2(ext, dist)) / 10) * 10 AS w, 2 * fx - a AS c, 2 * fy - b AS h FROM s), k AS (SELECT *, CASE WHEN w > 120 THEN dist * tan(pi() / 3) / ({_feet('a b', 'c h')} / 2) ELSE 1 END AS k FROM w),
q AS (SELECT *, CASE WHEN w > 120 THEN fx - k * (fx - a) ELSE a END AS px, CASE WHEN w > 120 THEN fy - k * (fy - b) ELSE b END AS py, CASE WHEN w > 120 THEN fx + k * (fx - a) ELSE c END AS qx, CASE WHEN w > 120 THEN fy + k * (fy - b) ELSE h END AS qy FROM k)
SELECT bldg_id, round(fx, 6) AS foot_lat, round(fy, 6) AS foot_lon, round(dist, 2) AS distance_ft, cast(least(w, 120) AS bigint) AS fov, round({_feet('px py', 'qx qy')} / 640, 4) AS scale_ft, round_even({_TURN.format(x=_HEAD, y=D(360))}, 2) AS heading FROM q""")
def cameras_of_fronts(s, d):
    """foot, distance, field of view, scale and heading of a camera beside each turned footprint's first edge."""
    fps = views.turned_footprints(s, d).join(views.points(s, d, "part").withColumnRenamed("p_partkey", "bldg_id"), "bldg_id")
    end = lambda i, k: F.get("ring", F.lit(i))[k]
    rows = fps.select("bldg_id", end(0, "lat").alias("lat1"), end(0, "lon").alias("lon1"), end(1, "lat").alias("lat2"), end(1, "lon").alias("lon2"), (F.col("lat") - ((F.col("bldg_id") % 9) + 1) / F.lit(20000.0)).alias("lat"), (F.col("lon") - ((F.col("bldg_id") % 7) + 1) / F.lit(20000.0)).alias("lon"))
    got = imagery.camera_parameters(rows, ["bldg_id"])
    return got.select("bldg_id", *(F.round(c, n).alias(c) for c, n in (("foot_lat", 6), ("foot_lon", 6), ("distance_ft", 2))), "fov", F.round("scale_ft", 4).alias("scale_ft"), "heading")


@query("""WITH q AS (SELECT vec_id AS query_id, label AS truth, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT query_id, vec_id, label, list_dot_product(q::double[], embedding::double[]) AS sim FROM q, embeddings WHERE vec_id <> query_id),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 50), t AS (SELECT query_id, label, sum(exp(sim / 0.07)) AS s FROM k GROUP BY 1, 2), r AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label) AS r FROM t)
SELECT round(avg(coalesce(r <= 1, false)::int), 6) AS top_1, round(avg(coalesce(r <= 5, false)::int), 6) AS top_5 FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.label = q.truth""")
def accuracy_of_neighbours(s, d):
    """How often the true class is the best, or among the best five, of fifty neighbours."""
    e = views.table(s, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("truth"))
    scores = metrics.weighted_knn(asked.drop("truth"), e.select("vec_id", F.col("embedding").alias("v"), "label"), 50, 0.07)
    return metrics.top_k_accuracy(scores, asked.select("query_id", "truth")).select(F.round("top_1", 6).alias("top_1"), F.round("top_5", 6).alias("top_5"))


@query("""SELECT c_nationkey AS category_id, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (1, 2, 3) AND n_nationkey NOT IN (2, 3) GROUP BY 1""")
def annotations_of_categories(s, d):
    """Annotations by supercategory and by id; nations are categories, regions supercategories."""
    nations = views.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("supercategory"))
    rows = views.table(s, d, "customer").select(F.col("c_nationkey").alias("category_id"), "c_custkey")
    got = detection.of_categories(rows, nations, supercategories=["1", "2", "3"], ids=[k for k in range(25) if k not in (2, 3)])
    return got.groupBy("category_id").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_size AS floors, p_size * 4 AS height, cast(1900 + p_partkey % 120 AS integer) AS "year" FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0""")
def buildings_of_pages(s, d):
    """Floors, height and year read off a page of cells for each part, of those in the United States that have all."""
    row = lambda label, value: F.concat(F.lit(f"<tr>\n<TH class='k'> {label} </TH><td>"), value, F.lit("</td></tr>"))
    k = F.col("p_partkey")
    country = F.when(k % 3 == 0, "Canada").otherwise("<a href='/us'>United States</a> ")
    floors = F.when(k % 4 == 0, "unknown").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" above ground")))
    html = F.concat(F.lit("<table>"), row("Country", country), row("Floors", floors), row("Height", F.concat((F.col("p_size") * 4).cast("string"), F.lit(" ft"))), row("Year", (1900 + k % 120).cast("string")), F.lit("</table>"))
    read = views.table(s, d, "part").select("p_partkey", parse.building_of_page(html).alias("b")).where("b.country = 'United States' and b.floors is not null and b.height is not null and b.year is not null")
    return read.select("p_partkey", "b.floors", "b.height", "b.year")
