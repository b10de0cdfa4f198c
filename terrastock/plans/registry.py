"""Queries over the test tables, one or more for each operator, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastock.functions import geo, parse
from terrastock.operators import detection, fusion, graph, metrics, spatial
from terrastock.plans import views
from terrastock.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


D = "cast({} as double)".format
_PTS = {n: f"{n}_pts AS (SELECT *, {views.lon_sql(views.KEY[n], n)} AS lon, {views.lat_sql(views.KEY[n], n)} AS lat FROM {n})" for n in views.KEY}
_FPS = f"{_PTS['part']}, fps AS (SELECT p_partkey AS bldg_id, lon AS cx, lat AS cy, (1 + p_size) / {D(2000)} AS h, lon - (1 + p_size) / {D(2000)} AS x0, lon + (1 + p_size) / {D(2000)} AS x1, lat - (1 + p_size) / {D(2000)} AS y0, lat + (1 + p_size) / {D(2000)} AS y1, p_retailprice, p_size, p_type, p_brand FROM part_pts)"
_HAV = "2 * 3958.8::double * 5280 * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))"
_ROADS = (
    f"placed AS (SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos, l_partkey,"
    f" {views.lon_sql('l_orderkey', 'orders')} + ((l_partkey % 11) - 5) / {D(1000)} AS lon, {views.lat_sql('l_orderkey', 'orders')} + ((l_suppkey % 11) - 5) / {D(1000)} AS lat FROM lineitem JOIN orders ON o_orderkey = l_orderkey),"
    " segs AS (SELECT line_id, pos AS part, lon AS alon, lat AS alat, lead(lon) OVER w AS blon, lead(lat) OVER w AS blat FROM placed WINDOW w AS (PARTITION BY line_id ORDER BY pos) QUALIFY blon IS NOT NULL)"
)
_SEG_HAV = _HAV.format(a="a", b="b").replace("alat", "alat")
_BOXES = "boxes AS (SELECT l_orderkey AS image, cast(l_linenumber * 1000000 + l_partkey AS bigint) AS box_id, cast(l_partkey * 13 % 500 AS double) AS x1, cast(l_suppkey * 37 % 500 AS double) AS y1, cast(l_partkey * 13 % 500 + 5 AS double) + l_quantity AS x2, cast(l_suppkey * 37 % 500 + 5 AS double) + l_quantity AS y2, 1 - l_discount AS score, l_returnflag AS label FROM lineitem)"
_JUDGED = "judged AS (SELECT doc_id, quality AS truth, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS pred, toxic FROM labels JOIN documents USING (doc_id))"


def _customers(s: SparkSession, d: str, *more: str) -> DataFrame:
    return views.points(s, d, "customer", *more)


def _suppliers(s: SparkSession, d: str) -> DataFrame:
    return views.points(s, d, "supplier").withColumnsRenamed({"lon": "rlon", "lat": "rlat"})


@query(f"""WITH {_FPS}, {_PTS['customer']}, m AS (SELECT bldg_id, min(c_custkey) AS struct_id FROM fps JOIN customer_pts ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY bldg_id)
SELECT f.bldg_id, m.struct_id, coalesce(f.p_type, c.c_mktsegment) AS occupancy, coalesce(c.c_acctbal, f.p_retailprice) AS repaircost, f.p_size AS numstories FROM fps f LEFT JOIN m USING (bldg_id) LEFT JOIN customer c ON c.c_custkey = m.struct_id""")
def nsi_point_in_envelope(s, d):
    """The first structure in each footprint's envelope, its value before the footprint's."""
    fps = views.footprints(s, d)
    points = _customers(s, d, "c_custkey as struct_id", "c_acctbal as value", "c_mktsegment as segment")
    first = spatial.first_in_rings(fps.select("bldg_id", "ring"), points, "bldg_id", "struct_id")
    return fps.join(first, "bldg_id", "left").select("bldg_id", "struct_id", F.coalesce("occupancy", "segment").alias("occupancy"), F.coalesce("value", "repaircost").alias("repaircost"), "numstories")


@query(f"WITH {_FPS}, {_PTS['customer']} SELECT bldg_id, c_custkey FROM fps JOIN customer_pts ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
def point_in_polygon_exact(s, d):
    """J1 contains, P8."""
    return spatial.keys_in_rings(views.footprints(s, d), _customers(s, d), "bldg_id", "c_custkey")


_ROI = [(-122.45, 37.55), (-122.1, 37.6), (-122.2, 37.9), (-122.45, 37.55)]
_CROSS = " + ".join(f"CASE WHEN ({D(a[1])} > lat) <> ({D(b[1])} > lat) AND lon < ({D(b[0])} - {D(a[0])}) * (lat - {D(a[1])}) / ({D(b[1])} - {D(a[1])}) + {D(a[0])} THEN 1 ELSE 0 END" for a, b in zip(_ROI, _ROI[1:], strict=False))


@query(f"WITH {_PTS['customer']} SELECT c_custkey FROM customer_pts WHERE ({_CROSS}) % 2 = 1")
def roi_filter(s, d):
    """J3, P7."""
    return spatial.points_in_roi(_customers(s, d), _ROI).select("c_custkey")


@query(f"WITH {_PTS['customer']}, {_PTS['supplier']} SELECT c_custkey, s_suppkey, round({_HAV.format(a='c.', b='s.')}, 4) AS dist_ft FROM customer_pts c, supplier_pts s WHERE {_HAV.format(a='c.', b='s.')} <= 15000")
def haversine_pairs(s, d):
    """F1."""
    return spatial.pairs_within(_customers(s, d), _suppliers(s, d), 15000).select("c_custkey", "s_suppkey", F.round("dist_ft", 4).alias("dist_ft"))


@query(f"WITH {_PTS['customer']}, {_PTS['supplier']}, p AS (SELECT c_custkey, s_suppkey, {_HAV.format(a='c.', b='s.')} AS d FROM customer_pts c, supplier_pts s) SELECT c_custkey, s_suppkey, round(d, 4) AS dist_ft FROM p WHERE d <= 15000 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) = 1")
def nearest_within_radius(s, d):
    """J10."""
    got = spatial.nearest_within(_customers(s, d), _suppliers(s, d), 15000, "c_custkey", "s_suppkey")
    return got.select("c_custkey", "s_suppkey", F.round("dist_ft", 4).alias("dist_ft"))


@query(f"""WITH {_FPS}, {_PTS['customer']}, near AS (SELECT bldg_id, c_custkey, lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 AS inside, row_number() OVER (PARTITION BY bldg_id ORDER BY (lon - x0) * (lon - x0) + (lat - y0) * (lat - y0), c_custkey) AS r
FROM fps, customer_pts)
SELECT bldg_id, c_custkey, inside FROM near WHERE r <= 10 QUALIFY row_number() OVER (PARTITION BY bldg_id ORDER BY NOT inside, r) = 1""")
def knn_contains_preference(s, d):
    """J11."""
    return spatial.knn_prefer_inside_all(views.footprints(s, d).select("bldg_id", "ring"), _customers(s, d), "bldg_id", "c_custkey")


@query()
def knn_contains_preference_all(s, d):
    """J11 from a reach of its own; tested against brute force."""
    return spatial.knn_prefer_inside_all(views.footprints(s, d).select("bldg_id", "ring"), _customers(s, d), "bldg_id", "c_custkey", reach=0.05)


@query(f"WITH {_FPS} SELECT bldg_id, round(cx, 6) AS lon, round(cy, 6) AS lat FROM fps")
def ring_centroid(s, d):
    """F4."""
    return views.footprints(s, d).select("bldg_id", geo.ring_centroid(F.col("ring")).alias("c")).select("bldg_id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query(f"WITH {_FPS} SELECT bldg_id, x0 AS min_lon, y0 AS min_lat, x1 AS max_lon, y1 AS max_lat FROM fps")
def ring_bbox(s, d):
    """F5, A1."""
    return views.footprints(s, d).select("bldg_id", geo.ring_bbox(F.col("ring")).alias("b")).select("bldg_id", "b.*")


_COLAT = "2 * atan2(sqrt(q), sqrt(1 - q))"


@query(f"""WITH {_FPS}, v AS (SELECT bldg_id, unnest([x0, x1, x1, x0, x0]) AS lon, unnest([y0, y0, y1, y1, y0]) AS lat, unnest([0, 1, 2, 3, 4]) AS k FROM fps),
w AS (SELECT bldg_id, k, pow(sin(radians(lat) / 2), 2) + cos(radians(lat)) * pow(sin(radians(lon) / 2), 2) AS q, atan2(cos(radians(lat)) * sin(radians(lon)), sin(radians(lat))) AS a0 FROM v),
x AS (SELECT bldg_id, k, {_COLAT} AS c, a0 - 2 * pi() * floor(a0 / (2 * pi())) AS az FROM w),
y AS (SELECT bldg_id, (c + lead(c) OVER o) / 2 AS m, lead(az) OVER o - az + pi() AS t FROM x WINDOW o AS (PARTITION BY bldg_id ORDER BY k)),
z AS (SELECT bldg_id, abs(sum((1 - cos(m)) * (t - 2 * pi() * floor(t / (2 * pi())) - pi()))) / (4 * pi()) AS share FROM y WHERE m IS NOT NULL GROUP BY bldg_id)
SELECT bldg_id, cast(round(least(share, 1 - share) * 4 * pi() * pow({D(20925721.784777)}, 2) / 1000) AS bigint) AS area_kft2 FROM z""")
def spherical_area(s, d):
    """F3, in thousands of square feet."""
    return views.footprints(s, d).select("bldg_id", F.round(geo.spherical_area_ft2(F.col("ring")) / 1000).cast("long").alias("area_kft2"))


_TX, _TY = "cast(floor((lon + 180) / 360 * 512) AS bigint)", "cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 512) AS bigint)"


@query(f"WITH {_PTS['customer']} SELECT c_custkey, {_TX} AS x, {_TY} AS y FROM customer_pts")
def tile_xy(s, d):
    """F7."""
    return _customers(s, d).select("c_custkey", geo.tile_x(F.col("lon"), 9).alias("x"), geo.tile_y(F.col("lat"), 9).alias("y"))


@query(f"WITH {_PTS['customer']}, t AS (SELECT DISTINCT {_TX} AS x, {_TY} AS y FROM customer_pts) SELECT x, y, round(x / {D(512)} * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() - 2 * pi() * y / {D(512)}))), 6) AS north FROM t")
def tile_bbox(s, d):
    """F8, F9."""
    return tile_xy(s, d).select("x", "y").distinct().select("x", "y", F.round(geo.tile_lon(F.col("x"), 9), 6).alias("west"), F.round(geo.tile_lat(F.col("y"), 9), 6).alias("north"))


_QK = "list_sum(list_transform(range(9), lambda i: (2 * ((y >> i) & 1) + ((x >> i) & 1)) * cast(pow(10, i) AS bigint)))"


@query(f"WITH {_PTS['customer']}, t AS (SELECT c_custkey, {_TX} AS x, {_TY} AS y FROM customer_pts) SELECT c_custkey, cast({_QK} AS bigint) AS quadkey FROM t")
def quadkey(s, d):
    """F10."""
    return tile_xy(s, d).select("c_custkey", geo.quadkey(F.col("x"), F.col("y"), 9).alias("quadkey"))


@query(f"WITH {_PTS['customer']}, t AS (SELECT c_custkey, {_TX} AS x, {_TY} AS y FROM customer_pts), q AS (SELECT c_custkey, cast({_QK} AS bigint) AS quadkey, c_custkey % 97 + 1 AS mb FROM t) SELECT quadkey, 'u' || c_custkey AS url FROM q QUALIFY row_number() OVER (PARTITION BY quadkey ORDER BY mb DESC, url) = 1")
def quadkey_prune(s, d):
    """The largest file of each tile."""
    links = quadkey(s, d).select("quadkey", F.concat(F.lit("u"), F.col("c_custkey")).alias("url"), F.concat(F.col("c_custkey") % 97 + 1, F.lit(".0MB")).alias("size"))
    return readers.largest_file_by_tile(links).select("quadkey", "url")


@query(f"""WITH {_PTS['customer']} SELECT least(cast(floor((lat - 37.5::double) / (0.5::double / 7)) AS bigint), 6) AS mesh_row, least(cast(floor((lon + 122.5::double) / (0.5::double / 5)) AS bigint), 4) AS mesh_col, count(*) AS n
FROM customer_pts WHERE lon BETWEEN -122.5 AND -122.0 AND lat BETWEEN 37.5 AND 38.0 GROUP BY 1, 2""")
def mesh_counts(s, d):
    """One round."""
    return spatial.mesh_counts(_customers(s, d), -122.5, 37.5, -122.0, 38.0, 7, 5)


@query()
def adaptive_mesh(s, d):
    """P5: cells with at most 40 points."""
    return spatial.adaptive_mesh(_customers(s, d), (-122.5, 37.5, -122.0, 38.0), 40)


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' ELSE NULL END, lang) AS mark FROM documents LEFT JOIN labels USING (doc_id)")
def attr_fusion_coalesce(s, d):
    """NA does not override."""
    base = views.table(s, d, "documents").select("doc_id", F.col("lang").alias("mark"))
    source = views.table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("NA").alias("mark"))
    return fusion.fuse(base, source, "doc_id", ["mark"])


@query("SELECT doc_id, coalesce(cast(quality AS varchar), source) AS mark FROM documents LEFT JOIN labels USING (doc_id)")
def prediction_merge(s, d):
    """J6, J19."""
    rows = views.table(s, d, "documents").select("doc_id", F.col("source").alias("mark"))
    pred = views.table(s, d, "labels").select(F.col("doc_id").alias("image"), F.col("quality").cast("string").alias("prediction"), F.lit(1.0).alias("probability"))
    return fusion.merge_predictions(rows, pred, "doc_id", "mark").select("doc_id", "mark")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_last_wins(s, d):
    """A5."""
    return fusion.keep_one(views.table(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"], last=True).drop("ts")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first_wins(s, d):
    """A4."""
    return fusion.keep_one(views.table(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(f"SELECT p_partkey, round(p_retailprice * {D(0.3048)} / 1000, 6) AS km, round(p_size * {D(0.0254)} / {D(0.3048)}, 6) AS ft FROM part")
def unit_convert(s, d):
    """M1."""
    part = views.table(s, d, "part")
    return part.select("p_partkey", F.round(parse.convert_units(F.col("p_retailprice"), F.lit("ft"), "km"), 6).alias("km"), F.round(parse.convert_units(F.col("p_size"), F.lit("inch"), "ft"), 6).alias("ft"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1900 + p_partkey % 100 END AS yr, CASE upper(substr(p_type, 1, 1)) WHEN 'M' THEN 'RM1' ELSE upper(substr(p_type, 1, 1)) || '1' END AS cls, split_part(p_brand, '#', 1) AS occ FROM part")
def attribute_parse(s, d):
    """X1, X2, X4, X5."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "ca. 19").otherwise(F.concat(F.lit("built "), 1900 + k % 100, F.lit("-01-01")))
    cls = F.upper(F.substring("p_type", 1, 1))
    return views.table(s, d, "part").select("p_partkey", parse.parse_year(text).cast("long").alias("yr"), parse.structure_class(cls).alias("cls"), parse.occupancy_class(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("occ"))


_CLS = "['S1100', 'S1200', 'S1400', 'S1500', 'S1740'][cast(substr(o_orderpriority, 1, 1) AS int)]"


@query(f"WITH c AS (SELECT o_orderkey, {_CLS} AS cls FROM orders) SELECT o_orderkey, CASE cls WHEN 'S1100' THEN 'primary' WHEN 'S1200' THEN 'secondary' WHEN 'S1400' THEN 'residential' ELSE 'unclassified' END AS road_type, CASE cls WHEN 'S1100' THEN 4 WHEN 'S1200' THEN 2 ELSE 1 END AS lanes, CASE cls WHEN 'S1100' THEN 70 WHEN 'S1200' THEN 55 WHEN 'S1740' THEN 10 ELSE 25 END AS mph, CASE cls WHEN 'S1100' THEN 7200 WHEN 'S1200' THEN 3600 ELSE 1800 END AS capacity FROM c")
def road_lookup(s, d):
    """G16, X16, M3."""
    cls = F.expr("element_at(array('S1100','S1200','S1400','S1500','S1740'), cast(substr(o_orderpriority, 1, 1) as int))")
    lanes = parse.lookup(parse.LANES, cls)
    return views.table(s, d, "orders").select("o_orderkey", parse.lookup(parse.ROAD_TYPE, cls).alias("road_type"), lanes.alias("lanes"), parse.lookup(parse.SPEED, cls).alias("mph"), (lanes * parse.LANE_CAPACITY).alias("capacity"))


@query("SELECT s_suppkey, s_nationkey * 100 + s_suppkey % 10 AS bridge_class, 'BRIDGE' AS kind FROM supplier")
def bridge_format(s, d):
    """G17, M6."""
    return views.table(s, d, "supplier").select("s_suppkey", parse.bridge_class(F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 10).cast("string")).cast("long").alias("bridge_class"), F.lit("BRIDGE").alias("kind"))


def _segments(s, d):
    return graph.explode_segments(views.roads(s, d))


@query(f"WITH {_ROADS} SELECT line_id, part, round(alon, 6) AS a_lon, round(blat, 6) AS b_lat FROM segs")
def explode_segments(s, d):
    """G1, W6."""
    return _segments(s, d).select("line_id", "part", F.round("a.lon", 6).alias("a_lon"), F.round("b.lat", 6).alias("b_lat"))


_NODE = "printf('%.7f', {p}lon) || ' ' || printf('%.7f', {p}lat)"


@query(f"WITH {_ROADS}, e AS (SELECT line_id, alon AS lon, alat AS lat FROM segs UNION ALL SELECT line_id, blon, blat FROM segs) SELECT {_NODE.format(p='')} AS node, count(*) AS degree, min(line_id) AS first_line FROM e GROUP BY 1")
def graph_nodes(s, d):
    """G2, G14."""
    return graph.graph_nodes(_segments(s, d)).select("node", "degree", "first_line")


_LEN = _HAV.replace("{a}", "a").replace("{b}", "b")


@query(f"WITH {_ROADS} SELECT line_id, part, {_NODE.format(p='a')} AS node_start, {_NODE.format(p='b')} AS node_end, round({_LEN}, 3) AS length_ft FROM segs")
def graph_edges(s, d):
    """G2, G15, F31."""
    return graph.graph_edges(_segments(s, d)).withColumn("length_ft", F.round("length_ft", 3))


@query(f"WITH {_ROADS} SELECT line_id, count(*) AS n, round(sum({_LEN}), 2) AS length_ft, round(sum({_LEN}) / {D(3.28084)} / (25 * ({D(1609.34)} / 3600)), 3) AS seconds FROM segs GROUP BY line_id")
def edge_fft(s, d):
    """A6, F28, M4."""
    length = F.col("length_ft")
    per = graph.graph_edges(_segments(s, d)).groupBy("line_id").agg(F.count("*").alias("n"), F.sum("length_ft").alias("length_ft"))
    return per.select("line_id", "n", F.round(length, 2).alias("length_ft"), F.round(parse.free_flow_seconds(length / geo.FT_PER_M, F.lit(25)), 3).alias("seconds"))


@query(f"WITH {_ROADS}, n AS (SELECT *, greatest(cast(ceil({_LEN} / 1000) AS int), 1) AS n FROM segs), p AS (SELECT *, unnest(range(n)) AS seg_id FROM n) SELECT line_id, part, seg_id, round(alon + (blon - alon) * (seg_id / n::double), 6) AS a_lon, round(alat + (blat - alat) * ((seg_id + 1) / n::double), 6) AS b_lat FROM p")
def split_long_edges(s, d):
    """G7, F29."""
    return graph.split_long_edges(_segments(s, d), 1000).select("line_id", "part", "seg_id", F.round("a.lon", 6).alias("a_lon"), F.round("b.lat", 6).alias("b_lat"))


@query(f"""WITH {_ROADS}, m AS (SELECT a.line_id AS left_id, b.line_id AS right_id, a.alon, a.alat, a.blon - a.alon AS rx, a.blat - a.alat AS ry, b.blon - b.alon AS sx, b.blat - b.alat AS sy, b.alon - a.alon AS ox, b.alat - a.alat AS oy FROM segs a JOIN segs b ON a.line_id < b.line_id AND least(a.alon, a.blon) <= greatest(b.alon, b.blon) AND least(b.alon, b.blon) <= greatest(a.alon, a.blon) AND least(a.alat, a.blat) <= greatest(b.alat, b.blat) AND least(b.alat, b.blat) <= greatest(a.alat, a.blat)),
k AS (SELECT *, (ox * sy - oy * sx) / nullif(rx * sy - ry * sx, 0) AS t, (ox * ry - oy * rx) / nullif(rx * sy - ry * sx, 0) AS u FROM m)
SELECT DISTINCT left_id, right_id, round(alon + t * rx, 7) AS lon, round(alat + t * ry, 7) AS lat FROM k WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""")
def line_intersections(s, d):
    """G8, J14, U7."""
    return graph.line_intersections(_segments(s, d), 0.005)


@query()
def line_intersections_all(s, d):
    """The query above, without SQL; tested against brute force."""
    return graph.line_intersections(_segments(s, d), 0.005)


@query()
def cut_lines(s, d):
    """G9, J15."""
    segs = _segments(s, d)
    met = graph.line_intersections(segs, 0.005)
    points = met.select(F.col("left_id").alias("line_id"), "lon", "lat").unionByName(met.select(F.col("right_id").alias("line_id"), "lon", "lat"))
    return graph.cut_segments(segs, points).select("line_id", "part", "piece", F.round("a.lon", 6).alias("a_lon"), F.round("b.lat", 6).alias("b_lat"))


@query()
def contract_degree2(s, d):
    """G3 to G6, over all roads."""
    return graph.contract_degree2(graph.graph_edges(_segments(s, d)).select(F.col("node_start").alias("u"), F.col("node_end").alias("v")))


@query(f"""WITH {_ROADS}, w AS (SELECT line_id, string_agg(printf('%.7f', lon) || ' ' || printf('%.7f', lat), ', ' ORDER BY pos) AS wkt, count(*) AS n FROM placed GROUP BY line_id HAVING n >= 2),
drawn AS (SELECT line_id, wkt FROM w UNION ALL SELECT -line_id, wkt FROM w WHERE line_id % 7 < 2), marked AS (SELECT *, line_id < 0 AND line_id % 7 = 0 AS matched FROM drawn),
sets AS (SELECT wkt, count(*) AS n, bool_or(matched) AS any_matched, min(line_id) AS first FROM marked GROUP BY wkt)
SELECT line_id FROM marked JOIN sets USING (wkt) WHERE n > 1 AND CASE WHEN any_matched THEN NOT matched ELSE line_id <> first END""")
def duplicate_lines(s, d):
    """Two of seven roads are drawn twice, the second time under their negative key; of these a half are matched."""
    roads = views.roads(s, d).select("line_id", "line")
    drawn = roads.unionByName(roads.where("line_id % 7 < 2").withColumn("line_id", -F.col("line_id")))
    return graph.repeated_lines(drawn, matched=drawn.where("line_id < 0 and line_id % 7 = 0").select("line_id"))


@query()
def name_match_tfidf(s, d):
    """suppliers' parts against the first parts of lines that meet the circle about them."""
    names = views.table(s, d, "part").select("p_partkey", "p_name")
    roads = views.roads(s, d)
    named = roads.select("line_id", F.col("first_part").alias("p_partkey")).join(names, "p_partkey", "left").select("line_id", F.col("p_name").alias("line_name"))
    bridges = views.points(s, d, "supplier").join(names, F.col("s_suppkey") == F.col("p_partkey")).select("s_suppkey", "lon", "lat", F.col("p_name").alias("point_name"))
    pairs = spatial.lines_near(bridges, graph.explode_segments(roads), 5000, "s_suppkey")
    return graph.match_names(pairs.join(bridges.drop("lon", "lat"), "s_suppkey").join(named, "line_id"), "s_suppkey", "line_id", "point_name", "line_name")


_TERMS = "regexp_extract_all(lower({}), '\\w\\w+')"


@query(f"""WITH b AS (SELECT s_suppkey, p_name AS a FROM supplier JOIN part ON p_partkey = s_suppkey), q AS (SELECT s_suppkey, p_partkey, {_TERMS.format('a')} AS x, {_TERMS.format('p_name')} AS y FROM b CROSS JOIN part),
n AS (SELECT s_suppkey, p_partkey, list_sum(list_transform(list_intersect(x, y), lambda t: (len(list_filter(x, lambda z: z = t)) * len(list_filter(y, lambda z: z = t)))::double)) AS dot,
sqrt(list_sum(list_transform(list_distinct(x), lambda t: pow(len(list_filter(x, lambda z: z = t)) * CASE WHEN list_contains(y, t) THEN 1 ELSE 1 + ln({D(1.5)}) END, 2)))) AS nx, sqrt(list_sum(list_transform(list_distinct(y), lambda t: pow(len(list_filter(y, lambda z: z = t)) * CASE WHEN list_contains(x, t) THEN 1 ELSE 1 + ln({D(1.5)}) END, 2)))) AS ny FROM q)
SELECT s_suppkey, p_partkey, round(dot / (nx * ny), 6) AS score FROM n WHERE dot > 0""")
def tfidf_similarity(s, d):
    """X6 of all suppliers and parts that share a term; any other pair scores 0."""
    part = views.table(s, d, "part")
    b = views.table(s, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select("s_suppkey", F.col("p_name").alias("a"))
    return graph.tfidf_pairs(b, part.select("p_partkey", "p_name"), "a", "p_name").select("s_suppkey", "p_partkey", F.round("score", 6).alias("score"))


@query()
def tfidf_similarity_all(s, d):
    """The query above, without SQL."""
    return tfidf_similarity(s, d)


@query("SELECT c_custkey AS k, c_acctbal AS v, 'P' AS layer FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'S' FROM supplier UNION ALL SELECT p_partkey, NULL, 'L' FROM part")
def union_tagged_layers(s, d):
    """U1 to U4."""
    pick = lambda n, k, *v: views.table(s, d, n).select(F.col(k).alias("k"), *(F.col(x).alias("v") for x in v))
    return fusion.union_tagged({"P": pick("customer", "c_custkey", "c_acctbal"), "S": pick("supplier", "s_suppkey", "s_acctbal"), "L": pick("part", "p_partkey")}, "layer").select("k", "v", "layer")


@query(f"WITH {_JUDGED} SELECT truth AS label, pred AS prediction, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM judged GROUP BY 1, 2")
def confusion_matrix(s, d):
    """A10."""
    return metrics.confusion_matrix(views.judged(s, d), "truth", "pred").withColumn("share", F.round("share", 6))


_PER = "per AS (SELECT c AS cls, count(*) FILTER (WHERE truth = c AND pred = c) AS tp, count(*) FILTER (WHERE truth <> c AND pred = c) AS fp, count(*) FILTER (WHERE truth = c AND pred <> c) AS fn FROM judged, (VALUES (0), (1)) v(c) GROUP BY c)"


@query(f"WITH {_JUDGED}, {_PER} SELECT cls, tp, fp, fn, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + 0.5 * (fp + fn)), 6) AS f1 FROM per")
def per_class_f1(s, d):
    """A11."""
    return metrics.per_class_scores(views.judged(s, d), "truth", "pred").withColumns({"recall": F.round("recall", 6), "f1": F.round("f1", 6)})


@query(f"WITH {_JUDGED}, {_PER}, f AS (SELECT *, tp / (tp + 0.5 * (fp + fn)) AS f1 FROM per) SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1 FROM f")
def accuracy(s, d):
    """A12, A13, A15."""
    df = metrics.overall_scores(views.judged(s, d), "truth", "pred")
    return df.select(*(F.round(c, 6).alias(c) for c in df.columns))


@query(f"WITH {_JUDGED}, {_PER} SELECT cls, tp AS intersection, tp + fp + fn AS union_, round(tp / (tp + fp + fn), 6) AS iou FROM per")
def iou_by_class(s, d):
    """A14."""
    return metrics.iou_by_class(views.judged(s, d), "truth", "pred").withColumn("iou", F.round("iou", 6))


@query("SELECT quality AS label, count(*) AS n, round(1 / count(*), 6) AS inverse, round(1 - count(*) / sum(count(*)) OVER (), 6) AS complement FROM labels GROUP BY 1")
def class_weights(s, d):
    """A20."""
    return metrics.class_weights(views.table(s, d, "labels"), "quality").select("label", "n", F.round("inverse", 6).alias("inverse"), F.round("complement", 6).alias("complement"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT query_id, vec_id, label, list_dot_product(q::double[], embedding::double[]) AS sim FROM q, embeddings WHERE vec_id <> query_id),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10), t AS (SELECT query_id, label, sum(exp(sim / 0.07)) AS s FROM k GROUP BY 1, 2)
SELECT query_id, label, round(s, 2) AS score FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label) = 1""")
def embedding_knn(s, d):
    """The class of the largest weight among ten neighbours."""
    e = views.table(s, d, "embeddings")
    scores = metrics.weighted_knn(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v"), "label"), 10, 0.07)
    best = scores.groupBy("query_id").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("label"))).alias("b"))
    return best.select("query_id", "b.label", F.round("b.score", 2).alias("score"))


@query()
def mahalanobis(s, d):
    """M9, A19."""
    return metrics.mahalanobis(views.table(s, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("m2", 4).alias("m2"))


@query(f"WITH {_BOXES} SELECT o_orderkey AS image, CASE WHEN max(score) > 0.95 THEN 1 ELSE 0 END AS prediction FROM orders LEFT JOIN boxes ON image = o_orderkey GROUP BY 1")
def presence_flag(s, d):
    """V3, P18."""
    return detection.presence(views.table(s, d, "orders").select(F.col("o_orderkey").alias("image")), views.boxes(s, d), 0.95)


@query()
def nms_boxes(s, d):
    """V1."""
    return detection.non_maximum_suppression(views.boxes(s, d))


@query()
def floor_count(s, d):
    """V4, F36."""
    return detection.floor_counts(views.boxes(s, d), 550)


@query(f"WITH {_BOXES}, u AS (SELECT DISTINCT * FROM boxes) SELECT DISTINCT p.image, p.box_id, q.box_id AS other_id FROM u p JOIN u q ON p.image = q.image AND p.box_id <> q.box_id WHERE greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0) > 0.1 * (p.x2 - p.x1) * (p.y2 - p.y1)")
def box_overlaps(s, d):
    """J16."""
    return detection.overlapping_boxes(views.boxes(s, d), 0.1).distinct()


@query(f"WITH {_BOXES} SELECT image FROM boxes WHERE score > 0.92 AND x2 - x1 >= 20 AND label IN ('A', 'R') GROUP BY image HAVING count(DISTINCT label) = 2")
def annotation_filter(s, d):
    """P16 to P19, J13, S21."""
    return detection.images_with_all(detection.clean_boxes(views.boxes(s, d), 0.92).where("x2 - x1 >= 20"), ["A", "R"])


@query(f"WITH {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id, x1, y1, x2, y2) AS k FROM boxes) SELECT image, max(score) AS top, count(*) AS n FROM r WHERE k <= 3 GROUP BY image")
def top_boxes(s, d):
    """W4, T5."""
    return detection.top_k(views.boxes(s, d), 3).groupBy("image").agg(F.max("score").alias("top"), F.count("*").alias("n"))


_BEAR = "degrees(atan2(sin(radians(d)) * cos(radians(p2)), cos(radians(p1)) * sin(radians(p2)) - sin(radians(p1)) * cos(radians(p2)) * cos(radians(d))))"


@query(f"WITH {_PTS['events']}, v AS (SELECT event_id, lat AS p1, {D(37.75)} AS p2, {D(-122.25)} - lon AS d FROM events_pts), b AS (SELECT event_id, {_BEAR} AS x FROM v) SELECT event_id, round(x - 360 * floor(x / 360), 4) AS bearing FROM b")
def bearing(s, d):
    """F23, F16."""
    return views.points(s, d, "events").select("event_id", F.round(geo.bearing_deg(F.col("lon"), F.col("lat"), F.lit(-122.25), F.lit(37.75)), 4).alias("bearing"))


@query("WITH h AS (SELECT event_id, round_even((value - 360 * floor(value / 360)), -1) AS a FROM events) SELECT event_id, cast(round_even((a - 10 + 180) / 360 * 2048, 0) AS bigint) AS lo, cast(round_even((a + 10 + 180) / 360 * 2048, 0) AS bigint) AS hi FROM h")
def crop_bounds(s, d):
    """F18, F13, V9."""
    e = views.table(s, d, "events").select("event_id", geo.view_columns(geo.floored_mod(F.col("value"), 360.0), F.lit(2048)).alias("v"))
    return e.select("event_id", F.col("v.left").cast("long").alias("lo"), F.col("v.right").cast("long").alias("hi"))


@query(f"WITH {_FPS}, c AS (SELECT bldg_id, {D(-122.25)} AS px, {D(37.75)} AS py, x0, x1, y0, y1 FROM fps) SELECT bldg_id, unnest([0, 1, 2, 3]) AS edge, unnest([py < y0 OR within_, px > x1 OR within_, py > y1 OR within_, px < x0 OR within_]) AS seen FROM (SELECT *, px > x0 AND px < x1 AND py > y0 AND py < y1 AS within_ FROM c)")
def visible_edges(s, d):
    """Edges whose midpoint is seen from a camera outside the ring."""
    cam = geo.point(F.lit(-122.25), F.lit(37.75))
    segs = geo.segments(F.col("ring"))
    edges = views.footprints(s, d).select("bldg_id", segs.alias("all"), F.posexplode(segs).alias("edge", "s"))
    mid = geo.point((F.col("s.a.lon") + F.col("s.b.lon")) / 2, (F.col("s.a.lat") + F.col("s.b.lat")) / 2)
    blocked = F.exists(F.filter("all", lambda o: (o["a"] != F.col("s.a")) | (o["b"] != F.col("s.b"))), lambda o: geo.segments_intersect(cam, mid, o["a"], o["b"]))
    return edges.select("bldg_id", "edge", (~blocked).alias("seen"))


@query("""WITH m AS (SELECT user_id, event_id, value, CASE WHEN abs(value - lag(value) OVER w) < 20 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT user_id, value, event_id, b, row_number() OVER () AS z FROM m),
j AS (SELECT m.user_id, m.value, m.event_id::double AS x, sum(m.b) OVER (PARTITION BY m.user_id ORDER BY e.ts, m.event_id ROWS UNBOUNDED PRECEDING) AS island FROM m JOIN events e USING (event_id))
SELECT user_id, cast(island AS bigint) AS island, count(*) AS n, round(regr_slope(value, x) + 1e-9, 5) AS slope FROM j GROUP BY 1, 2 HAVING count(*) >= 2""")
def gaps_islands_fit(s, d):
    """W3, F34."""
    e = views.table(s, d, "events").select("user_id", "ts", "event_id", "value", F.col("event_id").cast("double").alias("x"))
    return metrics.islands(e, "user_id", ["ts", "event_id"], "x", "value", 20).where("n >= 2").select("user_id", "island", "n", F.round(F.col("slope") + 1e-9, 5).alias("slope"))  # off the ties of rounding, where sums in another order differ


@query(f"WITH {_PTS['customer']}, {_PTS['supplier']}, p AS (SELECT c_acctbal - s_acctbal AS z, {_HAV.format(a='c.', b='s.')} AS d FROM customer_pts c, supplier_pts s) SELECT cast(floor(d / 3000) AS bigint) AS bin, count(*) AS n, round(avg(z * z) / 2, 2) AS gamma FROM p WHERE d <= 15000 GROUP BY 1")
def semivariogram(s, d):
    """A23."""
    right = views.points(s, d, "supplier", "s_acctbal").withColumnsRenamed({"lon": "rlon", "lat": "rlat"})
    pairs = spatial.pairs_within(_customers(s, d, "c_acctbal"), right, 15000)
    return metrics.semivariogram(pairs, "c_acctbal", "s_acctbal", "dist_ft", 3000).withColumn("gamma", F.round("gamma", 2))


_ORDER = "((c_custkey * 2654435761 + 7 * 40503) % 4294967291), c_custkey"


@query(f"SELECT c_custkey FROM customer ORDER BY {_ORDER} LIMIT 50")
def sample_random(s, d):
    """A sampling operator."""
    return fusion.sample(views.table(s, d, "customer").select("c_custkey"), "c_custkey", 50, 7)


@query(f"SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_ORDER}) <= 10")
def sample_stratified(s, d):
    """T3, T9, U8."""
    return fusion.stratified_sample(views.table(s, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 10, 7)


@query("SELECT user_id, count(*) AS n, cast(sum(cast(json_extract_string(props, '$.k') AS bigint)) AS bigint) AS total FROM events GROUP BY 1")
def json_props(s, d):
    """S6, X12."""
    k = F.from_json("props", "k bigint")["k"]
    return views.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("SELECT p_partkey, [1960, 1975, 1985, 1995, 2005, 2015][p_size % 6 + 1] AS yr, cast(p_size + 256 * (p_size % 7) + 65536 * (p_size % 5) AS bigint) AS rgb, cast(ceil(p_size / 8::double) * 8 AS bigint) AS padded FROM part")
def era_and_codes(s, d):
    """V7, X18, M13."""
    z = F.col("p_size")
    return views.table(s, d, "part").select("p_partkey", parse.era_year(z % 6).alias("yr"), parse.rgb_class(z, z % 7, z % 5).cast("long").alias("rgb"), parse.round_up(z, 8).cast("long").alias("padded"))


from terrastock.plans import inventory, registry_images, registry_more, registry_rest, registry_roads, registry_shapes  # noqa: E402, F401  further queries register themselves
