"""Further queries over the test tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrastock.functions import geo, parse
from terrastock.plans import views
from terrastock.plans.registry import _FPS, _PTS, D, query

_BOX = f"b AS (SELECT s_nationkey, min(lon) - {D(0.001)} AS x0, min(lat) - {D(0.001)} AS y0, max(lon) + {D(0.001)} AS x1, max(lat) + {D(0.001)} AS y1 FROM supplier_pts GROUP BY 1)"
_TX = "cast(floor(({} + 180) / 360 * 512) AS bigint)"
_TY = "cast(floor((1 - asinh(tan(radians({}))) / pi()) / 2 * 512) AS bigint)"


def _boxes(s, d):
    box = {"x0": F.min("lon") - 0.001, "y0": F.min("lat") - 0.001, "x1": F.max("lon") + 0.001, "y1": F.max("lat") + 0.001}
    return views.points(s, d, "supplier", "s_nationkey").groupBy("s_nationkey").agg(*(v.alias(k) for k, v in box.items()))


@query(f"WITH {_PTS['supplier']}, {_BOX} SELECT s_nationkey, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM b")
def padded_point_box(s, d):
    """P3."""
    return _boxes(s, d).select("s_nationkey", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"WITH {_PTS['supplier']}, {_BOX} SELECT s_nationkey, x, unnest(range({_TY.format('y1')}, {_TY.format('y0')} + 1)) AS y FROM (SELECT *, unnest(range({_TX.format('x0')}, {_TX.format('x1')} + 1)) AS x FROM b)")
def tile_range(s, d):
    """all tiles that each nation's box meets."""
    return _boxes(s, d).select("s_nationkey", F.inline(geo.tile_range(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 9)))


@query(f"WITH {_PTS['supplier']}, {_PTS['customer']}, {_BOX}, t AS (SELECT c_custkey, {_TX.format('lon')} AS x, {_TY.format('lat')} AS y, lon, lat FROM customer_pts) SELECT s_nationkey, count(*) AS n FROM b JOIN t ON x BETWEEN {_TX.format('x0')} AND {_TX.format('x1')} AND y BETWEEN {_TY.format('y1')} AND {_TY.format('y0')} AND lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1")
def tiles_pruned_scan(s, d):
    """Points of the tiles that a box meets, then of the box itself, by a join on the tile."""
    tiles = _boxes(s, d).select("*", F.inline(geo.tile_range(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 9)))
    points = views.points(s, d, "customer").withColumns({"x": geo.tile_x(F.col("lon"), 9), "y": geo.tile_y(F.col("lat"), 9)})
    return points.join(tiles, ["x", "y"]).where("lon between x0 and x1 and lat between y0 and y1").groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query(f"WITH {_FPS} SELECT bldg_id, round(x0 - {D(0.1)} * (x1 - x0), 7) AS x0, round(y0 - {D(0.1)} * (y1 - y0), 7) AS y0, round(x1 + {D(0.1)} * (x1 - x0), 7) AS x1, round(y1 + {D(0.1)} * (y1 - y0), 7) AS y1 FROM fps")
def padded_footprint(s, d):
    """F12."""
    b = geo.padded_bbox(F.col("ring"))
    return views.footprints(s, d).select("bldg_id", *(F.round(b[k], 7).alias(a) for a, k in (("x0", "min_lon"), ("y0", "min_lat"), ("x1", "max_lon"), ("y1", "max_lat"))))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN z - floor(z) < 0.9 THEN floor(z) ELSE round(z) END::bigint AS zoom FROM (SELECT *, log2(40075 * 3280.84::double / (l_quantity::double * 256 / 640)) AS z FROM lineitem)")
def best_zoom(s, d):
    """F14, of lengths in feet."""
    return views.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", geo.best_zoom(F.col("l_quantity").cast("double")).alias("zoom"))


@query(
    "WITH p AS (SELECT s_suppkey, (s_suppkey % 7 - 3)::double AS x, (s_suppkey % 5 + 1)::double AS y, (s_suppkey % 36 * 10)::double AS h FROM supplier), a AS (SELECT *, degrees(atan2(y, x)) AS t, degrees(atan2(y, x) - atan2(cos(radians(h)), sin(radians(h)))) AS r FROM p), v AS (SELECT *, 360 - CASE WHEN r < 0 THEN r + 360 ELSE r END AS w FROM a)"
    " SELECT s_suppkey, round(CASE WHEN t < 0 THEN t + 360 ELSE t END, 6) AS turned, CASE WHEN round(CASE WHEN w <= 180 THEN w ELSE w - 360 END, 6) = -180 THEN 180 ELSE round(CASE WHEN w <= 180 THEN w ELSE w - 360 END, 6) + 0.0::double END AS seen FROM v"
)
def view_angles(s, d):
    """F16, F17; straight behind is 180, whichever way rounding turns it."""
    k = F.col("s_suppkey")
    x, y, h, zero = (k % 7 - 3).cast("double"), (k % 5 + 1).cast("double"), (k % 36 * 10).cast("double"), F.lit(0.0)
    seen = F.round(geo.angle_from_heading(x, y, h), 6)
    turned = geo.three_point_angle(F.lit(1.0), zero, zero, zero, x, y)
    return views.table(s, d, "supplier").select("s_suppkey", F.round(turned, 6).alias("turned"), F.when(seen == -180, 180.0).otherwise(seen + 0.0).alias("seen"))


@query(f"WITH {_PTS['supplier']} SELECT s_suppkey, i, round(lon + degrees(500 / 20925721.784777::double) * sin(2 * pi() / 99 * i), 7) AS lon, round(lat + degrees(500 / 20925721.784777::double) * cos(2 * pi() / 99 * i), 7) AS lat FROM (SELECT *, unnest(range(100)) AS i FROM supplier_pts)")
def circles(s, d):
    """F27."""
    ring = geo.circle(F.col("lon"), F.col("lat"), 500)
    v = views.points(s, d, "supplier").select("s_suppkey", F.posexplode(ring).alias("i", "p"))
    return v.select("s_suppkey", F.col("i").cast("long").alias("i"), F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS piece FROM lineitem")
def renumber_pieces(s, d):
    """Pieces of each line numbered from 0."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return views.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(order) - 1).cast("long").alias("piece"))


@query("WITH u AS (SELECT p_brand, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1) SELECT p_brand, n, first_key, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM u")
def unique_codes(s, d):
    """Distinct values with counts, first keys and codes; the codes are numbered among the few distinct values."""
    values = views.table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))
    return values.withColumn("code", (F.dense_rank().over(Window.orderBy("p_brand")) - 1).cast("long"))


@query("SELECT s_suppkey, (p >= 0.5)::int AS cls, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 6) AS prob FROM (SELECT s_suppkey, 1 / (1 + exp(-s_acctbal::double / 3000)) AS p FROM supplier)")
def sigmoid_class(s, d):
    """A18."""
    p = 1 / (1 + F.exp(-F.col("s_acctbal").cast("double") / 3000))
    return views.table(s, d, "supplier").select("s_suppkey", (p >= 0.5).cast("int").alias("cls"), F.round(F.when(p >= 0.5, p).otherwise(1 - p), 6).alias("prob"))


@query("SELECT l_returnflag, round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0 END), 6) AS zero_share FROM lineitem GROUP BY 1")
def zero_fraction(s, d):
    """A21."""
    return views.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.when(F.col("l_discount") == 0, 1.0).otherwise(0.0)), 6).alias("zero_share"))


@query("SELECT o_custkey, max_by(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS largest FROM orders GROUP BY 1")
def largest_component(s, d):
    """The largest of each group, ties to the larger key."""
    return views.table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("largest"))


@query("SELECT o_orderstatus, upper(substr(lower(max(o_orderpriority)), 1, 1)) || substr(lower(max(o_orderpriority)), 2, 1) AS head, count(*) || CASE WHEN count(*) = 1 THEN ' order' ELSE ' orders' END AS said FROM orders GROUP BY 1")
def counts_said(s, d):
    """A24, X14."""
    return views.table(s, d, "orders").groupBy("o_orderstatus").agg(F.substring(F.initcap(F.max("o_orderpriority")), 1, 2).alias("head"), parse.plural(F.count("*"), "order").alias("said"))


@query("SELECT p_partkey, CASE WHEN mod(p_size, 4) = 2 THEN 2 * round(p_size / 8::double) ELSE round(p_size / 4::double) END::bigint AS lanes FROM part")
def lanes_each(s, d):
    """M5: a half goes to the even number."""
    return views.table(s, d, "part").select("p_partkey", parse.lanes_each(F.col("p_size").cast("string"), F.lit(4)).alias("lanes"))


@query("WITH y AS (SELECT p_partkey, (1955 + p_size)::double AS yr, unnest(range(6)) AS cls FROM part), w AS (SELECT *, exp(-pow((yr - [1960, 1975, 1985, 1995, 2005, 2015][cls + 1]) / 10, 2) / 2) AS e FROM y) SELECT p_partkey, cls, round(e / sum(e) OVER (PARTITION BY p_partkey), 6) AS weight FROM w")
def soft_labels(s, d):
    """M10."""
    weights = parse.soft_labels((1955 + F.col("p_size")).cast("double"))
    return views.table(s, d, "part").select("p_partkey", F.posexplode(weights).alias("cls", "weight")).select("p_partkey", F.col("cls").cast("long").alias("cls"), F.round("weight", 6).alias("weight"))


@query(f"WITH {_PTS['customer']} SELECT c_custkey, printf('img_%.6f_%.6f.png', lat, lon) AS name FROM customer_pts")
def image_names(s, d):
    """X9."""
    return views.points(s, d, "customer").select("c_custkey", parse.image_name("img", F.col("lat"), F.col("lon"), 6).alias("name"))


@query("SELECT p_partkey, p_name AS text FROM part")
def base64_round_trip(s, d):
    """Names written in the alphabet for addresses, without padding, and read again."""
    sent = F.replace(F.translate(F.base64(F.encode("p_name", "UTF-8")), "+/", "-_"), F.lit("="), F.lit(""))
    return views.table(s, d, "part").select("p_partkey", F.decode(parse.url_safe_base64(sent), "UTF-8").alias("text"))


@query(f"WITH {_PTS['supplier']} SELECT s_suppkey, unnest([0, 0, 1, 1]) AS part, unnest([0, 1, 0, 1]) AS pos, unnest([round(lon, 4), round(round(lon, 4) + 1, 4), round(lon, 4), round(round(lon, 4) - 1, 4)]) AS lon FROM supplier_pts")
def multiline_text(s, d):
    """Lines of a MultiLineString's text."""
    at = lambda d_: F.format_string("%.4f %.4f", F.round("lon", 4) + d_, F.col("lat"))
    text = F.concat(F.lit("MULTILINESTRING (("), at(0), F.lit(", "), at(1), F.lit("), ("), at(0), F.lit(", "), at(-1), F.lit("))"))
    lines = views.points(s, d, "supplier").select("s_suppkey", F.posexplode(parse.parse_multilinestring(text)).alias("part", "line"))
    return lines.select("s_suppkey", "part", F.posexplode("line").alias("pos", "p")).select("s_suppkey", "part", "pos", F.round("p.lon", 4).alias("lon"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def distinct_lists(s, d):
    """Lists of lists made flat, distinct and sorted."""
    lists = views.table(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.collect_list("o_orderpriority").alias("own"))
    flat = F.array_sort(F.array_distinct(F.flatten(F.collect_list("own"))))
    return lists.groupBy("o_custkey").agg(F.array_join(flat, ",").alias("kinds"), F.array_contains(flat, "1-URGENT").alias("urgent"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def missing_keys(s, d):
    """Customers without an urgent order."""
    return views.table(s, d, "customer").select("c_custkey").exceptAll(views.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("SELECT DISTINCT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_keys(s, d):
    """U6."""
    return views.table(s, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(views.table(s, d, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT c_custkey, CASE WHEN (c_custkey * 2654435761 + 3 * 40503) % 4294967291 % 5 = 0 THEN 'validation' ELSE 'train' END AS part FROM customer")
def train_split(s, d):
    """A fifth for validation, by a hash of the key."""
    place = (F.col("c_custkey").cast("decimal(38,0)") * 2654435761 + 3 * 40503) % 4294967291 % 5
    return views.table(s, d, "customer").select("c_custkey", F.when(place == 0, "validation").otherwise("train").alias("part"))


@query("WITH b AS (SELECT user_id, event_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events) SELECT event_id, row_number() OVER (PARTITION BY user_id, best ORDER BY ts, event_id) - 1 AS since_best FROM b")
def rounds_since_best(s, d):
    """Rounds since the best value so far."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    best = views.table(s, d, "events").withColumn("best", F.max("value").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.row_number().over(Window.partitionBy("user_id", "best").orderBy("ts", "event_id")) - 1
    return best.select("event_id", since.cast("long").alias("since_best"))


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 25) THEN p_size ELSE 0 END AS masked, CASE WHEN contains(p_type, 'STEEL') THEN 'S' WHEN contains(p_type, 'BRASS') THEN 'B' ELSE 'other' END AS kind FROM part WHERE length(p_name) > 9")
def masked_classes(s, d):
    """Rows with enough content, classes outside the targets masked, labels made fewer."""
    z, t = F.col("p_size"), F.col("p_type")
    kind = F.when(t.contains("STEEL"), "S").when(t.contains("BRASS"), "B").otherwise("other")
    return views.table(s, d, "part").where(F.length("p_name") > 9).select("p_partkey", F.when(z.isin(1, 25), z).otherwise(0).alias("masked"), kind.alias("kind"))


@query("SELECT l_orderkey AS road, l_linenumber AS part, coalesce(s.s_nationkey, -1) AS from_node, coalesce(t.s_nationkey, -1) AS to_node FROM lineitem LEFT JOIN supplier s ON s.s_suppkey = l_suppkey LEFT JOIN supplier t ON t.s_suppkey = l_partkey")
def remap_nodes(s, d):
    """Ends of edges take the nodes that theirs became, in two joins, and only needed columns stay."""
    node = views.table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    edges = views.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    first = edges.join(node.withColumnRenamed("s_nationkey", "f"), F.col("l_suppkey") == F.col("s_suppkey"), "left").drop("s_suppkey")
    both = first.join(node.withColumnRenamed("s_nationkey", "t"), F.col("l_partkey") == F.col("s_suppkey"), "left")
    return both.select(F.col("l_orderkey").alias("road"), F.col("l_linenumber").alias("part"), F.coalesce("f", F.lit(-1)).alias("from_node"), F.coalesce("t", F.lit(-1)).alias("to_node"))
