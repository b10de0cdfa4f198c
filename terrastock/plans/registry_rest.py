"""Queries of areas, networks, detections and sources, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrastock.functions import geo, parse
from terrastock.operators import detection, fusion, graph, metrics
from terrastock.plans import views
from terrastock.plans.registry import _BOXES, _FPS, _HAV, _JUDGED, _PTS, _ROADS, D, _segments, query
from terrastock.sources import images, readers, writers

#: An area by its corners, and one that is no box.
AREA = (-122.4, 37.6, -122.2, 37.8)
TRIANGLE = ((-122.45, 37.55), (-122.1, 37.7), (-122.3, 37.95), (-122.45, 37.55))
_AREA = [D(v) for v in AREA]


def _ring(points):
    return F.array(*(geo.point(F.lit(x), F.lit(y)) for x, y in points))


_SEGS = f"{_ROADS}, sg AS (SELECT line_id, part, alon AS ax, alat AS ay, blon AS ex, blat AS ey FROM segs)"


@query(f"""WITH {_SEGS}, v AS (SELECT *, ex - ax AS dx, ey - ay AS dy FROM sg), t AS (SELECT *, ({_AREA[0]} - ax) / nullif(dx, 0) AS p, ({_AREA[2]} - ax) / nullif(dx, 0) AS q, ({_AREA[1]} - ay) / nullif(dy, 0) AS r, ({_AREA[3]} - ay) / nullif(dy, 0) AS s FROM v
WHERE (dx <> 0 OR ax BETWEEN {_AREA[0]} AND {_AREA[2]}) AND (dy <> 0 OR ay BETWEEN {_AREA[1]} AND {_AREA[3]})), u AS (SELECT *, greatest(0, least(p, q), least(r, s)) AS t0, least(1, greatest(p, q), greatest(r, s)) AS t1 FROM t)
SELECT line_id, part, round(ax + t0 * dx, 6) AS x0, round(ay + t0 * dy, 6) AS y0, round(ax + t1 * dx, 6) AS x1, round(ay + t1 * dy, 6) AS y1 FROM u WHERE t0 <= t1""")
def clip_roads(s, d):
    """The parts of roads inside an area."""
    clipped = _segments(s, d).withColumn("c", geo.clip_segment(F.col("a"), F.col("b"), *map(F.lit, AREA))).where("c is not null")
    return clipped.select("line_id", "part", *(F.round(f"c.{p}.{k}", 6).alias(n) for n, p, k in (("x0", "a", "lon"), ("y0", "a", "lat"), ("x1", "b", "lon"), ("y1", "b", "lat"))))


_EDGES = ", ".join(f"({D(a[0])}, {D(a[1])}, {D(b[0])}, {D(b[1])})" for a, b in zip(TRIANGLE, TRIANGLE[1:], strict=False))
_TURN = "sign(({qy} - {py}) * ({rx} - {qx}) - ({qx} - {px}) * ({ry} - {qy}))"


def _turn(p, q, r):
    return _TURN.format(px=p + "x", py=p + "y", qx=q + "x", qy=q + "y", rx=r + "x", ry=r + "y")


@query(f"""WITH {_FPS}, area(cx_, cy_, dx_, dy_) AS (VALUES {_EDGES}), e AS (SELECT bldg_id, unnest([{{'ax': x0, 'ay': y0, 'ex': x1, 'ey': y0}}, {{'ax': x1, 'ay': y0, 'ex': x1, 'ey': y1}}, {{'ax': x1, 'ay': y1, 'ex': x0, 'ey': y1}}, {{'ax': x0, 'ay': y1, 'ex': x0, 'ey': y0}}], recursive := true) FROM fps),
m AS (SELECT bldg_id, ax, ay, ex, ey, cx_ AS cx, cy_ AS cy, dx_ AS dx, dy_ AS dy FROM e, area), met AS (SELECT bldg_id FROM m WHERE {_turn('a', 'e', 'c')} <> {_turn('a', 'e', 'd')} AND {_turn('c', 'd', 'a')} <> {_turn('c', 'd', 'e')}),
held AS (SELECT bldg_id FROM fps, area GROUP BY bldg_id HAVING count(*) FILTER (WHERE (cy_ > y0) <> (dy_ > y0) AND x0 < (dx_ - cx_) * (y0 - cy_) / nullif(dy_ - cy_, 0) + cx_) % 2 = 1)
SELECT bldg_id FROM met UNION SELECT bldg_id FROM held UNION SELECT bldg_id FROM fps WHERE {D(TRIANGLE[0][0])} BETWEEN x0 AND x1 AND {D(TRIANGLE[0][1])} BETWEEN y0 AND y1""")
def footprints_meeting_area(s, d):
    """P6."""
    return views.footprints(s, d).where(geo.rings_intersect(F.col("ring"), _ring(TRIANGLE))).select("bldg_id")


@query(f"WITH {_FPS} SELECT round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1 FROM fps")
def footprint_set_box(s, d):
    """P4."""
    b = views.footprints(s, d).select(geo.ring_bbox(F.col("ring")).alias("b"))
    return b.agg(F.round(F.min("b.min_lon"), 6).alias("x0"), F.round(F.min("b.min_lat"), 6).alias("y0"), F.round(F.max("b.max_lon"), 6).alias("x1"), F.round(F.max("b.max_lat"), 6).alias("y1"))


@query(f"""WITH {_PTS['supplier']}, area(cx, cy, dx, dy) AS (VALUES {_EDGES}), i AS (SELECT s_suppkey FROM supplier_pts, area GROUP BY s_suppkey HAVING count(*) FILTER (WHERE (cy > lat) <> (dy > lat) AND lon < (dx - cx) * (lat - cy) / nullif(dy - cy, 0) + cx) % 2 = 1)
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier_pts JOIN i USING (s_suppkey)""")
def structures_in_area(s, d):
    """All columns of the structures in an area, its box first."""
    pts = readers.in_box(views.points(s, d, "supplier", "s_name", "s_nationkey", "s_acctbal"), min(x for x, _ in TRIANGLE), min(y for _, y in TRIANGLE), max(x for x, _ in TRIANGLE), max(y for _, y in TRIANGLE))
    return pts.where(geo.point_in_ring(F.col("lon"), F.col("lat"), _ring(TRIANGLE))).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


_KEY = "printf('%.7f', {0}x) || ' ' || printf('%.7f', {0}y)"


@query(f"""WITH {_SEGS}, g AS (SELECT line_id, part, {_KEY.format('a')} AS u, {_KEY.format('e')} AS v FROM sg)
SELECT line_id, part, u AS node_start, v AS node_end FROM g""")
def oriented_edges(s, d):
    """Edges of odd roads are given backwards and turned again."""
    edges = _segments(s, d).select("line_id", "part", graph.node_key(F.col("a")).alias("node_start"), graph.node_key(F.col("b")).alias("node_end"), F.array("a", "b").alias("line"))
    odd = F.col("line_id") % 2 == 1
    given = edges.withColumns({"node_start": F.when(odd, F.col("node_end")).otherwise(F.col("node_start")), "node_end": F.when(odd, F.col("node_start")).otherwise(F.col("node_end"))})
    return graph.orient_edges(given).select("line_id", "part", "node_start", "node_end")


def _simple_edges(s, d):
    edges = _segments(s, d).select("line_id", "part", graph.node_key(F.col("a")).alias("node_start"), graph.node_key(F.col("b")).alias("node_end"), F.array("a", "b").alias("line"))
    pair = edges.where("node_start <> node_end").groupBy(F.least("node_start", "node_end").alias("k1"), F.greatest("node_start", "node_end").alias("k2"))
    one = pair.agg(F.min(F.struct((F.col("line_id") * 16 + F.col("part")).alias("edge"), "node_start", "node_end", "line")).alias("e"))
    return one.select("e.*")


@query(f"""WITH RECURSIVE {_SEGS}, g AS (SELECT line_id * 16 + part AS edge, {_KEY.format('a')} AS u, {_KEY.format('e')} AS v FROM sg), s1 AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM g WHERE u <> v), e AS (SELECT (SELECT min(edge) FROM g WHERE least(g.u, g.v) = s1.u AND greatest(g.u, g.v) = s1.v) AS edge, u, v FROM s1),
h AS (SELECT edge, u, v FROM e UNION ALL SELECT edge, v, u FROM e), deg AS (SELECT u AS node, count(*) AS n FROM h GROUP BY 1), walk AS (SELECT edge AS start, u AS s, edge, v AS dest, 1::bigint AS n, edge AS low FROM h JOIN deg ON node = u WHERE deg.n <> 2
UNION ALL SELECT start, s, h.edge, h.v, walk.n + 1, least(low, h.edge) FROM walk JOIN deg ON node = dest AND deg.n = 2 JOIN h ON h.u = dest AND h.edge <> walk.edge)
SELECT low AS chain, least(s, dest) AS end_low, greatest(s, dest) AS end_high, max(walk.n) AS edges, max(walk.n) + 1 AS points FROM walk JOIN deg ON node = dest WHERE deg.n <> 2 GROUP BY 1, 2, 3""")
def merged_roads(s, d):
    """Roads merged through nodes of degree 2, with their lines; closed rings, which have no end, are left out here."""
    edges = _simple_edges(s, d)
    degree = edges.select(F.explode(F.array("node_start", "node_end")).alias("node_start")).groupBy("node_start").agg(F.count("*").alias("d")).where("d <> 2")
    ended = graph.merge_chains(edges).join(degree.select("node_start"), "node_start", "left_semi")
    return ended.select("chain", F.least("node_start", "node_end").alias("end_low"), F.greatest("node_start", "node_end").alias("end_high"), F.col("edges").cast("long").alias("edges"), F.size("line").cast("long").alias("points"))


@query(f"""WITH {_SEGS}, p AS (SELECT line_id, {_KEY.format('a')} AS node FROM sg UNION ALL SELECT line_id, {_KEY.format('e')} FROM sg), f AS (SELECT node, min(line_id) AS first_line FROM p GROUP BY node)
SELECT node, first_line, row_number() OVER (ORDER BY first_line, node) - 1 AS node_id FROM f""")
def numbered_nodes(s, d):
    """Nodes numbered by the first line they lie on."""
    nodes = graph.graph_nodes(_segments(s, d)).select("node", "first_line")
    return graph.number_rows(nodes, "first_line", ["node"], "node_id")


@query("SELECT o_orderkey AS line_id, o_orderkey IN (SELECT s_suppkey FROM supplier) AS matched FROM orders")
def local_and_matched(s, d):
    """G12."""
    lines = views.table(s, d, "orders").select(F.col("o_orderkey").alias("line_id"))
    local, met = graph.split_matched(lines, views.table(s, d, "supplier").select(F.col("s_suppkey").alias("line_id")))
    return local.withColumn("matched", F.lit(False)).unionByName(met.withColumn("matched", F.lit(True)))


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS asset, l_orderkey AS line_id FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY asset) AS k FROM m)
SELECT line_id, asset, CASE WHEN s_nationkey % 3 = 0 THEN 'tunnel' ELSE 'bridge' END AS asset_type, cast(round_even((s_nationkey * 40) / k, 0) AS bigint) AS lanes, cast(round_even((s_nationkey * 40) / k, 0) AS bigint) * 1800 AS capacity FROM n JOIN supplier ON s_suppkey = asset""")
def asset_attributes(s, d):
    """Lanes and capacity of each asset shared by the roads it was matched with."""
    matches = views.table(s, d, "lineitem").select(F.col("l_suppkey").alias("asset"), F.col("l_orderkey").alias("line_id")).distinct()
    kind = F.when(F.col("s_nationkey") % 3 == 0, "tunnel").otherwise("bridge")
    assets = views.table(s, d, "supplier").select(F.col("s_suppkey").alias("asset"), kind.alias("asset_type"), (F.col("s_nationkey") * 40).cast("string").alias("lanes"))
    return graph.transfer_attributes(matches, assets, "asset")


@query("""SELECT 'T' || s_suppkey AS id, 'tunnel' AS asset_type, coalesce(nullif(s_nationkey % 4, 0)::varchar, 'unclassified') AS construct FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'B' || s_suppkey, 'bridge', s_nationkey::varchar FROM supplier WHERE s_suppkey % 2 = 1""")
def formatted_assets(s, d):
    """Tunnels with their default construction, and bridges, as one layer."""
    sup = views.table(s, d, "supplier")
    made = lambda mark, c: (F.concat(F.lit(mark), "s_suppkey").alias("id"), c.alias("construct"))
    default = F.coalesce(F.nullif(F.col("s_nationkey") % 4, F.lit(0)).cast("string"), F.lit("unclassified"))
    tunnels, bridges = sup.where("s_suppkey % 2 = 0").select(*made("T", default)), sup.where("s_suppkey % 2 = 1").select(*made("B", F.col("s_nationkey").cast("string")))
    return fusion.union_tagged({"tunnel": tunnels, "bridge": bridges}, "asset_type").select("id", "asset_type", "construct")


_FIT = "CASE WHEN w > h THEN 512 ELSE cast(floor(512 / h::double * w) AS bigint) END AS nw, CASE WHEN w > h THEN cast(floor(512 / w::double * h) AS bigint) ELSE 512 END AS nh"


@query(f"WITH i AS (SELECT p_partkey, 300 + p_partkey % 700 AS w, 250 + p_size * 17 AS h FROM part), f AS (SELECT *, {_FIT} FROM i) SELECT p_partkey, cast(nw AS bigint) AS new_w, cast(nh AS bigint) AS new_h, cast(512 - nw AS bigint) AS pad_w, cast(512 - nh AS bigint) AS pad_h FROM f")
def letter_boxes(s, d):
    """V5."""
    fit = detection.letter_box(300 + F.col("p_partkey") % 700, 250 + F.col("p_size") * 17, 512)
    return views.table(s, d, "part").select("p_partkey", fit.alias("f")).select("p_partkey", "f.*")


@query(f"WITH {_BOXES}, i AS (SELECT *, 300 + image % 700 AS w, 250 + image % 401 AS h FROM boxes), f AS (SELECT *, {_FIT} FROM i) SELECT image, box_id, x1 / (nw / w::double) AS x1, y1 / (nh / h::double) AS y1, x2 / (nw / w::double) AS x2, y2 / (nh / h::double) AS y2 FROM f")
def boxes_unfitted(s, d):
    """V2."""
    sized = views.boxes(s, d).withColumns({"w": 300 + F.col("image") % 700, "h": 250 + F.col("image") % 401})
    return detection.undo_letter_box(sized, "w", "h", 512).select("image", "box_id", "x1", "y1", "x2", "y2")


@query(f"""WITH {_BOXES}, a AS (SELECT *, (box_id % 7 - 3) / {D(10)} AS dx, (box_id % 5 - 2) / {D(10)} AS dy, (box_id % 3 - 1) / {D(4)} AS dw, (box_id % 11 - 5) / {D(10)} AS dh, x2 - x1 AS w, y2 - y1 AS h FROM boxes),
c AS (SELECT *, (x1 + x2) / 2 + dx * w AS cx, (y1 + y2) / 2 + dy * h AS cy, exp(dw) * w / 2 AS hw, exp(dh) * h / 2 AS hh FROM a)
SELECT image, box_id, round(greatest(cx - hw, 0), 4) AS x1, round(greatest(cy - hh, 0), 4) AS y1, round(least(cx + hw, 511), 4) AS x2, round(least(cy + hh, 511), 4) AS y2 FROM c""")
def decoded_boxes(s, d):
    """Boxes from anchors and offsets, clipped to the image."""
    k = F.col("box_id")
    offsets = {"dx": (k % 7 - 3) / 10, "dy": (k % 5 - 2) / 10, "dw": (k % 3 - 1) / 4, "dh": (k % 11 - 5) / 10}
    anchors = views.boxes(s, d).withColumnsRenamed({c: f"a{c}" for c in ("x1", "y1", "x2", "y2")}).withColumns(offsets)
    got = detection.decode_boxes(anchors, 512, 512)
    return got.select("image", "box_id", *(F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("""WITH m AS (SELECT l_orderkey AS image, ascii(l_returnflag) AS label, avg(cast(round(100 - l_discount * 100) AS bigint)) AS score FROM lineitem GROUP BY 1, 2) SELECT image, label, score FROM m QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, label) = 1""")
def class_over_scales(s, d):
    """V8, in hundredths."""
    scores = views.table(s, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.ascii("l_returnflag").alias("label"), F.round(100 - F.col("l_discount") * 100).cast("long").alias("score"))
    return detection.class_over_scales(scores, "image")


@query(f"WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(1 - l_discount * 10, {D(0.0001)}), {D(0.9999)}) AS p, l_returnflag = 'R' AS pos FROM lineitem), t AS (SELECT *, CASE WHEN pos THEN p ELSE 1 - p END AS r FROM p) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(-(CASE WHEN pos THEN {D(0.25)} ELSE {D(0.75)} END) * pow(1 - r, 2) * ln(r), 6) AS loss FROM t")
def focal_losses(s, d):
    """M12."""
    loss = parse.focal_loss(1 - F.col("l_discount") * 10, F.col("l_returnflag") == "R")
    return views.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(loss, 6).alias("loss"))


@query(f"WITH {_JUDGED}, k AS (SELECT c, count(*) FILTER (WHERE truth = c AND pred = c) AS tp, count(*) FILTER (WHERE truth <> c AND pred = c) AS fp, count(*) FILTER (WHERE truth = c AND pred <> c) AS fn FROM judged, (VALUES (0), (1)) v(c) GROUP BY c) SELECT round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) AS recall, round(avg(tp / (tp + 0.5 * (fp + fn))), 6) AS f1 FROM k")
def macro_scores(s, d):
    """A12."""
    df = metrics.macro_scores(views.judged(s, d), "truth", "pred")
    return df.select(*(F.round(c, 6).alias(c) for c in df.columns))


@query(f"WITH {_JUDGED}, j AS (SELECT CASE WHEN toxic = 1 THEN -1 ELSE truth END AS t, pred AS p FROM judged), v AS (SELECT * FROM j WHERE t >= 0), k AS (SELECT c, count(*) FILTER (WHERE t = c AND p = c) / count(*) FILTER (WHERE t = c OR p = c) AS iou FROM v, (VALUES (0), (1)) q(c) GROUP BY c) SELECT round((SELECT avg((t = p)::int) FROM v), 6) AS accuracy, round((SELECT avg(iou) FROM k), 6) AS mean_iou")
def pixel_accuracy(s, d):
    """Rows with a label below 0 are ignored."""
    judged = views.judged(s, d).withColumn("truth", F.when(F.col("toxic") == 1, -1).otherwise(F.col("truth")))
    df = metrics.pixel_accuracy(judged, "truth", "pred")
    return df.select(*(F.round(c, 6).alias(c) for c in df.columns))


@query("SELECT event_id, sum(cast(floor(value) AS bigint) * (event_id % 5 + 1)) OVER w / sum(event_id % 5 + 1) OVER w AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_mean(s, d):
    """The weighted mean of each user's whole values so far."""
    rows = views.table(s, d, "events").withColumns({"w": F.col("event_id") % 5 + 1, "v": F.floor("value")})
    return metrics.running_mean(rows, "user_id", ["event_id"], "v", "w").select("event_id", "mean")


@query("WITH e AS (SELECT p_partkey, [exp(p_size / 10::double), exp(p_partkey % 7::double), exp(p_partkey % 3::double)] AS e FROM part) SELECT p_partkey, round(e[1] / list_sum(e), 6) AS first, round(e[3] / list_sum(e), 6) AS last FROM e")
def softmax_scores(s, d):
    """M8."""
    z, k = F.col("p_size"), F.col("p_partkey")
    shares = parse.softmax(F.array((z / 10).cast("double"), (k % 7).cast("double"), (k % 3).cast("double")))
    return views.table(s, d, "part").select("p_partkey", F.round(shares[0], 6).alias("first"), F.round(shares[2], 6).alias("last"))


@query(f"WITH {_BOXES}, a AS (SELECT image, box_id, label, (x2 - x1) * (y2 - y1) AS area, box_id % 9 = 0 AS crowd FROM boxes) SELECT image, count(*) AS n, round(sum(area), 2) AS area FROM a WHERE area BETWEEN 400 AND 1600 AND NOT crowd GROUP BY image")
def annotations_by_area(s, d):
    """Annotations of an area range, groups left out."""
    rows = views.boxes(s, d).withColumns({"area": detection.box_area(), "crowd": F.col("box_id") % 9 == 0})
    return detection.in_area_range(rows, 400, 1600).groupBy("image").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"))


@query(f"WITH {_PTS['customer']}, d AS (SELECT c_nationkey, c_custkey, pow(lon + 122.25, 2) + pow(lat - 37.75, 2) AS d FROM customer_pts), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY d, c_custkey) AS near, row_number() OVER (PARTITION BY c_nationkey ORDER BY d DESC, c_custkey) AS far FROM d) SELECT c_nationkey, c_custkey, near <= 5 AS is_near FROM r WHERE near <= 5 OR far <= 7")
def closest_and_furthest(s, d):
    """T5: a top-k of each end."""
    away = F.pow(F.col("lon") + 122.25, F.lit(2.0)) + F.pow(F.col("lat") - 37.75, F.lit(2.0))
    by = Window.partitionBy("c_nationkey")
    rows = views.points(s, d, "customer", "c_nationkey").withColumn("d", away)
    ranked = rows.withColumns({"near": F.row_number().over(by.orderBy("d", "c_custkey")), "far": F.row_number().over(by.orderBy(F.desc("d"), "c_custkey"))})
    return ranked.where("near <= 5 or far <= 7").select("c_nationkey", "c_custkey", (F.col("near") <= 5).alias("is_near"))


_STATES = ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(parse.STATES.items()))


@query(f"SELECT c_custkey, code AS state FROM customer JOIN (VALUES {_STATES}) v(i, name, code) ON i = c_custkey % 51")
def state_of_place(s, d):
    """States read from display names, with and without a zip code."""
    name = F.get(F.array(*(F.lit(n) for n in parse.STATES)), F.col("c_custkey") % len(parse.STATES))
    shown = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_name"), F.lit(", "), name, F.lit(", United States"))).otherwise(F.concat(F.col("c_name"), F.lit(", "), name, F.lit(", 94720, United States")))
    return views.table(s, d, "customer").select("c_custkey", parse.state_of_place(shown).alias("state"))


@query("SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title, cast(len(regexp_extract_all(html, '<li')) AS bigint) AS items, TRY_CAST(nullif(regexp_extract(html, '<t[dh][^>]*>\\s*floors\\s*</t[dh]>\\s*<td[^>]*>\\s*([0-9]+)', 1, 'is'), '') AS int) AS floors FROM pages")
def page_facts(s, d):
    """Facts of pages; a table's numbers are tested on pages that have one."""
    html = F.col("html")
    return views.table(s, d, "pages").select("page_id", parse.page_title(html).alias("title"), F.size(F.regexp_extract_all(html, F.lit("<li"), F.lit(0))).cast("long").alias("items"), parse.labelled_number(html, "floors").alias("floors"))


@query("SELECT c_custkey, cast(('0x' || substr(md5(c_custkey::varchar), 1, 7))::bigint % 10 AS bigint) AS chunk FROM customer")
def download_chunks(s, d):
    """Rows dealt at random to chunks, alike in every run."""
    return views.table(s, d, "customer").select("c_custkey", readers.chunk_of(F.col("c_custkey"), 10).alias("chunk"))


@query(f"""WITH {_PTS['supplier']} SELECT '{{"type":"Feature","properties":{{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}},"geometry":{{"type":"Point","coordinates":[' || printf('%.7f', lon) || ',' || printf('%.7f', lat) || ']}}}}' AS value FROM supplier_pts""")
def point_features(s, d):
    """Features of points."""
    pts = views.points(s, d, "supplier", "s_name")
    return writers.features(pts, writers.point_json("lon", "lat"), "Point", ["s_suppkey", "s_name"])


@query(f"""WITH {_ROADS}, l AS (SELECT line_id, '[[' || string_agg(printf('%.7f', lon) || ',' || printf('%.7f', lat), '],[' ORDER BY pos) || ']]' AS g FROM placed GROUP BY line_id HAVING count(*) > 1) SELECT '{{"type":"Feature","properties":{{"line_id":' || line_id || '}},"geometry":{{"type":"LineString","coordinates":' || g || '}}}}' AS value FROM l""")
def line_features(s, d):
    """Features of lines."""
    return writers.features(views.roads(s, d), writers.line_json("line"), "LineString", ["line_id"])


@query(f"WITH {_PTS['events']} SELECT event_id, round(2 * 6371.0::double * 3280.84 * asin(sqrt(pow(sin(radians(37.75 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(37.75::double)) * pow(sin(radians(-122.25 - lon) / 2), 2))), 1) AS feet, 'POINT (' || printf('%.7f', lon) || ' ' || printf('%.7f', lat) || ')' AS wkt FROM events_pts")
def distance_and_text(s, d):
    """F2, F25, F31."""
    lon, lat = F.col("lon"), F.col("lat")
    return views.points(s, d, "events").select("event_id", F.round(geo.haversine_km_ft(lon, lat, F.lit(-122.25), F.lit(37.75)), 1).alias("feet"), geo.wkt_point(lon, lat).alias("wkt"))


@query(f"WITH {_FPS} SELECT bldg_id, round(x0 - 50 / 111111::double, 7) AS x0, round(y1 + 50 / 111111::double, 7) AS y1, round((cx - {_AREA[0]}) * 40075000.0::double * 3.28084 / 360 * cos(radians((cy + {_AREA[1]}) / 2)), 3) AS east, round((cy - {_AREA[1]}) * 40075000.0::double * 3.28084 / 360, 3) AS north FROM fps")
def buffered_and_local(s, d):
    """F15, F26, F35."""
    b = geo.buffered_bbox(F.col("ring"), 50.0)
    c = geo.ring_bbox(F.col("ring"))
    at = geo.local_ft((c["min_lon"] + c["max_lon"]) / 2, (c["min_lat"] + c["max_lat"]) / 2, F.lit(AREA[0]), F.lit(AREA[1]))
    return views.footprints(s, d).select("bldg_id", F.round(b["min_lon"], 7).alias("x0"), F.round(b["max_lat"], 7).alias("y1"), F.round(at["x"], 3).alias("east"), F.round(at["y"], 3).alias("north"))


@query("SELECT p_partkey, least(cast(ceil(2 * degrees(atan2(p_size / 2::double, p_partkey % 97 + 1)) / 10) * 10 AS bigint), 120) AS fov, round((p_retailprice - p_size) / nullif(p_partkey % 13, 0), 2) AS pitch FROM part")
def facade_measures(s, d):
    """F24, F33."""
    k, z = F.col("p_partkey"), F.col("p_size")
    return views.table(s, d, "part").select("p_partkey", geo.field_of_view(z.cast("double"), (k % 97 + 1).cast("double")).alias("fov"), geo.roof_pitch(z, F.col("p_retailprice"), (k % 13).cast("double")).alias("pitch"))


@query("SELECT p_partkey, p_partkey % 256 AS r, p_partkey // 256 % 256 AS g, p_partkey // 65536 AS b FROM part")
def rgb_inverse(s, d):
    """X18."""
    return views.table(s, d, "part").select("p_partkey", parse.rgb_parts(F.col("p_partkey")).alias("c")).select("p_partkey", *(F.col(f"c.{k}").cast("long").alias(k) for k in "rgb"))


@query("""WITH l AS (SELECT l_orderkey AS way_id, count(DISTINCT l_partkey) AS k, bool_and(l_suppkey <> 7) AS complete FROM lineitem GROUP BY 1) SELECT way_id, k + 1 AS points FROM l WHERE k >= 3 AND complete""")
def assembled_ways(s, d):
    """Closed ways whose nodes are all known; node 0 of each way is repeated at its end."""
    items = views.table(s, d, "lineitem")
    own = items.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("p"), F.bool_and(F.col("l_suppkey") != 7).alias("complete"))
    unknown = F.when(F.col("complete"), F.expr("cast(array() as array<bigint>)")).otherwise(F.array(F.lit(-1).cast("bigint")))
    ways = own.select("way_id", F.concat("p", unknown, F.slice("p", 1, 1)).alias("nodes"), F.lit(None).cast("map<string,string>").alias("tags"))
    nodes = views.points(s, d, "part").withColumnRenamed("p_partkey", "node_id")
    return readers.osm_footprints(nodes, ways).select("way_id", F.size("ring").cast("long").alias("points"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def uncached_rows(s, d):
    """S16."""
    cached = views.table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("s_suppkey"))
    return readers.new_rows(views.table(s, d, "supplier").select("s_suppkey", "s_name"), cached, "s_suppkey")


@query(f"SELECT p_partkey, round((p_size + (p_partkey % 60) / {D(60)} + (p_partkey % 59) / {D(3600)}) * CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END, 6) AS lat, round((p_size + 1 + (p_partkey % 60) / {D(60)} + (p_partkey % 59) / {D(3600)}) * CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END, 6) AS lon FROM part")
def image_positions(s, d):
    """S19."""
    k = F.col("p_partkey")
    parts = {f"{a}_{b}": v for a, first in (("lat", F.col("p_size")), ("lon", F.col("p_size") + 1)) for b, v in (("d", first), ("m", k % 60), ("s", k % 59))}
    refs = {"lat_ref": F.when(k % 2 == 0, "S").otherwise("N"), "lon_ref": F.when(k % 3 == 0, "W").otherwise("E")}
    rows = views.table(s, d, "part").withColumns(parts | refs | {"image": k, "heading": F.lit(0.0)})
    return readers.exif_position(rows).select(F.col("image").alias("p_partkey"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _photographs(s, d):
    """(p_partkey, content): the first bytes of a photograph taken at a place that the part's key and size give."""
    k, size = F.col("p_partkey"), F.col("p_size")
    number = lambda x: F.lpad(F.hex((F.lit(x) if isinstance(x, int) else x).cast("long")), 8, "0")
    field = lambda tag, kind, n, value: F.concat(F.lit(f"{tag:04X}{kind:04X}{n:08X}"), value)
    place = lambda deg: [number(x) for x in (deg, 1, k % 60, 1, k % 59 * 100, 100)]
    refs = [F.when(k % n == 0, F.lit(f"{ord(a):02X}000000")).otherwise(F.lit(f"{ord(b):02X}000000")) for n, a, b in ((2, "S", "N"), (3, "W", "E"))]
    table = [field(1, 2, 2, refs[0]), field(2, 5, 3, number(92)), field(3, 2, 2, refs[1]), field(4, 5, 3, number(116)), field(17, 5, 1, number(140))]
    start = F.lit("FFD8FFE1009C" + b"Exif\0\0MM".hex() + "002A00000008" + "0001" + "88250004000000010000001A" + "00000000" + "0005")
    return views.table(s, d, "part").select(k, F.unhex(F.concat(start, *table, number(0), *place(size), *place(size + 1), number(k % 3600), number(10))).alias("content"))


@query(f"SELECT p_partkey, round((p_size + (p_partkey % 60) / {D(60)} + (p_partkey % 59) / {D(3600)}) * CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END, 6) AS lat, round((p_size + 1 + (p_partkey % 60) / {D(60)} + (p_partkey % 59) / {D(3600)}) * CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END, 6) AS lon, (p_partkey % 3600) / {D(10)} AS heading FROM part")
def positions_in_headers(s, d):
    """Places and headings read from the bytes of photographs' headers."""
    got = images.header_positions(_photographs(s, d), "p_partkey")
    return got.select(F.col("image").alias("p_partkey"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "heading")


@query(f"WITH {_BOXES}, b AS (SELECT * FROM boxes WHERE label = 'R') SELECT image, x1 - 5 AS x1, y1 - 5 AS y1, x2 + 5 AS x2, y2 + 5 AS y2 FROM b QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) = 1")
def best_boxes(s, d):
    """V10."""
    return detection.best_box(views.boxes(s, d), "r", 5.0)
