"""Queries over road networks to the end: even pieces, numbered nodes, attributes on pieces, full records, one layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastock.functions import geo, parse
from terrastock.operators import graph, roads
from terrastock.plans import views
from terrastock.plans.registry import _CLS, _HAV, _PTS, _ROADS, _segments, query

CELL = 0.005
_KEY = "printf('%.7f', {0}lon) || ' ' || printf('%.7f', {0}lat)"
_UNITS = f"cast(round(({_HAV.format(a='a', b='b')}) * 1000) AS bigint)"


def _measured(source: str, key: str) -> str:
    """Measures of segments (key, part, alon, alat, blon, blat), pieces of at most 1,000 feet, and the parts of segments in them."""
    return f"""me AS (SELECT *, sum(len) OVER (PARTITION BY {key} ORDER BY part ROWS UNBOUNDED PRECEDING)::bigint AS m1, sum(len) OVER (PARTITION BY {key})::bigint AS total FROM (SELECT *, {_UNITS} AS len FROM {source})),
mm AS (SELECT *, m1 - len AS m0, greatest(1, (total + 999999) // 1000000) AS pieces FROM me WHERE len > 0 OR (total = 0 AND part = 0)),
mk AS (SELECT *, unnest(range(least(pieces - 1, ((m0 + 1) * pieces + total - 1) // greatest(total, 1) - 1), least(pieces - 1, (m1 * pieces + total - 1) // greatest(total, 1) - 1) + 1)) AS seg_id FROM mm WHERE total > 0 UNION ALL SELECT *, 0 FROM mm WHERE total = 0),
mc AS (SELECT *, greatest(m0, seg_id * total // pieces) AS c0, least(m1, (seg_id + 1) * total // pieces) AS c1 FROM mk),
mp AS (SELECT *, CASE WHEN c0 = m1 THEN blon ELSE alon + (blon - alon) * coalesce((c0 - m0) / nullif(m1 - m0, 0), 0) END AS plon, CASE WHEN c1 = m1 THEN blon ELSE alon + (blon - alon) * ((c1 - m0) / nullif(m1 - m0, 0)) END AS qlon, CASE WHEN c1 = m1 THEN blat ELSE alat + (blat - alat) * ((c1 - m0) / nullif(m1 - m0, 0)) END AS qlat FROM mc WHERE c1 > c0 OR total = 0),
mq AS (SELECT {key}, seg_id, max(pieces) AS pieces, count(*) + 1 AS points, (max(c1) - min(c0)) / 1000 AS length_ft, arg_min(plon, c0) AS start_lon, arg_max(qlon, c1) AS end_lon, arg_max(qlat, c1) AS end_lat FROM mp GROUP BY {key}, seg_id)"""


@query(f"WITH {_ROADS}, {_measured('segs', 'line_id')} SELECT line_id, seg_id::bigint AS seg_id, pieces::bigint AS pieces, points, length_ft, round(start_lon, 6) AS start_lon, round(end_lon, 6) AS end_lon, round(end_lat, 6) AS end_lat FROM mq")
def even_pieces(s, d):
    """Whole roads cut at equal spacing along their length, vertices kept."""
    got = roads.split_evenly(views.roads(s, d), 1000)
    last = F.element_at("line", -1)
    return got.select("line_id", "seg_id", "pieces", F.size("line").cast("long").alias("points"), "length_ft", F.round(F.get("line", F.lit(0))["lon"], 6).alias("start_lon"), F.round(last["lon"], 6).alias("end_lon"), F.round(last["lat"], 6).alias("end_lat"))


_NETWORK = f"""WITH RECURSIVE {_ROADS}, g AS (SELECT line_id * 1048576 + part AS edge, {_KEY.format('a')} AS u, {_KEY.format('b')} AS v, [{{'lon': alon, 'lat': alat}}, {{'lon': blon, 'lat': blat}}] AS pts FROM segs),
e AS (SELECT * FROM g WHERE u <> v QUALIFY row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY edge) = 1),
h AS (SELECT edge, u, v, pts FROM e UNION ALL SELECT edge, v, u, list_reverse(pts) FROM e), deg AS (SELECT u AS node, count(*) AS n FROM h GROUP BY 1),
walk AS (SELECT edge, v AS dest, edge AS low, pts FROM h JOIN deg ON node = u WHERE deg.n <> 2
UNION ALL SELECT h.edge, h.v, least(low, h.edge), walk.pts || h.pts[2:] FROM walk JOIN deg ON node = dest AND deg.n = 2 JOIN h ON h.u = dest AND h.edge <> walk.edge),
ended AS (SELECT DISTINCT low AS chain, least(pts, list_reverse(pts)) AS pts FROM walk JOIN deg ON node = dest WHERE deg.n <> 2),
seen AS (SELECT DISTINCT edge FROM walk),
ring AS (SELECT edge AS start, u AS s, edge, v AS dest, edge AS low, pts FROM e WHERE edge NOT IN (SELECT edge FROM seen)
UNION ALL SELECT start, s, h.edge, h.v, least(low, h.edge), ring.pts || h.pts[2:] FROM ring JOIN h ON h.u = dest AND h.edge <> ring.edge WHERE dest <> s),
chains AS (SELECT * FROM ended UNION ALL SELECT start, least(pts, list_reverse(pts)) FROM ring WHERE dest = s AND low = start),
cs AS (SELECT chain, part - 1 AS part, pts[part].lon AS alon, pts[part].lat AS alat, pts[part + 1].lon AS blon, pts[part + 1].lat AS blat FROM (SELECT chain, pts, unnest(range(1, len(pts))) AS part FROM chains)),
{_measured('cs', 'chain')},
ce AS (SELECT chain, printf('%.7f', pts[1].lon) || ' ' || printf('%.7f', pts[1].lat) AS ns, printf('%.7f', pts[-1].lon) || ' ' || printf('%.7f', pts[-1].lat) AS ne FROM chains),
old AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS node_id FROM (SELECT ns AS node FROM ce UNION SELECT ne FROM ce)),
fresh AS (SELECT chain, seg_id, end_lon, end_lat, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY chain, seg_id) - 1 AS node_id FROM mq WHERE seg_id < pieces - 1)"""


@query(f"""{_NETWORK}
SELECT q.chain, q.chain // 1048576 AS line_id, q.seg_id::bigint AS seg_id, coalesce(b.node_id, o.node_id) AS node_start, coalesce(f.node_id, p.node_id) AS node_end, q.points, q.length_ft FROM mq q JOIN ce USING (chain) JOIN old o ON o.node = ns JOIN old p ON p.node = ne
LEFT JOIN fresh f ON f.chain = q.chain AND f.seg_id = q.seg_id LEFT JOIN fresh b ON b.chain = q.chain AND b.seg_id = q.seg_id - 1""")
def network_edges(s, d):
    """Edges of the merged and evenly cut roads, with nodes that exist; rings are among them."""
    _, edges = roads.road_network(views.roads(s, d), 1000)
    return edges.select("chain", "line_id", "seg_id", "node_start", "node_end", F.size("line").cast("long").alias("points"), "length_ft")


@query(f"{_NETWORK} SELECT node_id, round(round(end_lon, 7), 6) AS lon, round(round(end_lat, 7), 6) AS lat FROM fresh UNION ALL SELECT node_id, round(split_part(node, ' ', 1)::double, 6), round(split_part(node, ' ', 2)::double, 6) FROM old")
def network_nodes(s, d):
    """Nodes of the same network, those that cutting made after the others."""
    nodes, _ = roads.road_network(views.roads(s, d), 1000)
    places = {c: F.round(F.round(c, 7), 6) for c in ("lon", "lat")}
    return nodes.select("node_id", *(F.round(v, 6).alias(k) for k, v in places.items()))


def _cut_points(s, d):
    met = graph.crossings(_segments(s, d), CELL)
    sides = [met.select(F.col(f"{n}_id").alias("line_id"), F.col(f"{n}_part").alias("part"), F.col(t).alias("t")) for n, t in (("left", "t"), ("right", "u"))]
    return sides[0].unionByName(sides[1])


@query(f"""WITH {_ROADS}, me AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY part ROWS UNBOUNDED PRECEDING)::bigint AS m1, sum(len) OVER (PARTITION BY line_id)::bigint AS total FROM (SELECT *, {_UNITS} AS len FROM segs)), mm AS (SELECT *, m1 - len AS m0 FROM me WHERE len > 0 OR (total = 0 AND part = 0)),
m AS (SELECT a.line_id, a.m0, a.m1, a.total, a.blon - a.alon AS rx, a.blat - a.alat AS ry, b.blon - b.alon AS sx, b.blat - b.alat AS sy, b.alon - a.alon AS ox, b.alat - a.alat AS oy FROM mm a JOIN segs b ON a.line_id <> b.line_id AND least(a.alon, a.blon) <= greatest(b.alon, b.blon) AND least(b.alon, b.blon) <= greatest(a.alon, a.blon) AND least(a.alat, a.blat) <= greatest(b.alat, b.blat) AND least(b.alat, b.blat) <= greatest(a.alat, a.blat)),
k AS (SELECT *, (ox * sy - oy * sx) / nullif(rx * sy - ry * sx, 0) AS t, (ox * ry - oy * rx) / nullif(rx * sy - ry * sx, 0) AS u FROM m),
c AS (SELECT DISTINCT line_id, m0 + cast(round(t * (m1 - m0)) AS bigint) AS m FROM k WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 AND m0 + cast(round(t * (m1 - m0)) AS bigint) > 0 AND m0 + cast(round(t * (m1 - m0)) AS bigint) < total),
b AS (SELECT line_id, m FROM c UNION SELECT line_id, 0 FROM mm UNION SELECT line_id, total FROM mm), p AS (SELECT line_id, row_number() OVER w - 1 AS piece, m, lead(m) OVER w AS n FROM b WINDOW w AS (PARTITION BY line_id ORDER BY m) QUALIFY n IS NOT NULL),
v AS (SELECT line_id, piece, (n - m) / 1000 AS length_ft, (SELECT count(*) FROM mm WHERE mm.line_id = p.line_id AND mm.m1 > p.m AND mm.m1 < p.n) + 2 AS points FROM p UNION ALL SELECT line_id, 0, 0, 2 FROM mm WHERE total = 0)
SELECT v.*, {_CLS} AS cls, o_orderstatus AS status FROM v JOIN orders ON o_orderkey = line_id""")
def cut_roads(s, d):
    """Roads cut at all their crossings, every piece with the columns of its road."""
    status = views.table(s, d, "orders").select(F.col("o_orderkey").alias("line_id"), F.col("o_orderstatus").alias("status"))
    lines = views.roads(s, d).select("line_id", "line", "cls").join(status, "line_id")
    got = roads.pieces_with_attributes(lines, _cut_points(s, d))
    return got.select("line_id", F.col("piece").cast("long").alias("piece"), F.size("line").cast("long").alias("points"), "cls", "status", "length_ft")


_RECORD = "CASE {c} WHEN 'S1100' THEN 'primary' WHEN 'S1200' THEN 'secondary' WHEN 'S1400' THEN 'residential' ELSE 'unclassified' END AS RoadType, CASE {c} WHEN 'S1100' THEN 4 WHEN 'S1200' THEN 2 ELSE 1 END AS NumOfLanes, CASE {c} WHEN 'S1100' THEN 70 WHEN 'S1200' THEN 55 WHEN 'S1740' THEN 10 ELSE 25 END AS MaxMPH"


def _named_roads(s, d):
    names = views.table(s, d, "part").select(F.col("p_partkey").alias("first_part"), F.col("p_name").alias("name"))
    return views.roads(s, d).select("line_id", "cls", "first_part").join(names, "first_part", "left").drop("first_part")


@query(f"""{_NETWORK}, cls AS (SELECT o_orderkey AS line_id, {_CLS} AS cls FROM orders), nm AS (SELECT line_id, p_name FROM placed LEFT JOIN part ON p_partkey = l_partkey WHERE pos = 0)
SELECT q.chain // 1048576 AS "TigerOID", {_RECORD.format(c='cls')}, cls AS "MTFCC", p_name AS "NAME", coalesce(b.node_id, o.node_id) AS "StartNode", coalesce(f.node_id, p.node_id) AS "EndNode", q.seg_id::bigint AS "SegID", 'Roadway' AS type, 'Roadway' AS "assetSubtype"
FROM mq q JOIN ce USING (chain) JOIN old o ON o.node = ns JOIN old p ON p.node = ne LEFT JOIN fresh f ON f.chain = q.chain AND f.seg_id = q.seg_id LEFT JOIN fresh b ON b.chain = q.chain AND b.seg_id = q.seg_id - 1 JOIN cls ON cls.line_id = q.chain // 1048576 JOIN nm ON nm.line_id = q.chain // 1048576""")
def roadway_records(s, d):
    """Whole records of roadways, with nodes, class, name and what the class gives."""
    _, edges = roads.road_network(views.roads(s, d), 1000)
    return roads.road_records(edges, _named_roads(s, d), minimum=True).drop("line")


_BRIDGES = f"br AS (SELECT s_suppkey, lon, lat, s_nationkey % 9 + 1 AS kind, s_suppkey % 20 AS design, 1900 + s_suppkey % 120 AS year_built, s_suppkey % 7 + 1 AS spans, s_nationkey * 3 + 10 AS span_m, s_nationkey AS state, s_suppkey % 45 AS skew, s_suppkey % 12 + 4 AS deck_m, s_name AS carried, s_nationkey * 9 + 30 AS len_m FROM supplier_pts)"


def _bridges(s, d):
    """Bridges of suppliers, by the columns of the national table."""
    return views.points(s, d, "supplier", "s_nationkey", "s_name").selectExpr(
        "cast(s_suppkey as string) as structure_number", "lon", "lat", "cast(s_nationkey % 9 + 1 as string) as structure_kind", "cast(s_suppkey % 20 as string) as structure_type", "1900 + s_suppkey % 120 as year_built",
        "s_suppkey % 7 + 1 as main_unit_spans", "s_nationkey * 3 + 10 as max_span_len_mt", "s_nationkey as state_code", "s_suppkey % 45 as degrees_skew", "s_suppkey % 12 + 4 as deck_width_mt", "s_name as facility_carried", "s_nationkey * 9 + 30 as structure_len_mt",
    )


@query(f"""WITH {_PTS['supplier']}, {_BRIDGES} SELECT s_suppkey::varchar AS "StructureNumber", row_number() OVER (ORDER BY s_suppkey::varchar) - 1 AS "Location", lon, lat, cast(kind * 100 + design AS bigint) AS "BridgeClass", year_built::bigint AS "YearBuilt", spans::bigint AS "NumOfSpans", round(span_m / {0.3048}::double, 6) AS "MaxSpanLength", state::bigint AS "StateCode", skew::bigint AS "Skew", round(deck_m / {0.3048}::double, 6) AS "DeckWidth", carried AS "FacilityCarried", round(len_m / {0.3048}::double, 6) AS "StructureLength", 'Bridge' AS type, 'HwyBridge' AS "assetSubtype" FROM br""")
def bridge_records(s, d):
    """Whole records of bridges in feet, numbered."""
    got = roads.bridge_records(_bridges(s, d), minimum=True, location=True)
    longs = [c for c, t in got.dtypes if t in ("int", "bigint")]
    return got.withColumns({c: F.col(c).cast("long") for c in longs} | {c: F.round(c, 6) for c in roads.METRIC})


def _tunnels(s, d):
    return views.points(s, d, "customer", "c_name", "c_nationkey").selectExpr("cast(c_custkey as string) as tunnel_number", "lon", "lat", "c_name as tunnel_name", "cast(c_nationkey * 11 as double) as tunnel_length")


@query(f"""WITH {_PTS['customer']} SELECT c_custkey::varchar AS "TunnelNumber", 'unclassified' AS "ConstructType", c_name AS "TunnelName", cast(c_nationkey * 11 AS double) AS "TunnelLength", lon, lat, 'Tunnel' AS type, 'HwyTunnel' AS "assetSubtype" FROM customer_pts""")
def tunnel_records(s, d):
    """Whole records of tunnels at the places of customers; without construction types."""
    return roads.tunnel_records(_tunnels(s, d), minimum=True)


_POINT = "'POINT (' || printf('%.7f', lon) || ' ' || printf('%.7f', lat) || ')'"


@query(f"""WITH {_PTS['supplier']}, {_PTS['customer']}, {_BRIDGES}, {_ROADS}, {_measured('segs', 'line_id')}, cls AS (SELECT o_orderkey AS line_id, {_CLS} AS cls FROM orders)
SELECT 'bridge' AS layer, 'HwyBridge' AS subtype, s_suppkey::varchar AS id, {_POINT} AS place FROM br UNION ALL SELECT 'tunnel', 'HwyTunnel', c_custkey::varchar, {_POINT} FROM customer_pts
UNION ALL SELECT 'roadway', 'Roadway', line_id || '-' || seg_id, 'POINT (' || printf('%.7f', end_lon) || ' ' || printf('%.7f', end_lat) || ')' FROM mq JOIN cls USING (line_id)""")
def transport_layer(s, d):
    """Bridges, tunnels and evenly cut roads as one layer, each with its place; a road's is its end."""
    point = lambda df, layer, key: df.select(F.lit(layer).alias("layer"), F.col("assetSubtype").alias("subtype"), F.col(key).alias("id"), geo.wkt_point(F.col("lon"), F.col("lat")).alias("place"))
    bridges, tunnels = roads.bridge_records(_bridges(s, d), minimum=True), roads.tunnel_records(_tunnels(s, d), minimum=True)
    edges = roads.split_evenly(views.roads(s, d), 1000).withColumns({"node_start": F.lit(0), "node_end": F.lit(0)})
    records = roads.road_records(edges, _named_roads(s, d))
    end = F.element_at("line", -1)
    ways = records.select(F.lit("roadway").alias("layer"), F.col("assetSubtype").alias("subtype"), F.concat_ws("-", "TigerOID", "SegID").alias("id"), geo.wkt_point(end["lon"], end["lat"]).alias("place"))
    return point(bridges, "bridge", "StructureNumber").unionByName(point(tunnels, "tunnel", "TunnelNumber")).unionByName(ways)


@query(f"""WITH {_ROADS}, g AS (SELECT line_id, part, {_KEY.format('a')} AS u, {_KEY.format('b')} AS v, ({_HAV.format(a='a', b='b')}) / {geo.FT_PER_M}::double AS len, alon, alat, blon, blat FROM segs), n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT u AS node FROM g UNION SELECT v FROM g)),
c AS (SELECT o_orderkey AS line_id, {_CLS} AS cls, o_orderstatus FROM orders), f AS (SELECT line_id, {_RECORD.format(c='cls')}, o_orderstatus FROM c)
SELECT line_id * 1048576 + part AS uniqueid, a.id AS start_nid, b.id AS end_nid, line_id AS osmid, round(len, 3) AS length, CASE WHEN o_orderstatus = 'F' THEN 'bridge' ELSE 'road' END AS type, NumOfLanes::bigint AS lanes, MaxMPH::bigint AS maxspeed, NumOfLanes * 1800::bigint AS capacity, round(len / (MaxMPH * ({1609.34}::double / 3600)), 3) AS fft,
'LINESTRING (' || printf('%.7f', alon) || ' ' || printf('%.7f', alat) || ', ' || printf('%.7f', blon) || ' ' || printf('%.7f', blat) || ')' AS geometry FROM g JOIN n a ON a.node = u JOIN n b ON b.node = v JOIN f USING (line_id)""")
def traffic_edges(s, d):
    """Whole edge records of a traffic model."""
    segs = _segments(s, d)
    key = F.col("line_id") * 1048576 + F.col("part")
    length = geo.haversine_ft(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    named = segs.select(key.alias("edge_id"), "line_id", graph.node_key(F.col("a")).alias("u"), graph.node_key(F.col("b")).alias("v"), F.array("a", "b").alias("line"), length.alias("length_ft"))
    nodes = graph.number_rows(named.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", [], "id")
    edges = named.join(nodes.select(F.col("node").alias("u"), F.col("id").alias("node_start")), "u").join(nodes.select(F.col("node").alias("v"), F.col("id").alias("node_end")), "v")
    cls = F.expr("element_at(array('S1100','S1200','S1400','S1500','S1740'), cast(substr(o_orderpriority, 1, 1) as int))")
    lanes = parse.lookup(parse.LANES, cls).cast("long")
    features = views.table(s, d, "orders").select(F.col("o_orderkey").alias("line_id"), F.when(F.col("o_orderstatus") == "F", "bridge").otherwise("road").alias("asset_type"), lanes.alias("lanes"), (lanes * parse.LANE_CAPACITY).alias("capacity"), parse.lookup(parse.SPEED, cls).cast("long").alias("maxspeed"))
    return roads.flow_edges(edges, features).withColumns({c: F.round(c, 3) for c in ("length", "fft")})
