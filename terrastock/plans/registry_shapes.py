"""Queries over areas and shapes: clipping by a polygon, cells under a row limit, roof runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrastock.functions import geo
from terrastock.operators import areas, shapes
from terrastock.plans import views
from terrastock.plans.registry import _FPS, _HAV, _PTS, _ROADS, D, query

#: A concave area within the places of the views.
REGION = [(-122.45, 37.55), (-122.05, 37.6), (-122.2, 37.75), (-122.1, 37.95), (-122.3, 37.8), (-122.42, 37.93), (-122.45, 37.55)]
_BORDER = ", ".join(f"({D(a[0])}, {D(a[1])}, {D(b[0])}, {D(b[1])})" for a, b in zip(REGION, REGION[1:], strict=False))


@query(f"""WITH {_ROADS}, border(cx, cy, dx, dy) AS (VALUES {_BORDER}),
m AS (SELECT line_id, part, alon, alat, blon - alon AS rx, blat - alat AS ry, dx - cx AS sx, dy - cy AS sy, cx - alon AS ox, cy - alat AS oy FROM segs, border),
t AS (SELECT line_id, part, (ox * sy - oy * sx) / nullif(rx * sy - ry * sx, 0) AS t, (ox * ry - oy * rx) / nullif(rx * sy - ry * sx, 0) AS u FROM m),
c AS (SELECT line_id, part, t FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 UNION SELECT line_id, part, 0 FROM segs UNION SELECT line_id, part, 1 FROM segs),
p AS (SELECT line_id, part, t AS t0, lead(t) OVER (PARTITION BY line_id, part ORDER BY t) AS t1 FROM c QUALIFY t1 IS NOT NULL),
g AS (SELECT p.*, alon, alat, blon, blat, alon + (blon - alon) * ((t0 + t1) / 2) AS mx, alat + (blat - alat) * ((t0 + t1) / 2) AS my FROM p JOIN segs USING (line_id, part)),
i AS (SELECT line_id, part, t0, t1, alon, alat, blon, blat FROM g, border GROUP BY ALL HAVING false UNION ALL SELECT line_id, part, t0, t1, alon, alat, blon, blat FROM g WHERE (SELECT count(*) FROM border WHERE (cy > my) <> (dy > my) AND mx < (dx - cx) * (my - cy) / nullif(dy - cy, 0) + cx) % 2 = 1),
n AS (SELECT *, CASE WHEN (lag(part) OVER w = part AND lag(t1) OVER w = t0) OR (lag(part) OVER w = part - 1 AND lag(t1) OVER w = 1 AND t0 = 0) THEN 0 ELSE 1 END AS b FROM i WINDOW w AS (PARTITION BY line_id ORDER BY part, t0)),
k AS (SELECT *, sum(b) OVER (PARTITION BY line_id ORDER BY part, t0 ROWS UNBOUNDED PRECEDING) - 1 AS piece FROM n),
e AS (SELECT line_id, piece, part, t0, alon + (blon - alon) * t0 AS alon, alat + (blat - alat) * t0 AS alat, alon + (blon - alon) * t1 AS blon, alat + (blat - alat) * t1 AS blat FROM k)
SELECT line_id, cast(piece AS bigint) AS piece, count(*) + 1 AS points, round(sum({_HAV.format(a='a', b='b')}), 3) AS length_ft, round(arg_min(alon, (part, t0)), 6) AS start_lon, round(arg_max(blat, (part, t0)), 6) AS end_lat FROM e GROUP BY 1, 2""".replace("FROM g, border GROUP BY ALL HAVING false UNION ALL SELECT line_id, part, t0, t1, alon, alat, blon, blat ", ""))
def clip_roads_to_region(s, d):
    """The parts of roads inside a concave area; a road that leaves it and comes back gives several."""
    got = areas.clip_lines(views.roads(s, d), REGION)
    return got.select("line_id", F.col("piece").cast("long").alias("piece"), F.size("line").cast("long").alias("points"), F.round(geo.line_length_ft(F.col("line")), 3).alias("length_ft"), F.round(F.get("line", F.lit(0))["lon"], 6).alias("start_lon"), F.round(F.element_at("line", -1)["lat"], 6).alias("end_lat"))


MESH, LIMIT = (-122.5, 37.5, -122.0, 38.0), 60
_MET = "f.x0 <= {c}x1 AND f.x1 >= {c}x0 AND f.y0 <= {c}y1 AND f.y1 >= {c}y0"
_BOX = [D(v) for v in MESH]
_MESH = f"""WITH RECURSIVE {_FPS}, cells AS (
SELECT '0' AS cell, 0 AS level, {_BOX[0]} AS x0, {_BOX[1]} AS y0, {_BOX[2]} AS x1, {_BOX[3]} AS y1, (SELECT count(*) FROM fps f WHERE f.x0 <= {_BOX[2]} AND f.x1 >= {_BOX[0]} AND f.y0 <= {_BOX[3]} AND f.y1 >= {_BOX[1]}) AS n
UNION ALL SELECT s.cell, s.level, s.x0, s.y0, s.x1, s.y1, count(f.bldg_id) AS n FROM (
  SELECT cell || '.' || i || '-' || j AS cell, level + 1 AS level, x0 + j * w AS x0, y0 + i * h AS y0, x0 + j * w + w AS x1, y0 + i * h + h AS y1 FROM (
    SELECT *, (x1 - x0) / cols AS w, (y1 - y0) / rows AS h, unnest(range(rows)) AS i FROM (
      SELECT * REPLACE (CASE WHEN rows * cols < 2 THEN 2 ELSE cols END AS cols) FROM (
        SELECT *, CASE WHEN wide > high THEN r * m ELSE m END AS rows, CASE WHEN wide > high THEN m ELSE r * m END AS cols FROM (
          SELECT *, greatest(1, cast(ceil(sqrt(k / r)) AS bigint)) AS m FROM (
            SELECT *, greatest(1, cast(ceil(greatest(wide, high) / least(wide, high)) AS bigint)) AS r, round_even(1.2::double * n / {LIMIT}, 0) AS k FROM (
              SELECT *, {_HAV.replace('{a}lat', 'y0').replace('{b}lat', 'y0').replace('{a}lon', 'x0').replace('{b}lon', 'x1')} AS wide, {_HAV.replace('{a}lat', 'y0').replace('{b}lat', 'y1').replace('{a}lon', 'x0').replace('{b}lon', 'x0')} AS high FROM cells WHERE n > {LIMIT} AND level < 40)))))), unnest(range(cols)) AS q(j)) s
  JOIN fps f ON {_MET.format(c='s.')} GROUP BY ALL)"""


@query(f"{_MESH} SELECT cell, level, round(x0, 7) AS x0, round(y0, 7) AS y0, round(x1, 7) AS x1, round(y1, 7) AS y1, n FROM cells WHERE n <= {LIMIT} AND n > 0")
def row_limited_cells(s, d):
    """Cells with at most 60 footprints each, cut again until none holds more; where more than 60 footprints
    cover a cell whole there is no such cell."""
    cells, _ = _mesh(s, d)
    return cells.where(F.col("n") <= LIMIT).select("cell", "level", *(F.round(c, 7).alias(c) for c in ("x0", "y0", "x1", "y1")), "n")


def _mesh(s, d):
    boxes = views.footprints(s, d).select("bldg_id", geo.ring_bbox(F.col("ring")).alias("b")).select("bldg_id", "b.*")
    return areas.row_limited_mesh(boxes, "bldg_id", MESH, LIMIT)


@query(f"""{_MESH}, got AS (SELECT bldg_id, cell FROM cells c JOIN fps f ON {_MET.format(c='c.')} WHERE n <= {LIMIT}) SELECT bldg_id, count(*) AS cells, min(cell) AS first_cell, max(cell) AS value_of FROM got GROUP BY 1""")
def rows_of_cells_made_one(s, d):
    """A4: footprints that several cells return, once each, at the place of the first cell with the value of the last."""
    cells, members = _mesh(s, d)
    members = members.join(cells.where(F.col("n") <= LIMIT).select("cell"), "cell", "left_semi")
    rows = members.select("bldg_id", "cell", F.col("cell").alias("value_of"))
    once = areas.last_value_at_first_place(rows.withColumn("row", F.col("bldg_id")), "bldg_id", ["cell"], ["row"])
    counts = members.groupBy("bldg_id").agg(F.count("*").alias("cells"))
    return once.join(counts, "bldg_id").select("bldg_id", "cells", F.col("first_place.cell").alias("first_cell"), "value_of")


_PER = f"({geo.EQUATOR_M}::double * {geo.FT_PER_M}::double / 360)"
_CORNERS = ", ".join(f"{{'lon': lon + c * (w * {D(x)}) - s * (h * {D(y)}), 'lat': lat + s * (w * {D(x)}) + c * (h * {D(y)})}}" for x, y in views.CORNERS)
_TURNED = f"""{_PTS['part']}, tp AS (SELECT p_partkey AS bldg_id, lon, lat, [{', '.join(D(t[0]) for t in views.TURNS)}][p_partkey % 4 + 1] / [{', '.join(D(t[2]) for t in views.TURNS)}][p_partkey % 4 + 1] AS c,
[{', '.join(D(t[1]) for t in views.TURNS)}][p_partkey % 4 + 1] / [{', '.join(D(t[2]) for t in views.TURNS)}][p_partkey % 4 + 1] AS s, (10 + p_size) / {D(100000)} AS w, (5 + p_partkey % 23) / {D(100000)} AS h FROM part_pts),
turned AS (SELECT bldg_id, [{_CORNERS}] AS ring FROM tp),
flat AS (SELECT bldg_id, list_transform(ring, lambda p: {{'x': (p.lon - ring[1].lon) * {_PER} * cos(radians((p.lat + ring[1].lat) / 2)), 'y': (p.lat - ring[1].lat) * {_PER}}}) AS xy FROM turned),
rs AS (SELECT bldg_id, i, xy[i + 1].x AS x1, xy[i + 1].y AS y1, xy[i + 2].x AS x2, xy[i + 2].y AS y2 FROM (SELECT bldg_id, xy, unnest(range(len(xy) - 1)) AS i FROM flat)),
sl AS (SELECT *, (y2 - y1) / nullif(x2 - x1, 0) AS slope, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM rs),
fold AS (SELECT bldg_id, i, [slope] AS heads, [0] AS ids FROM sl WHERE i = 0 UNION ALL SELECT f.bldg_id, s.i, CASE WHEN hit > 0 THEN heads ELSE heads || [s.slope] END, ids || [CASE WHEN hit > 0 THEN hit - 1 ELSE len(heads) END]
  FROM (SELECT f.*, n.slope AS next_slope, coalesce(list_position(list_transform(heads, lambda h: n.slope = h OR abs(n.slope - h) < {D(0.3)} * abs(h)), true), 0) AS hit FROM fold f JOIN sl n ON n.bldg_id = f.bldg_id AND n.i = f.i + 1) f JOIN sl s ON s.bldg_id = f.bldg_id AND s.i = f.i + 1),
cl AS (SELECT bldg_id, ids FROM fold WHERE i = {len(views.CORNERS) - 2}), own AS (SELECT sl.*, ids[i + 1] AS cluster FROM sl JOIN cl USING (bldg_id)),
md AS (SELECT bldg_id, cluster, sum(length) AS total, row_number() OVER (PARTITION BY bldg_id ORDER BY round(sum(length), 6) DESC, cluster DESC) AS rank FROM own GROUP BY 1, 2 HAVING count(*) > 1 QUALIFY rank <= 2)"""


@query(f"WITH RECURSIVE {_TURNED} SELECT bldg_id, rank, cast(cluster AS bigint) AS cluster, round(total, 4) AS total FROM md")
def footprint_directions(s, d):
    """The two main directions of turned footprints, by the total length of edges of like slope."""
    segs = shapes.ring_segments(views.turned_footprints(s, d), "bldg_id")
    got = shapes.main_directions(segs, "bldg_id")
    return got.select("bldg_id", F.col("rank").cast("long").alias("rank"), F.col("cluster").cast("long").alias("cluster"), F.round("total", 4).alias("total"))


_SIDE = "{x} * cos(pi() / 2 - atan(slope)) - {y} * sin(pi() / 2 - atan(slope))"
_MEET = "[((({p}.x1 * {p}.y2 - {p}.y1 * {p}.x2) * ({q}.x1 - {q}.x2) - ({p}.x1 - {p}.x2) * ({q}.x1 * {q}.y2 - {q}.y1 * {q}.x2)) / (({p}.x1 - {p}.x2) * ({q}.y1 - {q}.y2) - ({p}.y1 - {p}.y2) * ({q}.x1 - {q}.x2))), ((({p}.x1 * {p}.y2 - {p}.y1 * {p}.x2) * ({q}.y1 - {q}.y2) - ({p}.y1 - {p}.y2) * ({q}.x1 * {q}.y2 - {q}.y1 * {q}.x2)) / (({p}.x1 - {p}.x2) * ({q}.y1 - {q}.y2) - ({p}.y1 - {p}.y2) * ({q}.x1 - {q}.x2)))]"
_LONG = "sqrt(pow({p}[1] - {q}[1], 2) + pow({p}[2] - {q}[2], 2))"


@query(f"""WITH RECURSIVE {_TURNED}, o AS (SELECT bldg_id, rank, i, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS e, round(least({_SIDE.format(x='x1', y='y1')}, {_SIDE.format(x='x2', y='y2')}), 6) AS lo, round(greatest({_SIDE.format(x='x1', y='y1')}, {_SIDE.format(x='x2', y='y2')}), 6) AS hi FROM own JOIN md USING (bldg_id, cluster)),
l AS (SELECT bldg_id, rank, arg_min(e, (lo, i)) AS least_, arg_min(e, (-hi, i)) AS most_ FROM o GROUP BY 1, 2), q AS (SELECT a.bldg_id, a.least_ AS a, a.most_ AS b, c.least_ AS c, c.most_ AS d FROM l a JOIN l c ON a.bldg_id = c.bldg_id AND a.rank = 1 AND c.rank = 2),
k AS (SELECT bldg_id, {_MEET.format(p='a', q='c')} AS ac, {_MEET.format(p='a', q='d')} AS ad, {_MEET.format(p='b', q='d')} AS bd, {_MEET.format(p='b', q='c')} AS bc FROM q)
SELECT turned.bldg_id, round(least({_LONG.format(p='ac', q='ad')}, {_LONG.format(p='ad', q='bd')}, {_LONG.format(p='bd', q='bc')}, {_LONG.format(p='bc', q='ac')}), 4) AS run FROM turned LEFT JOIN k USING (bldg_id)""")
def roof_runs(s, d):
    """The run of the roof over each turned footprint."""
    return shapes.roof_runs(views.turned_footprints(s, d), "bldg_id").select("bldg_id", F.round("run", 4).alias("run"))
