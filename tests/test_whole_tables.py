"""Queries over whole tables against brute force without windows, bounds or modulo filters."""

from math import cos, degrees, pi, sin

import duckdb
from oracle import SF, TABLES, same
from pyspark.sql import functions as F

from terrastock.functions import geo
from terrastock.operators import graph, spatial
from terrastock.plans import registry, views
from terrastock.plans.registry import ORACLE, QUERIES


def without(name, *cuts):
    """The SQL of a query with its cuts taken out."""
    sql = ORACLE[name]
    for old, new in cuts:
        assert old in sql
        sql = sql.replace(old, new)
    return sql


CROSSINGS = ORACLE["line_intersections"]


def test_all_intersections(spark):
    same(spark, QUERIES["line_intersections_all"], CROSSINGS)


def test_cut_lines_of_all_roads(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    points = {}
    for left, right, lon, lat in con.sql(CROSSINGS).fetchall():
        points.setdefault(left, set()).add((lon, lat))
        points.setdefault(right, set()).add((lon, lat))
    want = {}
    for line, part, a, b in registry._segments(spark, SF).collect():
        dx, dy, n = b[0] - a[0], b[1] - a[1], 1
        size = dx * dx + dy * dy
        for x, y in points.get(line, ()) if size else ():
            t, off = ((x - a[0]) * dx + (y - a[1]) * dy) / size, abs((x - a[0]) * dy - (y - a[1]) * dx) / size**0.5
            n += off < 2e-7 and 1e-9 < t < 1 - 1e-9
        want[line, part] = n
    got = {(r["line_id"], r["part"]): r["count"] for r in QUERIES["cut_lines"](spark, SF).groupBy("line_id", "part").count().collect()}
    assert got == want and max(want.values()) > 1


def chains(edges):
    """(edges, least end, greatest end) of chains through nodes of degree 2."""
    edges = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    at = {}
    for e in edges:
        for n in e:
            at.setdefault(n, []).append(e)
    out, seen = [], set()
    for e in edges:
        if e in seen:
            continue
        chain, todo = {e}, [e]
        while todo:
            for n in todo.pop():
                if len(at[n]) == 2:
                    todo += (new := [x for x in at[n] if x not in chain])
                    chain.update(new)
        seen |= chain
        ends = sorted(n for x in chain for n in x if len(at[n]) != 2)
        out.append((len(chain), ends[0] if ends else "", ends[-1] if ends else ""))
    return sorted(out)


def test_contraction_of_all_roads(spark):
    edges = [(r["node_start"], r["node_end"]) for r in graph.graph_edges(registry._segments(spark, SF)).collect()]
    got = sorted((r["edges"], r["end_low"] or "", r["end_high"] or "") for r in QUERIES["contract_degree2"](spark, SF).collect())
    assert got == chains(edges) and sum(n for n, _, _ in got) > 4000


def meets(x, y, r, a, b):
    """Whether a segment meets the polygon of 100 vertices about a point, by clipping with its edges' half planes."""
    lo, hi = 0.0, 1.0
    for i in range(100):
        angle = 2 * pi * (i + 0.5) / 100
        nx, ny, most = cos(angle), sin(angle), r * cos(pi / 100)
        start = (a[0] - x) * nx + (a[1] - y) * ny - most
        slope = (b[0] - a[0]) * nx + (b[1] - a[1]) * ny
        if slope > 0:
            hi = min(hi, -start / slope)
        elif slope < 0:
            lo = max(lo, -start / slope)
        elif start > 0:
            return False
    return lo <= hi


def test_names_of_lines_that_pass(spark):
    """A line whose later segment alone passes the point is a candidate, on the given tables as on a long road."""
    r = degrees(5000 / geo.AREA_RADIUS_FT)
    spots, segs = views.points(spark, SF, "supplier"), registry._segments(spark, SF)
    want = {(k, line) for k, x, y in spots.collect() for line, _, a, b in segs.collect() if meets(x, y, r, a, b)}
    got = [tuple(p) for p in spatial.lines_near(spots, segs, 5000, "s_suppkey").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    names = {p["p_partkey"]: p["p_name"] for p in views.table(spark, SF, "part").collect()}
    firsts = {p["line_id"]: p["first_part"] for p in views.roads(spark, SF).collect()}
    pairs = spark.createDataFrame([(k, line, names[k], names[firsts[line]]) for k, line in want], "s_suppkey int, line_id long, a string, b string")
    assert sorted(QUERIES["name_match_tfidf"](spark, SF).collect()) == sorted(graph.match_names(pairs, "s_suppkey", "line_id", "a", "b").collect())
    long = spark.createDataFrame([(1, [(-1.0, 0.0), (-0.5, 0.4), (0.5, 0.4), (2.0, 0.405)]), (2, [(0.0, 0.3), (0.1, 0.3)])], "line_id long, line array<struct<lon double, lat double>>")
    assert [tuple(x) for x in spatial.lines_near(spark.createDataFrame([(7, 0.0, 0.41)], "k long, lon double, lat double"), graph.explode_segments(long), 5000, "k").collect()] == [(7, 1)]


def test_similarity_of_all_parts(spark):
    same(spark, QUERIES["tfidf_similarity_all"], ORACLE["tfidf_similarity"])


def test_similarity_of_odd_names(spark):
    left = spark.createDataFrame([(1, "red red Blue"), (2, "red red Blue"), (3, None), (4, "a b")], "k long, x string")
    right = spark.createDataFrame([(600, "blue red"), (601, "green"), (602, ""), (603, "red red blue")], "j long, y string")
    got = {(p["k"], p["j"]): round(p["score"], 9) for p in graph.tfidf_pairs(left, right, "x", "y").collect()}
    every = left.crossJoin(right).select("k", "j", F.round(graph.tfidf_cosine(F.col("x"), F.col("y")), 9)).collect()
    assert got == {(k, j): v for k, j, v in every if v} and len(got) == 4


def test_nearest_without_a_window(spark):
    same(spark, QUERIES["knn_contains_preference_all"], ORACLE["knn_contains_preference"])


def test_nearest_of_isolated_rings(spark):
    """Points in a far cluster are found, and of fewer than ten points all are ranked."""
    square = lambda x, y: [(x + dx, y + dy) for dx, dy in ((0.0, 0.0), (0.3, 0.0), (0.3, 0.3), (0.0, 0.3), (0.0, 0.0))]
    rings = spark.createDataFrame([(1, square(0.0, 0.0)), (2, square(5.0, 5.0))], "k long, ring array<struct<lon double, lat double>>")
    spots = [(10, 0.2, 0.2), (11, -0.1, 0.0), (12, 7.0, 7.0), (13, 6.0, 6.0)]
    points = lambda rows: spark.createDataFrame(rows, "p long, lon double, lat double")
    got = lambda rows: sorted(map(tuple, spatial.knn_prefer_inside_all(rings, points(rows), "k", "p").collect()))
    assert got(spots) == [(1, 10, True), (2, 13, False)]
    assert got([]) == []
    assert got(spots + [(k, -0.001 * (k - 19), 0.0) for k in range(20, 40)]) == [(1, 20, False), (2, 13, False)]
