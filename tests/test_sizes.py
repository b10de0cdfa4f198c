"""What tables many times larger ask of plans: nothing laid out in cells is broadcast, searches end early, with brute force beside them."""

import pathlib
import random
from math import asin, cos, exp, radians, sin, sqrt

import pytest
from oracle import SF
from pyspark.sql import functions as F

from terrastock.operators import areas, graph, imagery, metrics, roads, shared, spatial
from terrastock.plans.registry import QUERIES


def joins_of(df):
    """Lines of a plan that name a broadcast join."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def squares(spark, n, draw, side=0.05):
    rows = []
    for k in range(n):
        x, y, w = draw.uniform(-1, 1), draw.uniform(-1, 1), draw.uniform(0, side)
        rows.append((k, [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]))
    return rows, spark.createDataFrame(rows, "k long, ring array<struct<lon:double,lat:double>>")


def places(spark, n, draw, names="p long, lon double, lat double"):
    rows = [(k, draw.uniform(-1, 1), draw.uniform(-1, 1)) for k in range(n)]
    return rows, spark.createDataFrame(rows, names)


def feet(x0, y0, x1, y1):
    a = sin(radians(y1 - y0) / 2) ** 2 + cos(radians(y0)) * cos(radians(y1)) * sin(radians(x1 - x0) / 2) ** 2
    return 2 * 3958.8 * 5280 * asin(sqrt(a))


@pytest.mark.parametrize("name", ["point_in_polygon_exact", "nsi_point_in_envelope", "inventory_of_region"])
def test_rows_laid_out_in_cells_are_not_broadcast(spark, name):
    assert not [line for line in joins_of(QUERIES[name](spark, SF)) if "__sx" in line or "id#" in line.split("Inner")[0]]


@pytest.mark.parametrize("name", ["haversine_pairs", "nearest_within_radius", "roof_runs", "knn_contains_preference"])
def test_sides_without_an_estimate_are_not_broadcast(spark, name):
    assert joins_of(QUERIES[name](spark, SF)) == []


@pytest.mark.parametrize("limit", [8, 4096])
def test_keys_and_first_in_rings(spark, limit):
    draw = random.Random(5)
    (rings, drawn), (points, placed) = squares(spark, 300, draw, 0.5), places(spark, 400, draw)
    inside = {(k, p) for k, r in rings for p, x, y in points if r[0][0] < x < r[2][0] and r[0][1] < y < r[2][1]}
    got = [tuple(r) for r in spatial.keys_in_rings(drawn, placed, "k", "p", 0.1, limit=limit).collect()]
    assert set(got) == inside and len(got) == len(inside)
    first = {r["k"]: r["p"] for r in spatial.first_in_rings(drawn, placed, "k", "p", 0.1, limit=limit).collect()}
    assert first == {k: min(p for j, p in inside if j == k) for k, _ in inside}


def test_first_in_rings_looks_past_many_points(spark):
    """All but the last points of a cell lie beside the ring; one without a key is never the first."""
    rows = [(k, 0.01 + k * 1e-6, 0.01) for k in range(500)] + [(500, 0.09, 0.09), (501, 0.091, 0.09), (None, 0.09, 0.09)]
    ring = [(7, [(0.08, 0.08), (0.1, 0.08), (0.1, 0.1), (0.08, 0.1), (0.08, 0.08)])]
    drawn = spark.createDataFrame(ring, "k long, ring array<struct<lon:double,lat:double>>")
    got = spatial.first_in_rings(drawn, spark.createDataFrame(rows, "p long, lon double, lat double"), "k", "p", 1.0)
    assert [(r["k"], r["p"]) for r in got.collect()] == [(7, 500)]


def test_nearest_within(spark):
    """Clusters and far points: the search is widened where the first reach has none."""
    draw = random.Random(11)
    left, _ = places(spark, 200, draw)
    right = [(k, draw.gauss(0.5, 0.05), draw.gauss(0.5, 0.05)) for k in range(120)] + [(200, -0.9, -0.9), (201, -0.9, -0.9)]
    a, b = spark.createDataFrame(left, "p long, lon double, lat double"), spark.createDataFrame(right, "r long, rlon double, rlat double")
    for radius in (3000.0, 150_000.0):
        want = {}
        for p, x, y in left:
            near = min((feet(x, y, u, v), r) for r, u, v in right)
            if near[0] <= radius:
                want[p] = near[1]
        assert {r["p"]: r["r"] for r in spatial.nearest_within(a, b, radius, "p", "r").collect()} == want
    assert spatial.nearest_within(a, b.limit(0), 3000.0, "p", "r").isEmpty() and spatial.nearest_within(a.limit(0), b, 3000.0, "p", "r").isEmpty()


def test_a_wide_reach_is_not_where_the_search_begins(spark, monkeypatch):
    """With a reach over all places each ring would meet each point."""
    cells, used = spatial.with_cells, []
    monkeypatch.setattr(spatial, "with_cells", lambda df, cell, *box: used.append(cell) or cells(df, cell, *box))
    draw = random.Random(2)
    (_, drawn), (_, placed) = squares(spark, 60, draw), places(spark, 5000, draw)
    got = [sorted(map(tuple, spatial.knn_prefer_inside_all(drawn, placed, "k", "p", reach=r).collect())) for r in (None, 2.0)]
    assert got[0] == got[1] and len(got[0]) == 60 and max(used) < 1.0


def test_fronts_by_the_nearest_image_only(spark):
    """Of two images each footprint has the nearer one, and an image without a footprint isn't listed."""
    homes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0)], "bldg_id long, lon double, lat double")
    images = spark.createDataFrame([(8, 0.0011, 0.0), (9, 0.0002, 0.0), (10, 1.0, 1.0)], "image long, rlon double, rlat double")
    got = imagery.footprints_by_image(homes, images, 15000).orderBy("image")
    assert [(r["image"], r["footprints"]) for r in got.collect()] == [(8, [2]), (9, [1])]
    assert joins_of(got) == []
    assert got.agg(F.sum("n")).first()[0] == 2


def test_cells_that_too_many_boxes_cover_are_not_cut(spark):
    """Forty boxes over all of an area, and borders of others in it: no cut brings a cell under the limit."""
    boxes = [(k, -1.0, -1.0, 2.0, 2.0) for k in range(40)] + [(100 + k, k / 50, k / 70, 2.0, 2.0) for k in range(30)]
    df = spark.createDataFrame(boxes, "k long, min_lon double, min_lat double, max_lon double, max_lat double")
    cells, members = areas.row_limited_mesh(df, "k", (0.0, 0.0, 1.0, 1.0), 10)
    got = cells.collect()
    assert {r["level"] for r in got} == {1} and min(r["n"] for r in got) >= 40
    assert members.count() == sum(r["n"] for r in got)


def test_crossings_of_a_cell_in_many_batches(spark):
    """A crowded cell over several batches, beside sparse ones, against all pairs; its segments are not laid out finer than they are."""
    draw = random.Random(9)
    segs = [(k // 2, k % 2, (draw.random() * (1 if k < 160 else 9), draw.random()), (draw.random() * (1 if k < 160 else 9), draw.random())) for k in range(200)]
    df = spark.createDataFrame(segs, "line_id long, part int, a struct<lon:double,lat:double>, b struct<lon:double,lat:double>")
    want = set()
    for i, p, a, b in segs:
        for j, q, c, d in segs:
            det = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if i < j and det:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / det
                u = ((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / det
                if 0 <= t <= 1 and 0 <= u <= 1:
                    want.add((i, p, j, q))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        met = graph.crossings(df, 1.0, limit=8)
        rows = met.select("left_id", "left_part", "right_id", "right_part").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert set(map(tuple, rows)) == want and len(rows) == len(want)
    assert not [line for line in joins_of(met) if "sx" in line]


def test_weighted_knn_compares_blocks_as_matrices(spark):
    """Equal vectors in several blocks tie to the smaller number; one that is null or shorter is left out."""
    draw = random.Random(4)
    vectors = [[draw.gauss(0, 1) for _ in range(19)] for _ in range(60)]
    bank = [(k, vectors[k % 60], k % 7) for k in range(180)] + [(180, None, 0), (181, [1.0], 0)]
    df = spark.createDataFrame(bank, "vec_id long, v array<double>, label int")
    asked = df.where("vec_id % 30 = 0 and vec_id < 180").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    want = {}
    for k in range(0, 180, 30):
        near = sorted((-sum(x * y for x, y in zip(vectors[k % 60], v, strict=True)), j, c) for j, v, c in bank[:180] if j != k)[:10]
        for s, _, c in near:
            want[k, c] = want.get((k, c), 0) + exp(-s / 9)
    scored = metrics.weighted_knn(asked, df, 10, 9.0, blocks=5)
    got = {(r["query_id"], r["label"]): r["score"] for r in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] / want[x] - 1) < 1e-9 for x in want)
    assert "MapInArrow" in scored._jdf.queryExecution().executedPlan().toString()


def test_what_chains_are_made_of_goes(spark):
    """After a network is built the shared folder holds its chains, pieces and numbered rows, not the edges and walks before."""
    lines = [(k, [(k / 100, j / 100) for j in range(6)]) for k in range(50)]
    df = spark.createDataFrame(lines, "line_id long, line array<struct<lon:double,lat:double>>")
    folder = shared.use_shared_folder(spark)
    before = {p.name for p in pathlib.Path(folder.removeprefix("file:")).glob("cut-*")}
    nodes, edges = roads.road_network(df, 1000)
    left = {p.name for p in pathlib.Path(folder.removeprefix("file:")).glob("cut-*")} - before
    assert len(left) == 4 and nodes.count() and edges.count()
