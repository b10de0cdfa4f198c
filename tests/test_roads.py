"""Networks of roads against plain versions."""

import math
import random

import pytest
from oracle import SF
from pyspark.sql import functions as F

from terrastock.operators import graph, roads, shared
from terrastock.plans.registry import QUERIES

LINES = "line_id long, line array<struct<lon:double,lat:double>>, cls string"


def feet(p, q):
    (x0, y0), (x1, y1) = ((math.radians(v) for v in z) for z in (p, q))
    a = math.sin((y1 - y0) / 2) ** 2 + math.cos(y0) * math.cos(y1) * math.sin((x1 - x0) / 2) ** 2
    return 2 * 3958.8 * 5280 * math.asin(math.sqrt(a))


def units(line):
    return [round(feet(p, q) * 1000) for p, q in zip(line, line[1:], strict=False)]


def place(line, m):
    """The point at a measure along a line."""
    for (p, q), n in zip(zip(line, line[1:], strict=False), units(line), strict=True):
        if m <= n and n:
            return tuple(a + (b - a) * m / n for a, b in zip(p, q, strict=True))
        m -= n
    return line[-1]


def frame(spark, lines):
    return spark.createDataFrame([(k, [tuple(map(float, p)) for p in v], f"c{k}") for k, v in lines.items()], LINES).repartition(3)


def points(line):
    return [(p["lon"], p["lat"]) for p in line]


@pytest.fixture(scope="module")
def wandering():
    rng = random.Random(2)
    lines = {}
    for k in range(30):
        x, y, line = rng.uniform(-1, 1), rng.uniform(40, 41), []
        for _ in range(rng.randrange(2, 12)):
            line.append((x, y))
            x, y = x + rng.uniform(-0.01, 0.01), y + rng.uniform(-0.01, 0.01)
        lines[k] = line
    return lines | {90: [(0.0, 0.0), (0.0, 0.0)], 91: [(0.0, 0.0), (0.0, 0.0), (0.02, 0.0), (0.02, 0.0)]}


def test_even_pieces_of_whole_lines(spark, wandering):
    got = {(r["line_id"], r["seg_id"]): r for r in roads.split_evenly(frame(spark, wandering), 1000).collect()}
    for k, line in wandering.items():
        total = sum(units(line))
        n = max(1, -(-total // 1_000_000))
        own = [got.pop((k, i)) for i in range(n)]
        assert all(r["pieces"] == n for r in own)
        for i, r in enumerate(own):
            way = points(r["line"])
            for p, want in ((way[0], i * total // n), (way[-1], (i + 1) * total // n)):
                assert p == pytest.approx(place(line, want), abs=1e-9)
            assert r["length_ft"] == ((i + 1) * total // n - i * total // n) / 1000
        inner = [p for r in own for p in points(r["line"])[1:-1]]
        assert [p for p in inner if p in line] == inner
    assert not got


def test_network_names_nodes_that_exist(spark):
    square = [(0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01), (0, 0)]
    lines = {1: [(1, 0), (1.01, 0), (1.02, 0)], 2: [(1.02, 0), (1.03, 0.001)], 3: [(1.02, 0), (1.02, 0.01)], 4: square, 5: [(1.01, 0), (1, 0)], 6: [(2, 2), (2, 2)], 7: [(3, 0), (3.001, 0), (3, 0.001), (3, 0), (3, -0.01)]}
    nodes, edges = roads.road_network(frame(spark, lines), 1000)
    at, edges = {r["node_id"]: (r["lon"], r["lat"]) for r in nodes.collect()}, edges.collect()
    assert sorted(at) == list(range(len(at)))
    ends = set()
    for e in edges:
        way = points(e["line"])
        assert at[e["node_start"]] == pytest.approx(way[0], abs=1e-9) and at[e["node_end"]] == pytest.approx(way[-1], abs=1e-9)
        assert e["length_ft"] <= 1000.001
        ends |= {e["node_start"], e["node_end"]}
    assert ends == set(at)  # no node is left over
    chains = {}
    for e in sorted(edges, key=lambda e: (e["chain"], e["seg_id"])):
        chains.setdefault(e["line_id"], []).append(e)
    # two straight parts are one chain, a ring is one, a loop at a junction is one, a line without length is none
    assert {k: len({e["chain"] for e in v}) for k, v in chains.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 2}
    for own in chains.values():
        for a, b in zip(own, own[1:], strict=False):
            if a["chain"] == b["chain"]:
                assert a["node_end"] == b["node_start"] and a["line"][-1] == b["line"][0]
    whole = sum(feet(p, q) for k in (1, 2, 3, 4, 7) for p, q in zip(lines[k], lines[k][1:], strict=False))
    assert sum(e["length_ft"] for e in edges) == pytest.approx(whole, abs=0.1)


def test_pieces_keep_coordinates_and_attributes(spark):
    lines = {1: [(0, 0), (0.01, 0), (0.02, 0)], 2: [(0.005, -0.01), (0.005, 0.01)], 3: [(0.01, 0), (0.01, 0.01)], 4: [(5, 5), (5.01, 5)]}
    df = frame(spark, lines)
    met = graph.crossings(graph.explode_segments(df), 0.003)
    cuts = met.selectExpr("left_id as line_id", "left_part as part", "t").unionByName(met.selectExpr("right_id as line_id", "right_part as part", "u as t"))
    got = sorted((r["line_id"], r["piece"], r["cls"], [(round(x, 6), round(y, 6)) for x, y in points(r["line"])]) for r in roads.pieces_with_attributes(df, cuts).collect())
    assert got == [
        (1, 0, "c1", [(0, 0), (0.005, 0)]), (1, 1, "c1", [(0.005, 0), (0.01, 0)]), (1, 2, "c1", [(0.01, 0), (0.02, 0)]),
        (2, 0, "c2", [(0.005, -0.01), (0.005, 0)]), (2, 1, "c2", [(0.005, 0), (0.005, 0.01)]),
        (3, 0, "c3", [(0.01, 0), (0.01, 0.01)]), (4, 0, "c4", [(5, 5), (5.01, 5)]),
    ]


def test_crossings_of_one_hot_cell(spark):
    """A third of all segments lie in one cell, which is cut into finer ones; no crossing is lost or comes twice."""
    rng = random.Random(5)
    lines = {k: [(rng.uniform(0, 0.004), rng.uniform(0, 0.004)) for _ in range(2)] for k in range(60)}
    lines |= {100 + k: [(x := rng.uniform(-1, 1), y := rng.uniform(-1, 1)), (x + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.3, 0.3))] for k in range(60)}
    segs = graph.explode_segments(frame(spark, lines))
    got = {}
    for r in graph.crossings(segs, 0.05, limit=4).collect():
        assert (r["left_id"], r["right_id"]) not in got
        got[r["left_id"], r["right_id"]] = (r["lon"], r["lat"])
    want = {}
    for i, (a, b) in lines.items():
        for j, (c, d) in lines.items():
            rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
            det = rx * sy - ry * sx
            if i < j and det:
                t, u = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / det, ((c[0] - a[0]) * ry - (c[1] - a[1]) * rx) / det
                if 0 <= t <= 1 and 0 <= u <= 1:
                    want[i, j] = (a[0] + t * rx, a[1] + t * ry)
    assert got == want and len(got) > 400


def test_numbers_of_rows(spark):
    df = spark.range(1000).select(F.lit(5).alias("a"), F.xxhash64("id").alias("b")).repartition(7)
    got = [(r["b"], r["n"]) for r in shared.number_rows(df, ["a", "b"], "n", start=10).orderBy("b").collect()]
    assert [n for _, n in got] == list(range(10, 1010))
    assert shared.number_rows(df.limit(0), ["a", "b"], "n").count() == 0


def test_records_without_the_minimum(spark):
    bridges = spark.createDataFrame([("b", "3", "02", 1.0, 2.0, 3.0, "x")], "structure_number string, structure_kind string, structure_type string, max_span_len_mt double, deck_width_mt double, structure_len_mt double, more string")
    row = roads.bridge_records(bridges, unit="km").first()
    assert (row["BridgeClass"], row["MaxSpanLength"], row["StructureLength"], row["more"], row["type"]) == (302, 0.001, 0.003, "x", "Bridge")
    tunnels = spark.createDataFrame([("t", "bored", 1.0)], "tunnel_number string, cons_type string, lon double")
    row = roads.tunnel_records(tunnels, location=True).first()
    assert (row["TunnelNumber"], row["ConstructType"], row["Location"], row["assetSubtype"]) == ("t", "bored", 0, "HwyTunnel")


def test_shared_folder_holds_results_only(spark):
    """Merging in rounds leaves no files of earlier rounds."""
    import os

    folder = shared.use_shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    QUERIES["merged_roads"](spark, SF).count()
    assert len(set(os.listdir(folder)) - before) <= 4
