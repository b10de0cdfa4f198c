"""Networks, floors and sources against hand-made cases and plain versions."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from terrastock.functions import geo, parse
from terrastock.operators import detection, graph
from terrastock.sources import readers, writers

POINT = "struct<lon:double,lat:double>"


def merged(spark, pairs):
    rows = [(k, u, v, [(float(ord(u)), 0.0), (float(ord(v)), 0.0)]) for k, (u, v) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"edge long, node_start string, node_end string, line array<{POINT}>")
    return {r["chain"]: (r["edges"], "".join(chr(int(p["lon"])) for p in r["line"])) for r in graph.merge_chains(df).collect()}


def test_merge_chains(spark):
    # a chain drawn in mixed directions, a ring, a ring with one end, two parallel edges, an edge to its own node
    got = merged(spark, ["ba", "bc", "dc", "ef", "fg", "ge", "hi", "ij", "jk", "ki", "xy", "xy", "zz"])
    assert got[0][0] == 3 and got[0][1] in ("abcd", "dcba")
    assert got[3][0] == 3 and got[3][1][0] == got[3][1][-1] and set(got[3][1]) == set("efg")
    assert got[6] == (1, "hi")
    assert got[7][0] == 3 and got[7][1] in ("ijki", "ikji")
    assert got[10][0] == 2 and got[10][1] in ("xyx", "yxy")
    assert got[12] == (1, "zz") and len(got) == 6


def test_merge_chains_keeps_every_edge(spark):
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = sorted({"".join(sorted(draw.sample(letters, 2))) for _ in range(24)})
    got = merged(spark, pairs)
    seen = sorted("".join(sorted(line[i : i + 2])) for _, line in got.values() for i in range(len(line) - 1))
    assert seen == pairs and sum(n for n, _ in got.values()) == len(pairs)
    assert merged(spark, []) == {}


def plain_floors(rows, height):
    """The same steps box by box."""

    def share(p, q):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        areas = [(b[2] - b[0]) * (b[3] - b[1]) for b in (p, q)]
        return max(w, 0) * max(h, 0) / areas[0] if all(areas) else 0

    own, step = [r[:4] for r in rows if r[4] > 0.2], 1
    while True:
        crowded = any(sum(share(p, q) > 0.75 for p in own) > 3 for q in own)
        level = 0.2 + step * 0.1 if crowded else 0.2 - step * 0.02
        if (own and not crowded) or level > 1 or level < 1e-9:
            break
        own, step = [r[:4] for r in rows if r[4] > level], step + 1
    if not own:
        return 0
    gone = {k for q in own for k in [i for i, p in enumerate(own) if share(p, q) > 0.75][1:]}
    own = [b for k, b in enumerate(own) if k not in gone]
    wide = [(0.9 * b[0], 0, 1.1 * b[2], height - 1) for b in own]
    columns = {tuple(i for i, p in enumerate(wide) if share(p, q) > 0.1) for q in wide}
    stacks = set()
    for k, b in enumerate(own):
        c = lambda o: ((o[0] + o[2]) / 2, (o[1] + o[3]) / 2)
        up = [abs(c(b)[1] - c(o)[1]) > 1.3 * abs(c(b)[0] - c(o)[0]) for o in own]
        stacks.add(tuple(i for i in range(len(own)) if i == k or up[i]))
    first = lambda s: [i not in s for i in range(len(own))]
    if len(columns) == 1 or len(stacks) == 1:
        return len(min(columns, key=first))
    cover = np.zeros((int(height), int(height)))
    shares = []
    for s in sorted(stacks, key=first):
        cover[:] = 0
        for i in s:
            x1, y1, x2, y2 = map(int, own[i])
            cover[x1:x2, y1:y2] = 1
        shares.append((cover[int(height / 5) : int(4 * height / 5)].sum() / max(cover.sum(), 1), s))
    best = [s for v, s in sorted(shares, key=lambda x: -x[0])[:2] if v > 0.1]
    return max(map(len, best)) if best else len(min(stacks, key=first))


def test_floors_as_box_by_box():
    draw = random.Random(5)
    for _ in range(300):
        rows = []
        for _ in range(draw.randint(0, 9)):
            x, y = draw.randint(0, 80), draw.randint(0, 80)
            rows.append((x, y, x + draw.randint(1, 20), y + draw.randint(1, 20), draw.random()))
        rows.sort(key=lambda r: -r[4])
        table = np.array(rows, float).reshape(-1, 5)
        assert detection._floors(table, 100.0) == plain_floors([tuple(r) for r in table.tolist()], 100.0)


def test_floor_counts_of_named_images(spark):
    rows = [("a.png", 1, 40.0, 10.0 + 30 * k, 60.0, 30.0 + 30 * k, 0.9) for k in range(3)] + [("b.png", 9, 1.0, 1.0, 2.0, 2.0, 0.001)]
    boxes = spark.createDataFrame(rows, "image string, box_id long, x1 double, y1 double, x2 double, y2 double, score double")
    assert {tuple(r) for r in detection.floor_counts(boxes, 100).collect()} == {("a.png", 3), ("b.png", 0)}


def test_page_numbers_and_places(spark):
    df = spark.createDataFrame([("<table><tr><td>Floors</td><td> 42 stories</td></tr></table>",), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(parse.labelled_number(F.col("h"), "floors")).collect()] == [42, None, None]
    places = spark.createDataFrame([("x, Utah, United States",), ("Ohio",), (None,)], "p string")
    assert [r[0] for r in places.select(parse.state_of_place(F.col("p"))).collect()] == ["UT", None, None]


def test_lines_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, [(-122.5, 37.5), (-122.4, 37.6)])], f"line_id long, line array<{POINT}>")
    writers.write_lines(df, f"{tmp_path}/lines", ["line_id"])
    feature = json.loads("".join(r[0] for r in spark.read.text(f"{tmp_path}/lines").collect()))
    assert feature["geometry"]["coordinates"] == [[-122.5, 37.5], [-122.4, 37.6]] and feature["properties"] == {"line_id": 1}
    feature["geometry"] = {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}
    (tmp_path / "multi.json").write_text(json.dumps({"features": [feature]}))
    assert [(r["part"], len(r["line"])) for r in readers.read_lines(spark, f"{tmp_path}/multi.json").collect()] == [(0, 2), (1, 2)]


def test_boxed_scan_is_pushed_down(spark, tmp_path, capsys):
    box = geo.ring_bbox(F.array(geo.point(F.col("id"), F.col("id")), geo.point(F.col("id") + 1, F.col("id") + 2)))
    spark.range(10).select("id", box.alias("b")).select("id", "b.*").write.parquet(f"{tmp_path}/f")
    found = readers.read_boxed(spark, f"{tmp_path}/f", 3.5, 3.5, 4.5, 4.5)
    assert sorted(r["id"] for r in found.collect()) == [3, 4]
    found.explain("formatted")
    assert "LessThanOrEqual(min_lon" in capsys.readouterr().out
