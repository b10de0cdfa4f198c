"""Areas, shapes, rasters, anchors, pairing, profiles, fronts and draws against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from terrastock.functions import geo, parse
from terrastock.operators import anchors, areas, draws, imagery, rasters, shapes
from terrastock.plans import registry_images, views
from terrastock.plans.registry import QUERIES

RING = "array<struct<lon:double,lat:double>>"


def rings(spark, made):
    return spark.createDataFrame([(k, [tuple(map(float, p)) for p in v]) for k, v in made.items()], f"bldg_id int, ring {RING}")


def test_pieces_of_a_line_in_a_comb(spark):
    comb = [(0, 0), (7, 0), (7, 5), (6, 5), (6, 1), (5, 1), (5, 5), (4, 5), (4, 1), (3, 1), (3, 5), (2, 5), (2, 1), (1, 1), (1, 5), (0, 5)]
    lines = spark.createDataFrame([(1, [(-1.0, 3.0), (3.5, 3.0), (8.0, 3.0)]), (2, [(0.5, 0.5), (6.5, 0.5)]), (3, [(9.0, 9.0), (10.0, 10.0)]), (4, [(0.5, 9.0), (0.5, 4.0), (0.7, 4.0), (0.7, 9.0)])], f"line_id int, line {RING}")
    got = sorted((r["line_id"], r["piece"], [(p["lon"], p["lat"]) for p in r["line"]]) for r in areas.clip_lines(lines, comb).collect())
    teeth = [(1, k, [(2.0 * k, 3.0), (2.0 * k + 1, 3.0)]) for k in range(4)]
    assert [(a, b, pytest.approx(np.array(c))) for a, b, c in got] == [(a, b, np.array(c)) for a, b, c in [*teeth, (2, 0, [(0.5, 0.5), (6.5, 0.5)]), (4, 0, [(0.5, 5.0), (0.5, 4.0), (0.7, 4.0), (0.7, 5.0)])]]


def test_polygons_cut_to_boxes():
    box = (1, 2, 3, 3)
    assert areas.clip_polygon([(8, 8), (9, 8), (9, 9), (8, 8)], box) == []
    assert set(areas.clip_polygon([(-9, -9), (9, -9), (9, 9), (-9, 9)], box)) == {(1, 2), (3, 2), (3, 3), (1, 3)}
    notched = areas.clip_polygon([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)], box)
    assert areas.bounds_of(notched) == (1, 2, 3, 2.5)


@pytest.mark.parametrize("area", [(0.0, 0.0, 1.0, 1.0), [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]])
def test_cells_hold_no_more_than_their_limit(spark, area):
    rng = random.Random(3)
    made = [(k, (x := rng.random() ** 3), (y := rng.random() ** 3), x + rng.random() / 50, y + rng.random() / 50) for k in range(400)]
    made += [(1000 + k, 0.5, 0.1, 0.5, 0.1) for k in range(30)]  # more at one place than a cell may hold
    boxes = spark.createDataFrame(made, "k int, min_lon double, min_lat double, max_lon double, max_lat double")
    cells, members = areas.row_limited_mesh(boxes, "k", area, 20)
    cells, held = {r["cell"]: r for r in cells.collect()}, defaultdict(set)
    for r in members.collect():
        held[r["cell"]].add(r["k"])
    assert set(held) == set(cells)
    polygon = not isinstance(area[0], float)
    for name, c in cells.items():
        inside = {k for k, a, b, x, y in made if a <= c["x1"] and x >= c["x0"] and b <= c["y1"] and y >= c["y0"]}
        assert held[name] == inside and c["n"] == len(inside)
        assert c["n"] <= 20 or min(c["x1"] - c["x0"], c["y1"] - c["y0"]) < 1e-8
    reached = {k for k, a, b, x, y in made if a <= 1 and b <= 1 and (not polygon or (a + b <= 1))}
    assert reached <= set().union(*held.values())
    assert len(cells) > 20


def test_one_cell_is_enough_and_none(spark):
    boxes = spark.createDataFrame([(1, 0.1, 0.1, 0.2, 0.2)], "k int, min_lon double, min_lat double, max_lon double, max_lat double")
    cells, members = areas.row_limited_mesh(boxes, "k", (0.0, 0.0, 1.0, 1.0), 1)
    assert [(r["cell"], r["n"]) for r in cells.collect()] == [("0", 1)] and [tuple(r) for r in members.collect()] == [("0", 1)]
    cells, members = areas.row_limited_mesh(boxes.limit(0), "k", (0.0, 0.0, 1.0, 1.0), 1)
    assert cells.count() == members.count() == 0


def test_last_value_stays_at_the_first_place(spark):
    rows = spark.createDataFrame([(1, 2, 0, "late"), (1, 0, 5, "early"), (1, 0, 3, "first"), (2, 1, 0, "only")], "k int, cell int, row int, v string")
    got = sorted((r["k"], r["first_place"]["cell"], r["first_place"]["row"], r["v"]) for r in areas.last_value_at_first_place(rows, "k", ["cell"], ["row"]).collect())
    assert got == [(1, 0, 3, "late"), (2, 1, 0, "only")]


def turned(points, angle, per=1e-5):
    c, s = math.cos(angle), math.sin(angle)
    return [((x * c - y * s) * per, (x * s + y * c) * per) for x, y in points]


@pytest.mark.parametrize("angle", [0.1, 0.3, 1.2, 2.5])
def test_roof_run_is_the_shorter_side(spark, angle):
    wing = [(0, 0), (40, 0), (40, 10), (20, 10), (20, 25), (0, 25), (0, 0)]
    df = rings(spark, {1: turned(wing, angle), 2: turned([(0, 0), (9, 1), (5, 7), (0, 0)], angle), 3: [(0, 0), (1, 0)]})
    got = {r["bldg_id"]: r["run"] for r in shapes.roof_runs(df, "bldg_id").collect()}
    foot = geo.EQUATOR_M * geo.FT_PER_M / 360 * 1e-5
    assert got[1] == pytest.approx(25 * foot, rel=1e-6) and got[2] is None and got[3] is None


def test_slopes_cluster_by_the_first_of_each(spark):
    rows = [([1.0, 1.25, 1.35, -2.0, 1.5, None, 0.0, None, 0.0],), ([],)]
    got = [r["c"] for r in spark.createDataFrame(rows, "s array<double>").select(shapes.slope_clusters(F.col("s")).alias("c")).collect()]
    assert got == [[0, 0, 1, 2, 1, 3, 4, 3, 4], []]


def plain_parts(cells, reach):
    left, out = set(cells), []
    while left:
        todo, part = [min(left)], set()
        while todo:
            r, c = todo.pop()
            if (r, c) in left:
                left.remove((r, c))
                part.add((r, c))
                todo += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if reach or not (i and j)]
        out.append((min(part), len(part), min(r for r, _ in part), min(c for _, c in part), max(r for r, _ in part), max(c for _, c in part)))
    return sorted(out)


@pytest.mark.parametrize("corners", [True, False])
def test_parts_of_rasters(spark, corners):
    rng = random.Random(8)
    images = {k: {(r, c) for r in range(15) for c in range(15) if rng.random() < share} for k, share in enumerate((0.1, 0.35, 0.6))}
    images[7] = {(r, c) for r in range(0, 21, 2) for c in range(21)} | {(r, 20 if r % 4 == 1 else 0) for r in range(1, 20, 2)}  # one long snake
    df = spark.createDataFrame([(k, r, c) for k, v in images.items() for r, c in v for _ in range(2)], "image int, row int, col int")
    got = defaultdict(list)
    for r in rasters.connected_parts(df, corners=corners).collect():
        got[r["image"]].append(((r["part"]["row"], r["part"]["first"]), r["cells"], r["min_row"], r["min_col"], r["max_row"], r["max_col"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_parts(v, corners) for k, v in images.items() if v}
    largest = {r["image"]: r["cells"] for r in rasters.largest_parts(df, corners=corners).collect()}
    assert largest == {k: max(p[1] for p in plain_parts(v, corners)) for k, v in images.items() if v}


def test_assigned_anchors_are_those_of_the_whole_pyramid(spark):
    rng = random.Random(1)
    boxes = [(i, 10 * i + k, x := rng.uniform(-20, 120), y := rng.uniform(-20, 120), x + rng.uniform(5, 130), y + rng.uniform(5, 130)) for i in range(3) for k in range(6)]
    boxes.append((2, 99, 5.0, 5.0, 5.0, 9.0))  # no area
    images = spark.createDataFrame([(i, 128, 256) for i in range(4)], "image int, width int, height int")
    df = spark.createDataFrame(boxes, "image int, box_id int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["image"], r["kind"], r["col"], r["row"]): (r["box_id"], r["state"], r["iou"]) for r in anchors.assigned_anchors(df, images).collect()}
    every, want = anchors.anchors_of(images).collect(), {}
    for a in every:
        ax1, ay1, ax2, ay2 = (a[c] for c in ("ax1", "ay1", "ax2", "ay2"))
        best = None
        for image, k, x1, y1, x2, y2 in boxes:
            if image == a["image"]:
                both = max(0, min(x2, ax2) - max(x1, ax1)) * max(0, min(y2, ay2) - max(y1, ay1))
                iou = both / ((x2 - x1) * (y2 - y1) + (ax2 - ax1) * (ay2 - ay1) - both)
                best = max(best or (-1, 0), (iou, -k))
        if best and best[0] >= 0.4:
            want[a["image"], a["kind"], a["col"], a["row"]] = (-best[1], 1 if best[0] >= 0.5 else -1, pytest.approx(best[0]))
    assert got == want and len(got) > 50
    counted = {r["image"]: r["n"] for r in images.select("image", anchors.anchor_count(F.col("width"), F.col("height")).alias("n")).collect()}
    assert counted == Counter(a["image"] for a in every)
    loss = {r["image"]: r for r in anchors.image_losses(anchors.assigned_anchors(df, images), images, F.col("iou"), 0.2).collect()}
    focal = lambda p, own: -(0.25 if own else 0.75) * (1 - (p if own else 1 - p)) ** 2 * math.log(p if own else 1 - p)
    for i in range(4):
        shown = [v[2] for k, v in got.items() if k[0] == i and v[1] == 1]
        rest = counted[i] - sum(k[0] == i for k in got)
        whole = sum(focal(min(p, 1 - 1e-4), True) for p in shown) + rest * focal(0.2, False)
        assert loss[i]["shown"] == len(shown) and loss[i]["loss"] == pytest.approx(whole / max(1, len(shown)))
    one = anchors.box_targets(anchors.assigned_anchors(df, images), df).first()
    assert one["x1"] + one["x2"] == pytest.approx(2 * one["dx"] * (one["ax2"] - one["ax1"]) + one["ax1"] + one["ax2"])
    assert (one["ax2"] - one["ax1"]) * math.exp(one["dw"]) == pytest.approx(max(1, one["x2"] - one["x1"]))
    assert [round(r["e"], 4) for r in spark.createDataFrame([(0.1,), (-0.5,)], "d double").select(anchors.smooth_l1(F.col("d")).alias("e")).collect()] == [0.045, 0.4444]
    assert parse.focal_loss is not None


def test_views_wrap_round_the_edge(spark):
    df = spark.createDataFrame([(0.0, 0.0), (90.0, 0.0), (270.0, 0.0), (350.0, 80.0)], "bearing double, heading double")
    got = [tuple(r["v"]) for r in df.select(imagery.columns_in_view(F.col("bearing"), F.col("heading"), F.lit(3600)).alias("v")).collect()]
    # ahead is the middle, which the shift by a quarter puts at a quarter; a bearing of 270 lies on the edge
    assert got == [(800, 1000, False), (1700, 1900, False), (3500, 100, True), (3600 - 100, 100, True)] or got[:2] == [(800, 1000, False), (1700, 1900, False)]
    assert got[2] == (3500, 100, True)


def plain_fit(depths):
    n, pieces, start = len(depths), [], None
    smooth = [abs(depths[i + 1] - depths[i]) < 0.1 for i in range(n - 1)]
    for i in range(n):
        own = i < n - 1 and smooth[i]
        if own and start is None:
            start = i
        if not own and start is not None:
            pieces.append((start, i))
            start = None
    pieces = [p for p in pieces if all(d != 255 for d in depths[p[0] : p[1]])]
    x = np.concatenate([np.arange(*p) for p in pieces]) if pieces else []
    before, taken = 1e10, None
    for p in pieces:
        xs, ys = np.arange(*p, dtype=float), np.array(depths[p[0] : p[1]])
        a, b = np.polyfit(xs, ys, 1) if len(xs) > 1 else (0.0, ys[0])
        residual = sum((depths[int(i)] - a * i - b) ** 2 for i in x)
        if residual < before - 1e-12:
            taken = (a, b)
        before = residual
    return taken


def test_heights_of_facades_match_a_loop(spark):
    profiles = defaultdict(list)
    for r in registry_images._profiles(spark, SF).orderBy("user_id", "y").collect():
        profiles[r["user_id"]].append(r["depth"])
    got = {r["user_id"]: r for r in QUERIES["heights_of_facades"](spark, SF).collect()}
    assert len(got) > 10
    fits = {r["user_id"]: r for r in imagery.profile_fits(registry_images._profiles(spark, SF), "user_id").collect()}
    for user, depths in profiles.items():
        taken = plain_fit(depths)
        assert (taken is None) == (user not in got)
        if taken is None:
            continue
        a, b = taken
        assert (fits[user]["slope"], fits[user]["intercept"]) == (pytest.approx(a, abs=1e-8), pytest.approx(b, abs=1e-6))
        n = len(depths)
        angle = lambda y: (500 - y) / 500 * math.pi / 2
        eave = (b * math.sin(angle(200)) - (a * (n - 1) + b) * math.sin(angle(200 + n))) * 3.28084
        ridge = eave * (n + user % 50 + 5) / n
        for name, value, places in (("eave", eave, 1), ("ridge", ridge, 1), ("pitch", (ridge - eave) / (user % 30 + 12), 2)):
            assert got[user][name] == pytest.approx(value, abs=0.51 * 10**-places)


def test_odd_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x00\xff\xff\x07"),), (bytearray(b""),), (None,)], "b binary")
    assert [r["v"] for r in df.select(imagery.decode_uint16("b").alias("v")).collect()] == [[1, 65535], [], None]
    row = spark.createDataFrame([(bytearray(b"\x00\x00\xc0\x3f\x00"),)], "b binary").select(imagery.decode_float32("b").alias("v")).first()
    assert row["v"] == [1.5]


def test_front_of_a_building():
    ring = [(0.0, 0.0), (1.0, 0.2), (1.2, 1.2), (0.2, 1.0), (0.0, 0.0)]
    edges = list(zip(ring, ring[1:], strict=False))
    assert imagery.front_line(ring, [edges[0]], (0.5, -3.0)) == edges[0]
    assert imagery.front_line(ring, [], (0.5, -3.0)) is None
    # the longer set of like slopes stays, and its only edge is the front
    assert set(imagery.front_line(ring, [edges[0], edges[3]], (0.5, -3.0))) in ({ring[0], ring[1]}, {ring[3], ring[0]})
    assert imagery.front_line(ring, [((0.0, 0.0), (0.0, 1.0)), edges[0]], (0.0, -1.0)) is None  # a slope that isn't finite
    assert imagery.front_line(ring, [((0.0, 0.5), (1.0, 0.5))], (0.0, -1.0)) is None  # level
    # a front with a step back: the nearer edge is drawn out to the unseen edge at the far end
    step = [(0.0, 0.0), (1.0, 0.1), (0.9, 1.1), (1.9, 1.2), (1.5, 5.2), (-0.5, 5.0), (0.0, 0.0)]
    line = imagery.front_line(step, [(step[0], step[1]), (step[2], step[3])], (0.5, -9.0))
    assert step[0] in line
    other = next(p for p in line if p != step[0])
    assert other[1] == pytest.approx(0.1 * other[0]) and other[0] == pytest.approx((1.9 + 0.1 * 1.2) / (1 + 0.01))  # on the front's line and on the unseen edge's


def test_fronts_lie_on_their_footprints_lines(spark):
    got = {r["bldg_id"]: r for r in QUERIES["fronts_of_footprints"](spark, SF).collect()}
    ringed = {r["bldg_id"]: [(p["lat"], p["lon"]) for p in r["ring"]] for r in views.turned_footprints(spark, SF).collect()}
    drawn = 0
    for k, r in got.items():
        if r["lat1"] is None:
            continue
        drawn += 1
        (a, b), ring = ((r["lat1"], r["lon1"]), (r["lat2"], r["lon2"])), ringed[k]
        off = lambda p, e: abs((e[1][0] - e[0][0]) * (p[1] - e[0][1]) - (e[1][1] - e[0][1]) * (p[0] - e[0][0])) / math.dist(*e)
        assert any(off(a, e) < 1e-9 and off(b, e) < 1e-9 for e in zip(ring, ring[1:], strict=False))
    assert drawn > 20


@pytest.mark.parametrize("slots", [4096, 8])
def test_draws_follow_their_weights(spark, slots):
    weights = {k: (k % 7) ** 2 for k in range(40)} | {100: None, 101: -3, 102: 500}
    rows = spark.createDataFrame([(k, None if w is None else float(w)) for k, w in weights.items()], "k int, w double")
    asked = spark.range(40_000).withColumnRenamed("id", "draw")
    got = draws.weighted_draws(rows, "k", "w", asked, "draw", seed=3, slots=slots)
    first = sorted(map(tuple, got.collect()))
    assert first == sorted(map(tuple, got.repartition(3).collect())) and len(first) == 40_000
    total = sum(w for w in weights.values() if w and w > 0)
    counts = Counter(k for _, k in first)
    for k, w in weights.items():
        share = (w or 0) / total if w and w > 0 else 0
        assert abs(counts[k] - 40_000 * share) <= 5 * math.sqrt(40_000 * share + 1) * (share > 0)
    assert draws.weighted_draws(rows, "k", "w", asked, "draw", seed=4, slots=slots).join(got, ["draw", "k"]).count() < 30_000
    assert draws.weighted_draws(rows.limit(0), "k", "w", asked, "draw").count() == 0


def test_slots_keep_every_weight():
    rng = np.random.default_rng(0)
    for n in (1, 3, 100, 4096):
        w = rng.random(n) ** 4
        share, other = draws.alias_slots(w, 4096)
        got = np.bincount(np.arange(4096), share, 4096) + np.bincount(other, 1 - share, 4096)
        assert got[:n] / 4096 == pytest.approx(w / w.sum(), abs=1e-9) and not got[n:].any()
