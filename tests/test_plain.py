"""Operators that SQL can't check, against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from terrastock.functions import geo
from terrastock.operators import detection, graph, spatial
from terrastock.plans import views
from terrastock.plans.registry import QUERIES


def cosine(a, b):
    x, y = (Counter(re.findall(r"\b\w\w+\b", s.lower())) for s in (a, b))
    weigh = lambda own, other: {t: n * (1 if t in other else 1 + math.log(1.5)) for t, n in own.items()}
    u, v = weigh(x, y), weigh(y, x)
    norm = math.sqrt(sum(w * w for w in u.values()) * sum(w * w for w in v.values()))
    return sum(u[t] * v[t] for t in u if t in v) / norm if norm else 0.0


def test_names_are_matched_as_by_hand(spark):
    rng = random.Random(4)
    words = ["main", "Street", "river", "bridge", "old", "élan", "a", "of", "old-town"]
    name = lambda: rng.choice([None, "", " ", "?"]) if rng.random() < 0.2 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
    lines = {k: name() for k in range(40)}
    points = {k: name() or "x" for k in range(25)}
    pairs = [(p, points[p], k, lines[k]) for p in points for k in lines if rng.random() < 0.3]
    df = spark.createDataFrame(pairs, "p int, a string, k int, b string")
    got = {r["p"]: (r["lines"], r["score"]) for r in graph.match_names(df, "p", "k", "a", "b").collect()}
    want = {}
    for p in {q[0] for q in pairs}:
        scored = [(-1.0 if not (b or "").strip() else round(cosine(a, b), 9), k) for q, a, k, b in pairs if q == p]
        top = max(s for s, _ in scored)
        kept = [(s, k) for s, k in scored if (s == top if top > 0 else s == -1)]
        if kept:
            want[p] = (",".join(map(str, sorted(k for _, k in kept))), pytest.approx(max(s for s, _ in kept)))
    assert got == want


def test_mahalanobis_distances(spark):
    x = np.array([r["embedding"] for r in views.table(spark, SF, "embeddings").orderBy("vec_id").collect()])
    c = x - x.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", c, np.linalg.inv(c.T @ c / len(x) + 1e-9 * np.eye(x.shape[1])), c)
    got = [r["m2"] for r in QUERIES["mahalanobis"](spark, SF).orderBy("vec_id").collect()]
    assert got == pytest.approx(want, abs=1e-3)


def test_cells_of_the_adaptive_mesh(spark):
    places = [(r["lon"], r["lat"]) for r in views.points(spark, SF, "customer").collect()]
    cells = QUERIES["adaptive_mesh"](spark, SF).collect()
    held = 0
    for c in cells:
        size = 0.5 / 2 ** c["level"]
        own = sum(c["cx"] <= (x + 122.5) / size < c["cx"] + 1 and c["cy"] <= (y - 37.5) / size < c["cy"] + 1 for x, y in places)
        assert c["n"] == own <= 40
        held += own
    assert held == len(places)


@pytest.mark.parametrize("n", [1, 7, 60])
def test_joint_area_of_boxes(n):
    rng = random.Random(n)
    b = np.array([[x := rng.randrange(30), y := rng.randrange(30), x + rng.randrange(12), y + rng.randrange(12)] for _ in range(n)], float)
    cells = {(i, j) for x0, y0, x1, y1 in b.astype(int) for i in range(x0, x1) for j in range(y0, y1)}
    assert detection._joint_area(b, 10, 20, 25) == (len(cells), sum(10 <= i < 20 and j < 25 for i, j in cells))


def test_a_thousand_boxes_need_little_memory():
    rng = np.random.default_rng(0)
    b = rng.random((1000, 4)) * 500
    b[:, 2:] += b[:, :2]
    whole, middle = detection._joint_area(b, 200, 400, 1000)
    assert 0 < middle < whole < 10**6


@pytest.mark.parametrize("limit", [2, 50, 4096])
def test_points_in_rings_where_a_third_lie_in_one_place(spark, limit):
    rng = random.Random(limit)
    places = [(k, 5.0, 5.0) if k % 3 == 0 else (k, rng.choice([rng.uniform(-3, 12), 5 + rng.random() / 100, float(rng.randrange(10))]), rng.uniform(-3, 12)) for k in range(300)]
    rings = [(k, float(x), float(y), x + w, y + h) for k in range(40) for x, y, w, h in [(rng.randrange(-2, 9) + rng.choice([0.0, 0.3]), rng.randrange(-2, 9), rng.choice([0.0, 0.5, 2.0]), rng.choice([0.25, 3.0]))]]
    points = spark.createDataFrame([*places, (900, None, 1.0), (901, 2.0, None)], "p int, lon double, lat double").withColumn("name", F.concat(F.lit("n"), "p"))
    corner = lambda x, y: geo.point(F.col(x), F.col(y))
    drawn = spark.createDataFrame(rings, "k int, x0 double, y0 double, x1 double, y1 double")
    drawn = drawn.select("k", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")).alias("ring"))
    want = {(k, p) for k, x0, y0, x1, y1 in rings for p, x, y in places if x0 <= x <= x1 and y0 <= y <= y1}
    got = [(r["k"], r["p"]) for r in spatial.points_in_rings(drawn, points, 1.0, limit=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = {r["k"]: (r["p"], r["name"]) for r in spatial.first_in_rings(drawn, points, "k", "p", 1.0, limit=limit).collect()}
    assert first == {k: (p, f"n{p}") for k in {k for k, _ in want} for p in [min(p for j, p in want if j == k)]}
    assert spatial.points_in_rings(drawn.limit(0), points, 1.0).isEmpty() and spatial.points_in_rings(drawn, points.limit(0), 1.0).isEmpty()


def test_anchors_stay_in_the_task_of_their_box(spark):
    plan = QUERIES["anchors_of_boxes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # nothing is shuffled between the places of boxes and the choice of each anchor's box
    placed = plan.index("Generate explode(CASE")
    chosen = plan[:placed].rindex("min(struct(")
    assert "Exchange" not in plan[chosen:placed]
