"""Hard negatives, exact k-means and repeated passages against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from brute import BLANK, ODD, odd
from oracle import SF, same
from pyspark.sql import functions as F

import corpus_pipeline
from terrastock.llm import ball_kmeans, chat_events, hard_negatives, mil_quality, scaled_sketch, substring_dedup
from terrastock.llm.common import Shingler
from terrastock.llm.queries import ORACLE, QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, extra string"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_ball_kmeans", "op13_substring_dedup"])
def test_same_as_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


def mined(rows, is_anchor, positives=5, negatives=10):
    """Rows (vec_id, vector, label) compared one by one."""
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    own = [(k, np.array([math.floor(256 * x) for x in v], object), y) for k, v, y in rows if k is not None and y is not None and fine(v)]
    out = []
    for i, (a, q, label) in enumerate(own):
        if not is_anchor(a):
            continue
        scored = sorted(((-int(q @ v), k, y) for j, (k, v, y) in enumerate(own) if j != i))
        for s, k, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [(t, n) for t, n, y in scored if y != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, k, r + 1, n, -s, -t) for r, (t, n) in enumerate(hard)]
    return sorted(out)


def clustered(rng, n, d=6, groups=5):
    middle = rng.normal(size=(groups, d))
    return middle[rng.integers(0, groups, n)] + rng.normal(scale=0.2, size=(n, d))


@pytest.mark.parametrize(("first", "block", "cells"), [(4, 8192, 1_000_000), (1, 7, 50)])
def test_hard_negatives(spark, monkeypatch, first, block, cells):
    for name, value in (("FIRST", first), ("BLOCK", block), ("CELLS", cells), ("GROWTH", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist(), int(k) % 4) for k, v in enumerate(clustered(rng, 400))]
    rows += [(400 + k, rows[9][1], int(k) % 3) for k in range(200)]  # a third are copies, with ties
    rows += [(20, rows[3][1], 2), (20, rows[3][1], 2), (40, rows[5][1], 1)]  # ids that repeat
    odd_rows = [(1000, None, 1), (1020, [], 1), (1040, [None] * 6, 1), (1060, [float("nan")] * 6, 1), (1080, [float("inf")] + [0.0] * 5, 1), (1100, [1.0] * 6, None), (None, [1.0] * 6, 2), (1120, [0.0] * 6, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd_rows], VECTORS).repartition(3)
    got = hard_negatives.mine_hard_negatives(df.withColumnsRenamed({"extra": "uid"}), F.col("id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows + odd_rows, lambda k: k % 20 == 0)


def test_hard_negatives_of_large_components_and_none(spark):
    rows = [(k, [float(x) * 1e5 for x in v], k % 2) for k, v in enumerate(clustered(np.random.default_rng(8), 60))]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    got = hard_negatives.mine_hard_negatives(df, F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda k: k % 10 == 0)
    assert hard_negatives.mine_hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(df, F.lit(False)).count() == 0
    assert hard_negatives.mine_hard_negatives(df.where("vec_id = 0"), F.col("id") % 10 == 0).count() == 0


def test_lists_far_below_the_last_score_are_not_visited(spark):
    index = object.__new__(hard_negatives._Index)
    index.centroids, index.radii, index.blocks = np.array([[10.0, 0.0], [0.0, 10.0], [-10.0, 0.0]]), np.array([1.0, 1.0, 1.0]), np.array([2, 1, 1])
    batch = spark.createDataFrame([(7, 1, np.array([10, 0], np.int32).tobytes(), [(1, 50, 10**6)])], f"uid long, label long, v binary, wanted {hard_negatives.WINDOWS}").toArrow().to_batches()
    seen = [(r["list"], r["block"]) for b in hard_negatives._visits(index, 0, 9)(iter(batch)) for r in b.to_pylist()]
    assert seen == [(0, 0), (0, 1)]
    upper, lower = index.bounds(np.array([[10.0, 0.0]]))
    assert (upper[0] >= [110, 10, -90]).all() and (lower[0] <= [90, -10, -110]).all()


def lloyd(rows, k=8, rounds=10):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) in whole numbers of any size."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**16 for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    for r in range(rounds + 1):
        to = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]
        if r < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, t) in zip(kept, to, strict=True) if t == j]
                if mine:
                    centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    whole = [sum(d for d, t in to if t == j) for j in range(len(centres))]
    return [(i, t, d, whole[t], sum(whole), centres[t]) for (i, _), (d, t) in zip(kept, to, strict=True)]


def clusters(spark, rows, **more):
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], VECTORS).repartition(3)
    got = ball_kmeans.cluster_vectors(df.withColumnsRenamed({"extra": "cluster"}), **more)
    return sorted(map(str, ((*r[:5], list(r[5])) for r in got.collect())))


@pytest.mark.parametrize(("chunk", "leaf"), [(4096, 32), (50, 2)])
def test_ball_kmeans(spark, monkeypatch, chunk, leaf):
    monkeypatch.setattr(ball_kmeans, "CHUNK", chunk)
    monkeypatch.setattr(ball_kmeans, "LEAF", leaf)
    rng = np.random.default_rng(5)
    rows = [(k, v.tolist()) for k, v in enumerate(clustered(rng, 240, d=64))]
    rows += [(300 + k, rows[3][1]) for k in range(120)]  # a third are copies
    rows += [(7, rows[8][1]), (7, rows[8][1]), (None, rows[2][1]), (900, None), (901, []), (902, [0.5] * 63), (903, [None] + [0.5] * 63), (904, [float("nan")] * 64), (905, [float("-inf")] * 64)]
    assert clusters(spark, rows) == sorted(map(str, lloyd(rows)))


def test_ball_kmeans_of_large_components_few_rows_and_none(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (v * 2000).tolist()) for k, v in enumerate(clustered(rng, 40, d=64))] + [(99, [1e30] * 64)]
    assert clusters(spark, rows) == sorted(map(str, lloyd(rows)))
    assert clusters(spark, rows[:3]) == sorted(map(str, lloyd(rows[:3])))
    assert clusters(spark, [(1, None)]) == clusters(spark, []) == []


def test_balls_are_settled_whole():
    rng = np.random.default_rng(7)
    far = np.concatenate([rng.integers(0, 50, (100, 4)), rng.integers(10_000, 10_050, (100, 4))]).astype(np.int64)
    order, *nodes = ball_kmeans._build(far)
    t = object.__new__(ball_kmeans._Tree)
    t.points, (t.centres, t.radii, t.counts, t.sums, t.ends) = far[order], nodes
    balls, single = t.settle(np.array([[0, 0, 0, 0], [10_000] * 4]))
    assert len(single) == 0 and sorted(int(t.counts[n]) for n, _ in balls) == [100, 100]
    balls, single = t.settle(np.array([[0, 0, 0, 0], [0, 0, 0, 0], [10_000] * 4]))  # equal centroids: no ball is sure
    assert len(single) == 100 and [int(t.counts[n]) for n, _ in balls] == [100]


def kept_words(docs, window=50):
    """(n_words, n_removed, kept words) of each (doc_id, text)."""
    split = lambda t: [w for w in re.split(f"[{BLANK}]+", t or "") if w]
    least, out = {}, []
    for k, t in docs:
        words = split(t)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if k is not None:
                least[w] = min(k, least.get(w, k))
    for k, t in docs:
        words, gone = split(t), set()
        for i in range(len(words) - window + 1):
            if k is not None and least[tuple(words[i : i + window])] < k:
                gone |= set(range(i, i + window))
        out.append((k, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def passages(rng, n=120):
    words = [f"w{i}" for i in range(400)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    hot, pair, base = some(60), some(50), some(300)
    docs = []
    for k in range(n):
        if k % 3 == 0:  # a passage in a third of all documents, at any place
            docs.append(some(rng.randrange(90)) + hot + some(rng.randrange(90)))
        elif k % 3 == 1:  # copies with a word changed
            own = list(base)
            own[rng.randrange(300)] = f"own{k}"
            docs.append(own[: rng.randrange(100, 300)])
        else:
            docs.append(some(70) + (pair[:49] if k % 2 else pair) + some(10) + (pair if k % 5 == 0 else []))
    docs += [["same"] * 200, ["same"] * 49, ["same"] * 90, hot[:49], hot[:50], hot]
    return [(int(k), " ".join(d)) for k, d in enumerate(docs)]


@pytest.mark.parametrize("chunk", [600_000, 40])
def test_repeated_passages(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    rng = random.Random(9)
    docs = passages(rng)
    rng.shuffle(docs)
    got = substring_dedup.drop_repeats(odd(spark, docs).repartition(5).withColumn("known", F.lit("clash")), tidy=True).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got), key=str) == kept_words(docs)
    assert {r["known"] for r in got} == {"clash"}


@pytest.mark.parametrize(("window", "period"), [(3, 1), (8, 8), (8, 5), (20, None), (1, None)])
def test_other_windows(spark, window, period):
    rng = random.Random(window)
    docs = [(k, " ".join(rng.choice("abc") if window < 10 else rng.choice("ab") for _ in range(rng.randrange(60)))) for k in range(40)]
    got = substring_dedup.drop_repeats(odd(spark, docs), window=window, period=period, tidy=True).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got), key=str) == kept_words(docs, window)


def test_odd_texts_of_passages(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    docs = [*ODD, (9, passage), (9, passage), (9, f"x {passage}"), (None, passage), (None, passage), (3, f"{passage}\n\n z"), (10, passage.upper()), (11, f"ab　c {passage}"), (10**12, None)]
    got = substring_dedup.drop_repeats(odd(spark, docs), tidy=True).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got), key=str) == kept_words(docs)
    plain = {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(odd(spark, [(1, None), (2, " a\n b "), (3, passage), (4, f"q {passage}")])).collect()}
    assert plain == {1: None, 2: " a\n b ", 3: passage, 4: "q"}
    assert substring_dedup.drop_repeats(odd(spark, [])).count() == 0


@pytest.mark.parametrize("period", range(1, 36))
def test_cover_gives_every_shift(period):
    cover = substring_dedup.difference_cover(period)
    assert {(int(a) - int(b)) % period for a in cover for b in cover} == set(range(period))


def test_passages_of_the_small_table_recur(spark):
    got = QUERIES["op13_substring_dedup"](spark, SF)
    assert got.where("n_removed > 0").count() > 0


def test_logs_of_turns_fold_back(spark):
    turns = spark.createDataFrame([(c, p, ("user", "assistant", None)[p % 3], t) for c in (1, 2, None) for p, t in enumerate(["", None, "a", "äß😀 three", "x" * 500, "<|im_end|>", "superseded", "b\nc"] * 4, 1)], "conv_id long, place long, role string, text string")
    log = chat_events.events_of_turns(turns)
    kinds = {r["kind"] for r in log.select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"} and log.where("text = 'an answer to what is gone'").count() > 9
    got = sorted((r["conv_id"] or 0, r["turn"], r["role"], r["text"]) for r in chat_events.fold_events(log).collect())
    assert got == sorted((r["conv_id"] or 0, 2 * r["place"], r["role"] or "", r["text"] or "") for r in turns.collect())


def test_one_long_labelled_text_does_not_stop_the_fit(spark):
    good, bad = "A plain sentence about the weather in spring, and another one. ", "$$$ CLICK >>> http 0000 !!! "
    docs = [(k, (good if k % 2 else bad) * (3 + k % 5), "en", "s", 0) for k in range(60)]
    ids = spark.createDataFrame([(k,) for k in range(60)], "doc_id long").orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    docs[ids] = (ids, good * 500_000, "en", "s", 0)  # 31 MB, the first by hash
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = mil_quality.train_quality(df, labels)
    scored = {r["doc_id"]: r["score"] for r in mil_quality.score_quality(df.where(F.col("doc_id") != ids), model).collect()}
    assert all((s >= 0.5) == bool(k % 2) for k, s in scored.items())


def plain_sketches(spark, docs):
    """Neighbours and sketches of (doc_id, text) one by one, in the order of id and the text's hash."""
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in docs], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    rows = sorted(((-(2**63) if k is None else k, hashes[t or ""], k, t or "") for k, t in docs), key=lambda r: r[:2])
    sets = Shingler().sets
    kept = lambda t: sorted(int(h) for i, h in enumerate(s) if int(h) < 2**60 or i < 32) if len(s := sets([t])[0]) else []
    out = []
    for n, (_, _, k, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][3]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]

        def near(a, b):
            x, y = ([int(h) for h in sets([t])[0]] for t in (a, b))
            if not x or not y:
                return float(len(x) == len(y) == 0)
            reach = min(2**64 if len(kept(t)) == len(v) else max(2**60 - 1, kept(t)[-1]) for t, v in ((a, x), (b, y)))
            x, y = ({h for h in kept(t) if h <= reach} for t in (a, b))
            return len(x & y) / len(x | y) if x and y else 0.0

        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), kept(text), kept(edited), near(text, edited), near(text, after)))
    return sorted(out, key=str)


def test_sketches_of_many_rows_of_one_id(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    docs = [(rng.choice([None, None, k // 3]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 600])))) for k in range(90)]
    docs += ODD + [(7, docs[5][1]), (None, docs[5][1])] + [(None, "twice " * 9)] * 2
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], [int(h) for h in scaled_sketch.Sketch.parse(r["fingerprint"]).hashes], [int(h) for h in scaled_sketch.Sketch.parse(r["edited_fingerprint"]).hashes], r["near_edited"], r["near_next"]) for r in scaled_sketch.edited_by_next(odd(spark, docs).repartition(3)).collect()]
    assert [(*r[:5], pytest.approx(r[5]), pytest.approx(r[6])) for r in sorted(got, key=str)] == plain_sketches(spark, docs)
    places = odd(spark, [(None, f"t{k}") for k in range(4000)]).select(F.lit(-(2**63)).alias("id"), F.xxhash64("text").alias("h"))
    assert len(scaled_sketch._firsts(places)) > 2  # one id is many ranges


def test_pipeline_and_new_queries_over_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op2_scaled_sketch", "op11_hard_negatives", "op12_ball_kmeans", "op13_substring_dedup"):
        got, full = QUERIES[name](spark, str(tmp_path)), QUERIES[name](spark, SF)
        assert got.count() == 0 and got.dtypes == full.dtypes
    assert [r["conv_id"] for r in QUERIES["op8_chat_events"](spark, str(tmp_path)).collect()] == [-1]
