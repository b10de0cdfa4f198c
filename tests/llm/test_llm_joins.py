import random
from pathlib import Path

import numpy as np
import pytest
from brute import BLANK, ODD, base_spans, components, kept_lines, odd
from oracle import SF
from pyspark.sql import functions as F
from test_llm_text import check_pieces

import corpus_pipeline
from terrastock.llm import nn_descent, parity_join
from terrastock.llm.common import Shingler, shared_folder
from terrastock.llm.components import connected_components


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [f"w{k}" for k in range(3000)]


@pytest.fixture(scope="module")
def planted():
    """Chains of edits, a large group of near copies, and texts of all sizes around the limit."""
    rng, docs = random.Random(4), []
    for n in (3, 5, 9, 12, 30, 63, 64, 65, 120, 255, 300, 1100):
        words = text(rng, n).split()
        for k in range(8):
            docs.append(" ".join(words))
            words[rng.randrange(n)] = f"new{n}x{k}"
            if k % 3 == 2:
                words.append("tail")
    shared = text(rng, 80).split()
    for k in range(90):  # one group of near copies with a common passage, and others that have the passage alone
        own = list(shared)
        own[k % 80] = f"only{k}"
        docs.append(" ".join(own))
    for _ in range(40):
        docs.append(" ".join(shared) + " " + text(rng, 60))
    docs += [None, "", " \t", "Alone", "alone\n", docs[0].upper()]
    return list(enumerate(docs))


@pytest.mark.parametrize(("small", "block"), [(8, 256), (2, 256), (2, 7)])
def test_components_of_near_duplicates(spark, planted, monkeypatch, small, block):
    monkeypatch.setattr(parity_join, "SMALL", small)
    monkeypatch.setattr(parity_join, "BLOCK", block)
    got = parity_join.near_duplicates(odd(spark, planted).withColumn("node", F.lit("clash"))).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(planted)


def test_large_group_of_near_copies(spark):
    """5,000 copies of one text with a word changed in each, and as many texts that only share its first half."""
    rng = random.Random(12)
    words = text(rng, 120).split()
    docs = []
    for k in range(5000):
        own = list(words)
        own[rng.randrange(120)] = f"only{k}"
        docs.append((k, " ".join(own)))
    docs += [(10_000 + k, " ".join(words[:60]) + " " + " ".join(f"other{k}x{i}" for i in range(60))) for k in range(5000)]
    got = parity_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    assert got.where("component_id <> case when doc_id < 10000 then 0 else doc_id end").count() == 0 and got.count() == 10_000


def test_near_duplicates_of_odd_rows(spark):
    got = parity_join.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert parity_join.near_duplicates(odd(spark).limit(0)).count() == 0


def test_cells_meet():
    """Sets at the limit share a cell, whatever their size."""
    rng, none = np.random.default_rng(6), np.zeros(1 << 10, bool)
    for n in (9, 20, 63, 64, 70, 250, 256, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, np.uint64) * np.uint64(2))
            d = int(parity_join.difference_limit(len(a), len(a)))
            gone = d // 2
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, gone, np.uint64) * np.uint64(2)]))
            assert len(np.intersect1d(parity_join.cells_of(a, none), parity_join.cells_of(b, none))), n
            assert parity_join.bit_distance(parity_join.parity_bits(a), parity_join.parity_bits(b)) <= parity_join.difference_limit(len(a), len(b))


def test_counts_of_shingles_cover_all_texts(spark):
    """The order of cells follows counts over every document, also those after the first few thousand."""
    rng = random.Random(3)
    passage = text(rng, 30)
    texts = [f"{k} {passage} {k}" if k % 50 == 0 else f"{k} " + text(rng, 12) for k in range(12_000)] + [None, "", "alone"]
    table = parity_join.common_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(6))
    places = np.concatenate([parity_join._places(s, len(table)) for s in Shingler().sequences(texts)])
    assert table.tolist() == [max(n, 1).bit_length() - 1 for n in np.bincount(places, minlength=len(table)).tolist()]
    assert table[parity_join._places(Shingler().sets([passage])[0], len(table))].min() >= 7  # 240 documents


def test_cells_with_rare_shingles_come_first():
    rng = np.random.default_rng(2)
    s, common = np.unique(rng.integers(0, 2**63, 200, np.uint64) * np.uint64(2)), np.full(1 << 12, 9, np.uint8)
    common[parity_join._places(s[::2], len(common))] = rng.integers(0, 5, len(s[::2]))
    part = (s >> np.uint64(64 - 7)).tolist()
    level = common[parity_join._places(s, len(common))].tolist()
    cells = [sorted(b for a, b in zip(part, level, strict=True) if a == p) for p in sorted(set(part))]
    assert parity_join._commonness(s, 7, common).tolist() == [32 * x[0] + (x[1] if len(x) > 1 else 31) for x in cells]


def test_cells_are_not_kept(spark, planted):
    """What only the meeting of cells needs is gone after it, and the session's setting is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before, setting = set(folder.iterdir()), spark.conf.get(name, "false")
    parity_join.near_duplicates(spark.createDataFrame(planted, "doc_id long, text string"))
    left = [c for p in set(folder.iterdir()) - before if any(p.glob("*.parquet")) for c in spark.read.parquet(str(p)).columns]
    assert "sketch" in left and "cells" not in left
    assert spark.conf.get(name, "false") == setting


def test_connected_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102)}


def nearest_by_force(rows, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = {int(ids[j]) for j in order}
    return out


@pytest.mark.parametrize("leaf", [1024, 30])
def test_neighbours(spark, monkeypatch, leaf):
    monkeypatch.setattr(nn_descent, "LEAF", leaf)
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(1000, None), (1020, [0.0] * 64), (1040, [float("nan")] * 64), (1060, [None] * 64), (1080, [1.0]), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    found = nn_descent.nearest(table.unionByName(bad).withColumn("id", F.lit("x")), F.col("vec_id") % 20 == 0).collect()
    want = nearest_by_force([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert all(v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())
    assert sum(len(want[q] & {i for i, _ in v}) for q, v in got.items()) >= 0.9 * 20 * len(want)


def test_recall_over_many_vectors(spark):
    """20,000 vectors, in many leaves, of which 1,000 are queries."""
    x = np.random.default_rng(2).normal(size=(20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.tolist()))
    found = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8), F.col("vec_id") % 20 == 0).collect()
    want, hits = nearest_by_force(rows), 0
    for r in found:
        hits += r["vec_id"] in want[r["query_id"]]
    assert len(found) == 20_000 and hits >= 0.9 * 20_000


def test_few_neighbours(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nn_descent.nearest(table, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert nn_descent.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# pipeline


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    """Each stage against plain code on the rows that the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, SF).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {k for k, _ in pairs(good)}
    assert good.columns == docs.columns
    assert sum((k in kept) == bool(q) for k, q in labels.items() if q is not None) >= 0.9 * len(labels)
    lines = stage["line dedup"](spark, good, SF).cache()
    assert {k: t or "" for k, t in pairs(lines)} == {k: x[2] for k, x in kept_lines(pairs(good)).items()}
    single = stage["n-gram Jaccard join"](spark, lines, SF).cache()
    least = components(pairs(lines))
    assert sorted(pairs(single), key=str) == sorted(((k, t) for k, t in pairs(lines) if least[k][1] == k), key=str)
    clean = stage["PII"](spark, single, SF).cache()
    before = dict(pairs(single))
    assert len(before) == clean.count() and clean.columns == docs.columns
    for k, t in pairs(clean):
        assert not base_spans(t) and ((t or "") == (before[k] or "") or "[" in t), k
    assert check_pieces(stage["packing"](spark, clean, SF).collect(), pairs(clean)) < 0.05


def test_one_of_each_without_or_with_shared_ids(spark):
    """Null ids take part, rows alone stay, and repeated ids leave one row of a group."""
    rng = random.Random(8)
    one, two, three, four, five = (text(rng, 40) for _ in range(5))
    near = lambda t: t + " tail"
    far = near(near(two))
    rows = [(None, one), (None, near(two)), (3, two), (7, three), (7, three), (7, three.upper()), (8, near(three)), (9, four), (9, five), (None, None), (None, ""), (11, ""), (11, "")]
    chain = text(rng, 40).split()
    a, b, c = (" ".join(chain + [f"x{i}" for i in range(k)]) for k in (0, 6, 12))  # a to b and b to c are near, a to c is not
    rows += [(20, a), (None, b), (21, c)]
    docs = odd(spark, rows + [(30, far)])
    got = sorted(pairs(corpus_pipeline.keep_one_of_each(spark, docs, SF)), key=str)
    assert [(k, t.lower() if k == 7 else t) for k, t in got] == sorted([(None, one), (3, two), (7, three), (9, four), (9, five), (None, None), (None, ""), (11, ""), (11, ""), (20, a)], key=str)
    found = {(r["doc_id"]): r["component_id"] for r in parity_join.near_duplicates(docs).collect() if r["doc_id"] in (20, 21)}
    assert found == {20: 20, 21: 20}


def test_run(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert got.columns == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split() and got.count() > 0
    assert BLANK and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
