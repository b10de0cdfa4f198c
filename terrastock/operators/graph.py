"""Road networks: lines to edges and nodes, splitting, intersections, contraction, name matching.

Lines are (line_id, ring-like array of points); nodes are named by their coordinates, rounded to 7 decimals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastock.functions import geo
from terrastock.operators import shared
from terrastock.operators.shared import cut, release


def node_key(p: Column) -> Column:
    return F.concat(geo.seven_places(p["lon"]), F.lit(" "), geo.seven_places(p["lat"]))


def explode_segments(lines: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """(key, part, a, b): the segments of each line in order."""
    return lines.select(key, F.posexplode(geo.segments(F.col(line))).alias("part", "s")).select(key, "part", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


def graph_nodes(segs: DataFrame, key: str = "line_id") -> DataFrame:
    """(node, lon, lat, degree, first_line): distinct end points with the smallest line they lie on."""
    ends = segs.select(key, F.explode(F.array("a", "b")).alias("p"))
    return ends.groupBy(node_key(F.col("p")).alias("node")).agg(F.min("p.lon").alias("lon"), F.min("p.lat").alias("lat"), F.count("*").alias("degree"), F.min(key).alias("first_line"))


def graph_edges(segs: DataFrame, key: str = "line_id") -> DataFrame:
    """(key, part, node_start, node_end, length_ft)."""
    length = geo.haversine_ft(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    return segs.select(key, "part", node_key(F.col("a")).alias("node_start"), node_key(F.col("b")).alias("node_end"), length.alias("length_ft"))


def split_long_edges(segs: DataFrame, most_ft: float, key: str = "line_id") -> DataFrame:
    """Segments cut into equal parts of at most ``most_ft``: (key, part, seg_id, a, b)."""
    length = geo.haversine_ft(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    counted = segs.withColumn("__n", F.greatest(F.ceil(length / most_ft), F.lit(1)).cast("int"))
    parts = counted.withColumn("seg_id", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    cut = geo.split_line(F.col("a"), F.col("b"), F.col("__n"), F.col("seg_id"))
    return parts.select(key, "part", "seg_id", F.get(cut, F.lit(0)).alias("a"), F.get(cut, F.lit(1)).alias("b"))


def crossings(segs: DataFrame, cell: float, key: str = "line_id", limit: int = 64, columns: Sequence[str] | None = None) -> DataFrame:
    """Points where segments of different lines meet, ends included, once for each pair of segments: (left_id, left_part, t,
    right_id, right_part, u, lon, lat), or of these ``columns``, t and u being the place on each segment from 0 to 1. Segments
    on one line of the plane have no such point.

    Segments meet in the cells that both cover, and a pair counts in the cell that holds the lower left corner of what
    their boxes share, so that no pair comes twice. A cell with more than ``limit`` segments is cut into finer ones, but not
    finer than its segments' boxes usually are: such cells would meet the same pairs again and again.
    """
    lo, hi = (lambda k: F.least(f"a.{k}", f"b.{k}")), (lambda k: F.greatest(f"a.{k}", f"b.{k}"))
    axes = {"x": "lon", "y": "lat"}
    at = lambda x: F.floor(x / cell).cast("long")
    # dealt before segments are laid out in cells, which are many more rows
    boxed = shared.dealt(segs.select(key, "part", "a", "b"), key).select(F.col(key).alias("id"), "part", "a", "b", *(f(k).alias(f"{n}{c}") for c, k in axes.items() for n, f in (("lo", lo), ("hi", hi))))
    covered = boxed.withColumn("cx", F.explode(F.sequence(at(F.col("lox")), at(F.col("hix"))))).withColumn("cy", F.explode(F.sequence(at(F.col("loy")), at(F.col("hiy")))))
    side = F.avg((F.col("hix") - F.col("lox") + F.col("hiy") - F.col("loy")) / 2)
    crowded = covered.groupBy("cx", "cy").agg(F.count("*").alias("n"), side.alias("side")).where(F.col("n") > limit)
    most = F.greatest(F.lit(1), F.floor(F.coalesce(F.lit(float(cell)) / F.nullif(F.col("side"), F.lit(0.0)), F.lit(1024.0))))
    finer = crowded.select("cx", "cy", F.least(F.ceil(F.sqrt(F.col("n") / limit)), most, F.lit(1024)).cast("long").alias("f")).where("f > 1")
    cells = covered.join(finer, ["cx", "cy"], "left").withColumn("f", F.coalesce("f", F.lit(1)))
    # the finer cell of a place in a cell, kept inside it
    fine = lambda x, c: F.greatest(F.lit(0), F.least(F.col("f") - 1, F.floor((x / cell - F.col(c)) * F.col("f"))))
    for c in axes:
        cells = cells.withColumn(f"s{c}", F.explode(F.sequence(fine(F.col(f"lo{c}"), f"c{c}"), fine(F.col(f"hi{c}"), f"c{c}"))))
    places = ["cx", "cy", "sx", "sy"]
    ends = [F.col(f"{p}.{k}").alias(f"{p}{c}") for p in ("a", "b") for c, k in axes.items()]
    flat = cells.select(*places, "f", "id", "part", *ends).repartition(shared.task_count(segs), *places).sortWithinPartitions(*places)
    types = {f.name: f.dataType for f in flat.schema}
    kinds = {"left_id": types["id"], "left_part": types["part"], "t": T.DoubleType(), "right_id": types["id"], "right_part": types["part"], "u": T.DoubleType(), "lon": T.DoubleType(), "lat": T.DoubleType()}
    wanted = list(columns or kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_cells(batches, places):
            for i, j, made in _crossings_in(rows, starts, cell):
                sides = {"left": i, "right": j}
                arrays = [pa.array(made[c]) if c in made else rows.column(c.split("_")[1]).take(pa.array(sides[c.split("_")[0]])) for c in wanted]
                yield pa.RecordBatch.from_arrays(arrays, wanted)

    return flat.mapInArrow(run, T.StructType([T.StructField(c, kinds[c]) for c in wanted]))


def _whole_cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in batches of whole cells, with the places where cells begin and the last one ends."""
    held, last = [], None

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        k = np.column_stack([rows.column(c).to_numpy() for c in keys])
        return rows, np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, rows.num_rows]

    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(c).to_numpy() for c in keys])
        end = tuple(k[-1])
        first = int((k == k[-1]).all(1).argmax())  # where the batch's last cell begins
        if end != last or first:
            if held or first:
                yield whole([*held, b.slice(0, first)] if first else held)
            held, last = [b.slice(first)], end
        else:
            held.append(b)
    if held:
        yield whole(held)


def _crossings_in(rows: pa.RecordBatch, starts: np.ndarray, cell: float, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Pairs of rows of one cell whose segments cross and that count there, by their places, with t, u and the point."""
    ids = rows.column("id").to_numpy(zero_copy_only=False)
    cx, cy, sx, sy, f = (rows.column(c).to_numpy().astype(float) for c in ("cx", "cy", "sx", "sy", "f"))
    ax, ay, bx, by = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("ax", "ay", "bx", "by"))
    lox, hix, loy, hiy = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)

    def told(i: np.ndarray, j: np.ndarray):
        for lo, c, s in ((lox, cx, sx), (loy, cy, sy)):
            corner = np.maximum(lo[i], lo[j])
            place = np.clip(np.floor((corner / cell - c[i]) * f[i]), 0, f[i] - 1)
            own = (np.floor(corner / cell) == c[i]) & (place == s[i])
            i, j = i[own], j[own]
        rx, ry, qx, qy = bx[i] - ax[i], by[i] - ay[i], bx[j] - ax[j], by[j] - ay[j]
        det = rx * qy - ry * qx
        ox, oy = ax[j] - ax[i], ay[j] - ay[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (ox * qy - oy * qx) / det, (ox * ry - oy * rx) / det
        on = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        t, i = t[on], i[on]
        return i, j[on], {"t": t, "u": u[on], "lon": ax[i] + t * rx[on], "lat": ay[i] + t * ry[on]}

    left, right, n = [], [], 0
    for at, until in zip(starts[:-1], starts[1:], strict=True):
        if until - at < 2:
            continue
        own = slice(at, until)
        step = max(1, most // int(until - at))
        for x in range(at, until, step):
            some = slice(x, min(until, x + step))
            met = (ids[some, None] < ids[own]) & (lox[some, None] <= hix[own]) & (hix[some, None] >= lox[own]) & (loy[some, None] <= hiy[own]) & (hiy[some, None] >= loy[own])
            i, j = np.nonzero(met)
            left.append(i + x)
            right.append(j + at)
            n += len(i)
            if n > most // 4:
                yield told(np.concatenate(left), np.concatenate(right))
                left, right, n = [], [], 0
    if n:
        yield told(np.concatenate(left), np.concatenate(right))


def line_intersections(segs: DataFrame, cell: float, key: str = "line_id") -> DataFrame:
    """(left_id, right_id, lon, lat) of proper crossings of segments of different lines, once each."""
    met = crossings(segs, cell, key, columns=("left_id", "right_id", "lon", "lat"))
    return met.select("left_id", "right_id", geo.rounded("lon", 7).alias("lon"), geo.rounded("lat", 7).alias("lat")).distinct()


def cut_segments(segs: DataFrame, points: DataFrame, key: str = "line_id") -> DataFrame:
    """Segments cut at given points of their line: (key, part, piece, a, b). ``points``: (key, lon, lat)."""
    on = points.select(key, F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat")).alias("p")).distinct()
    d2 = lambda p, q: (F.col(f"{p}.lon") - F.col(f"{q}.lon")) ** 2 + (F.col(f"{p}.lat") - F.col(f"{q}.lat")) ** 2
    along = ((F.col("p.lon") - F.col("a.lon")) * (F.col("b.lon") - F.col("a.lon")) + (F.col("p.lat") - F.col("a.lat")) * (F.col("b.lat") - F.col("a.lat"))) / F.nullif(d2("a", "b"), F.lit(0.0))
    off = F.abs((F.col("p.lon") - F.col("a.lon")) * (F.col("b.lat") - F.col("a.lat")) - (F.col("p.lat") - F.col("a.lat")) * (F.col("b.lon") - F.col("a.lon"))) / F.sqrt(F.nullif(d2("a", "b"), F.lit(0.0)))
    hits = segs.join(on, key).withColumns({"t": along, "off": off}).where("off < 2e-7 and t > 1e-9 and t < 1 - 1e-9")
    cuts = hits.groupBy(key, "part").agg(F.array_sort(F.collect_set(F.struct("t", "p"))).alias("cuts"))
    joined = segs.join(cuts, [key, "part"], "left")
    way = F.concat(F.array("a"), F.coalesce(F.transform("cuts", lambda c: c["p"]), F.expr("cast(array() as array<struct<lon:double,lat:double>>)")), F.array("b"))
    return joined.select(key, "part", F.posexplode(geo.segments(way)).alias("piece", "s")).select(key, "part", "piece", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


def repeated_lines(lines: DataFrame, key: str = "line_id", line: str = "line", matched: DataFrame | None = None) -> DataFrame:
    """(key) of lines to remove: of those drawn alike, the unmatched ones if one is matched, else all but the first."""
    drawn = lines.select(key, geo.wkt_line(F.col(line)).alias("wkt"))
    marks = drawn.withColumn("m", F.lit(0)) if matched is None else drawn.join(matched.select(key, F.lit(1).alias("m")).distinct(), key, "left").na.fill(0, ["m"])
    sets = marks.groupBy("wkt").agg(F.count("*").alias("n"), F.max("m").alias("any"), F.min(key).alias("first")).where("n > 1")
    return marks.join(sets, "wkt").where("(any = 1 and m = 0) or (any = 0 and " + key + " <> first)").select(key)


def contract_degree2(edges: DataFrame) -> DataFrame:
    """Chains of an undirected simple graph (u, v) joined through nodes of degree 2: (chain, edges, end_low, end_high).

    Edges that share a node of degree 2 are linked and linked edges made one by pointer jumping: each round every edge
    takes the smallest name in its chain that its name or its neighbours know. Closed rings have no ends (null).
    """
    named = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    named = named.withColumn("e", F.concat_ws("-", "u", "v"))
    ends = named.select("e", F.explode(F.array("u", "v")).alias("node"))
    inner = ends.groupBy("node").agg(F.count("*").alias("d"), F.min("e").alias("e1"), F.max("e").alias("e2")).where("d = 2")
    both = inner.select(F.col("e1").alias("e"), F.col("e2").alias("o")).unionByName(inner.select(F.col("e2").alias("e"), F.col("e1").alias("o")))
    label = named.select("e", F.col("e").alias("chain"))
    both, label = cut(both), cut(label)
    while True:
        heard = both.join(label.select(F.col("e").alias("o"), "chain"), "o").groupBy("e").agg(F.min("chain").alias("near"))
        nearer = label.join(heard, "e", "left").select("e", F.least("chain", F.coalesce("near", "chain")).alias("chain"), F.col("chain").alias("old"))
        jump = nearer.select(F.col("e").alias("chain"), F.col("chain").alias("further"))
        after = nearer.join(jump, "chain", "left").select("e", F.least("chain", F.coalesce("further", "chain")).alias("chain"), "old")
        label, before = cut(after), label
        release(before)
        if label.where("chain <> old").isEmpty():
            break
    release(both)
    outer = ends.join(inner.select("node"), "node", "left_anti").join(label.select("e", "chain"), "e").groupBy("chain").agg(F.min("node").alias("end_low"), F.max("node").alias("end_high"))
    return label.groupBy("chain").agg(F.count("*").alias("edges")).join(outer, "chain", "left").select("chain", "edges", "end_low", "end_high")


def orient_edges(edges: DataFrame) -> DataFrame:
    """(node_start, node_end, line, ...) with the two nodes swapped where the line starts at the node given as its end."""
    swap = (node_key(F.get("line", F.lit(0))) == F.col("node_end")) & (F.col("node_start") != F.col("node_end"))
    ends = {"node_start": F.when(swap, F.col("node_end")).otherwise(F.col("node_start")), "node_end": F.when(swap, F.col("node_start")).otherwise(F.col("node_end"))}
    return edges.withColumns(ends)


def _walk(halves: DataFrame) -> DataFrame:
    """(h, last, steps, low, ring) of (h, next): where following ``next`` ends, after how many steps, the least name on
    the way, and whether it never ends. Each round every half jumps as far again as it has come."""
    at = halves.select("h", F.coalesce("next", "h").alias("last"), F.col("next").isNotNull().cast("long").alias("steps"), F.least("h", F.coalesce("next", "h")).alias("low"), F.col("next").isNotNull().alias("ring"))
    at = cut(at)
    while True:
        ahead = at.select(F.col("h").alias("last"), F.col("last").alias("l2"), F.col("steps").alias("s2"), F.col("low").alias("w2"), F.col("ring").alias("r2"))
        low = F.least("low", "w2")
        changed = (low != F.col("low")) | (F.col("ring") != F.col("r2")) | (~F.col("r2") & (F.col("s2") > 0))
        met = at.join(ahead, "last").select("h", F.col("l2").alias("last"), (F.col("steps") + F.col("s2")).alias("steps"), low.alias("low"), (F.col("ring") & F.col("r2")).alias("ring"), (F.col("ring") & changed).alias("changed"))
        at, before = cut(met), at
        release(before)
        if at.where("changed").isEmpty():
            return at.drop("changed")


def merge_chains(edges: DataFrame) -> DataFrame:
    """Edges (edge long, node_start, node_end, line) made one line through all nodes that just two edges meet in:
    (chain, node_start, node_end, line, edges), the chain named by its least edge. Edges from a node to itself stay alone.

    Each edge is two halves, one for each direction, and points to the half that goes on from its end; following the
    pointers by doubling gives each half its place. Rings are cut at their least half. Only a chain's own edges are
    gathered, as they make up its line.
    """
    edges = cut(edges.select("edge", "node_start", "node_end", "line"))
    way = F.array(F.struct((F.col("edge") * 2).alias("h"), F.col("node_start").alias("u"), F.col("node_end").alias("v")), F.struct((F.col("edge") * 2 + 1).alias("h"), F.col("node_end").alias("u"), F.col("node_start").alias("v")))
    halves = edges.select(F.inline(way))
    out = halves.groupBy("u").agg(F.count("*").alias("d"), F.min("h").alias("h1"), F.max("h").alias("h2")).where("d = 2 and h1 div 2 <> h2 div 2")
    onward = out.select(F.inline(F.array(F.struct(F.col("h1").bitwiseXOR(F.lit(1)).alias("h"), F.col("h2").alias("next")), F.struct(F.col("h2").bitwiseXOR(F.lit(1)).alias("h"), F.col("h1").alias("next")))))
    linked = halves.select("h").join(onward, "h", "left")
    first = _walk(linked)
    rings = first.where("ring").select("h", "low")
    opened = linked.join(rings, "h", "left").select("h", F.when(F.col("next") == F.col("low"), None).when(F.col("next").bitwiseXOR(F.lit(1)) == F.col("h"), None).otherwise(F.col("next")).alias("next"), F.col("low").alias("ring_low"))
    placed = first.where("not ring").select("h", "last", "steps")
    if not rings.isEmpty():
        # of a ring's two directions the one with the lower least half stays
        whole = opened.where("ring_low is not null")
        mate = whole.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("ring_low").alias("other"))
        walked = _walk(whole.select("h", "next")).join(whole.join(mate, "h").where("ring_low < other").select("h"), "h", "left_semi")
        placed = placed.unionByName(walked.select("h", "last", "steps"))
    mates = placed.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("last").alias("back"))
    chosen = placed.join(mates, "h", "left").where("back is null or last < back").select(F.floor(F.col("h") / 2).alias("edge"), F.col("last"), F.col("steps"), (F.col("h") % 2 == 1).alias("turned"))
    parts = chosen.join(edges, "edge")
    line = F.when(F.col("turned"), F.reverse("line")).otherwise(F.col("line"))
    ends = [F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(n) for n, a, b in (("u", "node_start", "node_end"), ("v", "node_end", "node_start"))]
    item = F.struct((-F.col("steps")).alias("place"), *ends, line.alias("line"))
    joined = parts.groupBy("last").agg(F.min("edge").alias("chain"), F.array_sort(F.collect_list(item)).alias("p"))
    rest = F.flatten(F.transform("p", lambda x: F.slice(x["line"], F.lit(2), F.size(x["line"]))))
    return joined.select("chain", F.get("p", F.lit(0))["u"].alias("node_start"), F.element_at("p", -1)["v"].alias("node_end"), F.concat(F.slice(F.get("p", F.lit(0))["line"], 1, 1), rest).alias("line"), F.size("p").alias("edges"))


def number_rows(df: DataFrame, key: str, order: list[str], name: str = "id") -> DataFrame:
    """``df`` with places from 0 by a key and further columns."""
    return shared.number_rows(df, [key, *order], name)


def split_matched(lines: DataFrame, matches: DataFrame, key: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """Lines without and with a match."""
    return lines.join(matches, key, "left_anti"), lines.join(matches, key, "left_semi")


def transfer_attributes(matches: DataFrame, assets: DataFrame, point_key: str, line_key: str = "line_id") -> DataFrame:
    """(line_key, asset id, asset type, lanes, capacity) for each (asset, line): an asset's lanes are shared by its lines."""
    from terrastock.functions import parse

    per = matches.groupBy(point_key).agg(F.count("*").alias("__n"))
    got = matches.join(per, point_key).join(assets, point_key)
    lanes = parse.lanes_each(F.col("lanes"), F.col("__n"))
    return got.select(line_key, point_key, "asset_type", lanes.alias("lanes"), (lanes * parse.LANE_CAPACITY).alias("capacity"))


def _terms(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))


def tfidf_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts' term weights where just these two are the corpus: a term of both weighs its count, of one
    1 + ln 1.5 times its count. Texts without terms give 0."""
    x, y = F.coalesce(_terms(a), F.array()), F.coalesce(_terms(b), F.array())
    count = lambda items, t: F.size(F.filter(items, lambda z: z == t)).cast("double")
    add = lambda items, f: F.aggregate(items, F.lit(0.0), lambda acc, t: acc + f(t))
    lone = 1 + F.log(F.lit(1.5))
    norm = lambda own, other: F.sqrt(add(F.array_distinct(own), lambda t: F.pow(count(own, t) * F.when(F.array_contains(other, t), 1.0).otherwise(lone), F.lit(2.0))))
    dot = add(F.array_intersect(x, y), lambda t: count(x, t) * count(y, t))
    return F.coalesce(dot / F.nullif(norm(x, y) * norm(y, x), F.lit(0.0)), F.lit(0.0))


def _term_counts(names: DataFrame, name: str, k: str) -> DataFrame:
    """(__k, __t, __ck, __wk) of distinct names: terms with their counts, and the sum of the squared counts of all of them."""
    each = names.select(F.col(name).alias(f"__{k}")).distinct().withColumn("__t", F.explode(_terms(F.col(f"__{k}")))).groupBy(f"__{k}", "__t").agg(F.count("*").cast("double").alias(f"__c{k}"))
    whole = each.groupBy(f"__{k}").agg(F.sum(F.col(f"__c{k}") * F.col(f"__c{k}")).alias(f"__w{k}"))
    return each.join(whole, f"__{k}")


def _scores(met: DataFrame) -> DataFrame:
    """(__x, __y, score) of names that meet by a term, from their counts."""
    lone2 = (1 + F.log(F.lit(1.5))) ** 2
    square = lambda k: F.sum(F.col(f"__c{k}") * F.col(f"__c{k}"))
    sums = met.groupBy("__x", "__y").agg(F.sum(F.col("__cx") * F.col("__cy")).alias("dot"), square("x").alias("sx"), square("y").alias("sy"), F.first("__wx").alias("wx"), F.first("__wy").alias("wy"))
    norm = lambda k: F.sqrt(F.col(f"s{k}") + lone2 * (F.col(f"w{k}") - F.col(f"s{k}")))
    return sums.select("__x", "__y", (F.col("dot") / (norm("x") * norm("y"))).alias("score"))


def tfidf_pairs(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """``tfidf_cosine`` of all pairs of rows that share a term, as ``score``; that of any other pair is 0. The columns of
    the two tables differ in name. Distinct names meet by their terms, with counts, and rows by their names."""
    scored = _scores(_term_counts(left, left_name, "x").join(_term_counts(right, right_name, "y"), "__t"))
    return scored.join(left, F.col("__x") == F.col(left_name)).join(right, F.col("__y") == F.col(right_name)).drop("__x", "__y")


def match_names(pairs: DataFrame, point_key: str, line_key: str, point_name: str, line_name: str) -> DataFrame:
    """Of the lines near each point those named most like it, ties all kept: (point, lines joined by commas, score).

    A line without a name scores -1; where no name is alike at all, only such lines are kept.
    """
    named = F.coalesce(F.trim(line_name) != "", F.lit(False))
    # each two names are scored once, however many rows bear them, over the terms that both have
    both = pairs.where(named).select(F.col(point_name).alias("__x"), F.col(line_name).alias("__y")).distinct()
    met = both.join(_term_counts(both, "__x", "x"), "__x").join(_term_counts(both, "__y", "y"), ["__y", "__t"])
    alike = _scores(met).withColumnsRenamed({"__x": point_name, "__y": line_name, "score": "__s"})
    score = F.when(~named, -1.0).otherwise(F.round(F.coalesce("__s", F.lit(0.0)), 9))
    scored = pairs.join(alike, [point_name, line_name], "left").select(point_key, line_key, score.alias("score"))
    best = scored.groupBy(point_key).agg(F.max("score").alias("top"))
    kept = scored.join(best, point_key).where((F.col("score") == F.col("top")) & (F.col("top") > 0) | (F.col("top") <= 0) & (F.col("score") == -1))
    return kept.groupBy(point_key).agg(F.array_join(F.array_sort(F.collect_set(line_key)), ",").alias("lines"), F.max("score").alias("score"))
