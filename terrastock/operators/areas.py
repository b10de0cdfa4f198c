"""Areas: lines cut off at a polygon's border, and meshes of cells that hold a limited number of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastock.functions import geo
from terrastock.operators.fusion import keep_one
from terrastock.operators.graph import explode_segments
from terrastock.operators.shared import cut, release

Polygon = list[tuple[float, float]]
Box = tuple[float, float, float, float]


def ring_of(polygon: Polygon) -> Column:
    """A closed ring of given vertices."""
    closed = polygon if polygon[0] == polygon[-1] else [*polygon, polygon[0]]
    return F.array(*(geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in closed))


def bounds_of(polygon: Polygon) -> Box:
    xs, ys = zip(*polygon, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def _place_on(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where segment ab crosses cd, from 0 to 1 along ab; null if nowhere or if they are parallel."""
    rx, ry, sx, sy = b["lon"] - a["lon"], b["lat"] - a["lat"], d["lon"] - c["lon"], d["lat"] - c["lat"]
    ox, oy, det = c["lon"] - a["lon"], c["lat"] - a["lat"], rx * sy - ry * sx
    t, u = (ox * sy - oy * sx) / F.nullif(det, F.lit(0.0)), (ox * ry - oy * rx) / F.nullif(det, F.lit(0.0))
    return F.when(t.between(0, 1) & u.between(0, 1), t)


def clip_lines(lines: DataFrame, polygon: Polygon, key: str = "line_id", line: str = "line") -> DataFrame:
    """(key, piece, line): the parts of lines inside any simple polygon, concave ones included; a line that leaves and comes
    back gives several pieces, numbered along it.

    Each segment is cut where it crosses the border, and of the parts between cuts those stay whose middle is inside.
    Parts that follow each other make one piece. A line along the border counts as inside or outside by its middle.
    """
    x0, y0, x1, y1 = bounds_of(polygon)
    ring, a, b = ring_of(polygon), F.col("a"), F.col("b")
    near = (F.greatest("a.lon", "b.lon") >= x0) & (F.least("a.lon", "b.lon") <= x1) & (F.greatest("a.lat", "b.lat") >= y0) & (F.least("a.lat", "b.lat") <= y1)
    crossed = F.filter(F.transform(geo.segments(ring), lambda e: _place_on(a, b, e["a"], e["b"])), lambda t: t.isNotNull())
    cuts = explode_segments(lines, key, line).where(near).withColumn("t", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossed))))
    spans = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t")), lambda s, e: F.struct(s.alias("t0"), e.alias("t1")))
    parts = cuts.select(key, "part", "a", "b", F.explode(spans).alias("s")).select(key, "part", "a", "b", "s.t0", "s.t1")
    at = lambda t, k: F.col(f"a.{k}") + (F.col(f"b.{k}") - F.col(f"a.{k}")) * t
    middle = (F.col("t0") + F.col("t1")) / 2
    inside = parts.where(geo.point_in_ring(at(middle, "lon"), at(middle, "lat"), ring))
    along = Window.partitionBy(key).orderBy("part", "t0")
    last, end = F.lag("part").over(along), F.lag("t1").over(along)
    follows = ((last == F.col("part")) & (end == F.col("t0"))) | ((last == F.col("part") - 1) & (end == 1) & (F.col("t0") == 0))
    numbered = inside.withColumn("__new", F.when(follows, 0).otherwise(1)).withColumn("piece", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    place = lambda t: F.when(F.col(t) == 0, a).when(F.col(t) == 1, b).otherwise(geo.point(at(F.col(t), "lon"), at(F.col(t), "lat")))
    joined = numbered.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct("part", "t0", place("t0").alias("p"), place("t1").alias("q")))).alias("v"))
    return joined.select(key, "piece", F.concat(F.array(F.get("v", F.lit(0))["p"]), F.transform("v", lambda x: x["q"])).alias("line"))


def clip_polygon(points: Polygon, box: Box) -> Polygon:
    """The vertices of a polygon cut down to a box, side by side; none where nothing is left."""
    points = points[:-1] if points[0] == points[-1] else points
    for axis, bound, keep in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        left = []
        for p, q in zip(points[-1:] + points[:-1], points, strict=True):
            inp, inq = (p[axis] - bound) * keep >= 0, (q[axis] - bound) * keep >= 0
            if inp != inq:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                met = p[1 - axis] + (q[1 - axis] - p[1 - axis]) * t
                left.append((bound, met) if axis == 0 else (met, bound))
            if inq:
                left.append(q)
        points = left
        if not points:
            break
    return points


def _envelopes(cells: DataFrame, polygon: Polygon) -> DataFrame:
    """Cells (x0, y0, x1, y1) made the envelopes of what a polygon has in each; those it has no area in go."""

    def run(batches):
        for b in batches:
            boxes = list(zip(b["x0"], b["y0"], b["x1"], b["y1"], strict=True))
            left = [clip_polygon(polygon, box) for box in boxes]
            bounds = [bounds_of(p) if p else (0.0, 0.0, 0.0, 0.0) for p in left]
            for k, c in enumerate(("x0", "y0", "x1", "y1")):
                b[c] = [float(v[k]) for v in bounds]
            yield b[(b["x1"] > b["x0"]) & (b["y1"] > b["y0"])]

    return cells.mapInPandas(run, cells.schema)


def _grid(cells: DataFrame, limit: int) -> DataFrame:
    """``cells`` (x0, y0, x1, y1, n) with the rows and columns that each is cut into: about 1.2 n / limit cells, at least two;
    as many times more rows than columns as a cell is wider than high, or columns than rows as it is higher."""
    wide = geo.haversine_ft(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0"))
    high = geo.haversine_ft(F.col("x0"), F.col("y0"), F.col("x0"), F.col("y1"))
    sized = cells.withColumns({"__w": wide, "__h": high, "__k": F.bround(F.lit(1.2) * F.col("n") / limit)})
    ratio = F.greatest(F.lit(1), F.ceil(F.greatest("__w", "__h") / F.nullif(F.least("__w", "__h"), F.lit(0.0))))
    sized = sized.withColumn("__r", F.coalesce(ratio, F.lit(1))).withColumn("__n", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("__k") / F.col("__r")))))
    long, short = F.col("__r") * F.col("__n"), F.col("__n")
    sized = sized.withColumns({"rows": F.when(F.col("__w") > F.col("__h"), long).otherwise(short).cast("long"), "cols": F.when(F.col("__w") > F.col("__h"), short).otherwise(long).cast("long")})
    return sized.withColumn("cols", F.when(F.col("rows") * F.col("cols") < 2, 2).otherwise(F.col("cols"))).drop("__w", "__h", "__k", "__r", "__n")


def _cut_cells(cells: DataFrame, limit: int) -> DataFrame:
    grid = _grid(cells, limit).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    w, h = (F.col("x1") - F.col("x0")) / F.col("cols"), (F.col("y1") - F.col("y0")) / F.col("rows")
    x, y = F.col("x0") + F.col("j") * w, F.col("y0") + F.col("i") * h
    return grid.select("cell", F.concat_ws(".", "cell", F.concat_ws("-", "i", "j")).alias("sub"), "i", "j", x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def row_limited_mesh(boxes: DataFrame, key: str, area: Box | Polygon, limit: int) -> tuple[DataFrame, DataFrame]:
    """Cells (cell, level, x0, y0, x1, y1, n) that cover an area with at most ``limit`` boxes each, and (cell, key) of the
    boxes that meet each cell, borders included, so that a box may be of several cells.

    ``boxes``: (key, min_lon, min_lat, max_lon, max_lat). Cells over the limit are cut again, round by round, into about
    as many cells as their number asks for; empty ones go. Of a polygon the first cells are the envelopes of what lies in
    each. A cell narrower or lower than 1e-9 degrees, or one that all its boxes or more than ``limit`` of them cover whole, is
    not cut again, whatever it holds: all cells cut from the last would be over the limit too.
    """
    polygon = None if isinstance(area[0], (int, float)) else area
    x0, y0, x1, y1 = area if polygon is None else bounds_of(area)
    meets = (F.col("min_lon") <= F.col("x1")) & (F.col("max_lon") >= F.col("x0")) & (F.col("min_lat") <= F.col("y1")) & (F.col("max_lat") >= F.col("y0"))
    whole = {"x0": F.lit(float(x0)), "y0": F.lit(float(y0)), "x1": F.lit(float(x1)), "y1": F.lit(float(y1))}
    box = ["min_lon", "min_lat", "max_lon", "max_lat"]
    held = cut(boxes.select(F.col(key).alias("key"), *box).withColumns(whole).where(meets).select(F.lit("0").alias("cell"), "key", *box))
    spark = boxes.sparkSession
    todo = spark.range(1).select(F.lit("0").alias("cell"), *(v.alias(k) for k, v in whole.items())).crossJoin(held.agg(F.count("*").alias("n")))
    done, members, level = None, None, 0

    def keep(cells: DataFrame, own: DataFrame) -> None:
        nonlocal done, members
        cells = cells.select("cell", F.lit(level).alias("level"), "x0", "y0", "x1", "y1", "n")
        own = own.join(cells.select("cell"), "cell", "left_semi").select("cell", "key")
        done = cells if done is None else done.unionByName(cells)
        members = own if members is None else members.unionByName(own)

    todo = cut(todo.where("n > 0"))
    while True:
        over = todo.where(F.col("n") > limit)
        if level:
            spans = (F.col("min_lon") > F.col("x0")) | (F.col("min_lat") > F.col("y0")) | (F.col("max_lon") < F.col("x1")) | (F.col("max_lat") < F.col("y1"))
            counts = held.join(over.select("cell", "x0", "y0", "x1", "y1"), "cell").groupBy("cell").agg(F.count_if(spans).alias("parts"), F.count_if(~spans).alias("wholes"))
            parted = counts.where((F.col("parts") > 0) & (F.col("wholes") <= limit))
            over = over.where("x1 - x0 > 1e-9 and y1 - y0 > 1e-9").join(parted, "cell", "left_semi")
        over = cut(over)
        keep(todo.join(over.select("cell"), "cell", "left_anti"), held)
        if over.isEmpty():
            break
        subs = _cut_cells(over, limit)
        if polygon is not None and level == 0:
            subs = _envelopes(subs, polygon)
        # a box can only meet the subcells of the rows and columns that it spans, and their neighbours
        ways = _grid(over, limit).select("cell", F.col("x0").alias("__x"), F.col("y0").alias("__y"), ((F.col("x1") - F.col("x0")) / F.col("cols")).alias("__w"), ((F.col("y1") - F.col("y0")) / F.col("rows")).alias("__h"), "rows", "cols")
        span = lambda lo, hi, at, size, n: F.sequence(F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor((F.col(lo) - F.col(at)) / F.col(size)) - 1)).cast("long"), F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor((F.col(hi) - F.col(at)) / F.col(size)) + 1)).cast("long"))
        own = held.join(ways, "cell").withColumn("i", F.explode(span("min_lat", "max_lat", "__y", "__h", "rows"))).withColumn("j", F.explode(span("min_lon", "max_lon", "__x", "__w", "cols")))
        before, subs = held, cut(subs)
        held = cut(own.select("cell", "key", "i", "j", *box).join(subs, ["cell", "i", "j"]).where(meets).select(F.col("sub").alias("cell"), "key", *box))
        counted = held.groupBy("cell").agg(F.count("*").alias("n"))
        todo = cut(subs.select(F.col("sub").alias("cell"), "x0", "y0", "x1", "y1").join(counted, "cell"))
        if level == 0:  # the first round's rows are in no cell that is kept
            members = None
            done = done.where("false")
        level += 1
    return done, members.withColumnRenamed("key", key) if members is not None else held.select("cell", F.col("key").alias(key))


def last_value_at_first_place(rows: DataFrame, key: str, cell: list[str], place: list[str]) -> DataFrame:
    """Rows that several cells return made one: of each cell the first by ``place``, of all cells the last one's values,
    and ``first_place`` (cell and place) of the first. Both are aggregated before the shuffle."""
    once = keep_one(rows, [key, *cell], place)
    values = [c for c in once.columns if c != key]
    last = F.max_by(F.struct(*values), F.struct(*cell))
    return once.groupBy(key).agg(F.min(F.struct(*cell, *place)).alias("first_place"), last.alias("__v")).select(key, *(F.col(f"__v.{c}").alias(c) for c in values), "first_place")
