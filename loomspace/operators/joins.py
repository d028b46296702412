"""Spatial joins on a grid of several levels.

Cells of level l are 2^l wide.  A geometry's level is the first whose cells are as large as
its box, but no lower than the levels in use, so that it covers four cells of its level, or
of a coarser one, at most.  Two geometries meet on the coarser of their levels; the pair
counts in the cell that holds the lower left corner of the boxes' intersection, so that it
comes once.  The join is an equality of cells: no pair is formed that doesn't share one.

The levels in use come from one pass over both sides that counts boxes by size, or are
given.  The lowest is that of the median box that isn't a point's; smaller boxes share its
cells.

Where pairs are judged, rows of equal geometry are one class: the classes are met and judged
once (`class_pairs`), and rows come to the judged pairs by their classes' numbers (`expanded`).
So the grid and the kernel have work by the different geometries, not by pairs of rows, and
counts and semi-joins form no pair of rows at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspace.functions.geometry import LINE, computed

from .lineage import checkpointed
from .predicates import holds, with_relation

LEAST, MOST = -30, 60  # levels


def _size(g: Column) -> Column:
    """The level of a box by its size alone; null for points and for nothing."""
    extent = F.greatest(g["maxx"] - g["minx"], g["maxy"] - g["miny"])
    return F.when(extent > 0, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(F.log2(extent)).cast("int"))))


def levels(*sides: tuple[DataFrame, str | Column]) -> list[int]:
    """The levels that boxes of the sides (frame, geometry column) need, the median's the lowest."""
    counts = None
    for df, g in sides:
        part = df.select(_size(F.col(g) if isinstance(g, str) else g).alias("l")).where("l is not null").groupBy("l").count()
        counts = part if counts is None else counts.unionByName(part)
    found: dict[int, int] = {}
    for r in counts.collect():  # MOST - LEAST + 1 a side at most
        found[r.l] = found.get(r.l, 0) + r["count"]
    half, seen = sum(found.values()) / 2, 0
    for level in sorted(found):
        seen += found[level]
        if seen >= half:
            return [x for x in sorted(found) if x >= level]
    return [0]


def _own(size: Column, use: list[int]) -> Column:
    """The least level in use that isn't below a size; the highest where all are, the lowest for no size."""
    return F.coalesce(F.array_min(F.filter(F.array(*(F.lit(x) for x in use)), lambda x: x >= F.coalesce(size, F.lit(use[0])))), F.lit(use[-1]))


def _celled(df: DataFrame, geom: Column, use: list[int], prefix: str) -> DataFrame:
    """A row for each cell of each level in use from the geometry's own on; its box in columns of its own."""
    df = df.where(geom.isNotNull()).select("*", *(geom[c].alias(f"{prefix}_{c}") for c in ("minx", "miny", "maxx", "maxy")))
    df = df.withColumn(f"{prefix}_level", _own(_size(geom), use))
    box = {c: F.col(f"{prefix}_{c}") for c in ("minx", "miny", "maxx", "maxy")}

    def cells(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        span = lambda lo, hi: F.sequence(F.floor(box[lo] / size), F.floor(box[hi] / size))
        return F.flatten(F.transform(span("minx", "maxx"), lambda x: F.transform(span("miny", "maxy"), lambda y: F.struct(level.alias("l"), x.alias("x"), y.alias("y")))))

    at = F.filter(F.array(*(F.lit(x) for x in use)), lambda x: x >= F.col(f"{prefix}_level"))
    cell = F.col(f"{prefix}_cell")
    df = df.withColumn(f"{prefix}_cell", F.explode(F.flatten(F.transform(at, cells))))
    return df.select("*", *(cell[c].alias(f"{prefix}_{c}") for c in "lxy")).drop(f"{prefix}_cell")


def candidates(left: DataFrame, right: DataFrame, on: list[tuple[str, str]] | None = None, use: list[int] | None = None, a: Column | None = None, b: Column | None = None) -> DataFrame:
    """Pairs whose boxes meet, with the columns of both sides.

    left has its geometry in `a`, right in `b`, or in the columns given.  on: further equalities
    (left name, right name).  use: the levels in use, ascending; any choice gives the same pairs.
    """
    a, b = F.col("a") if a is None else a, F.col("b") if b is None else b
    use = sorted(use) if use else levels((left, a), (right, b))
    x, y = _celled(left, a, use, "_a"), _celled(right, b, use, "_b")
    c = lambda name: F.col(f"_{name}")
    size = F.pow(F.lit(2.0), c("a_l"))
    corner = (F.floor(F.greatest(c("a_minx"), c("b_minx")) / size) == c("a_x")) & (F.floor(F.greatest(c("a_miny"), c("b_miny")) / size) == c("a_y"))
    meet = (c("a_minx") <= c("b_maxx")) & (c("b_minx") <= c("a_maxx")) & (c("a_miny") <= c("b_maxy")) & (c("b_miny") <= c("a_maxy"))
    condition = (c("a_l") == c("b_l")) & (c("a_x") == c("b_x")) & (c("a_y") == c("b_y"))
    for p, q in on or []:
        condition &= F.col(p) == F.col(q)
    # Sizes are guessed from files, too low for geometries in cells; so no side is sent to all tasks.
    pairs = x.join(y.hint("merge"), condition & meet & corner & (c("a_l") == F.greatest(c("a_level"), c("b_level"))))
    return pairs.drop(*(f"_{side}_{name}" for side in "ab" for name in ("minx", "miny", "maxx", "maxy", "level", "l", "x", "y")))


def classes(df: DataFrame, geom: Column, name: str, on: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that have a geometry with the number of its class in `name`; and the classes: that number, the geometry, and `on`, whose values part classes.

    The geometry keeps its column, the rows all of theirs.
    """
    on = on or []
    some = df.where(geom.isNotNull())
    # Written once, so that a class has the same number wherever it is read.
    each = checkpointed(some.select(*on, geom).distinct()).withColumn(name, F.monotonically_increasing_id())
    held = each.select(*(F.col(c).alias(f"{name}_{c}") for c in on), geom.alias(f"{name}_geom"), F.xxhash64(geom).alias(f"{name}_hash"), name)
    same = (F.xxhash64(geom) == F.col(f"{name}_hash")) & (geom == F.col(f"{name}_geom"))
    for c in on:
        same &= F.col(c) == F.col(f"{name}_{c}")
    # Sizes are guessed from files, too low for geometries; so no side is sent to all tasks.
    return some.join(held.hint("merge"), same).drop(*(c for c in held.columns if c != name)), each


def class_pairs(left: DataFrame, right: DataFrame, judge: Callable[[DataFrame], DataFrame], on: list[tuple[str, str]] | None = None, use: list[int] | None = None,
                a: Column | None = None, b: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """left and right with the numbers of their classes, _a_class and _b_class; and the judged pairs of classes whose boxes meet.

    judge(pairs): what is kept of the pairs, which have the classes' numbers and the geometries.
    """
    a, b = F.col("a") if a is None else a, F.col("b") if b is None else b
    left, x = classes(left, a, "_a_class", [p for p, _ in on or []])
    right, y = classes(right, b, "_b_class", [q for _, q in on or []])
    return left, right, judge(candidates(x, y, on, use, a, b))


def expanded(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows' pairs of judged pairs of classes, with the columns of all three."""
    return left.join(pairs.hint("merge"), "_a_class").join(right.hint("merge"), "_b_class").drop("_a_class", "_b_class")


CHUNK, SLICE = 1 << 17, 128  # places of a class that are collected together, rows of them that come together to a pair


def row_pairs(rows: DataFrame, pairs: DataFrame, values: list[str]) -> DataFrame:
    """The pairs of rows (_class, ord, values) with a_ord < b_ord of judged pairs of classes: a_ord, b_ord, values as a_ and b_, and the pairs' columns.

    Rows come as slices of a class, not one by one with all that a pair has, and pairs of rows
    are formed behind the last shuffle, those of two slices at a time.
    """
    held = rows.groupBy("_class", F.floor(F.col("ord") / CHUNK).alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("ord", *values))).alias("_rows"))
    held = held.select("_class", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / SLICE).cast("int")), lambda i: F.slice("_rows", i * SLICE + 1, SLICE))).alias("_rows"))
    side = lambda s: held.select(F.col("_class").alias(f"_{s}_class"), F.col("_rows").alias(f"_{s}_rows"))
    kept = [c for c in pairs.columns if c not in ("_a_class", "_b_class")]
    met = pairs.join(side("a").hint("merge"), "_a_class").join(side("b").hint("merge"), "_b_class").where(F.element_at("_a_rows", 1)["ord"] < F.element_at("_b_rows", -1)["ord"])
    each = met.select(*kept, F.explode("_a_rows").alias("_a"), "_b_rows").select(*kept, "_a", F.explode("_b_rows").alias("_b")).where("_a.ord < _b.ord")
    return each.select(*kept, *(F.col(f"_{s}.{v}").alias(f"{s}_{v}") for v in ("ord", *values) for s in "ab"))


def judged(left: DataFrame, right: DataFrame, judge: Callable[[DataFrame], DataFrame], told: list[str], on: list[tuple[str, str]] | None = None, use: list[int] | None = None) -> DataFrame:
    """Pairs whose boxes meet, with the columns of both sides and those of `told` that judge(pairs) gives; it may leave pairs out."""
    x, y, pairs = class_pairs(left, right, judge, on, use)
    return expanded(x, y, pairs.select("_a_class", "_b_class", *told))


STEPS = 4  # a line's cells are 2^4 times smaller than the cell of its box


def _cover(pts: Column, level: Column) -> Column:
    """The cells of a level that a line passes through, as hashes: for each column of cells, those between its ends there.

    Heights at a column's sides are taken a little wider, so that no cell is missed by rounding.
    """
    size = F.pow(F.lit(2.0), level)
    at = lambda v: F.floor(v / size)

    def of(p: Column, q: Column) -> Column:
        left, right = F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])
        slope = F.when(p["x"] == q["x"], 0.0).otherwise((q["y"] - p["y"]) / (q["x"] - p["x"]))
        height = lambda x: p["y"] + (x - p["x"]) * slope

        def rows(x: Column) -> Column:
            lo, hi = height(F.greatest(x * size, left)), height(F.least((x + 1) * size, right))
            # A line straight up has all of its height in one column.
            low, high = F.when(p["x"] == q["x"], F.least(p["y"], q["y"])).otherwise(F.least(lo, hi)), F.when(p["x"] == q["x"], F.greatest(p["y"], q["y"])).otherwise(F.greatest(lo, hi))
            return F.transform(F.sequence(at(low - size * 1e-6), at(high + size * 1e-6)), lambda y: F.xxhash64(x, y))

        return F.flatten(F.transform(F.sequence(at(left - size * 1e-6), at(right + size * 1e-6)), rows))

    last = F.size(pts) - 1
    segments = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: of(F.element_at(pts, i), F.element_at(pts, F.least(i + 1, F.size(pts)))))
    return F.array_distinct(F.flatten(segments))


def _stepped(df: DataFrame, geom: Column, use: list[int], prefix: str) -> DataFrame:
    """A row for each cell that a line passes through, of each level in use from its own on, with all of its cells of that level."""
    df = df.where(geom.isNotNull() & (geom["kind"] == LINE)).select("*", *(geom[c].alias(f"{prefix}_{c}") for c in ("minx", "miny", "maxx", "maxy")))
    df = df.withColumn(f"{prefix}_level", _own(_size(geom) - STEPS, use)).withColumn(f"{prefix}_l", F.explode(F.filter(F.array(*(F.lit(x) for x in use)), lambda x: x >= F.col(f"{prefix}_level"))))
    df = computed(df, f"{prefix}_cells", _cover(geom["pts"], F.col(f"{prefix}_l")))
    return df.withColumn(f"{prefix}_cell", F.explode(f"{prefix}_cells"))


def line_candidates(left: DataFrame, right: DataFrame, use: list[int] | None = None, a: Column | None = None, b: Column | None = None, also: Column | None = None) -> DataFrame:
    """Pairs of lines that pass through a cell in common, with the columns of both sides; rows of other kinds don't take part.

    A line's cells are those along it, not those of its box, so that long lines meet only lines
    near to them.  Two lines meet on the coarser of their levels, and the pair counts in the
    first of the cells that they share.  also: a cheap condition on both sides' columns, tried
    before a pair's cells are compared.
    """
    a, b = F.col("a") if a is None else a, F.col("b") if b is None else b
    use = sorted(use) if use else [x - STEPS for x in levels((left, a), (right, b))]
    x, y = _stepped(left, a, use, "_a"), _stepped(right, b, use, "_b")
    c = lambda name: F.col(f"_{name}")
    meet = (c("a_minx") <= c("b_maxx")) & (c("b_minx") <= c("a_maxx")) & (c("a_miny") <= c("b_maxy")) & (c("b_miny") <= c("a_maxy"))
    first = c("a_cell") == F.array_min(F.array_intersect(c("a_cells"), c("b_cells")))
    if also is not None:
        meet &= also
    # Sizes are guessed from files, too low for lines with all of their cells; so no side is sent to all tasks.
    pairs = x.join(y.hint("merge"), (c("a_l") == c("b_l")) & (c("a_cell") == c("b_cell")) & (c("a_l") == F.greatest(c("a_level"), c("b_level"))) & meet & first)
    return pairs.drop(*(f"_{side}_{name}" for side in "ab" for name in ("minx", "miny", "maxx", "maxy", "level", "l", "cells", "cell")))


def _by(predicate: str, native: bool) -> Callable[[DataFrame], DataFrame]:
    if predicate == "disjoint":
        raise ValueError("disjoint pairs can't be found by place; see disjoint_from")
    return lambda pairs: with_relation(pairs, native).where(holds(predicate, F.col("relation"), F.col("a"), F.col("b")))


def spatial_join(left: DataFrame, right: DataFrame, predicate: str, on: list[tuple[str, str]] | None = None, native: bool = False, use: list[int] | None = None) -> DataFrame:
    """Pairs for which a predicate holds, with their matrix `relation`; left's geometry is `a`, right's `b`.

    native: all pairs are of points with points or polygons, and the kernel isn't needed.
    """
    return judged(left, right, _by(predicate, native), ["relation"], on, use)


def semi_join(left: DataFrame, right: DataFrame, key: str, predicate: str = "intersects", native: bool = False, anti: bool = False, use: list[int] | None = None) -> DataFrame:
    """Left rows for which some right row fulfils the predicate (anti: none does); key tells left rows apart. No pair of rows is formed."""
    x, _, pairs = class_pairs(left, right.select("b"), _by(predicate, native), use=use)
    hit = x.join(pairs.select("_a_class").distinct().hint("merge"), "_a_class", "left_semi")
    return left.join(hit.select(key).hint("merge"), key, "left_anti") if anti else hit.drop("_a_class")


def disjoint_from(left: DataFrame, one: DataFrame, key: str, native: bool = False) -> DataFrame:
    """Left rows disjoint from all geometries `b` of a side: those that intersect none."""
    return semi_join(left, one, key, "intersects", native, anti=True)


def disjoint_counts(left: DataFrame, right: DataFrame, key: str, native: bool = False, use: list[int] | None = None) -> DataFrame:
    """key, n_disjoint: to how many right rows each left row is disjoint, as all of them less those that it intersects.

    No pair of rows is formed: right rows are counted by class.  Rows without a geometry are
    disjoint from nothing, and nothing is from them: they don't count, and left ones have null.
    """
    x, y, pairs = class_pairs(left.select(key, "a"), right.select("b"), _by("intersects", native), use=use)
    sizes = y.groupBy("_b_class").agg(F.count("b").alias("n"))
    meets = pairs.select("_a_class", "_b_class").join(sizes.hint("merge"), "_b_class").groupBy("_a_class").agg(F.sum("n").alias("n_meet"))
    every = right.agg(F.count("b").alias("n_right"))  # one row
    rows = x.select(key, "_a_class").join(meets.hint("merge"), "_a_class", "left").select(key, F.coalesce("n_meet", F.lit(0)).alias("n_meet"))
    none = left.where("a IS NULL").select(key, F.lit(None).cast("long").alias("n_meet"))
    return rows.unionByName(none).join(F.broadcast(every)).select(key, (F.col("n_right") - F.col("n_meet")).alias("n_disjoint"))
