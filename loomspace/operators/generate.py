"""Seeded random scenes: polygons, forced pair topologies, and placement of what is left.

Every number is a hash of seed, scene and position, so a scene is the same however the
scenes are dealt out.  Polygons, their pairing and the forcing of pairs are DataFrame
expressions over all scenes; only placement, where each geometry must avoid those placed
before it, goes scene by scene.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomspace.functions import geometry as G
from loomspace.functions.relate import batch_matrices

from .order import block_of, numbered
from .predicates import holds, relate


@dataclass(frozen=True)
class SceneConfig:
    """What a scene holds. The usual canvas, counts, probabilities and numbers of attempts."""

    bounds: tuple[float, float, float, float] = (0.0, 0.0, 100.0, 100.0)
    polygons: int = 5
    vertices: tuple[int, int] = (3, 6)
    radius: tuple[float, float] = (5.0, 25.0)
    regular: bool = False
    aligned: int = 0
    overlapping: int = 0
    contained: int = 1
    touching: int = 0
    points: int = 10
    lines: int = 3
    line_length: tuple[float, float] = (10.0, 30.0)
    line_vertices: tuple[int, int] = (3, 8)
    straight_only: bool = False
    crossing: float = 0.1
    line_in_poly: float = 0.1
    line_on_border: float = 0.1
    line_through: float = 0.1
    point_in_poly: float = 0.1
    point_on_border: float = 0.1
    point_on_line: float = 0.1
    placement_attempts: int = 100
    align_attempts: int = 20
    touch_attempts: int = 10
    align_origin: str = "centroid"
    attempts_per_polygon: int = 10
    older: bool = False  # the older ways to overlap, contain and touch, and two coins for a line's kind

    def check(self) -> SceneConfig:
        """Raises where the pairs need more polygons than there are."""
        need = 2 * (self.aligned + self.overlapping + self.contained + self.touching)
        if need > self.polygons:
            raise ValueError(f"the pairs need {need} polygons, {self.polygons} are asked for")
        return self


#: The older set: containment only, more often; one attempt a polygon; the older ways to force pairs.
OLDER = SceneConfig(polygons=3, contained=0, lines=1, crossing=0.0, line_in_poly=0.3, line_on_border=0.0, line_through=0.0, point_in_poly=0.3, point_on_border=0.0, point_on_line=0.0, align_origin="center", attempts_per_polygon=1, older=True)


def uniform(seed: int, *keys: Column | str | int) -> Column:
    """A number in [0, 1) from the keys."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def between(u: Column, low: Column | float, high: Column | float) -> Column:
    return low + u * (high - low)


def random_points(spark: SparkSession, scenes: int, n: int, bounds: tuple, seed: int) -> DataFrame:
    """scene_id, slot, geom: n points of each scene, uniform on the canvas."""
    rows = spark.range(scenes).withColumnRenamed("id", "scene_id").withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else spark.range(0).select(F.col("id").alias("scene_id"), F.lit(1).alias("slot"))
    x0, y0, x1, y1 = bounds
    u = lambda name: uniform(seed, F.col("scene_id"), F.col("slot"), name)
    return rows.select("scene_id", "slot", G.point(between(u("px"), x0, x1), between(u("py"), y0, y1)).alias("geom"))


def clamped_walk(x: Column, y: Column, steps: Column, bounds: tuple) -> Column:
    """Vertices of a walk from x, y by steps (structs dx, dy), each held to the canvas."""
    x0, y0, x1, y1 = (float(b) for b in bounds)
    hold = lambda v, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), v))

    def go(pts: Column, s: Column) -> Column:
        last = F.element_at(pts, -1)
        return F.concat(pts, F.array(G.xy(hold(last["x"] + s["dx"], x0, x1), hold(last["y"] + s["dy"], y0, y1))))

    return F.aggregate(steps, F.array(G.xy(x, y)), go)


def random_lines(spark: SparkSession, scenes: int, n: int, cfg: SceneConfig, seed: int) -> DataFrame:
    """scene_id, slot, style (straight or curly), geom: a coin decides between two uniform ends and a walk with turns.

    Older: a first coin decides on the style alone, and one in two curly ones is straight all the same.
    """
    x0, y0, x1, y1 = cfg.bounds
    u = lambda *name: uniform(seed, F.col("scene_id"), F.col("slot"), *name)
    at = lambda a, b: G.xy(between(u(a), x0, x1), between(u(b), y0, y1))
    rows = spark.range(scenes).withColumnRenamed("id", "scene_id").withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(max(1, n))))).where(F.lit(n > 0))
    low, high = cfg.line_vertices
    k = (F.lit(low) + F.floor(u("k") * (high - low + 1))).cast("int")
    step = between(u("length"), *cfg.line_length) / k
    turns = F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda i: between(u("turn", i), -math.pi / 2, math.pi / 2))
    first = u("heading") * 2 * math.pi
    walked = F.aggregate(turns, F.struct(first.alias("h"), F.array().cast("array<double>").alias("all")), lambda s, t: F.struct((s["h"] + t).alias("h"), F.concat(s["all"], F.array(s["h"] + t)).alias("all")))["all"]
    steps = F.transform(walked, lambda h: F.struct((step * F.cos(h)).alias("dx"), (step * F.sin(h)).alias("dy")))
    straight = F.array(at("ax", "ay"), at("bx", "by"))
    listed = F.lit(cfg.straight_only) | (u("list") < 0.5)
    drawn = F.lit(cfg.straight_only) | (u("coin") < 0.5)
    pts = F.when((listed | drawn) if cfg.older else drawn, straight).otherwise(clamped_walk(between(u("ax"), x0, x1), between(u("ay"), y0, y1), steps, cfg.bounds))
    rows = rows.withColumn("geom", G.line(pts))
    is_straight = listed if cfg.older else F.size("geom.pts") == 2
    return rows.select("scene_id", "slot", F.when(is_straight, "straight").otherwise("curly").alias("style"), "geom")


def random_polygons(spark: SparkSession, scenes: int, cfg: SceneConfig, seed: int) -> DataFrame:
    """scene_id, slot, geom: the first valid ones of some attempts for each polygon; a scene may have fewer."""
    x0, y0, x1, y1 = cfg.bounds
    rows = spark.range(scenes).withColumnRenamed("id", "scene_id").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(cfg.attempts_per_polygon * max(1, cfg.polygons))))).where(F.lit(cfg.polygons > 0))
    u = lambda *name: uniform(seed, F.col("scene_id"), F.col("attempt"), *name)
    low, high = cfg.vertices
    rows = rows.withColumn("nv", (F.lit(low) + F.floor(u("nv") * (high - low + 1))).cast("int")).withColumn("r", between(u("r"), *cfg.radius))
    edge = F.col("r") * 1.1
    rows = rows.withColumn("cx", between(u("cx"), x0 + edge, x1 - edge)).withColumn("cy", between(u("cy"), y0 + edge, y1 - edge))
    order = F.sequence(F.lit(0), F.col("nv") - 1)
    if cfg.regular:
        angles, radius = F.transform(order, lambda i: u("start") * 2 * math.pi + i * 2 * math.pi / F.col("nv")), lambda i: F.col("r")
    else:
        angles, radius = F.array_sort(F.transform(order, lambda i: u("angle", i) * 2 * math.pi)), lambda i: between(u("radius", i), 0.8 * F.col("r"), 1.2 * F.col("r"))
    rows = rows.withColumn("angles", angles)
    ring = F.transform("angles", lambda t, i: G.xy(F.col("cx") + radius(i) * F.cos(t), F.col("cy") + radius(i) * F.sin(t)))
    # A generator: filters above it aren't pushed below, with the whole expression written out in them.
    rows = rows.withColumn("geom", F.explode(F.array(G.polygon(ring)))).where(G.is_valid(F.col("geom")))
    rows = rows.withColumn("slot", F.row_number().over(W.partitionBy("scene_id").orderBy("attempt"))).where(F.col("slot") <= cfg.polygons)
    return rows.select("scene_id", "slot", "geom")


def paired(polygons: DataFrame, cfg: SceneConfig, seed: int) -> DataFrame:
    """scene_id, slot, geom, role, pair: shuffled slots in consecutive pairs, the roles in their order; null for free ones."""
    place = F.row_number().over(W.partitionBy("scene_id").orderBy(uniform(seed, F.col("scene_id"), F.col("slot"), "shuffle"), "slot")) - 1
    rows = polygons.withColumn("place", place).withColumn("pair", F.floor(F.col("place") / 2).cast("int"))
    role, at = F.lit(None).cast("string"), 0
    for name, n in (("aligned", cfg.aligned), ("overlapping", cfg.overlapping), ("contained", cfg.contained), ("touching", cfg.touching)):
        role = F.when(F.col("pair").between(at, at + n - 1), name).otherwise(role)
        at += n
    whole = F.count("slot").over(W.partitionBy("scene_id", "pair")) == 2
    return rows.withColumn("role", F.when(whole, role)).withColumn("second", F.col("place") % 2 == 1)


def _edge(g: Column, u: Column) -> tuple[Column, Column]:
    i = F.floor(u * (F.size(g["pts"]) - 1)).cast("int")
    return F.get(g["pts"], i), F.get(g["pts"], i + 1)


def align(a: Column, b: Column, u: Column, v: Column, origin: str = "centroid") -> Column:
    """B turned so that an edge of it lies against an edge of A, middle on middle."""
    angle = lambda m, n: F.atan2(n["y"] - m["y"], n["x"] - m["x"])

    def against(turned: Column, p: Column, q: Column, m: Column, n: Column) -> Column:
        return G.translate(turned, (p["x"] + q["x"] - m["x"] - n["x"]) / 2, (p["y"] + q["y"] - m["y"] - n["y"]) / 2)

    def turn(b: Column, v: Column, p: Column, q: Column, r: Column, s: Column) -> Column:
        turned = G.rotate(b, F.degrees(angle(p, q) - angle(r, s) + math.pi), origin)
        return G.once(lambda t: G.once(against, t, p, q, *_edge(t, v)), turned)

    return G.once(turn, b, v, *_edge(a, u), *_edge(b, v))


def moved_to(g: Column, to: Column, frm: Column | None = None) -> Column:
    """The geometry translated so that a point of it (its centroid) comes to `to`."""
    shift = lambda g, to, o: G.translate(g, to["x"] - o["x"], to["y"] - o["y"])
    return G.once(lambda g, to: G.once(shift, g, to, G.centroid(g) if frm is None else frm), g, to)


def overlap(a: Column, b: Column, u: Column, older: bool = False) -> Column:
    """B with its centroid on a boundary point of A; older: with a boundary point on A's centroid."""
    return moved_to(b, G.centroid(a), G.interpolate(b, u, True)) if older else moved_to(b, G.interpolate(a, u, True))


def contain(a: Column, b: Column, older: bool = False) -> Column:
    """The smaller one shrunk about its box's centre and put to the larger one's inner point."""
    w, h = lambda g: g["maxx"] - g["minx"], lambda g: g["maxy"] - g["miny"]
    f = F.least(F.lit(0.5), 0.5 * F.sqrt(G.area(a) / G.area(b))) if older else F.least(0.25 * w(a) / w(b), 0.25 * h(a) / h(b))
    return moved_to(G.once(lambda f: G.scale(b, f, f), f), G.representative_point(a))


def touch(a: Column, b: Column, u: Column, v: Column, older: bool = False) -> Column:
    """A vertex of B on a vertex of A; older: a point of B's ring on one of A's."""
    if older:
        return moved_to(b, G.interpolate(a, u, True), G.interpolate(b, v, True))
    return moved_to(b, _edge(a, u)[0], _edge(b, v)[0])


def forced(pairs: DataFrame, cfg: SceneConfig, seed: int) -> DataFrame:
    """scene_id, slot, role, geom with the second of each pair made to fit the first.

    Aligned and touching pairs take the first attempt that doesn't overlap, or stay as they
    are; older: touching pairs take the first attempt as it is.
    """
    first = pairs.where("role is not null and not second").select("scene_id", "pair", F.col("geom").alias("a"), F.col("slot").alias("slot_a"))
    second = pairs.where("role is not null and second").select("scene_id", "pair", "role", F.col("geom").alias("b"), F.col("slot").alias("slot_b"))
    both = first.join(second, ["scene_id", "pair"])
    a, b = F.col("a"), F.col("b")
    swap = (F.col("role") == "contained") & (G.area(a) < G.area(b))
    both = both.select("scene_id", "pair", "role", *(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("slot_a", "slot_b"), ("slot_b", "slot_a"))))
    tries = F.when(F.col("role") == "aligned", cfg.align_attempts).when(F.col("role") == "touching", 1 if cfg.older else cfg.touch_attempts).otherwise(1)
    tried = both.withColumn("attempt", F.explode(F.sequence(F.lit(1), tries)))
    u = lambda name: uniform(seed, F.col("scene_id"), F.col("pair"), F.col("attempt"), name)
    new = (
        F.when(F.col("role") == "aligned", align(a, b, u("a"), u("b"), cfg.align_origin)).when(F.col("role") == "overlapping", overlap(a, b, u("a"), cfg.older))
        .when(F.col("role") == "contained", contain(a, b, cfg.older)).otherwise(touch(a, b, u("a"), u("b"), cfg.older))
    )
    tried = tried.withColumn("new", F.explode(F.array(new)))
    must = F.col("role").isin("aligned", *([] if cfg.older else ["touching"]))
    bad = holds("overlaps", relate(F.when(must, a), F.when(must, F.col("new"))), a, F.col("new"))
    tried = tried.withColumn("good", ~must | ~bad)
    same = [F.any_value(x).alias(x) for x in ("role", "a", "b", "slot_a", "slot_b")]
    done = tried.groupBy("scene_id", "pair").agg(*same, F.min_by("new", F.when(F.col("good"), F.col("attempt"))).alias("new"))
    either = F.array(F.struct(F.col("slot_a").alias("slot"), a.alias("geom")), F.struct(F.col("slot_b").alias("slot"), F.coalesce("new", "b").alias("geom")))
    out = done.select("scene_id", "role", F.inline(either)).select("scene_id", "slot", "role", "geom")
    return out.unionByName(pairs.where("role is null").select("scene_id", "slot", "role", "geom"))


class _Placer:
    """One scene: draws in a fixed order from a generator seeded by the scene."""

    def __init__(self, cfg: SceneConfig, seed: int, scene: int) -> None:
        self.cfg, self.rng = cfg, np.random.default_rng([seed, scene])
        self.placed: list[tuple[str, str, list]] = []  # kind, style, vertices

    def meets(self, kind: str, pts: list) -> bool:
        """Whether a geometry meets any that is placed."""
        xs, ys = (np.array(c) for c in zip(*pts))
        near = []
        for k, _, q in self.placed:
            ox, oy = (np.array(c) for c in zip(*q))
            if xs.min() <= ox.max() and ox.min() <= xs.max() and ys.min() <= oy.max() and oy.min() <= ys.max():
                near.append((k, ox, oy))
        if not near:
            return False
        kinds = np.array([k for k, *_ in near], dtype=object)
        found = batch_matrices(np.full(len(near), kind, dtype=object), [xs] * len(near), [ys] * len(near), kinds, [x for _, x, _ in near], [y for *_, y in near])
        return any(not (m[0] == m[1] == m[3] == m[4] == "F") for m in found)

    def polygon(self) -> list:
        c = self.cfg
        n, r = int(self.rng.integers(c.vertices[0], c.vertices[1] + 1)), self.rng.uniform(*c.radius)
        x, y = (self.rng.uniform(c.bounds[i] + 1.1 * r, c.bounds[i + 2] - 1.1 * r) for i in (0, 1))
        angles = self.rng.uniform(0, 2 * math.pi) + 2 * math.pi / n * np.arange(n) if c.regular else np.sort(self.rng.uniform(0, 2 * math.pi, n))
        radii = np.full(n, r) if c.regular else self.rng.uniform(0.8 * r, 1.2 * r, n)
        ring = [(float(x + s * math.cos(t)), float(y + s * math.sin(t))) for s, t in zip(radii, angles)]
        return [*ring, ring[0]]

    def line(self, straight_only: bool = False) -> tuple[str, list]:
        c = self.cfg
        at = lambda: (float(self.rng.uniform(c.bounds[0], c.bounds[2])), float(self.rng.uniform(c.bounds[1], c.bounds[3])))
        if straight_only or c.straight_only or self.rng.random() < 0.5:
            return "straight", [at(), at()]
        k = int(self.rng.integers(c.line_vertices[0], c.line_vertices[1] + 1))
        step, heading, pts = self.rng.uniform(*c.line_length) / k, self.rng.uniform(0, 2 * math.pi), [at()]
        for _ in range(k - 1):
            heading += self.rng.uniform(-math.pi / 2, math.pi / 2)
            pts.append(tuple(float(min(max(v + step * f(heading), c.bounds[i]), c.bounds[i + 2])) for i, (v, f) in enumerate(zip(pts[-1], (math.cos, math.sin)))))
        return "curly", pts

    def first_clear(self, draw, kind: str) -> tuple | None:
        """The first of the attempts that meets nothing placed; None where all do."""
        for _ in range(self.cfg.placement_attempts):
            style, pts = draw()
            if not self.meets(kind, pts):
                return style, pts
        return None


def _place(cfg: SceneConfig, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, c = _Placer(cfg, seed, int(key[0])), cfg
        style = "regular" if c.regular else "irregular"
        rows = rows.sort_values("slot")
        pts_of = lambda g: [(float(v["x"]), float(v["y"])) for v in g["pts"]]
        final: dict[int, list] = {}
        for slot, role, g in zip(rows["slot"], rows["role"], rows["geom"]):
            if role is not None and g is not None and isinstance(role, str):
                final[slot] = pts_of(g)
                p.placed.append((G.POLYGON, style, final[slot]))
        for slot, role, g in zip(rows["slot"], rows["role"], rows["geom"]):
            if g is not None and not isinstance(role, str):
                pts, left = pts_of(g), c.placement_attempts
                while left and p.meets(G.POLYGON, pts):
                    pts, left = p.polygon(), left - 1
                final[slot] = pts  # placed all the same when no attempt was clear
                p.placed.append((G.POLYGON, style, pts))
        polygons, lines, points = [final[s] for s in sorted(final)], [], []
        todo = c.lines
        for _ in range(int(c.lines * c.crossing / 2)):
            a, b = crossing_lines(p.line(True)[1], p.line(True)[1], p.rng)
            for _ in range(c.placement_attempts):
                if not p.meets(G.LINE, a) and not p.meets(G.LINE, b):
                    lines += [("crossing_line", a), ("crossing_line", b)]
                    p.placed += [(G.LINE, "crossing_line", a), (G.LINE, "crossing_line", b)]
                    todo -= 2
                    break
                # The pair moves as a whole.
                (ox, oy), x, y = _centre(a, b), p.rng.uniform(c.bounds[0], c.bounds[2]), p.rng.uniform(c.bounds[1], c.bounds[3])
                a, b = ([(float(u + x - ox), float(v + y - oy)) for u, v in q] for q in (a, b))
        pick = lambda some: some[int(p.rng.integers(len(some)))]
        for _ in range(todo):
            kind, got = None, None
            for name, chance in (("in_poly", c.line_in_poly), ("on_poly_border", c.line_on_border), ("through_poly", c.line_through)):
                if kind is None and polygons and p.rng.random() < chance:
                    kind = name
            if kind:
                got = (kind, _line_on(kind, p.line()[1], pick(polygons), p.rng))
            else:
                got = p.first_clear(p.line, G.LINE)
            if got:
                lines.append(got)
                p.placed.append((G.LINE, *got))
        for _ in range(c.points):
            kind, got = None, None
            for name, chance, some in (("in_poly", c.point_in_poly, polygons), ("on_border", c.point_on_border, polygons), ("on_line", c.point_on_line, lines)):
                if kind is None and some and p.rng.random() < chance:
                    kind = name
            if kind == "in_poly":
                got = ("in_poly", [_inner(pick(polygons))])
            elif kind:
                got = ("on_border_or_line", [_along(pick(polygons) if kind == "on_border" else pick(lines)[1], p.rng.random())])
            else:
                draw = lambda: ("point", [(float(p.rng.uniform(c.bounds[0], c.bounds[2])), float(p.rng.uniform(c.bounds[1], c.bounds[3])))])
                got = p.first_clear(draw, G.POINT)
            if got:
                points.append(got)
                p.placed.append((G.POINT, *got))
        out = [(f"POLYGON_{i}", G.POLYGON, style, q) for i, q in enumerate(polygons, 1)] + [(f"LINE_{i}", G.LINE, s, q) for i, (s, q) in enumerate(lines, 1)] + [(f"POINT_{i}", G.POINT, s, q) for i, (s, q) in enumerate(points, 1)]
        return pd.DataFrame([(key[0], k, n, kind, s, [{"x": x, "y": y} for x, y in q]) for k, (n, kind, s, q) in enumerate(out, 1)], columns=["scene_id", "ord", "name", "kind", "style", "pts"])

    return run


def _centre(*lines: list) -> tuple[float, float]:
    """The centroid of lines, by length; the first vertex where they have none."""
    parts = [(math.dist(p, q), p, q) for pts in lines for p, q in zip(pts, pts[1:])]
    whole = sum(d for d, *_ in parts)
    return tuple(sum(d * (p[i] + q[i]) / 2 for d, p, q in parts) / whole for i in (0, 1)) if whole else lines[0][0]


def crossing_lines(a: list, b: list, rng: np.random.Generator) -> tuple[list, list]:
    """B's centroid 0.2 to 0.8 units along A, then B turned by 30 to 150 degrees about it."""
    (x, y), (ox, oy), t = _along(a, rng.uniform(0.2, 0.8), False), _centre(b), math.radians(rng.uniform(30, 150))
    return a, [(float(x + (u - ox) * math.cos(t) - (v - oy) * math.sin(t)), float(y + (u - ox) * math.sin(t) + (v - oy) * math.cos(t))) for u, v in b]


def _along(pts: list, share: float, normalized: bool = True) -> tuple[float, float]:
    spans = [math.dist(a, b) for a, b in zip(pts, pts[1:])]
    left = share * sum(spans) if normalized else share
    for (ax, ay), (bx, by), d in zip(pts, pts[1:], spans):
        if left <= d and d:
            return ax + left / d * (bx - ax), ay + left / d * (by - ay)
        left -= d
    return pts[-1]


def _inner(ring: list) -> tuple[float, float]:
    ys = sorted({y for _, y in ring})
    middle = (ys[0] + ys[-1]) / 2
    at = (max(y for y in ys if y <= middle) + min((y for y in ys if y > middle), default=middle)) / 2
    cuts = sorted(ax + (at - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(ring, ring[1:]) if (ay > at) != (by > at))
    spans = [(q - p, (p + q) / 2) for p, q in zip(cuts[::2], cuts[1::2])]
    return (max(spans)[1], at) if spans else ring[0]


def _line_on(kind: str, line: list, ring: list, rng: np.random.Generator) -> list:
    if kind == "in_poly":
        size = lambda q, i: max(v[i] for v in q) - min(v[i] for v in q)
        f = min(0.5 * size(ring, i) / (size(line, i) if size(line, i) > 1e-6 else 1.0) for i in (0, 1))
        (cx, cy), (tx, ty) = _centre(line), _inner(ring)
        return [(float(tx + f * (x - cx)), float(ty + f * (y - cy))) for x, y in line]
    if kind == "on_poly_border":
        lo, hi = sorted(rng.random(2))
        return sorted(_along(ring, t) for t in (lo, hi, *rng.uniform(lo, hi, 3)))
    (ax, ay), (bx, by) = _along(ring, rng.random()), _along(ring, rng.random())
    dx, dy = 0.5 * (bx - ax), 0.5 * (by - ay)
    return [(ax - dx, ay - dy), (bx + dx, by + dy)]


def scenes(spark: SparkSession, n: int, cfg: SceneConfig = SceneConfig(), seed: int = 1) -> DataFrame:
    """The table of geometries of n scenes: scene_id, ord, id, name, geom_type, style, vertices, area, geom, box, created_at."""
    cfg.check()
    ready = forced(paired(random_polygons(spark, n, cfg, seed), cfg, seed), cfg, seed).select("scene_id", "slot", "role", "geom")
    every = spark.range(n).select(F.col("id").alias("scene_id"))
    ready = every.join(ready, "scene_id", "left")  # scenes without polygons have lines and points
    placed = ready.groupBy("scene_id").applyInPandas(_place(replace(cfg), seed), "scene_id long, ord int, name string, kind string, style string, pts array<struct<x:double,y:double>>")
    return geometry_table(placed.select("scene_id", "ord", "name", "style", G.geometry(F.col("kind"), F.col("pts")).alias("geom")))


def geometry_table(rows: DataFrame) -> DataFrame:
    """The table's columns from scene_id, ord, name, style, geom."""
    g = F.col("geom")
    return rows.select(
        "scene_id", "ord", F.row_number().over(W.partitionBy("scene_id").orderBy("ord")).cast("long").alias("id"), "name", G.geom_type(g).alias("geom_type"), "style",
        G.vertex_count(g).alias("vertices"), G.area(g).alias("area"), "geom", g["minx"].alias("minx"), g["miny"].alias("miny"), g["maxx"].alias("maxx"), g["maxy"].alias("maxy"),
        F.current_timestamp().alias("created_at"),
    )


def named(rows: DataFrame) -> DataFrame:
    """rows (scene_id, ord, geom) with names by kind, in the order of ord."""
    kind = F.when(F.col("geom.kind") == G.LINE, "LINE").otherwise(F.upper("geom.kind"))
    placed = numbered(rows.withColumn("_kind", kind), ["scene_id", "_kind"], [block_of(F.col("ord"))], ["ord"], "_number")
    return placed.withColumn("name", F.concat_ws("_", "_kind", "_number")).drop("_kind", "_number")
