"""DE-9IM matrices of two geometries, exact, for points, lines and polygons without holes.

Outlines are split where they meet; each vertex and a point of each piece is located in
both geometries, and that fills the matrix.

`batch_matrices` decides whole batches of pairs in numpy by the signs of determinants.
Edges that cross properly settle what lies on both sides of them; all other contacts are at
vertices, so outlines are cut there only, and no point of intersection is computed.  On a
grid on which doubles are exact the point of a piece is its middle; else no vertex may lie
on or too near a line of the other geometry, and it is the piece's start.  Pairs that
doubles leave open go to `matrix`, which computes with fractions, so that the answer is that
of the stored doubles in every case.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import LINE, POINT, POLYGON

INTERIOR, BOUNDARY, EXTERIOR = 0, 1, 2


def _orient(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a, b, p) -> bool:
    return _orient(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


class Shape:
    def __init__(self, kind: str, pts: list[tuple[float, float]]) -> None:
        self.kind = kind
        exact = [(Fraction(x), Fraction(y)) for x, y in pts]
        self.pts = [p for i, p in enumerate(exact) if not i or p != exact[i - 1]]
        self.edges = list(zip(self.pts, self.pts[1:])) if kind != POINT else []
        self.closed = self.pts[0] == self.pts[-1]

    def locate(self, p) -> int:
        """Interior, boundary or exterior of this geometry."""
        if self.kind == POINT or not self.edges:
            return INTERIOR if p == self.pts[0] else EXTERIOR
        on = any(_on(a, b, p) for a, b in self.edges)
        if self.kind == LINE:
            end = not self.closed and p in (self.pts[0], self.pts[-1])
            return BOUNDARY if end else INTERIOR if on else EXTERIOR
        if on:
            return BOUNDARY
        inside = False
        for a, b in self.edges:
            if (a[1] > p[1]) != (b[1] > p[1]) and (_orient(a, b, p) > 0) == (b[1] > a[1]):
                inside = not inside
        return INTERIOR if inside else EXTERIOR

    def samples(self, other: Shape) -> tuple[set, list]:
        """The vertices of the outline split at the other's, and the middles of its pieces."""
        nodes, middles = set(self.pts), []
        for a, b in self.edges:
            d = (b[0] - a[0], b[1] - a[1])
            cuts = {Fraction(0), Fraction(1)}
            axis = 0 if d[0] else 1
            place = lambda p: (p[axis] - a[axis]) / d[axis]  # noqa: B023, E731
            for p in other.pts:
                if _on(a, b, p):
                    cuts.add(place(p))
            for c, e in other.edges:
                o1, o2 = _orient(c, e, a), _orient(c, e, b)
                if o1 != o2 and (o1 > 0) != (o2 > 0) and o1 and o2:
                    t = o1 / (o1 - o2)
                    if _on(c, e, (a[0] + t * d[0], a[1] + t * d[1])) or _orient(a, b, c) * _orient(a, b, e) < 0:
                        cuts.add(t)
                for o, t in ((o1, Fraction(0)), (o2, Fraction(1))):
                    if o == 0 and _on(c, e, (a, b)[int(t)]):
                        cuts.add(t)
            order = sorted(cuts)
            at = lambda t: (a[0] + t * d[0], a[1] + t * d[1])  # noqa: B023, E731
            nodes.update(at(t) for t in order)
            middles += [at((s + t) / 2) for s, t in zip(order, order[1:])]
        return nodes, middles


def matrix(a: Shape, b: Shape) -> str:
    """The nine characters of the intersections of interior, boundary and exterior."""
    cells = [[-1] * 3 for _ in range(3)]

    def seen(i: int, j: int, dim: int) -> None:
        cells[i][j] = max(cells[i][j], dim)

    # A piece of an outline lies in a polygon's boundary or a line's interior, even where its middle is that line's end.
    outline = lambda g: BOUNDARY if g.kind == POLYGON else INTERIOR
    for one, two in ((a, b), (b, a)):
        nodes, middles = one.samples(two)
        for p in nodes:
            seen(a.locate(p), b.locate(p), 0)
        for p in middles:
            if one is a:
                seen(outline(a), b.locate(p) if b.locate(p) == EXTERIOR or b.kind == POLYGON else INTERIOR, 1)
            else:
                seen(a.locate(p) if a.locate(p) == EXTERIOR or a.kind == POLYGON else INTERIOR, outline(b), 1)
    cells[EXTERIOR][EXTERIOR] = 2
    area_a, area_b = a.kind == POLYGON, b.kind == POLYGON
    if area_a and area_b:
        ib, bi, be, eb = cells[0][1], cells[1][0], cells[1][2], cells[2][1]
        cells[0][0] = 2 if ib >= 0 or bi >= 0 or (be < 0 and eb < 0) else -1
        cells[0][2] = 2 if ib >= 0 or be >= 0 else -1
        cells[2][0] = 2 if bi >= 0 or eb >= 0 else -1
    elif area_a:
        cells[0][2] = 2
    elif area_b:
        cells[2][0] = 2
    return "".join("F012"[c + 1] for row in cells for c in row)


def relate_values(kind_a: str, pts_a, kind_b: str, pts_b) -> str:
    return matrix(Shape(kind_a, [(p["x"], p["y"]) for p in pts_a]), Shape(kind_b, [(p["x"], p["y"]) for p in pts_b]))


# Exactness of double arithmetic: a determinant of differences has the right sign where it exceeds this share of its
# terms; and it is exact on these grids (steps to a unit, largest value), quarters of steps included.
SIGN_BOUND = 3.4e-16
GRIDS = ((1024.0, 8192.0), (2.0, 4_000_000.0))
MOST = 1 << 21  # edges times vertices that are held at once, where no single pair has more


def _ragged(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the owner of each of sum(n) items, and the item's number in its owner."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


class _Side:
    """One geometry of each pair: vertices end to end, and edges by their first vertex."""

    def __init__(self, kind: np.ndarray, xs: list[np.ndarray], ys: list[np.ndarray]) -> None:
        self.n = np.array([len(x) for x in xs])
        self.x, self.y = np.concatenate(xs), np.concatenate(ys)
        self.start = np.cumsum(self.n) - self.n
        self.area, self.line = kind == POLYGON, kind == LINE
        self.edges = np.where(self.area | self.line, self.n - 1, 0)
        self.of, _ = _ragged(self.n)
        last = self.start + self.n - 1
        self.open = self.line & ((self.x[self.start] != self.x[last]) | (self.y[self.start] != self.y[last]))
        self.first, self.last = self.start, last
        equal = lambda at: (self.x == self.x[at[self.of]]) & (self.y == self.y[at[self.of]])
        end = equal(self.first) | equal(self.last)
        self.own = np.where(self.area[self.of] | (end & self.open[self.of]), BOUNDARY, INTERIOR)  # of each vertex in its geometry
        self.edge_of, edge = _ragged(self.edges)
        self.p = self.start[self.edge_of] + edge

    def grid(self, step: float, most: float) -> np.ndarray:
        off = (np.abs(self.x) > most) | (np.abs(self.y) > most) | (self.x * step != np.floor(self.x * step)) | (self.y * step != np.floor(self.y * step))
        return np.bincount(self.of[off], minlength=len(self.n)) == 0

    def against(self, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points (of pair, x, y) with every edge of their pair: point, edge's first vertex, determinant."""
        point, k = _ragged(self.edges[of])
        p = self.start[of[point]] + k
        px, py = x[point], y[point]
        left, right = (self.x[p + 1] - self.x[p]) * (py - self.y[p]), (self.y[p + 1] - self.y[p]) * (px - self.x[p])
        return point, p, left - right

    def inside_box(self, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        between = lambda v, c: (np.minimum(c[p], c[p + 1]) <= v) & (v <= np.maximum(c[p], c[p + 1]))
        return between(x, self.x) & between(y, self.y)

    def locate(self, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        point, p, det = self.against(of, x, y)
        px, py = x[point], y[point]
        on = np.bincount(point[(det == 0) & self.inside_box(p, px, py)], minlength=len(of)) > 0
        up = ((self.y[p] > py) != (self.y[p + 1] > py)) & ((det > 0) == (self.y[p + 1] > self.y[p]))
        odd = np.bincount(point[up], minlength=len(of)) % 2 == 1
        same = lambda at: (x == self.x[at[of]]) & (y == self.y[at[of]])
        end = self.open[of] & (same(self.first) | same(self.last))
        area = np.where(on, BOUNDARY, np.where(odd, INTERIOR, EXTERIOR))
        line = np.where(on, np.where(end, BOUNDARY, INTERIOR), EXTERIOR)
        return np.where(self.area[of], area, np.where(self.line[of], line, np.where(same(self.first), INTERIOR, EXTERIOR)))


def _sides(one: _Side, two: _Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Signs of two's vertices to one's edges, pair by pair, edge by edge; where a pair's begin; pairs with a doubtful one; vertices on edges."""
    n = one.edges * two.n
    of, k = _ragged(n)
    edge, v = np.divmod(k, np.maximum(two.n[of], 1))
    p, q = one.start[of] + edge, two.start[of] + v
    left, right = (one.x[p + 1] - one.x[p]) * (two.y[q] - one.y[p]), (one.y[p + 1] - one.y[p]) * (two.x[q] - one.x[p])
    det = left - right
    doubtful = np.abs(det) <= SIGN_BOUND * (np.abs(left) + np.abs(right))
    touch = np.flatnonzero((det == 0) & one.inside_box(p, two.x[q], two.y[q]))
    return np.sign(det).astype(np.int8), np.cumsum(n) - n, np.bincount(of[doubtful], minlength=len(n)) > 0, (p[touch], q[touch])


def _samples(one: _Side, two: _Side, touches: tuple, grid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Points of the pieces of one's edges: edge, middle, and the point half-way to it; off the grid the edge's start."""
    edge = np.arange(len(one.p))
    number = np.full(len(one.x), -1)
    number[one.p] = edge
    p, q = touches
    e = np.concatenate((edge, edge, number[p]))
    x, y = np.concatenate((one.x[one.p], one.x[one.p + 1], two.x[q])), np.concatenate((one.y[one.p], one.y[one.p + 1], two.y[q]))
    order = np.lexsort((y, x, e))
    e, x, y = e[order], x[order], y[order]
    piece = np.flatnonzero((e[1:] == e[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    of = e[piece]
    on = grid[one.edge_of[of]]
    at = lambda c, begin, share: np.where(on, c[piece] * (1 - share) + c[piece + 1] * share, begin[one.p[of]])
    return of, at(x, one.x, 0.5), at(y, one.y, 0.5), at(x, one.x, 0.25), at(y, one.y, 0.25)


def _decided(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Cells (nine a pair) and whether the pair is decided."""
    n = len(a.n)
    sab, begin_ab, doubt_ab, touch_a = _sides(a, b)
    sba, begin_ba, doubt_ba, touch_b = _sides(b, a)
    grid = np.zeros(n, dtype=bool)
    for step, most in GRIDS:
        grid |= a.grid(step, most) & b.grid(step, most)
    sure = grid | ~(doubt_ab | doubt_ba)
    of, k = _ragged(a.edges * b.edges)
    i, j = np.divmod(k, np.maximum(b.edges[of], 1))
    u, v = begin_ab[of] + i * b.n[of] + j, begin_ba[of] + j * a.n[of] + i
    hit = np.flatnonzero((sab[u] * sab[np.minimum(u + 1, len(sab) - 1)] < 0) & (sba[v] * sba[np.minimum(v + 1, len(sba) - 1)] < 0)) if len(u) else np.empty(0, dtype=np.int64)
    cross = np.bincount(of[hit], minlength=n) > 0
    cells = np.full((n, 9), -1, dtype=np.int8)

    def told(pair: np.ndarray, row, column, dim: int) -> None:
        np.maximum.at(cells, (pair, 3 * row + column), dim)

    outline = lambda g: np.where(g.area, BOUNDARY, INTERIOR)
    first_edge = lambda g: np.cumsum(g.edges) - g.edges
    for one, two, edge, touches, turn in ((a, b, i, touch_a, False), (b, a, j, touch_b, True)):
        crossed = np.zeros(len(one.p), dtype=bool)
        crossed[first_edge(one)[of[hit]] + edge[hit]] = True
        e, x, y, x2, y2 = _samples(one, two, touches, grid)
        pair = one.edge_of[e]
        at, edge_line = two.locate(pair, x, y), outline(two)[pair]
        # A point of a crossed edge on the other's outline may be the crossing itself: the second point may settle it.
        again = np.flatnonzero(crossed[e] & (at == edge_line))
        at[again] = two.locate(pair[again], x2[again], y2[again])
        sure[pair[again][at[again] == edge_line[again]]] = False
        nodes = two.locate(one.of, one.x, one.y)
        put = (lambda p, mine, other, d: told(p, other, mine, d)) if turn else told
        put(pair, outline(one)[pair], at, 1)
        put(one.of, one.own, nodes, 0)
    c = np.flatnonzero(cross)
    told(c, outline(a)[c], outline(b)[c], 0)
    for rule, found in ((a.area & b.area, ((1, 0), (0, 1), (1, 2), (2, 1))), (a.line & b.area, ((0, 0), (0, 2))), (a.area & b.line, ((0, 0), (2, 0)))):
        for row, column in found:
            told(np.flatnonzero(cross & rule), row, column, 1)
    cells[:, 8] = 2
    both = a.area & b.area
    ib, bi, be, eb = (cells[:, k] >= 0 for k in (1, 3, 5, 7))
    cells[both, 0] = np.where(ib | bi | (~be & ~eb), 2, -1)[both]
    cells[both, 2] = np.where(ib | be, 2, -1)[both]
    cells[both, 6] = np.where(bi | eb, 2, -1)[both]
    cells[a.area & ~b.area, 2] = 2
    cells[~a.area & b.area, 6] = 2
    return cells, sure


def batch_matrices(kind_a: np.ndarray, xa: list, ya: list, kind_b: np.ndarray, xb: list, yb: list) -> np.ndarray:
    """The matrices of pairs of geometries (no nulls): kinds, and the coordinates of the vertices."""
    out = np.empty(len(kind_a), dtype=object)
    work = np.array([len(p) * len(q) for p, q in zip(xa, xb)])
    part = np.cumsum(work) // MOST
    for rows in np.split(np.arange(len(out)), np.flatnonzero(np.diff(part)) + 1):
        if not len(rows):
            continue
        pick = lambda c: [np.asarray(c[i], dtype=np.float64) for i in rows]  # noqa: B023, E731
        cells, sure = _decided(_Side(kind_a[rows], pick(xa), pick(ya)), _Side(kind_b[rows], pick(xb), pick(yb)))
        out[rows] = np.frombuffer(b"F012", dtype=np.uint8)[cells + 1].view("S9").ravel().astype(str)
        for i in rows[~sure]:
            out[i] = matrix(Shape(kind_a[i], list(zip(xa[i], ya[i]))), Shape(kind_b[i], list(zip(xb[i], yb[i]))))
    return out


def _batch(ka: pd.Series, xa: pd.Series, ya: pd.Series, kb: pd.Series, xb: pd.Series, yb: pd.Series) -> pd.Series:
    out = np.full(len(ka), None, dtype=object)
    some = np.flatnonzero((ka.notna() & kb.notna()).to_numpy())
    if len(some):
        pick = lambda c: [c.iat[i] for i in some]
        out[some] = batch_matrices(np.array(pick(ka), dtype=object), pick(xa), pick(ya), np.array(pick(kb), dtype=object), pick(xb), pick(yb))
    return pd.Series(out, dtype=object)


def batch_matrix(a: Column, b: Column, needed: Column) -> Column:
    """The matrices of two geometry columns, batch by batch, where needed; null elsewhere and where one is null."""
    part = lambda g: (F.when(needed, g["kind"]), *(F.when(needed, F.transform(g["pts"], lambda p: p[c])) for c in "xy"))  # noqa: B023, E731
    return F.pandas_udf(_batch, "string")(*part(a), *part(b))


def _relate(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    flat = lambda g: (g["kind"], *(pd.Series([None if p is None else [v[c] for v in p] for p in g["pts"]], dtype=object) for c in "xy"))  # noqa: B023, E731
    return _batch(*flat(a), *flat(b))


def relate_udf():
    """The matrix of two geometry columns, as a function that SQL can call; null where one is null."""
    return F.pandas_udf(_relate, "string")


def matches(relation: Column, pattern: str) -> Column:
    """Whether a matrix fits a DE-9IM pattern of T, F, *, 0, 1, 2."""
    # What each sign of a pattern stands for.
    sign = {"T": "[012]", "*": ".", "F": "F", "0": "0", "1": "1", "2": "2"}
    return relation.rlike("^" + "".join(sign[c] for c in pattern) + "$")
