"""Geometry as a struct column, and functions on it that stay inside the JVM.

A geometry is struct<kind, pts, minx, miny, maxx, maxy>: kind is Point, LineString or
Polygon, pts its vertices, a polygon's ring closed (the first again at the end).  The box is
part of the struct so that predicates can reject by it.  Null geometries give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOMETRY = "struct<kind:string,pts:array<struct<x:double,y:double>>,minx:double,miny:double,maxx:double,maxy:double>"
POINT, LINE, POLYGON = "Point", "LineString", "Polygon"


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def once(then, *values: Column) -> Column:
    """then(*values) with each value written out once in the plan, however often `then` uses it."""
    held = F.array(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
    return F.get(F.transform(held, lambda r: then(*(r[f"v{i}"] for i in range(len(values))))), F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: behind a generator it isn't written out again wherever it is used or filtered by."""
    return df.select("*", value.alias("_once")).select(*df.columns, F.explode(F.array("_once")).alias(name))


def geometry(kind: Column | str, pts: Column) -> Column:
    """A geometry of a kind from its vertices."""
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), pts.alias("pts"),
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )


def point(x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    return F.struct(F.lit(POINT).alias("kind"), F.array(xy(x, y)).alias("pts"), x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy"))


def line(pts: Column) -> Column:
    return geometry(LINE, pts)


def polygon(ring: Column) -> Column:
    """A polygon from its vertices, closed where they aren't."""
    closed = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.array(F.element_at(r, 1))))
    return once(lambda r: once(lambda pts: geometry(POLYGON, pts), closed(r)), ring)


def _segments(pts: Column, f) -> Column:
    """f of each vertex and the next."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.zip_with(F.slice(pts, 1, n), F.slice(pts, 2, n), f)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def _span(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def geom_type(g: Column) -> Column:
    return g["kind"]


def entity_type(name: Column) -> Column:
    """The kind that a name states: what stands before its first underscore."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def vertex_count(g: Column) -> Column:
    """Vertices as the table counts them: a ring's last isn't counted again."""
    return (F.size(g["pts"]) - F.when(g["kind"] == POLYGON, 1).otherwise(0)).cast("int")


def area(g: Column) -> Column:
    return F.when(g["kind"] == POLYGON, F.abs(_sum(_segments(g["pts"], _cross))) / 2).otherwise(F.lit(0.0))


def length(g: Column) -> Column:
    """Length of a line or of a polygon's ring; 0 for points."""
    return _sum(_segments(g["pts"], _span))


def bounds(g: Column) -> Column:
    return F.struct(g["minx"].alias("minx"), g["miny"].alias("miny"), g["maxx"].alias("maxx"), g["maxy"].alias("maxy"))


def centroid(g: Column) -> Column:
    """The centroid as an x, y struct: weighted by area for polygons, by length for lines.

    A polygon without area, or a line without length, has that of its first vertex.
    """

    def of(kind: Column, pts: Column, o: Column, local: Column, whole: Column) -> Column:
        twice = _sum(_segments(local, _cross))
        ring = lambda c: o[c] + _sum(_segments(local, lambda a, b: (a[c] + b[c]) * _cross(a, b))) / (3 * twice)
        run = lambda c: _sum(_segments(pts, lambda a, b: (a[c] + b[c]) / 2 * _span(a, b))) / whole
        return F.when((kind == POLYGON) & (twice != 0), xy(ring("x"), ring("y"))).when((kind == LINE) & (whole > 0), xy(run("x"), run("y"))).otherwise(o)

    def parts(g: Column) -> Column:
        o = F.element_at(g["pts"], 1)
        return once(of, g["kind"], g["pts"], o, F.transform(g["pts"], lambda p: xy(p["x"] - o["x"], p["y"] - o["y"])), length(g))

    return once(parts, g)


def boundary(g: Column) -> Column:
    """A polygon's ring as a line; a line's ends as points' vertices (none if closed); nothing for a point."""
    pts = g["pts"]
    closed = F.element_at(pts, 1) == F.element_at(pts, -1)
    none = F.slice(pts, 1, 0)
    ends = F.array(F.element_at(pts, 1), F.element_at(pts, -1))
    return F.when(g["kind"] == POLYGON, pts).when((g["kind"] == LINE) & ~closed, ends).otherwise(none)


def exterior(g: Column) -> Column:
    return F.when(g["kind"] == POLYGON, line(g["pts"]))


def interpolate(g: Column, distance: Column, normalized: bool = False) -> Column:
    """The x, y at a distance along a line or ring, held to its ends."""
    return once(lambda g, d: _interpolated(g["pts"], d * length(g) if normalized else d), g, distance)


def _interpolated(pts: Column, d: Column) -> Column:
    start = F.struct(F.greatest(d, F.lit(0.0)).alias("left"), F.element_at(pts, 1).alias("prev"), F.element_at(pts, 1).alias("at"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        part = _span(s["prev"], p)
        share = s["left"] / part
        hit = (s["left"] <= part) & (part > 0)
        there = xy(s["prev"]["x"] + share * (p["x"] - s["prev"]["x"]), s["prev"]["y"] + share * (p["y"] - s["prev"]["y"]))
        on = F.struct((s["left"] - part).alias("left"), p.alias("prev"), F.when(hit, there).otherwise(p).alias("at"), hit.alias("done"))
        return F.when(s["done"], s).otherwise(on)

    return F.aggregate(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), start, step)["at"]


def _moved(g: Column, f) -> Column:
    return once(geometry, g["kind"], F.transform(g["pts"], f))


def translate(g: Column, dx: Column, dy: Column) -> Column:
    return once(lambda g, dx, dy: _moved(g, lambda p: xy(p["x"] + dx, p["y"] + dy)), g, dx, dy)


def box_centre(g: Column) -> Column:
    return xy((g["minx"] + g["maxx"]) / 2, (g["miny"] + g["maxy"]) / 2)


def _origin(g: Column, origin: str | Column) -> Column:
    return origin if isinstance(origin, Column) else centroid(g) if origin == "centroid" else box_centre(g)


def rotate(g: Column, degrees: Column, origin: str | Column = "center") -> Column:
    """Counter-clockwise about the box's centre, the centroid or a point; exact at quarter turns."""
    turn = F.pmod(degrees.cast("double"), F.lit(360.0))
    quarter = lambda turn, a, b, c, d, e: F.when(turn == 0, a).when(turn == 90, b).when(turn == 180, c).when(turn == 270, d).otherwise(e)
    cos, sin = (once(lambda t, d=d, f=f: quarter(t, *d, f(F.radians(t))), turn) for d, f in (((1.0, 0.0, -1.0, 0.0), F.cos), ((0.0, 1.0, 0.0, -1.0), F.sin)))
    turned = lambda g, o, cos, sin: _moved(g, lambda p: xy(o["x"] + (p["x"] - o["x"]) * cos - (p["y"] - o["y"]) * sin, o["y"] + (p["x"] - o["x"]) * sin + (p["y"] - o["y"]) * cos))
    return once(lambda g, cos, sin: once(turned, g, _origin(g, origin), cos, sin), g, cos, sin)


def scale(g: Column, fx: Column, fy: Column, origin: str | Column = "center") -> Column:
    scaled = lambda g, o, fx, fy: _moved(g, lambda p: xy(o["x"] + (p["x"] - o["x"]) * fx, o["y"] + (p["y"] - o["y"]) * fy))
    return once(lambda g, fx, fy: once(scaled, g, _origin(g, origin), fx, fy), g, fx, fy)


def representative_point(g: Column) -> Column:
    """An x, y strictly inside a polygon: the middle of the widest inner part of a horizontal line
    half-way between the two vertex heights around the box's middle.  A line's middle vertex, a point itself.
    """
    def height(g: Column) -> Column:
        ys, middle = F.transform(g["pts"], lambda p: p["y"]), (g["miny"] + g["maxy"]) / 2
        return (F.array_max(F.filter(ys, lambda y: y <= middle)) + F.array_min(F.filter(ys, lambda y: y > middle))) / 2

    def cut(g: Column, at: Column) -> Column:
        cross = lambda a, b: F.when((a["y"] > at) != (b["y"] > at), a["x"] + (at - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"]))
        return once(lambda cuts: xy(F.array_max(_spans(cuts))["x"], at), F.array_sort(F.filter(_segments(g["pts"], cross), lambda x: x.isNotNull())))

    def inner(g: Column) -> Column:
        vertex = F.element_at(g["pts"], (F.floor(F.size(g["pts"]) / 2) + 1).cast("int"))
        return F.when((g["kind"] == POLYGON) & (g["maxy"] > g["miny"]), once(cut, g, height(g))).otherwise(vertex)

    return once(inner, g)


def _spans(cuts: Column) -> Column:
    """Width and middle of every other gap between sorted numbers."""
    some = F.sequence(F.lit(0), F.greatest(F.size(cuts) / 2 - 1, F.lit(0)).cast("int"))
    return F.transform(some, lambda i: F.struct((F.get(cuts, 2 * i + 1) - F.get(cuts, 2 * i)).alias("w"), ((F.get(cuts, 2 * i) + F.get(cuts, 2 * i + 1)) / 2).alias("x")))


def _number(v: Column) -> Column:
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def to_wkt(g: Column) -> Column:
    body = F.array_join(F.transform(g["pts"], lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]))), ", ")
    return F.when(g["kind"] == POINT, F.concat(F.lit("POINT ("), body, F.lit(")"))).when(g["kind"] == LINE, F.concat(F.lit("LINESTRING ("), body, F.lit(")"))).otherwise(F.concat(F.lit("POLYGON (("), body, F.lit("))")))


def from_wkt(text: Column) -> Column:
    """A point, line or hole-free polygon from WKT; null for anything else, holes included."""
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    pts = F.transform(F.regexp_extract_all(text, F.lit(rf"({number}\s+{number})"), 1), lambda p: xy(F.split(p, r"\s+")[0], F.split(p, r"\s+")[1]))
    name = F.when(kind == "POINT", POINT).when(kind == "LINESTRING", LINE).when(kind == "POLYGON", POLYGON)
    holes = F.length(text) - F.length(F.replace(text, F.lit("("))) > F.when(kind == "POLYGON", 2).otherwise(1)
    return F.when(name.isNotNull() & (F.size(pts) > 0) & ~holes, geometry(name, pts))


def orient(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _within_box(a: Column, b: Column, p: Column) -> Column:
    return p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def point_in_ring(p: Column, ring: Column) -> Column:
    """1 inside, 0 on the ring, -1 outside; without division, so exact on whole numbers."""
    on = F.exists(_segments(ring, lambda a, b: (orient(a, b, p) == 0) & _within_box(a, b, p)), lambda x: x)
    up = lambda a, b: ((a["y"] > p["y"]) != (b["y"] > p["y"])) & ((orient(a, b, p) > 0) == (b["y"] > a["y"]))
    odd = F.aggregate(_segments(ring, up), F.lit(0), lambda s, v: s + F.when(v, 1).otherwise(0)) % 2 == 1
    return F.when(on, 0).when(odd, 1).otherwise(-1)


def is_valid(g: Column) -> Column:
    """A polygon's ring is simple: three distinct vertices, some area, and no two edges meet but neighbours in their shared vertex."""
    pts = g["pts"]
    n = F.size(pts) - 1
    edge = lambda i: (F.get(pts, i), F.get(pts, i + 1))

    def meet(i: Column, j: Column) -> Column:
        (a, b), (c, d) = edge(i), edge(j)
        o1, o2, o3, o4 = orient(a, b, c), orient(a, b, d), orient(c, d, a), orient(c, d, b)
        across = (F.signum(o1) * F.signum(o2) < 0) & (F.signum(o3) * F.signum(o4) < 0)
        touch = ((o1 == 0) & _within_box(a, b, c)) | ((o2 == 0) & _within_box(a, b, d)) | ((o3 == 0) & _within_box(c, d, a)) | ((o4 == 0) & _within_box(c, d, b))
        back = F.when(j == i + 1, (o2 == 0) & _within_box(a, b, d)).otherwise((o3 == 0) & (_within_box(c, d, b) & (o4 == 0)))
        near = (j == i + 1) | ((i == 0) & (j == n - 1))
        return F.when(near, (j == i + 1) & back & (n > 2)).otherwise(across | touch)

    pairs = F.exists(F.sequence(F.lit(0), n - 2), lambda i: F.exists(F.sequence(i + 1, n - 1), lambda j: meet(i, j)))
    distinct = F.size(F.array_distinct(pts)) >= 3
    return F.when(g["kind"] == POLYGON, F.when((n < 3) | ~distinct | (area(g) == 0), False).otherwise(~pairs)).otherwise(F.size(pts) >= 1)
