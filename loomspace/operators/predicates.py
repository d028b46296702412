"""Topological predicates, as patterns of the DE-9IM matrix and as SQL functions ST_*."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspace.functions.geometry import GEOMETRY, LINE, POINT, POLYGON, computed, point_in_ring
from loomspace.functions.relate import batch_matrix, matches, relate_udf

# The patterns of simple-features predicates, rows interior, boundary, exterior.
WITHIN, CONTAINS = "T*F**F***", "T*****FF*"
EQUALS, DISJOINT = "T*F**FFF*", "FF*FF****"
TOUCHES = ("FT*******", "F**T*****", "F***T****")
OVERLAPS_SAME, OVERLAPS_LINES = "T*T***T**", "1*T***T**"
CROSSES_LOWER, CROSSES_HIGHER, CROSSES_LINES = "T*T******", "T*****T**", "0********"
PREDICATES = ("within", "contains", "overlaps", "intersects", "disjoint", "crosses", "touches", "equals")


def dimension(g: Column) -> Column:
    return F.when(g["kind"] == POINT, 0).when(g["kind"] == LINE, 1).otherwise(2)


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def native_matrix(a: Column, b: Column) -> Column:
    """The matrix of two points, or of a point and a polygon in either order; null for other kinds."""
    first = lambda g: F.element_at(g["pts"], 1)
    at = point_in_ring(first(a), b["pts"])
    back = point_in_ring(first(b), a["pts"])
    return (
        F.when((a["kind"] == POINT) & (b["kind"] == POLYGON), F.when(at == 1, "0FFFFF212").when(at == 0, "F0FFFF212").otherwise("FF0FFF212"))
        .when((a["kind"] == POLYGON) & (b["kind"] == POINT), F.when(back == 1, "0F2FF1FF2").when(back == 0, "FF20F1FF2").otherwise("FF2FF10F2"))
        .when((a["kind"] == POINT) & (b["kind"] == POINT), F.when(first(a) == first(b), "0FFFFFFF2").otherwise("FF0FFF0F2"))
    )


def relate(a: Column, b: Column) -> Column:
    """The matrix of any two geometries: native where a point is involved with a point or polygon, else by batches."""
    fast = native_matrix(a, b)
    return F.coalesce(fast, batch_matrix(a, b, fast.isNull()))


def with_relation(pairs: DataFrame, native: bool = False, name: str = "relation") -> DataFrame:
    """Pairs (geometries a, b) with their matrix, computed once a row.  native: all pairs are of points with points or polygons."""
    a, b = F.col("a"), F.col("b")
    if native:
        return computed(pairs, name, native_matrix(a, b))
    found = computed(pairs, "fast", native_matrix(a, b))
    return found.select(*pairs.columns, F.coalesce("fast", batch_matrix(a, b, F.col("fast").isNull())).alias(name))


def holds(predicate: str, relation: Column, a: Column, b: Column) -> Column:
    """Whether a predicate holds, from the matrix and the kinds."""
    da, db = dimension(a), dimension(b)
    if predicate == "within":
        return matches(relation, WITHIN)
    if predicate == "contains":
        return matches(relation, CONTAINS)
    if predicate == "equals":
        return matches(relation, EQUALS)
    if predicate == "disjoint":
        return matches(relation, DISJOINT)
    if predicate == "intersects":
        return ~matches(relation, DISJOINT)
    if predicate == "touches":
        return ((da > 0) | (db > 0)) & (matches(relation, TOUCHES[0]) | matches(relation, TOUCHES[1]) | matches(relation, TOUCHES[2]))
    if predicate == "overlaps":
        return (da == db) & F.when(da == 1, matches(relation, OVERLAPS_LINES)).otherwise(matches(relation, OVERLAPS_SAME))
    if predicate == "crosses":
        return F.when(da < db, matches(relation, CROSSES_LOWER)).when(da > db, matches(relation, CROSSES_HIGHER)).when(da == 1, matches(relation, CROSSES_LINES)).otherwise(False)
    raise ValueError(f"no such predicate: {predicate}")


def _expression(*patterns: str) -> str:
    sign = {"T": "[012]", "*": ".", "F": "F", "0": "0", "1": "1", "2": "2"}
    return "^(" + "|".join("".join(sign[c] for c in p) for p in patterns) + ")$"


def register(spark: SparkSession) -> None:
    """Temporary SQL functions: ST_* predicates, ST_Relate, ST_Equals and ST_GeomFromText.

    Each body begins with the boxes' comparison as plain conjuncts, which stay in the join
    condition, and only pairs that pass it reach the kernel.
    """
    spark.udf.register("loomspace_relate", relate_udf())
    meet = "a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy"
    inside = "a.minx >= b.minx AND a.maxx <= b.maxx AND a.miny >= b.miny AND a.maxy <= b.maxy"
    outside = "b.minx >= a.minx AND b.maxx <= a.maxx AND b.miny >= a.miny AND b.maxy <= a.maxy"
    dim = lambda g: f"CASE {g}.kind WHEN 'Point' THEN 0 WHEN 'LineString' THEN 1 ELSE 2 END"
    m = "loomspace_relate(a, b)"
    never = "^$"
    bodies = {
        "st_within": f"{inside} AND {m} RLIKE '{_expression(WITHIN)}'",
        "st_contains": f"{outside} AND {m} RLIKE '{_expression(CONTAINS)}'",
        "st_equals": f"{inside} AND {outside} AND {m} RLIKE '{_expression(EQUALS)}'",
        "st_intersects": f"{meet} AND NOT {m} RLIKE '{_expression(DISJOINT)}'",
        # Boxes apart decide it; the kernel is handed nothing then.
        "st_disjoint": f"(NOT ({meet}) OR loomspace_relate(CASE WHEN {meet} THEN a END, CASE WHEN {meet} THEN b END) RLIKE '{_expression(DISJOINT)}')",
        "st_touches": f"{meet} AND NOT (a.kind = 'Point' AND b.kind = 'Point') AND {m} RLIKE '{_expression(*TOUCHES)}'",
        "st_overlaps": f"{meet} AND a.kind = b.kind AND {m} RLIKE CASE a.kind WHEN 'LineString' THEN '{_expression(OVERLAPS_LINES)}' ELSE '{_expression(OVERLAPS_SAME)}' END",
        "st_crosses": f"{meet} AND {m} RLIKE CASE WHEN ({dim('a')}) < ({dim('b')}) THEN '{_expression(CROSSES_LOWER)}' WHEN ({dim('a')}) > ({dim('b')}) THEN '{_expression(CROSSES_HIGHER)}' WHEN a.kind = 'LineString' THEN '{_expression(CROSSES_LINES)}' ELSE '{never}' END",
    }
    g = GEOMETRY
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a {g}, b {g}) RETURNS BOOLEAN RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION st_relate(a {g}, b {g}) RETURNS STRING RETURN {m}")
    number = "[-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?"
    pts = f"transform(regexp_extract_all(wkt, '({number} +{number})', 1), p -> named_struct('x', CAST(split(p, ' +')[0] AS DOUBLE), 'y', CAST(split(p, ' +')[1] AS DOUBLE)))"
    kind = "CASE upper(regexp_extract(wkt, '^ *([A-Za-z]+)', 1)) WHEN 'POINT' THEN 'Point' WHEN 'LINESTRING' THEN 'LineString' WHEN 'POLYGON' THEN 'Polygon' END"
    # A polygon with holes, or another kind of geometry, is null, as from_wkt has it.
    sound = f"({kind}) IS NOT NULL AND size({pts}) > 0 AND NOT wkt RLIKE '[)][^(]*[(]'"
    least = lambda f, c: f"{f}(transform({pts}, q -> q.{c}))"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION st_geomfromtext(wkt STRING, srid INT DEFAULT 0) RETURNS {g} RETURN CASE WHEN {sound} THEN named_struct('kind', {kind}, 'pts', {pts}, "
        f"'minx', {least('array_min', 'x')}, 'miny', {least('array_min', 'y')}, 'maxx', {least('array_max', 'x')}, 'maxy', {least('array_max', 'y')}) END"
    )
