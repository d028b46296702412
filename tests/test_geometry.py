import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.functions.relate import Shape, matrix


def poly(*p):
    return Shape("Polygon", [*p, p[0]])


def line(*p):
    return Shape("LineString", list(p))


def square(x, y, w):
    return poly((x, y), (x + w, y), (x + w, y + w), (x, y + w))


A = square(0, 0, 4)


@pytest.mark.parametrize(
    "want, a, b",
    [
        ("212FF1FF2", A, square(1, 1, 1)), ("212101212", A, square(2, 2, 4)), ("FF2F11212", A, square(4, 0, 4)), ("FF2F01212", A, square(4, 4, 4)), ("FF2FF1212", A, square(9, 9, 1)), ("2FFF1FFF2", A, square(0, 0, 4)),
        ("1F20F1102", A, line((-1, 2), (9, 2))), ("102FF1FF2", A, line((1, 1), (2, 2))), ("0F1FF0102", line((0, 0), (4, 4)), line((0, 4), (4, 0))), ("1FFF0FFF2", line((0, 0), (4, 4)), line((0, 0), (4, 4))),
        ("0FFFFF212", Shape("Point", [(1, 1)]), A), ("F0FFFF212", Shape("Point", [(0, 1)]), A), ("0FFFFFFF2", Shape("Point", [(1, 1)]), Shape("Point", [(1, 1)])), ("F0FFFF102", Shape("Point", [(0, 0)]), line((0, 0), (2, 2))),
    ],
)
def test_matrices(want, a, b):
    assert matrix(a, b) == want


def turned(m):
    return "".join(m[3 * j + i] for i in range(3) for j in range(3))


coords = st.integers(0, 6)
shapes = st.one_of(
    st.builds(lambda x, y, w: square(x, y, w), coords, coords, st.integers(1, 4)),
    st.builds(lambda x, y, w: poly((x, y), (x + w, y), (x, y + w)), coords, coords, st.integers(1, 4)),
    st.builds(lambda a, b, c, d: line((a, b), (c + 7, d)), coords, coords, coords, coords),
    st.builds(lambda x, y: Shape("Point", [(x, y)]), coords, coords),
)


@settings(max_examples=150, deadline=None)
@given(shapes, shapes)
def test_matrix_of_swapped_geometries_is_transposed(a, b):
    assert turned(matrix(a, b)) == matrix(b, a)


@settings(max_examples=60, deadline=None)
@given(shapes, shapes)
def test_matrix_does_not_change_when_both_move(a, b):
    move = lambda s: Shape(s.kind, [(float(x) + 3, float(y) - 5) for x, y in s.pts])
    assert matrix(a, b) == matrix(move(a), move(b))


def test_functions(spark):
    wkt = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
    df = spark.createDataFrame([(wkt,), ("POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))",), ("LINESTRING (0 0, 3 4)",), ("POINT (1.5 2)",), ("POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))",), (None,)], "w string")
    g = F.col("g")
    rows = df.withColumn("g", G.from_wkt(F.col("w"))).select(G.to_wkt(g).alias("w"), G.area(g).alias("a"), G.length(g).alias("l"), G.is_valid(g).alias("v"), G.vertex_count(g).alias("n"), F.size(G.boundary(g)).alias("b"), g.isNull().alias("none")).collect()
    assert (rows[0].w, rows[0].a, rows[0].l, rows[0].v, rows[0].n, rows[0].b) == (wkt, 16.0, 16.0, True, 4, 5)
    assert rows[1].v is False
    assert (rows[2].w, rows[2].l, rows[2].a, rows[2].b) == ("LINESTRING (0 0, 3 4)", 5.0, 0.0, 2)
    assert (rows[3].w, rows[3].n) == ("POINT (1.5 2)", 1)
    assert rows[4].none and rows[5].none
