"""Figures of an analysed spatial join are of rows, but equal geometries are judged once."""

from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.plans import sqlfront


def test_rows_are_told_and_classes_judged(spark):
    xy = lambda x, y: G.xy(F.lit(float(x)), F.lit(float(y)))
    triangle = G.polygon(F.array(xy(0, 0), xy(10, 0), xy(0, 10)))
    # Half of the points are within the triangle, half in its box alone.
    pts = spark.range(200).select("id", G.point(1 + 8 * (F.col("id") % 2), 1 + 8 * (F.col("id") % 2)).alias("geom"))
    shp = spark.range(50).select("id", triangle.alias("geom"))
    sql = "EXPLAIN (ANALYZE, BUFFERS) SELECT p.id, s.id FROM pts AS p, shp AS s WHERE ST_Intersects(p.geom, s.geom);"
    nodes = sqlfront.analyze(spark, sql, {"pts": pts, "shp": shp}).orderBy("node").collect()
    assert next(n.rows for n in nodes if n.operator.endswith("Join")) == 200 * 50
    assert next(n.rows for n in nodes if n.operator == "Filter") == 100 * 50
    # No pair of rows goes to the kernel.
    assert not [n for n in nodes if "Python" in n.operator]
