"""Pairs of rows from judged pairs of classes, and crossings of lines of which many are equal."""

from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.operators import joins
from loomspace.plans import registry


def test_rows_of_classes_are_paired_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "SLICE", 3)
    monkeypatch.setattr(joins, "CHUNK", 16)
    rows = spark.range(40).select((F.col("id") % 3).alias("_class"), F.col("id").alias("ord"), F.format_string("N_%d", "id").alias("name"))
    pairs = spark.createDataFrame([(0, 1, "x"), (1, 0, "y"), (2, 2, "z")], "_a_class long, _b_class long, t string")
    got = sorted(tuple(r) for r in joins.row_pairs(rows, pairs, ["name"]).select("t", "a_ord", "b_ord", "a_name", "b_name").collect())
    of = {(0, 1): "x", (1, 0): "y", (2, 2): "z"}
    assert got == sorted((of[a % 3, b % 3], a, b, f"N_{a}", f"N_{b}") for a in range(40) for b in range(a + 1, 40) if (a % 3, b % 3) in of)


def test_no_side_of_the_lines_is_sent_to_all_tasks(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    found = registry.queries()["st_crosses_segments"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    one = lambda k: [k * 6151 % 1000, k * 3571 % 1000, k * 7919 % 1000, k * 104729 % 1000]
    side = lambda p, x, y: (p[2] - p[0]) * (y - p[1]) - (p[3] - p[1]) * (x - p[0])
    apart = lambda p, q: side(p, q[0], q[1]) * side(p, q[2], q[3]) < 0
    lines = [one(k) for k in range(1000)]
    crossed = sum(apart(p, q) and apart(q, p) for i, p in enumerate(lines) for q in lines[i + 1 :])
    # Each line is there three times.
    assert found.count() == 9 * crossed
    assert found.where("ida >= idb").count() == 0


def test_lines_of_many_cells_are_joined_by_shuffle(spark):
    lines = spark.range(20).select("id", G.line(F.array(G.xy(F.col("id"), F.lit(0)), G.xy(F.lit(9), F.col("id")))).alias("g"))
    pairs = joins.line_candidates(lines.select(F.col("id").alias("i"), F.col("g").alias("a")), lines.select(F.col("id").alias("j"), F.col("g").alias("b")))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
