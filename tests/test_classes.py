"""Rows of equal geometry: judged once, placed once, and never sent whole to all tasks."""

from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.operators import joins, placement
from loomspace.plans import sqlfront

COPIES = 30


def _copies(spark, name):
    """Thirty copies of each of four squares in a row, the first three of which meet, in two scenes; and a row without a geometry."""
    k = F.col("id")
    x = F.when(k % 4 == 3, 90.0).otherwise(((k % 4) * 3).cast("double"))
    square = G.polygon(F.array(G.xy(x, F.lit(0.0)), G.xy(x + 4, F.lit(0.0)), G.xy(x + 4, F.lit(4.0)), G.xy(x, F.lit(4.0))))
    return spark.range(4 * COPIES + 1).select(k.alias(f"{name}_id"), F.floor(k / 4 % 2).alias(f"{name}_scene"), F.when(k < 4 * COPIES, square).alias(name))


def test_copies_are_judged_once(spark):
    a, b = _copies(spark, "a"), _copies(spark, "b")
    seen = []
    told = lambda pairs: seen.append(pairs.count()) or pairs.withColumn("same", F.col("a") == F.col("b"))
    got = [tuple(r) for r in joins.judged(a, b, told, ["same"]).select("a_id", "b_id", "same").collect()]
    meet = lambda i, j: i % 4 == j % 4 or (i % 4, j % 4) in {(0, 1), (1, 0), (1, 2), (2, 1)}
    want = {(i, j, i % 4 == j % 4) for i in range(4 * COPIES) for j in range(4 * COPIES) if meet(i, j)}
    assert seen == [8] and len(got) == len(want) and set(got) == want
    got = {tuple(r) for r in joins.spatial_join(a, b, "overlaps", [("a_scene", "b_scene")]).select("a_id", "b_id").collect()}
    assert got == {(i, j) for i, j, same in want if not same and i // 4 % 2 == j // 4 % 2}
    counts = {r.a_id: r.n_disjoint for r in joins.disjoint_counts(a, b, "a_id").collect()}
    assert counts == {i: sum(not meet(i, j) for j in range(4 * COPIES)) for i in range(4 * COPIES)} | {4 * COPIES: None}
    none = {r.a_id for r in joins.semi_join(a, b.where("b_id % 4 = 0"), "a_id", anti=True).collect()}
    assert none == {i for i in range(4 * COPIES) if i % 4 > 1} | {4 * COPIES}


def test_no_side_of_a_join_is_sent_whole(spark):
    a, b = _copies(spark, "a"), _copies(spark, "b")
    for df in (joins.candidates(a, b), joins.spatial_join(a, b, "overlaps"), joins.semi_join(a, b, "a_id", anti=True)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_copies_are_placed_once(spark, monkeypatch):
    a = _copies(spark, "a").select(F.col("a_scene").alias("scene_id"), F.col("a_id").alias("id"), F.col("a").alias("geom"))
    met, join = [], placement.spatial_join
    monkeypatch.setattr(placement, "spatial_join", lambda *x, **y: met.append(join(*x, **y)) or met[-1])
    assert {r.id for r in placement.place(a, ["id"]).collect()} == {0, 2, 3, 4, 6, 7}
    assert met[0].count() == 2 * 8


def test_sql_joins_judge_copies_once(spark):
    views = {"p": _copies(spark, "a"), "q": _copies(spark, "b")}
    sql = "SELECT a_id, b_id FROM p, q WHERE a_id + b_id > 9 AND ST_Overlaps(a, b)"
    df, _ = sqlfront.run(spark, sql, views)
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    judged, row_joins = (next(i for i, line in enumerate(lines) if w in line) for w in ("ArrowEvalPython", "_b_class"))
    # The kernel runs below the join that brings rows to classes.
    assert judged > row_joins and sorted(map(tuple, df.collect())) == sorted(map(tuple, spark.sql(sql).collect()))
