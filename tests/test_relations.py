from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.operators import joins, relations
from loomspace.plans import sqlfront


def scene(spark, *wkts):
    rows = [(0, i, f"{w.split()[0]}_{i}", w) for i, w in enumerate(wkts, 1)]
    return spark.createDataFrame(rows, "scene_id long, ord int, name string, w string").select("scene_id", "ord", "name", G.from_wkt(F.col("w")).alias("geom"))


def found(df):
    return {(r.a, r.b, r.rel) for r in df.collect()}


BIG, SMALL, LINE, ON = "POLYGON ((0 0, 8 0, 8 8, 0 8, 0 0))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", "LINESTRING (-1 4, 9 4)", "POINT (3 4)"


def test_contact_and_one_way_containment(spark):
    s = scene(spark, BIG, SMALL, LINE, ON)
    compat, ogc = found(relations.find(s, "compat", rate=0)), found(relations.find(s, "ogc", rate=0))
    assert ("POLYGON_1", "POLYGON_2", "touches") in compat and ("POLYGON_2", "POLYGON_1", "within") not in compat
    assert ("POLYGON_2", "POLYGON_1", "within") in ogc and ("POLYGON_1", "POLYGON_2", "touches") not in ogc
    assert {("LINESTRING_3", "POLYGON_1", "cross"), ("POLYGON_1", "LINESTRING_3", "touches"), ("POINT_4", "POLYGON_1", "within")} <= compat
    assert not any({a, b} == {"LINESTRING_3", "POINT_4"} for a, b, _ in compat)
    assert ("POINT_4", "LINESTRING_3", "within") in ogc
    every = found(relations.find(s, "compat", chosen=lambda *_: F.lit(True)))
    assert ("LINESTRING_3", "POINT_4", "disjoint") in every  # a point in a line has no label there
    assert ("LINESTRING_3", "POINT_4", "disjoint") not in found(relations.find(s, "ogc", chosen=lambda *_: F.lit(True)))


def test_equal_geometries_have_no_relation(spark):
    assert found(relations.find(scene(spark, BIG, BIG), "compat", chosen=lambda *_: F.lit(True))) == set()


def test_grid_join_of_all_sizes_is_that_of_all_pairs(spark):
    boxes = spark.range(120).select("id", *(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(200)).cast("double").alias(c) for k, c in enumerate("xy")), F.pow(F.lit(2.0), F.col("id") % 7).alias("w"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    boxes = boxes.select("id", G.polygon(F.array(G.xy(x, y), G.xy(x + w, y), G.xy(x + w, y + w), G.xy(x, y + w))).alias("g"))
    a, b = boxes.select(F.col("id").alias("i"), F.col("g").alias("a")), boxes.select(F.col("id").alias("j"), F.col("g").alias("b"))
    got = joins.candidates(a, b).select("i", "j").collect()
    r = boxes.select("id", "g.minx", "g.miny", "g.maxx", "g.maxy").collect()
    want = {(p.id, q.id) for p in r for q in r if p.minx <= q.maxx and q.minx <= p.maxx and p.miny <= q.maxy and q.miny <= p.maxy}
    assert len(got) == len(want) and {(t.i, t.j) for t in got} == want


def test_chosen_pairs_are_formed_by_equality(spark, monkeypatch):
    monkeypatch.setattr(relations, "BLOCK", 7)  # several blocks a scene
    rows = [(n, i, f"POINT_{i}", f"POINT ({i} {(i * 7) % 11})") for n, size in ((1, 40), (2, 5), (3, 1)) for i in range(1, size + 1)]
    s = spark.createDataFrame(rows, "scene_id long, ord int, name string, w string").select("scene_id", "ord", "name", G.from_wkt(F.col("w")).alias("geom"))
    by = relations.Residues(lambda s, a: a.cast("long") * 7919, lambda s, b: b.cast("long") * 104729, 5, 100)
    keys = lambda df: sorted((r.scene_id, r.a_ord, r.b_ord) for r in df.where("rel = 'disjoint'").collect())
    want = sorted((n, a, b) for n, a, *_ in rows for m, b, *_ in rows if n == m and a < b and (a * 7919 + b * 104729) % 100 < 5)
    assert want and keys(relations.find(s, "compat", by, scene_bound=3)) == want
    assert keys(relations.find(s, "compat", lambda *x: by(*x))) == want
    half = relations.sampled(0.5)
    assert (half.below, half.grain) == (50, 100) and keys(relations.find(s, "ogc", rate=0.5)) == keys(relations.find(s, "ogc", lambda *x: half(*x)))
    assert len(keys(relations.find(s, "ogc", rate=1.0))) == 780 + 10


def test_scene_beyond_the_former_bound(spark):
    n = 20_100
    s = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("scene_id"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("POINT_"), "id").alias("name"), G.point(F.col("id").cast("double"), F.lit(0.0)).alias("geom"))
    got = relations.find(s, "compat", rate=0.0001, native=True).count()
    assert abs(got - n * (n - 1) / 2 * 0.0001) < 2_000


def test_sql_functions_and_explain(spark):
    df, plan = sqlfront.run(spark, "EXPLAIN (ANALYZE, BUFFERS) SELECT T1.name FROM g AS T1, g AS T2 WHERE T2.name = 'POLYGON_1' AND ST_Within(T1.geom, T2.geom) AND T1.name <> 'POLYGON_1';", {"g": scene(spark, BIG, SMALL, LINE, ON)})
    assert {r.name for r in df.collect()} == {"POLYGON_2", "POINT_4"} and "Physical Plan" in plan
    assert spark.sql("SELECT st_within(st_geomfromtext('POINT (1 1)'), st_geomfromtext('POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))', 0)) AS w").first().w


def test_empty_inputs(spark):
    none = scene(spark, BIG).where("ord > 9")
    assert relations.find(none, "compat").count() == 0
