"""Draws of questions: subject by subject, chains by number, and SQL joins by the grid."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.operators import joins, questions
from loomspace.plans import sqlfront

EDGES = [("P_1", "P_2", "within"), ("P_2", "P_3", "overlap"), ("P_2", "P_4", "overlap"), ("P_2", "P_4", "disjoint"), ("P_5", "P_2", "within"), ("P_3", "P_1", "overlap"), ("P_4", "P_6", "disjoint"), ("P_4", "P_6", "within")]


def test_draws_are_uniform_subject_by_subject(spark):
    scenes = 4000
    rows = spark.createDataFrame([(i + 1, *e) for i, e in enumerate(EDGES)], "id long, a string, b string, rel string").crossJoin(spark.range(scenes).select(F.col("id").alias("scene_id")))
    chains = questions.draw_chain(rows, questions._hashed(3)).collect()
    into, out = defaultdict(list), defaultdict(list)
    for a, b, _ in EDGES:
        into[b].append(a)
        out[a].append(b)
    middles = set(into) & set(out)
    assert len(chains) == scenes and {r.b for r in chains} == middles
    want = Counter()
    for i, (a, b, _) in enumerate(EDGES, 1):
        for j, (x, _, _) in enumerate(EDGES, 1):
            if x == b:
                want[i, j] += 1 / len(middles) / len(into[b]) / len(out[b])
    got = Counter((r.id1, r.id2) for r in chains)
    assert got.keys() == want.keys() and all(abs(got[k] / scenes - p) < 0.03 for k, p in want.items())
    pairs = questions.draw_pair(rows, questions._hashed(4)).collect()
    got, many = Counter((r.id1, r.id2) for r in pairs), [a for a in out if len(out[a]) > 1]
    want = {(i, j): 1 / len(many) / len(out[a]) / (len(out[a]) - 1) for i, (a, _, _) in enumerate(EDGES, 1) for j, (x, _, _) in enumerate(EDGES, 1) if i != j and x == a and a in many}
    assert got.keys() == want.keys() and all(abs(got[k] / scenes - p) < 0.03 for k, p in want.items())


def test_numbers_lead_to_all_chains(spark):
    rows = spark.createDataFrame([(s, (i + 1) * 70_000, *e) for s in (1, 2) for i, e in enumerate(EDGES[: 9 - s])], "scene_id long, id long, a string, b string, rel string")
    every = questions.chains(rows).groupBy("scene_id").count().collect()
    n = max(r["count"] for r in every)
    got = questions.sample_chains(rows, n, lambda scene, j, chains: j % chains).select("scene_id", "id1", "id2").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, questions.chains(rows).select("scene_id", "id1", "id2").collect()))
    assert questions.sample_chains(rows.limit(0), 3, lambda scene, j, chains: j % chains).count() == 0


def _squares(spark, n, name):
    at = spark.range(n).select("id", ((F.col("id") * 7919) % 97).cast("double").alias("x"), ((F.col("id") * 104729) % 89).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    return at.select(F.concat(F.lit(name), F.col("id").cast("string")).alias("name"), G.polygon(F.array(G.xy(x, y), G.xy(x + 5, y), G.xy(x + 5, y + 5), G.xy(x, y + 5))).alias("geom"))


def test_sql_joins_run_by_the_grid(spark):
    views = {"left_ones": _squares(spark, 300, "A_"), "right_ones": _squares(spark, 200, "B_")}
    for predicate in ("ST_Intersects", "ST_Overlaps", "ST_Equals", "ST_Contains", "ST_Touches"):
        sql = f"SELECT count(*) AS n, count(DISTINCT p.name) AS names FROM left_ones p, right_ones q WHERE q.name <> 'B_1' AND {predicate}(p.geom, q.geom)"
        df, _ = sqlfront.run(spark, sql, views)
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.first() == spark.sql(sql).first()
    sql = "WITH w AS (SELECT p.name AS a, p.geom, q.geom AS other FROM left_ones p, right_ones q WHERE ST_Overlaps(p.geom, q.geom)) SELECT w.a, r.name FROM w, right_ones r WHERE ST_Touches(r.geom, w.other) AND r.name = 'B_7'"
    df, _ = sqlfront.run(spark, sql, views)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, spark.sql(sql).collect()))


def test_disjoint_pairs_are_counted_not_formed(spark):
    left, right = _squares(spark, 60, "A_").select("name", F.col("geom").alias("a")), _squares(spark, 50, "B_").select(F.col("geom").alias("b"))
    left = left.unionByName(spark.sql("SELECT 'none' AS name").select("name", F.lit(None).cast(left.schema["a"].dataType).alias("a")))
    got = {r.name: r.n_disjoint for r in joins.disjoint_counts(left, right, "name").collect()}
    rows, others = left.where("a IS NOT NULL").collect(), right.collect()
    far = lambda p, q: p.minx > q.maxx or q.minx > p.maxx or p.miny > q.maxy or q.miny > p.maxy
    assert got == {r.name: sum(far(r.a, o.b) for o in others) for r in rows} | {"none": None}


def test_lines_meet_by_the_cells_along_them(spark):
    k = F.col("id")
    pts = F.array(G.xy((k * 7919) % 1000, (k * 104729) % 1000), G.xy((k * 6151) % 1000, (k * 3571) % 1000), G.xy(F.when(k % 5 == 0, (k * 6151) % 1000).otherwise((k * 31) % 1000), (k * 77) % 1000))
    lines = spark.range(80).select("id", G.line(pts).alias("g")).unionByName(spark.range(80, 83).select("id", G.line(F.array(G.xy(k, k), G.xy(k, k))).alias("g")))
    side = lambda i, g: lines.select(F.col("id").alias(i), F.col("g").alias(g))
    found = joins.line_candidates(side("i", "a"), side("j", "b"))
    got = [(r.i, r.j) for r in found.select("i", "j").collect()]
    want = {(r.i, r.j) for r in joins.spatial_join(side("i", "a"), side("j", "b"), "intersects").select("i", "j").collect()}
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(got) < joins.candidates(side("i", "a"), side("j", "b")).count()
    coarse = [(r.i, r.j) for r in joins.line_candidates(side("i", "a"), side("j", "b"), use=[4, 5, 7]).select("i", "j").collect()]
    assert len(coarse) == len(set(coarse)) and want <= set(coarse)
