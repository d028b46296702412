from loomspace.operators import questions as Q
from loomspace.operators.generate import SceneConfig, scenes
from loomspace.sources import tables

import pytest

# A sample list of relations, in its order.
SAMPLE = """POLYGON_1 POLYGON_3 touches|LINE_2 POLYGON_1 cross|POLYGON_1 LINE_2 touches|POINT_4 POLYGON_1 within|POLYGON_1 POINT_4 contains|POLYGON_1 POINT_5 disjoint|POLYGON_2 POINT_4 disjoint|POLYGON_3 POINT_7 disjoint
POLYGON_4 POINT_1 disjoint|POINT_8 POLYGON_4 within|POLYGON_4 POINT_8 contains|LINE_1 POLYGON_5 cross|POLYGON_5 LINE_1 touches|LINE_2 POLYGON_5 cross|POLYGON_5 LINE_2 touches"""


@pytest.fixture(scope="module")
def triples(spark):
    rows = [(0, i, *t.split()) for i, t in enumerate(SAMPLE.replace("\n", "|").split("|"), 1)]
    return spark.createDataFrame(rows, "scene_id long, id long, a string, b string, rel string").coalesce(1).cache()


@pytest.mark.parametrize("options, kept, chains, pairs", [({}, 6, 3, 0), ({"normalize": True}, 11, 9, 6), ({"normalize": True, "touches": True}, 15, 23, 18)])
def test_counts(triples, options, kept, chains, pairs):
    known = Q.known_triples(triples, **options)
    assert (known.count(), Q.chains(known).count(), Q.multi_conditions(known).count()) == (kept, chains, pairs)


def test_only_chains_are_feasible_as_is(triples):
    r = Q.feasible(Q.known_triples(triples)).first()
    assert r.has_chain and not r.has_multi


def test_texts(triples):
    rows = {r.question: r for r in Q.chain_questions(Q.chains(Q.known_triples(triples)), "generated_geometries").collect()}
    r = rows["Which POINTs in the database within the POLYGON that is disjoint POINT_5?"]
    assert r.sql.splitlines()[0] == "WITH IntermediateSet AS (" and "AND ST_Disjoint(T1.geom, T2.geom)" in r.sql and r.sql.endswith("AND ST_Within(T_Final.geom, IntermediateSet.geom);")
    assert r.reasoning[0] == "Step 1 (Intermediate Set): Find all `POLYGON` geometries that `disjoint` (`ST_Disjoint(.., ..)`) 'POINT_5'."


def test_one_question_is_the_same_again_and_errors_are_told(triples, spark):
    one = lambda: Q.one_question(triples, 5).collect()
    assert one() == one() and one()[0].error is None
    assert Q.one_question(triples.where("id = 1"), 5).first().error == Q.NO_PATTERN


def test_report_is_drawn_from_all_triples(spark):
    from loomspace.plans import registry

    d = "/root/testdata/sf0.001"
    known, allowed = {}, {"within": "within", "contains": "contain", "overlaps": "overlap", "disjoint": "disjoint", "cross": "crosses"}
    for r in registry.relation_finder_compat(spark, d).collect():
        if r.rel in allowed:
            known.setdefault(r.scene_id, []).append((r.a, allowed[r.rel], r.b))
    chain = lambda t: {f"Which {a.split('_')[0]}s in the database {p} the {b.split('_')[0]} that is {q} {c}?" for a, p, b in t for x, q, c in t if b == x}
    multi = lambda t: {f"Find all {a.split('_')[0]}s that both {p} '{b}' AND {q} '{c}'." for i, (a, p, b) in enumerate(t) for j, (x, q, c) in enumerate(t) if i != j and a == x}
    want = {s: every for s, t in known.items() if (every := chain(t) | multi(t))}
    got = {r.scene_id: r.question for r in registry.question_report(spark, d).collect()}
    assert set(got) == set(want) and all(q in want[s] for s, q in got.items()) and any("disjoint" in q for q in got.values())


def test_placeholders(spark):
    rows = Q.placeholder_questions(spark, "parcels", "shape_geom")
    assert rows.count() == 588
    with pytest.raises(ValueError):
        Q.placeholder_questions(spark, "x; drop", "g")


def test_files_and_scenes(spark, triples, tmp_path):
    tables.write_relationships(triples, str(tmp_path / "r"))
    assert sorted(map(tuple, tables.read_relationships(spark, str(tmp_path / "r")).collect())) == sorted(map(tuple, triples.collect()))
    cfg = SceneConfig(polygons=6, contained=1, overlapping=1, touching=1, lines=2, points=3)
    g = scenes(spark, 3, cfg, 2).cache()
    again = scenes(spark, 3, cfg, 2)
    key = lambda df: sorted((r.scene_id, r.name, str(r.geom)) for r in df.collect())
    assert key(g) == key(again)
    assert g.select("scene_id", "name").distinct().count() == g.count() and g.where("geom_type = 'Polygon'").count() <= 18
    assert all(3 <= r.vertices <= 6 for r in g.where("geom_type = 'Polygon'").collect())
    tables.save_table(g, str(tmp_path / "g"))
    assert tables.load_table(spark, str(tmp_path / "g")).count() == g.count()
    tables.write_sql(g, str(tmp_path / "s"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "s")).collect())
    assert text.count("INSERT INTO") == g.count() and "CREATE TABLE" in text
    assert tables.svg(g).first().svg.startswith("<svg")
    with pytest.raises(ValueError):
        SceneConfig(polygons=3, contained=2).check()


def test_files_of_several_scenes_and_the_spread_form(spark, tmp_path):
    rows = [(s, i, f"A_{i}", f"B_{s}", "within") for s in range(5) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "scene_id long, id long, a string, b string, rel string").coalesce(1)
    tables.write_relationships(df.repartition(1), str(tmp_path / "r"))
    assert sorted(map(tuple, tables.read_relationships(spark, str(tmp_path / "r")).collect())) == rows
    (tmp_path / "one.json").write_text('{\n  "relationships": [\n    [\n      "A_1",\n      "B_1",\n      "touches"\n    ],\n    ["A_2", "B_1", "cross"]\n  ]\n}\n')
    assert sorted(map(tuple, tables.read_relationships(spark, str(tmp_path / "one.json")).collect())) == [(0, 1, "A_1", "B_1", "touches"), (0, 2, "A_2", "B_1", "cross")]
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.json").write_text((tmp_path / "one.json").read_text())
    (tmp_path / "mixed" / "b.json").write_text('{"scene_id": 7, "relationships": [["X_1", "Y_1", "within"]]}\n\n{"scene_id": 8, "relationships": []}\n')
    assert tables.read_relationships(spark, str(tmp_path / "mixed")).count() == 3


def test_analyze_runs_the_plan(spark):
    from loomspace.plans import sqlfront

    spark.range(10).createOrReplaceTempView("ten")
    df, report = sqlfront.run(spark, "EXPLAIN (ANALYZE, BUFFERS) SELECT id % 3 AS k, count(*) AS n FROM ten GROUP BY 1;")
    assert df.count() == 3 and report.startswith("rows: 3\nseconds: ") and "isFinalPlan=true" in report
    assert "Physical Plan" in sqlfront.run(spark, "EXPLAIN SELECT 1 AS one")[1] and sqlfront.run(spark, "SELECT 1 AS one")[1] is None


def test_dataset(spark):
    data = tables.SpatialDataset(spark, "mix", 2, SceneConfig(polygons=3, contained=1, lines=2, points=3), seed=4)
    found = data.relationships(rate=0.5).cache()
    assert found.columns == ["scene_id", "id", "a", "b", "rel"] and found.count() > 0
    assert data.questions(normalize=True).columns[:2] == data.questions().columns[:2]
    assert {r.geom_type for r in tables.SpatialDataset(spark, "polygon", 1, SceneConfig(polygons=2, contained=0)).geometries.collect()} == {"Polygon"}
    with pytest.raises(ValueError):
        tables.SpatialDataset(spark, "other")
