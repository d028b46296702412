"""The table that changes, documents in pieces, and figures of plans."""

import json

import pytest
from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.plans import sqlfront
from loomspace.sources import documents, geotable, tables


def _rows(spark, n, kind="POINT"):
    k = F.col("id")
    return spark.range(n).select((k % 3).alias("scene_id"), F.concat_ws("_", F.lit(kind), k).alias("name"), F.lit("Point").alias("geom_type"), F.lit("point").alias("style"), F.lit(1).alias("vertices"), G.point(k, k + 1).alias("geom"))


def test_table_is_filled_and_emptied(spark, tmp_path):
    t = geotable.GeometryTable(spark, str(tmp_path / "g")).create()
    names = lambda: sorted((r.scene_id, r.name) for r in t.create().rows().select("scene_id", "name").collect())
    assert names() == []
    every = [(i % 3, f"POINT_{i}") for i in range(9)]
    for _ in range(2):  # the same again changes nothing
        t.insert(_rows(spark, 9).unionByName(_rows(spark, 9)))
        assert names() == sorted(every)
    t.sql("DELETE FROM generated_geometries WHERE name IN ('POINT_1', 'POINT_4', 'POINT_7', 'POINT_2')")
    assert names() == sorted(x for x in every if x[1][-1] not in "1472") and not (tmp_path / "g" / "scene_id=1").exists() and not (tmp_path / "g.staged").exists()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "scene_id=0").glob("*.parquet")}
    t.sql("INSERT INTO generated_geometries (name, geom_type, style, vertices, geom) VALUES ('POINT_3', 'Point', 'x', 1, ST_GeomFromText('POINT (9 9)')), ('POINT_0', NULL, 'x', 1, NULL);")
    assert names() == sorted(x for x in every if x[1][-1] not in "1472") and before == {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "scene_id=0").glob("*.parquet")}
    t.sql("INSERT INTO generated_geometries (scene_id, name, geom) VALUES (7, 'it''s', ST_GeomFromText('POINT (9 8)'))")
    got = t.rows().where("scene_id = 7").first()
    assert (got.name, got.geom.minx, got.geom.maxy, got.style) == ("it's", 9.0, 8.0, None)
    t.delete("ST_Within(geom, ST_GeomFromText('POLYGON ((8 7, 10 7, 10 9, 8 9, 8 7))'))")
    assert (7, "it's") not in names() and len(names()) == 5
    t.delete("style = 'no such'")
    t.delete("NULL")
    assert len(names()) == 5
    t.sql("DELETE FROM generated_geometries;")
    assert names() == []
    for bad in ("DROP TABLE generated_geometries", "DELETE FROM other", "INSERT INTO generated_geometries (name) VALUES ('a', 'b')"):
        with pytest.raises(ValueError):
            t.sql(bad)


def test_inserts_as_written_fill_the_table(spark, tmp_path):
    rows = _rows(spark, 3).withColumn("ord", F.col("vertices"))
    t = geotable.GeometryTable(spark, str(tmp_path / "g")).create()
    for r in tables.insert_sql(rows).collect():
        t.sql(r.sql)
    assert sorted((r.name, r.geom.minx) for r in t.rows().collect()) == [(f"POINT_{i}", float(i)) for i in range(3)]


def test_documents_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "ROWS_A_PIECE", 40)
    triples = spark.range(300).select((F.col("id") % 2).alias("scene_id"), (F.floor(F.col("id") / 2) + 1).alias("id"), F.format_string('A "%d", é', F.col("id")).alias("a"), F.format_string("B\\%d", F.col("id") % 7).alias("b"), F.lit("touches").alias("rel"))
    documents.write_document(triples, str(tmp_path / "d"))
    want = sorted(map(tuple, triples.collect()))
    for scene in (0, 1):
        pieces = sorted((tmp_path / "d" / f"scene_id={scene}").glob("part-*"))
        whole = json.loads("".join(p.read_text() for p in pieces))
        assert len(pieces) > 2 and [tuple(x) for x in whole["relationships"]] == [x[2:] for x in want if x[0] == scene]
    assert sorted(map(tuple, documents.read_document(spark, str(tmp_path / "d")).collect())) == want
    # One file over many lines, cut to splits inside.
    (tmp_path / "one.json").write_text(json.dumps({"relationships": [list(x[2:]) for x in want if x[0] == 0]}, indent=4))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = documents.read_document(spark, str(tmp_path / "one.json"))
        assert got.rdd.getNumPartitions() and sorted(map(tuple, got.collect())) == [x for x in want if x[0] == 0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "none.json").write_text('{"relationships": []}')
    assert documents.read_document(spark, str(tmp_path / "none.json")).count() == 0


def test_figures_of_a_plan(spark):
    view = {"numbers": spark.range(0, 1000, 1, 3), "few": spark.range(10)}
    nodes = sqlfront.analyze(spark, "EXPLAIN ANALYZE SELECT /*+ MERGE(f) */ n.id FROM numbers n JOIN few f ON n.id = f.id WHERE n.id % 2 = 0", view).collect()
    of = lambda name: [r.rows for r in nodes if r.operator.startswith(name)]
    assert of("SortMergeJoin") == [5] and sorted(of("Range")) == [10, 1000]
    assert any(r.bytes_shuffled for r in nodes if r.operator == "Exchange")
    assert [r.node for r in nodes] == list(range(len(nodes)))
    _, report = sqlfront.run(spark, "EXPLAIN (ANALYZE, BUFFERS) SELECT count(*) FROM numbers", view)
    assert report.startswith("rows: 1\n") and "Range rows=1000" in report
    assert sqlfront.run(spark, "EXPLAIN SELECT 1")[1].startswith("== Physical Plan ==")


def test_sql_reads_the_same_texts_as_the_function(spark):
    from loomspace.operators.predicates import register

    register(spark)
    texts = ["POINT (1 2)", "point(-1.5 2e3)", "LINESTRING (0 0, 4 4, 5 1)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "POINT EMPTY", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "w string")
    for r in rows.select("w", G.from_wkt(F.col("w")).alias("a"), F.expr("ST_GeomFromText(w)").alias("b")).collect():
        assert r.b == r.a, r.w
