"""Draws from the finder's relations without their list (F1, F2, F3, F5), against the same draws from the list."""

import pytest
from pyspark.sql import functions as F

from loomspace.functions import geometry as G
from loomspace.operators import edges, questions, relations
from loomspace.sources import tables


@pytest.fixture(scope="module")
def scenes(spark):
    """Two scenes of squares, points and rows without geometry; one of a crowd of equal squares with others behind."""
    k = F.col("id")
    box = lambda x, y, w: G.polygon(F.array(G.xy(x, y), G.xy(x + w, y), G.xy(x + w, y + w), G.xy(x, y + w)))
    x, y, w = ((k * 7) % 13).cast("double"), ((k * 11) % 17).cast("double"), (2 + k % 3).cast("double")
    geom = F.when(k % 9 == 8, None).when(k % 4 == 0, G.point(x, y)).otherwise(box(x, y, w))
    name = F.concat(F.when(k % 4 == 0, "POINT_").otherwise("POLYGON_"), k.cast("string"))
    mixed = spark.range(90).select((k % 2).alias("scene_id"), k.cast("int").alias("ord"), name.alias("name"), geom.alias("geom"))
    far = F.when(k < 12, 0).otherwise(k * 10).cast("double")
    crowd = spark.range(18).select(F.lit(2).cast("long").alias("scene_id"), k.cast("int").alias("ord"), F.concat(F.lit("POLYGON_"), k.cast("string")).alias("name"), box(far, far, F.lit(4.0)).alias("geom"))
    return mixed.unionByName(crowd).localCheckpoint()


BY = relations.Residues(lambda s, a: a.cast("long") * 7919, lambda s, b: b.cast("long") * 104729, 30, 100)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("semantics", ["compat", "ogc"])
def test_draws_equal_those_of_the_list(spark, scenes, semantics, monkeypatch):
    triples = tables.numbered(relations.find(scenes, semantics, BY))
    known = questions.known_triples(triples, normalize=True).localCheckpoint()
    number = lambda scene, j, chains: (j * 7919 + scene * 31) % chains
    want = rows(questions.feasible(known)), rows(questions.sample_chains(known, 60, number).drop("id1", "id2")), rows(questions.one_question(triples, 3, normalize=True))
    every = {tuple(r) for r in known.collect()}
    monkeypatch.setattr(relations, "find", None)
    monkeypatch.setattr(relations.Residues, "pairs", None)
    graph = questions.edges(scenes, BY, semantics)
    assert (rows(questions.feasible_of(graph)), rows(questions.sample_chains_of(graph, 60, number)), rows(questions.one_question_of(graph, 3))) == want
    # All edges, both ways, have the ids of the list, and the least ones are theirs.
    own = graph.ids(graph.of(graph.rows)).localCheckpoint()
    for onward in (True, False):
        name, other = ("name", "other") if onward else ("other", "name")
        got = [(r.scene_id, r.id, r[name], r[other], questions.NORMAL.get(r.rel, r.rel)) for r in own.where("onward" if onward else "NOT onward").collect()]
        assert len(got) == len(set(got)) and set(got) == every
        degree = "n_out" if onward else "n_in"
        least = {(r.scene_id, r.name): r.id for r in graph.ids(graph.least(onward, graph.degrees().where(f"{degree} > 0"))).collect()}
        assert least == {(r.scene_id, r.x): r.n for r in known.groupBy("scene_id", F.col("a" if onward else "b").alias("x")).agg(F.min("id").alias("n")).collect()}


def test_a_crowd_beyond_the_rounds_is_listed(spark, scenes, monkeypatch):
    monkeypatch.setattr(edges, "ROUNDS", 1)
    graph = questions.edges(scenes, BY)
    got = {(r.scene_id, r.ord): r.at for r in graph.least(True, graph.degrees().where("apart_out > 0 AND n_out = apart_out")).collect()}
    want = graph.of(graph.rows).where("onward AND rel = 'disjoint'").groupBy("scene_id", "ord").agg(F.min("at").alias("at")).collect()
    assert got and got.items() <= {((r.scene_id, r.ord), r.at) for r in want}


def test_queries_list_no_relations(spark, monkeypatch):
    from loomspace.plans import registry

    monkeypatch.setattr(relations, "find", None)
    d = "/root/testdata/sf0.001"
    assert registry.feasible_templates(spark, d).count()
