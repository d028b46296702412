"""Pairs of edges: every chain and every pair of one subject, without numbers or a written list."""

from pyspark.sql import functions as F

from loomspace.operators import questions as Q
from loomspace.operators import relations
from loomspace.sources import tables


def _found(spark):
    rows = [(s, a, b, step, f"N_{a}", f"N_{b}", rel) for s in range(2) for a in range(1, 7) for b in range(a + 1, 7) for step, rel in ((0, "within"), (5, "disjoint")) if (a * b + step + s) % 3]
    rows += [(s, a, b, 1, f"N_{b}", f"N_{a}", "contains") for s, a, b, step, *_ in rows if step == 0]
    return spark.createDataFrame(rows, "scene_id long, a_ord int, b_ord int, step int, a string, b string, rel string")


def test_keys_tell_triples_apart_in_their_order(spark):
    found = _found(spark)
    keyed, numbers = tables.keyed(found), tables.numbered(found)
    order = lambda df: [tuple(r)[:1] + tuple(r)[2:] for r in df.orderBy("scene_id", "id").collect()]
    assert order(keyed) == order(numbers) and keyed.select("scene_id", "id").distinct().count() == found.count()
    bag = lambda df: sorted((r.scene_id, r.a, r.rel1, r.b, r.rel2, r.c) for r in df.collect())
    for pairs in (Q.chains, Q.multi_conditions):
        assert bag(pairs(keyed)) == bag(pairs(numbers)) != []


def test_texts_of_chains_are_those_of_their_questions(spark):
    known = Q.known_triples(tables.keyed(_found(spark)), normalize=True)
    bag = lambda df: sorted((r.scene_id, r.question) for r in df.collect())
    assert bag(Q.chain_texts(known)) == bag(Q.chain_questions(Q.chains(known))) != []


def test_chosen_pairs_are_dealt_to_many_tasks(spark):
    rows = spark.range(1, 2001).select((F.col("id") % 2).alias("scene_id"), F.col("id").cast("int").alias("a_ord"))
    chosen = relations.Residues(lambda s, a: a.cast("long") * 7919, lambda s, b: b.cast("long") * 104729, 5, 100)
    pairs = chosen.pairs(rows, rows.select(F.col("scene_id").alias("b_scene"), F.col("a_ord").alias("b_ord")))
    # Few bytes go in, so partitions would be merged to as many as there are cores, or fewer.
    assert pairs.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert pairs.count() == sum((a * 7919 + b * 104729) % 100 < 5 for a in range(1, 2001) for b in range(a + 2, 2001, 2))
