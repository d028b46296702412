"""Placement of candidates that mustn't meet, in rounds over all scenes at once.

The rule is the sequential one: candidates are taken by rank, and each stays that meets none
of those that stay already.  A candidate whose better-ranked neighbours are all decided can be
decided with them, so each round accepts every open candidate without an open better
neighbour and turns away their neighbours.  Neighbours come from one grid join; a round is
joins of keys.  With ranks in random order the rounds grow with the logarithm of the
candidates, and no task holds a scene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import spatial_join
from .lineage import checkpointed


def place(candidates: DataFrame, rank: list[str], predicate: str = "intersects", use: list[int] | None = None) -> DataFrame:
    """The candidates (scene_id, id, geom and more) that stay. rank: columns that order them; id, unique within a scene, decides ties.

    Candidates without a geometry never stay.  An empty table gives an empty result.
    """
    ranked = candidates.where("geom IS NOT NULL").select("scene_id", "id", "geom", F.struct(*rank, F.col("id").alias("_id")).alias("_r"))
    if predicate == "intersects":
        # Equal geometries meet each other and the same others: none stays but the first of them.
        ranked = ranked.groupBy("scene_id", "geom").agg(F.min("_r").alias("_r")).select("scene_id", F.col("_r")["_id"].alias("id"), "geom", "_r")
    one = lambda s, i, g, r: ranked.select(F.col("scene_id").alias(s), F.col("id").alias(i), F.col("geom").alias(g), F.col("_r").alias(r))
    met = spatial_join(one("scene_id", "better", "a", "_r"), one("_scene", "worse", "b", "_q"), predicate, [("scene_id", "_scene")], use=use)
    edges = checkpointed(met.where("_r < _q").select("scene_id", "better", "worse"))
    undecided = checkpointed(ranked.select("scene_id", "id"))
    stay = None
    key = lambda df, name: df.select("scene_id", F.col("id").alias(name))
    while not undecided.isEmpty():
        # Nobody better is open.
        new = undecided.join(edges.select("scene_id", F.col("worse").alias("id")).distinct(), ["scene_id", "id"], "left_anti")
        new = checkpointed(new)
        stay = new if stay is None else stay.unionByName(new)
        gone = checkpointed(edges.join(key(new, "better"), ["scene_id", "better"], "left_semi").select("scene_id", F.col("worse").alias("id")).distinct())
        undecided = checkpointed(undecided.join(new, ["scene_id", "id"], "left_anti").join(gone, ["scene_id", "id"], "left_anti"))
        open_ = edges.join(key(gone, "better"), ["scene_id", "better"], "left_anti").join(key(gone, "worse"), ["scene_id", "worse"], "left_anti")
        edges = checkpointed(open_.join(key(new, "better"), ["scene_id", "better"], "left_anti"))
    if stay is None:
        return candidates.where("false")
    return candidates.join(stay, ["scene_id", "id"], "left_semi")
