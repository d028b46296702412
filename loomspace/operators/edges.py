"""The relations that the finder lists, as edges between places, without the list.

`relations.find` lists a share of all pairs of a scene.  What draws from that list needs the
edges in and out of each geometry, the least of them, the ids of a few, and those of the few
geometries that are drawn.  All of these are counts of places beyond another:

- labelled edges: the rows near a class of equal geometry, as the judged pairs of classes tell,
  are put in the order of their places, and running sums over them answer all of its rows;
- disjoint ones: running counts over the places of a residue, less those over the places of
  that residue near the class.

So the work grows with the rows times the classes near to one, not with pairs of rows.  The
edges of one geometry are in the order of the other's place, and within a pair in that of steps.
Names tell the geometries of a scene apart.  Rows without a geometry have no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import candidates, classes
from .lineage import checkpointed
from .order import block_of, numbered
from .relations import Residues, told

KNOWN = ("within", "contains", "overlaps", "cross")
ROUNDS = 3  # of the next chosen place, before all those left of a row are listed


def _sides() -> list[Column]:
    """A place as the first of a pair, and as the second."""
    return [F.struct(F.lit(onward).alias("onward"), F.col(own).alias("residue")) for onward, own in ((False, "l"), (True, "r"))]


def _beyond(gives: DataFrame, asks: DataFrame, keys: list[str], before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """asks (keys, at, ask) with aggregates over the gives of the same keys at lesser places (before) and at greater ones (after)."""
    every = asks.unionByName(gives, allowMissingColumns=True)
    for told_, place in ((before, F.col("at")), (after, -F.col("at"))):
        if told_:
            over = W.partitionBy(*keys).orderBy(place).rangeBetween(W.unboundedPreceding, -1)
            every = every.select("*", *(value.over(over).alias(name) for name, value in told_.items()))
    return every.where("ask IS NOT NULL").select("ask", *before, *after)


class Edges:
    def __init__(self, geometries: DataFrame, chosen: Residues, semantics: str = "compat", known: tuple[str, ...] = KNOWN, native: bool = False, use: list[int] | None = None) -> None:
        """known: the labels, besides `disjoint`, that make an edge; the others count in the ids alone."""
        self.chosen = chosen
        rows, each = classes(geometries.where("geom IS NOT NULL").select("scene_id", "ord", "name", "geom"), F.col("geom"), "cls", ["scene_id"])
        scene, place = F.col("scene_id"), F.col("ord")
        residue = lambda side: side(scene, place).cast("int")
        self.rows = checkpointed(rows.select("scene_id", place.cast("long").alias("ord"), "name", "cls", residue(chosen.left).alias("l"), residue(chosen.right).alias("r")))
        x = each.select("scene_id", F.col("geom").alias("a"), F.col("cls").alias("a_cls"))
        y = each.select(scene.alias("b_scene"), F.col("geom").alias("b"), F.col("cls").alias("b_cls"))
        pairs = candidates(x, y, [("scene_id", "b_scene")], use).withColumn("a_name", F.lit("a")).withColumn("b_name", F.lit("b"))
        pairs = told(pairs, semantics, native).where("taken").select("scene_id", "a_cls", "b_cls", F.col("told.t").alias("t"))
        edges = F.filter(F.transform("t", lambda e, i: F.struct(i.alias("pos"), e["rel"].alias("rel"), (e["b"] == "b").alias("onward"))), lambda e: e["rel"].isin(*known))
        # Pairs of classes of which a label is told, or that can't be disjoint: a's row is the one of the lesser place.
        self.pairs = checkpointed(pairs.select("scene_id", "a_cls", "b_cls", F.size("t").cast("long").alias("labels"), edges.alias("t")))
        self._degrees: DataFrame | None = None

    def _near(self) -> DataFrame:
        """cls, and for each row near to the class its place and residues, and what a row of the class has with it where it is before or after."""
        some = lambda onward: F.filter("t", lambda e: e["onward"] == onward)
        n = lambda onward: F.size(some(onward)).cast("long")
        pos = lambda onward: F.array_min(F.transform(some(onward), lambda e: e["pos"]))
        # A row that is before the own one is the pair's first.
        before = self.pairs.select(F.col("b_cls").alias("cls"), F.col("a_cls").alias("other"), n(True).alias("in_b"), pos(True).alias("in_b_pos"), n(False).alias("out_b"), pos(False).alias("out_b_pos"), F.lit(True).alias("taken_b"))
        after = self.pairs.select(F.col("a_cls").alias("cls"), F.col("b_cls").alias("other"), n(False).alias("in_a"), pos(False).alias("in_a_pos"), n(True).alias("out_a"), pos(True).alias("out_a_pos"), F.col("labels").alias("all_a"), F.lit(True).alias("taken_a"))
        both = before.unionByName(after, allowMissingColumns=True)
        both = both.groupBy("cls", "other").agg(*(F.max(c).alias(c) for c in both.columns if c not in ("cls", "other")))
        of = self.rows.select("scene_id", F.col("cls").alias("other"), F.col("ord").alias("at"), "l", "r")
        return both.join(of.hint("merge"), "other").drop("other")

    def _wanted(self, own: Column) -> Column:
        """The residues of the other side with which a place is chosen."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.chosen.below - 1)), lambda t: F.pmod(t - own, F.lit(self.chosen.grain)))

    def _apart(self, asks: DataFrame) -> DataFrame:
        """ask, n: how many places a row is chosen with and not near to. asks: scene_id, cls, onward, own (its residue), at, ask; those before `at`, onward those after."""
        if not self.chosen.below:
            return asks.select("ask", F.lit(0).cast("long").alias("n"))
        kept = lambda b, a: F.explode(F.filter(F.array(F.when(b, _sides()[0]), F.when(a, _sides()[1])), lambda s: s.isNotNull())).alias("s")
        near = self._near().select("scene_id", "cls", "at", kept(F.col("taken_b"), F.col("taken_a"))).select("scene_id", "cls", "s.onward", "s.residue", "at")
        every = self.rows.select("scene_id", F.lit(-1).cast("long").alias("cls"), F.col("ord").alias("at"), kept(F.lit(True), F.lit(True))).select("scene_id", "cls", "s.onward", "s.residue", "at")
        way = lambda df: df.withColumn("at", F.when(F.col("onward"), -F.col("at")).otherwise(F.col("at")))
        asked = asks.select("scene_id", F.explode(F.array("cls", F.lit(-1).cast("long"))).alias("cls"), "onward", "own", "at", "ask")
        asked = asked.select("scene_id", "cls", "onward", F.explode(self._wanted(F.col("own"))).alias("residue"), "at", F.struct("ask", F.when(F.col("cls") < 0, 1).otherwise(-1).alias("sign")).alias("ask"))
        counts = _beyond(way(near.unionByName(every)).withColumn("one", F.lit(1)), way(asked), ["scene_id", "cls", "onward", "residue"], {"n": F.sum("one")}, {})
        return counts.groupBy("ask.ask").agg(F.coalesce(F.sum(F.col("ask.sign") * F.col("n")), F.lit(0)).alias("n"))

    def degrees(self) -> DataFrame:
        """scene_id, ord, name, cls, l, r; n_in, n_out edges; apart_in, apart_out of them disjoint; n_all triples whose pair it is the first of; first_in, first_out (at, pos) of the least labelled edges."""
        if self._degrees is None:
            key = F.struct("scene_id", "ord").alias("ask")
            first = lambda c: F.min(F.when(F.col(c) > 0, F.struct("at", F.col(f"{c}_pos").alias("pos"))))
            before = {"in_b_n": F.sum("in_b"), "out_b_n": F.sum("out_b"), "in_b_1": first("in_b"), "out_b_1": first("out_b")}
            after = {"in_a_n": F.sum("in_a"), "out_a_n": F.sum("out_a"), "all_a_n": F.sum("all_a"), "in_a_1": first("in_a"), "out_a_1": first("out_a")}
            gives = self._near().where("all_a > 0 OR in_b > 0 OR out_b > 0").drop("scene_id", "l", "r", "taken_b", "taken_a")
            near = _beyond(gives, self.rows.select("cls", F.col("ord").alias("at"), key), ["cls"], before, after)
            n = lambda *c: sum((F.coalesce(x, F.lit(0)) for x in c[1:]), F.coalesce(c[0], F.lit(0)))
            near = near.select("ask.*", n("in_b_n", "in_a_n").alias("n_in"), n("out_b_n", "out_a_n").alias("n_out"), n("all_a_n").alias("n_all"), F.coalesce("in_b_1", "in_a_1").alias("first_in"), F.coalesce("out_b_1", "out_a_1").alias("first_out"))
            way = lambda onward, own: self.rows.select("scene_id", "cls", F.lit(onward).alias("onward"), F.col(own).alias("own"), F.col("ord").alias("at"), F.struct("scene_id", "ord", F.lit(onward).alias("onward")).alias("ask"))
            apart = self._apart(way(False, "r").unionByName(way(True, "l")))
            apart = apart.groupBy("ask.scene_id", "ask.ord").agg(*(F.sum(F.when(F.col("ask.onward") == onward, F.col("n")).otherwise(0)).alias(name) for name, onward in (("apart_in", False), ("apart_out", True))))
            found = self.rows.join(near.hint("merge"), ["scene_id", "ord"]).join(apart.hint("merge"), ["scene_id", "ord"])
            found = found.withColumn("n_in", F.col("n_in") + F.col("apart_in")).withColumn("n_out", F.col("n_out") + F.col("apart_out")).withColumn("n_all", F.col("n_all") + F.col("apart_out"))
            self._degrees = checkpointed(found)
        return self._degrees

    def _listed_apart(self, some: DataFrame) -> DataFrame:
        """scene_id, ord, onward, at: the disjoint edges of some rows (scene_id, ord, cls, l, r, onward)."""
        own = some.select("scene_id", "ord", "cls", "onward", F.explode(self._wanted(F.when(F.col("onward"), F.col("l")).otherwise(F.col("r")))).alias("residue"))
        other = self.rows.select("scene_id", F.col("ord").alias("at"), F.col("cls").alias("other"), F.explode(F.array(*_sides())).alias("s")).select("scene_id", "at", "other", "s.*")
        met = own.join(other.hint("merge"), ["scene_id", "onward", "residue"]).where(F.when(F.col("onward"), F.col("at") > F.col("ord")).otherwise(F.col("at") < F.col("ord")))
        first, second = F.when(F.col("onward"), F.col("cls")).otherwise(F.col("other")), F.when(F.col("onward"), F.col("other")).otherwise(F.col("cls"))
        return met.withColumn("a_cls", first).withColumn("b_cls", second).join(self.pairs.select("a_cls", "b_cls").hint("merge"), ["a_cls", "b_cls"], "left_anti").select("scene_id", "ord", "onward", "at")

    def _next_apart(self, asks: DataFrame) -> DataFrame:
        """scene_id, ord, onward, at: the other place of each row's least disjoint edge, in or onward. asks: scene_id, ord, cls, l, r, onward, of rows that have one."""
        found, keys = None, ["scene_id", "ord", "cls", "l", "r", "onward"]
        gives = self.rows.select("scene_id", F.col("ord").alias("at"), F.col("cls").alias("other"), F.explode(F.array(*_sides())).alias("s")).select("scene_id", "at", "s.*", F.struct("at", "other").alias("to"))
        left = asks.select(*keys, F.when(F.col("onward"), F.col("ord")).otherwise(-1).alias("at"))
        for _ in range(ROUNDS):
            asked = left.select("scene_id", "onward", F.explode(self._wanted(F.when(F.col("onward"), F.col("l")).otherwise(F.col("r")))).alias("residue"), "at", F.struct(*keys).alias("ask"))
            to = _beyond(gives, asked, ["scene_id", "onward", "residue"], {}, {"next": F.min("to")}).groupBy("ask").agg(F.min("next").alias("next")).select("ask.*", "next.*")
            first, second = F.when(F.col("onward"), F.col("cls")).otherwise(F.col("other")), F.when(F.col("onward"), F.col("other")).otherwise(F.col("cls"))
            to = to.withColumn("a_cls", first).withColumn("b_cls", second).join(self.pairs.select("a_cls", "b_cls", F.lit(True).alias("taken")).hint("merge"), ["a_cls", "b_cls"], "left")
            to = checkpointed(to.select(*keys, "at", "taken"))
            good = to.where("taken IS NULL").select("scene_id", "ord", "onward", "at")
            found = good if found is None else found.unionByName(good)
            left = to.where("taken").select(*keys, "at")
            if left.isEmpty():
                return found
        return found.unionByName(self._listed_apart(left).groupBy("scene_id", "ord", "onward").agg(F.min("at").alias("at")))

    def least(self, onward: bool, some: DataFrame) -> DataFrame:
        """The rows of `degrees` given, with at and pos of the least edge out of each (onward) or into it."""
        name, apart = ("first_out", "apart_out") if onward else ("first_in", "apart_in")
        near = some.where(F.col(name).isNotNull()).select("scene_id", "ord", F.col(name).alias("to"))
        if self.chosen.below:
            far = self._next_apart(some.where(F.col(apart) > 0).select("scene_id", "ord", "cls", "l", "r", F.lit(onward).alias("onward")))
            near = near.unionByName(far.select("scene_id", "ord", F.struct(F.col("at"), F.lit(0).alias("pos")).alias("to")))
        return some.join(near.groupBy("scene_id", "ord").agg(F.min("to").alias("to")).hint("merge"), ["scene_id", "ord"]).select(*some.columns, "to.at", "to.pos")

    def ids(self, edges: DataFrame) -> DataFrame:
        """edges (scene_id, ord, at, pos and more) with `id`, that of the triple in the order of the list: by first place, second place and step."""
        every = self.degrees().select("scene_id", "ord", "cls", "l", "n_all")
        block = F.struct("scene_id", block_of(F.col("ord")).alias("block"))
        own = every.withColumn("_block", block).withColumn("end", F.sum("n_all").over(W.partitionBy("_block").orderBy("ord")))
        sums = own.groupBy("_block").agg(F.sum("n_all").alias("_n")).withColumn("before", F.coalesce(F.sum("_n").over(W.partitionBy("_block.scene_id").orderBy("_block.block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        ends = own.join(sums.select("_block", "before").hint("merge"), "_block").select("scene_id", F.col("ord").alias("first"), "cls", "l", (F.col("end") + F.col("before")).alias("end"))
        edges = edges.withColumn("first", F.least("ord", "at")).withColumn("second", F.greatest("ord", "at"))
        asked = checkpointed(edges.select("scene_id", "first", "second").distinct().join(ends.hint("merge"), ["scene_id", "first"]))
        # A row's last triple has the number `end`: those from the second place on are taken off.
        asks = asked.select("scene_id", "cls", F.lit(True).alias("onward"), F.col("l").alias("own"), (F.col("second") - 1).alias("at"), F.struct("scene_id", "first", "second").alias("ask"))
        gives = self._near().where("all_a > 0").select("cls", "at", "all_a")
        near = _beyond(gives, asks.select("cls", "at", "ask"), ["cls"], {}, {"n": F.sum("all_a")}).select("ask", F.coalesce("n", F.lit(0)).alias("n"))
        later = near.unionByName(self._apart(asks)).groupBy("ask").agg(F.sum("n").alias("later")).select("ask.*", "later")
        at = asked.join(later.hint("merge"), ["scene_id", "first", "second"]).select("scene_id", "first", "second", (F.col("end") - F.col("later")).alias("before"))
        return edges.join(at.hint("merge"), ["scene_id", "first", "second"]).withColumn("id", (F.col("before") + F.col("pos") + 1).cast("long")).drop("first", "second", "before")

    def of(self, some: DataFrame) -> DataFrame:
        """scene_id, ord, at, pos, onward, rel, name, other: all edges of some rows (scene_id, ord), onward those out of them; other: the other's name."""
        own = checkpointed(self.rows.join(some.select("scene_id", "ord").distinct().hint("merge"), ["scene_id", "ord"]))
        before = self.pairs.select(F.col("b_cls").alias("cls"), F.col("a_cls").alias("other"), F.lit(False).alias("later"), F.explode("t").alias("e"))
        after = self.pairs.select(F.col("a_cls").alias("cls"), F.col("b_cls").alias("other"), F.lit(True).alias("later"), F.explode("t").alias("e"))
        met = own.select("scene_id", "ord", "cls").join(before.unionByName(after).hint("merge"), "cls").join(self.rows.select(F.col("cls").alias("other"), F.col("ord").alias("at")).hint("merge"), "other")
        met = met.where((F.col("at") != F.col("ord")) & ((F.col("at") > F.col("ord")) == F.col("later")))
        found = met.select("scene_id", "ord", "at", F.col("e.pos").alias("pos"), (F.col("e.onward") == F.col("later")).alias("onward"), F.col("e.rel").alias("rel"))
        if self.chosen.below:
            both = own.select("scene_id", "ord", "cls", "l", "r", F.explode(F.array(F.lit(False), F.lit(True))).alias("onward"))
            far = self._listed_apart(both).select("scene_id", "ord", "at", F.lit(0).alias("pos"), "onward", F.lit("disjoint").alias("rel"))
            found = found.unionByName(far)
        names = self.rows.select("scene_id", F.col("ord").alias("at"), F.col("name").alias("other"))
        return found.join(own.select("scene_id", "ord", "name").hint("merge"), ["scene_id", "ord"]).join(names.hint("merge"), ["scene_id", "at"]).select("scene_id", "ord", "at", "pos", "onward", "rel", "name", "other")


def placed(edges: DataFrame) -> DataFrame:
    """edges of some rows with `i`: 1, 2, ... in their order, of those in and of those out of each row."""
    return numbered(edges, ["scene_id", "ord", "onward"], [block_of(F.col("at"))], ["at", "pos"], "i")
