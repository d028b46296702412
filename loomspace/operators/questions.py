"""Questions with their reasoning and SQL, from relationship triples or from placeholders.

Triples are rows (scene_id, id, a, b, rel); the id tells a scene's triples apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspace.functions.geometry import entity_type

from . import paired
from .edges import Edges, placed
from .lineage import checkpointed
from .order import block_of, numbered
from .relations import Residues

# The labels that the triples' questions know, and those of the placeholder
# questions, with the predicate of each; and the labels of the finder that differ.
TRIPLE_PREDICATES = {"within": "ST_Within", "contain": "ST_Contains", "overlap": "ST_Overlaps", "intersect": "ST_Intersects", "disjoint": "ST_Disjoint", "crosses": "ST_Crosses"}
PLACEHOLDER_PREDICATES = {"intersects": "ST_Intersects", "contains": "ST_Contains", "within": "ST_Within", "overlaps": "ST_Overlaps", "touches": "ST_Touches", "disjoint": "ST_Disjoint", "crosses": "ST_Crosses"}
PLACEHOLDERS = ("Polygon_A", "Polygon_B", "Point_C", "Line_D")
NORMAL = {"contains": "contain", "overlaps": "overlap", "cross": "crosses"}
NO_PATTERN = "Could not find any multi-step patterns in the provided data."


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def _predicates(touches: bool) -> dict[str, str]:
    return TRIPLE_PREDICATES | ({"touches": "ST_Touches"} if touches else {})


def known_triples(triples: DataFrame, normalize: bool = False, touches: bool = False) -> DataFrame:
    """The triples whose label the questions know; normalize: the finder's own labels are renamed first."""
    if normalize:
        triples = triples.withColumn("rel", F.coalesce(_map(NORMAL)[F.col("rel")], F.col("rel")))
    return triples.where(F.col("rel").isin(list(_predicates(touches))))


def edges(geometries: DataFrame, chosen: Residues, semantics: str = "compat", touches: bool = False) -> Edges:
    """What `find` lists as edges; those whose normalized label the questions know."""
    return Edges(geometries, chosen, semantics, tuple(x for x in ("within", "contains", "overlaps", "cross", "touches") if NORMAL.get(x, x) in _predicates(touches)))


def identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*", name):
        raise ValueError(f"not a table or column name: {name!r}")
    return name


def clean_sql(sql: Column) -> Column:
    """Lines trimmed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(sql, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n")


def _text(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p))


def _literal(name: Column) -> Column:
    return F.replace(name, F.lit("'"), F.lit("''"))


def _met(triples: DataFrame, onward: DataFrame, middle: str) -> DataFrame:
    """Pairs of edges of one entity. Its hash is the first key, so that sorts go by one number and seldom compare names."""
    key = lambda df: df.withColumn("_key", F.xxhash64("scene_id", middle))
    # All edges of a large scene are too many to send to every task, however small their size is guessed.
    return key(triples).join(key(onward).hint("merge"), ["_key", "scene_id", middle]).drop("_key")


def chains(triples: DataFrame) -> DataFrame:
    """Every chain a -> rel1 -> b -> rel2 -> c."""
    e1 = triples.select("scene_id", F.col("id").alias("id1"), "a", F.col("rel").alias("rel1"), "b")
    e2 = triples.select("scene_id", F.col("id").alias("id2"), F.col("a").alias("b"), F.col("rel").alias("rel2"), F.col("b").alias("c"))
    return _met(e1, e2, "b").select("scene_id", "id1", "id2", "a", "rel1", "b", "rel2", "c")


def multi_conditions(triples: DataFrame) -> DataFrame:
    """Every ordered pair of relations of one subject."""
    e1 = triples.select("scene_id", F.col("id").alias("id1"), "a", F.col("rel").alias("rel1"), "b")
    e2 = triples.select("scene_id", F.col("id").alias("id2"), "a", F.col("rel").alias("rel2"), F.col("b").alias("c"))
    return _met(e1, e2, "a").where("id1 <> id2").select("scene_id", "id1", "id2", "a", "rel1", "b", "rel2", "c")


def _labels(touches: bool) -> dict[str, str]:
    """The finder's labels that the questions know, with their names there."""
    return {x: NORMAL.get(x, x) for x in ("within", "contains", "overlaps", "cross", "touches", "disjoint") if NORMAL.get(x, x) in _predicates(touches)}


def chains_of(geometries: DataFrame, chosen: Residues, semantics: str = "compat", touches: bool = False) -> DataFrame:
    """As `chains` of all that `find` lists, normalized, without the list and ids."""
    return paired.chains(paired.met_edges(geometries, chosen, _labels(touches), True, semantics))


def multi_conditions_of(geometries: DataFrame, chosen: Residues, semantics: str = "compat", touches: bool = False) -> DataFrame:
    """As `multi_conditions` of all that `find` lists, normalized, without the list and ids."""
    return paired.multi_conditions(paired.met_edges(geometries, chosen, _labels(touches), False, semantics))


def feasible(triples: DataFrame) -> DataFrame:
    """scene_id, has_multi, has_chain of each scene."""
    many = triples.groupBy("scene_id", "a").agg(F.count("id").alias("n")).where("n >= 2").select("scene_id").distinct().withColumn("has_multi", F.lit(True))
    linked = triples.select("scene_id", F.col("a").alias("x")).intersect(triples.select("scene_id", F.col("b").alias("x"))).select("scene_id").distinct().withColumn("has_chain", F.lit(True))
    every = triples.select("scene_id").distinct()
    return every.join(many, "scene_id", "left").join(linked, "scene_id", "left").na.fill(False)


def feasible_of(graph: Edges) -> DataFrame:
    """As `feasible` of all edges, from degrees."""
    named = graph.degrees().groupBy("scene_id", "name").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).where("n_in + n_out > 0")
    return named.groupBy("scene_id").agg((F.max("n_out") >= 2).alias("has_multi"), F.max((F.col("n_in") > 0) & (F.col("n_out") > 0)).alias("has_chain"))


# The text of the SQL.
CHAIN_SQL = """WITH IntermediateSet AS (
SELECT T1.{geom}
FROM {table} AS T1, {table} AS T2
WHERE
T1.{name} LIKE '{type_b}_%'
AND T2.{name} = '{c}'
AND {f2}(T1.{geom}, T2.{geom})
)
SELECT DISTINCT T_Final.{name}
FROM {table} AS T_Final, IntermediateSet
WHERE
T_Final.{name} LIKE '{type_a}_%'
AND {f1}(T_Final.{geom}, IntermediateSet.{geom});"""

BOTH_SQL = """SELECT T1.{name}
FROM {table} AS T1, {table} AS T2
WHERE
T1.{name} LIKE '{type_a}_%'
AND T2.{name} = '{b}'
AND {f1}(T1.{geom}, T2.{geom})
INTERSECT
SELECT T1.{name}
FROM {table} AS T1, {table} AS T2
WHERE
T1.{name} LIKE '{type_a}_%'
AND T2.{name} = '{c}'
AND {f2}(T1.{geom}, T2.{geom});"""


def _values(table: str, name: str, geom: str, touches: bool) -> dict[str, Column]:
    of = _map(_predicates(touches))
    fixed = {k: F.lit(identifier(v)) for k, v in (("table", table), ("name", name), ("geom", geom))}
    return fixed | {
        "type_a": entity_type(F.col("a")), "type_b": entity_type(F.col("b")), "a": F.col("a"), "b": _literal(F.col("b")), "c": _literal(F.col("c")),
        "r1": F.col("rel1"), "r2": F.col("rel2"), "f1": of[F.col("rel1")], "f2": of[F.col("rel2")],
    }


# The question of a chain, in the words that its first edge gives and those of its second.
CHAIN_QUESTION = "Which {type_a}s in the database {r1} the {type_b} that is ", "{r2} {c}?"


def chain_texts(triples: DataFrame) -> DataFrame:
    """scene_id, question of every chain. Each edge's words are put together once, not once a chain."""
    kind = lambda name: entity_type(F.col(name))
    e1 = triples.select("scene_id", "b", _text(CHAIN_QUESTION[0], type_a=kind("a"), r1=F.col("rel"), type_b=kind("b")).alias("head"))
    e2 = triples.select("scene_id", F.col("a").alias("b"), _text(CHAIN_QUESTION[1], r2=F.col("rel"), c=F.col("b")).alias("tail"))
    return _met(e1, e2, "b").select("scene_id", F.concat("head", "tail").alias("question"))


def chain_texts_of(geometries: DataFrame, chosen: Residues, semantics: str = "compat", touches: bool = False) -> DataFrame:
    """As `chain_texts` of all that `find` lists, normalized, without the list."""
    met = paired.met_edges(geometries, chosen, _labels(touches), True, semantics)
    return paired.chain_texts(met, lambda a, rel, b: _text(CHAIN_QUESTION[0], type_a=entity_type(a), r1=rel, type_b=entity_type(b)), lambda rel, c: _text(CHAIN_QUESTION[1], r2=rel, c=c))


def chain_questions(chain: DataFrame, table: str = "geometries", name: str = "name", geom: str = "geom", touches: bool = False) -> DataFrame:
    v = _values(table, name, geom, touches)
    steps = F.array(
        _text("Step 1 (Intermediate Set): Find all `{type_b}` geometries that `{r2}` (`{f2}(.., ..)`) '{c}'.", **v),
        _text("Step 2 (Final Set): Find all `{type_a}` geometries that `{r1}` (`{f1}(.., ..)`) intermediate set.", **v),
        F.lit("Step 3: Return the distinct names of these final geometries."),
    )
    question = _text("".join(CHAIN_QUESTION), **(v | {"c": F.col("c")}))
    return chain.select("scene_id", "id1", "id2", F.lit("chain").alias("template"), question.alias("question"), steps.alias("reasoning"), _text(CHAIN_SQL, **v).alias("sql"))


def multi_questions(pairs: DataFrame, table: str = "geometries", name: str = "name", geom: str = "geom", touches: bool = False) -> DataFrame:
    v = _values(table, name, geom, touches)
    steps = F.array(
        _text("Step 1: Find the set of all `{type_a}`s that `{r1}` (using `{f1}(.., ..)`) '{b}'.", **v),
        _text("Step 2: Find the set of all `{type_a}`s that `{r2}` (using `{f2}(.., ..)`) '{c}'.", **v),
        F.lit("Step 3: Find the common geometries (the intersection) between the sets from Step 1 and Step 2."),
    )
    question = _text("Find all {type_a}s that both {r1} '{b}' AND {r2} '{c}'.", **v)
    return pairs.select("scene_id", "id1", "id2", F.lit("multi").alias("template"), question.alias("question"), steps.alias("reasoning"), _text(BOTH_SQL, **v).alias("sql"))


def questions(triples: DataFrame, table: str = "geometries", name: str = "name", geom: str = "geom", normalize: bool = False, touches: bool = False) -> DataFrame:
    """Every question that the triples allow, of both templates."""
    known = known_triples(triples, normalize, touches)
    return chain_questions(chains(known), table, name, geom, touches).unionByName(multi_questions(multi_conditions(known), table, name, geom, touches))


Draw = Callable[[Column, Column, int], Column]


def _hashed(seed: int) -> Draw:
    return lambda scene, number, step: F.xxhash64(scene, number, F.lit(step), F.lit(seed))


def _least(rows: DataFrame, key: Column, *values: str) -> DataFrame:
    """A row of each scene: that of the least key. No scene's rows come together, as minima are combined before the shuffle."""
    first = F.min(F.struct(key.alias("_key"), *values)).alias("_first")
    return rows.groupBy("scene_id").agg(first).select("scene_id", *(F.col("_first")[v].alias(v) for v in values))


def draw_chain(triples: DataFrame, draw: Draw) -> DataFrame:
    """A chain of each scene that has one: the middle is drawn among all entities that are subject and object, then an edge to it, then one from it."""
    middles = triples.groupBy("scene_id", F.col("b").alias("x")).agg(F.min("id").alias("n")).join(triples.select("scene_id", F.col("a").alias("x")).distinct(), ["scene_id", "x"], "left_semi")
    middle = _least(middles, draw(F.col("scene_id"), F.col("n"), 1), "n", "x").drop("n")
    return _chain_at(triples.join(middle.withColumnRenamed("x", "b"), ["scene_id", "b"]), triples.join(middle.withColumnRenamed("x", "a"), ["scene_id", "a"]), draw)


def _chain_at(to: DataFrame, onward: DataFrame, draw: Draw) -> DataFrame:
    """A chain of each scene, of the edges into its middle and those out of it."""
    to = to.select("scene_id", F.col("id").alias("id1"), "a", F.col("rel").alias("rel1"), "b")
    onward = onward.select("scene_id", F.col("id").alias("id2"), F.col("rel").alias("rel2"), F.col("b").alias("c"))
    return _least(to, draw(F.col("scene_id"), F.col("id1"), 2), "id1", "a", "rel1", "b").join(_least(onward, draw(F.col("scene_id"), F.col("id2"), 3), "id2", "rel2", "c"), "scene_id").select("scene_id", "id1", "id2", "a", "rel1", "b", "rel2", "c")


def draw_pair(triples: DataFrame, draw: Draw) -> DataFrame:
    """Two relations of one subject, of each scene that has any: the subject is drawn, then two of its edges without replacement."""
    subjects = triples.groupBy("scene_id", "a").agg(F.min("id").alias("n"), F.count("id").alias("edges")).where("edges >= 2")
    return _pair_of(triples.join(_least(subjects, draw(F.col("scene_id"), F.col("n"), 4), "n", "a").drop("n"), ["scene_id", "a"]), draw)


def _pair_of(own: DataFrame, draw: Draw) -> DataFrame:
    """Two of the edges of each scene, without replacement."""
    first = _least(own.select("scene_id", F.col("id").alias("id1"), "a", F.col("rel").alias("rel1"), "b"), draw(F.col("scene_id"), F.col("id1"), 5), "id1", "a", "rel1", "b")
    rest = own.select("scene_id", F.col("id").alias("id2"), F.col("rel").alias("rel2"), F.col("b").alias("c")).join(first.select("scene_id", "id1"), "scene_id").where("id1 <> id2")
    return first.join(_least(rest, draw(F.col("scene_id"), F.col("id2"), 5), "id2", "rel2", "c"), "scene_id").select("scene_id", "id1", "id2", "a", "rel1", "b", "rel2", "c")


def one_question(triples: DataFrame, seed: int, table: str = "geometries", name: str = "name", geom: str = "geom", normalize: bool = False, touches: bool = False, draw: Draw | None = None) -> DataFrame:
    """One question of each scene; `error` where its triples allow none.

    A template is drawn among those that the scene allows, then its entity, then that entity's
    edges, as `draw_chain` and `draw_pair` do: no chain is formed but the one drawn, so the work
    is that of a few passes over the triples.  draw(scene, number, step): what orders the numbers of a
    scene (ids, of entities the least id that leads to them or from them, of templates twice the
    scene's number and one more); by default a hash with the seed.
    """
    triples = checkpointed(triples)
    known, draw = known_triples(triples, normalize, touches), draw or _hashed(seed)
    return _asked(triples.select("scene_id").distinct(), draw_chain(known, draw), draw_pair(known, draw), draw, table, name, geom, touches)


def one_question_of(graph: Edges, seed: int, table: str = "geometries", name: str = "name", geom: str = "geom", touches: bool = False, draw: Draw | None = None) -> DataFrame:
    """As `one_question` of all that `find` lists, normalized: only the edges of the entities that are drawn are listed."""
    draw, degrees = draw or _hashed(seed), graph.degrees()
    least = graph.least(False, degrees.where("n_in > 0 AND n_out > 0")).select("scene_id", "ord", "at", "pos", F.lit("chain").alias("of"))
    least = least.unionByName(graph.least(True, degrees.where("n_out >= 2")).select("scene_id", "ord", "at", "pos", F.lit("multi").alias("of")))
    numbers = checkpointed(graph.ids(least).select("scene_id", "ord", F.col("id").alias("n"), "of"))
    drawn = lambda of, step: _least(numbers.where(F.col("of") == of), draw(F.col("scene_id"), F.col("n"), step), "n", "ord").select("scene_id", "ord")
    middle, subject = drawn("chain", 1), drawn("multi", 4)
    own = checkpointed(graph.ids(graph.of(middle.unionByName(subject))))
    of = lambda rows, onward: own.where("onward" if onward else "NOT onward").join(rows, ["scene_id", "ord"], "left_semi").select("scene_id", "id", F.col("name" if onward else "other").alias("a"), F.coalesce(_map(NORMAL)[F.col("rel")], F.col("rel")).alias("rel"), F.col("other" if onward else "name").alias("b"))
    scenes = degrees.where("n_all > 0").select("scene_id").distinct()
    return _asked(scenes, _chain_at(of(middle, False), of(middle, True), draw), _pair_of(of(subject, True), draw), draw, table, name, geom, touches)


def _asked(scenes: DataFrame, chain: DataFrame, pair: DataFrame, draw: Draw, table: str, name: str, geom: str, touches: bool) -> DataFrame:
    """A question of each scene, of its chain or its pair; `error` where it has neither."""
    both = chain.withColumn("template", F.lit("chain")).unionByName(pair.withColumn("template", F.lit("multi")))
    number = 2 * F.col("scene_id").cast("long") + F.when(F.col("template") == "chain", 0).otherwise(1)
    drawn = _least(both, draw(F.col("scene_id"), number, 6), "template", "id1", "id2", "a", "rel1", "b", "rel2", "c")
    of = lambda t: drawn.where(F.col("template") == t)
    best = chain_questions(of("chain"), table, name, geom, touches).unionByName(multi_questions(of("multi"), table, name, geom, touches)).drop("id1", "id2").withColumn("sql", clean_sql(F.col("sql")))
    return scenes.join(best, "scene_id", "left").withColumn("error", F.when(F.col("question").isNull(), NO_PATTERN))


def _numbers_held(middles: DataFrame, order: list[str], count: int, number: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """scene_id, j, x, i, k: the middle of each draw's chain, the places of its edges in and out. middles: scene_id, x, n_in, n_out, block, and `order` in a block."""
    chains = F.col("n_in") * F.col("n_out")
    # Blocks of a scene: one for each 65,536 ids at most.
    blocks = middles.groupBy("scene_id", "block").agg(F.sum(chains).alias("size"))
    blocks = blocks.withColumn("end", F.sum("size").over(W.partitionBy("scene_id").orderBy("block"))).withColumn("all", F.sum("size").over(W.partitionBy("scene_id")))
    draws = blocks.select("scene_id", "all").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select("scene_id", "j", number(F.col("scene_id"), F.col("j").cast("long"), F.col("all")).alias("at"))
    held = draws.join(blocks, "scene_id").where((F.col("at") < F.col("end")) & (F.col("at") >= F.col("end") - F.col("size"))).select("scene_id", "block", "j", (F.col("at") - F.col("end") + F.col("size")).alias("at"))
    placed = middles.withColumn("end", F.sum(chains).over(W.partitionBy("scene_id", "block").orderBy(*order))).withColumn("start", F.col("end") - chains)
    held = held.join(placed, ["scene_id", "block"]).where((F.col("at") < F.col("end")) & (F.col("at") >= F.col("start"))).withColumn("at", F.col("at") - F.col("start"))
    return held.select("scene_id", "j", "x", (F.call_function("div", F.col("at"), F.col("n_out")) + 1).alias("i"), (F.col("at") % F.col("n_out") + 1).alias("k"))


def sample_chains(triples: DataFrame, count: int, number: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """`count` chains of each scene by their numbers, drawn uniformly from all of them, none but these formed.

    A scene's chains are numbered by their middle, that of the least incoming id first, then by
    the incoming edge's id, then by the outgoing one's.  number(scene, j, chains): the number of
    the j-th draw, from 0 to one less than the scene's chains.  Middles have in x out chains;
    running sums of these, by blocks, lead from a number to its middle, and what is left to its
    two edges by equality.
    """
    triples = checkpointed(triples)
    to = numbered(triples.select("scene_id", F.col("id").alias("id1"), "a", F.col("rel").alias("rel1"), F.col("b").alias("x")), ["scene_id", "x"], [block_of(F.col("id1"))], ["id1"], "i")
    onward = numbered(triples.select("scene_id", F.col("id").alias("id2"), F.col("a").alias("x"), F.col("rel").alias("rel2"), F.col("b").alias("c")), ["scene_id", "x"], [block_of(F.col("id2"))], ["id2"], "k")
    n_in = triples.groupBy("scene_id", F.col("b").alias("x")).agg(F.min("id").alias("least"), F.count("id").alias("n_in"))
    n_out = triples.groupBy("scene_id", F.col("a").alias("x")).agg(F.count("id").alias("n_out"))
    middles = n_in.join(n_out, ["scene_id", "x"]).withColumn("block", block_of(F.col("least")))
    held = _numbers_held(middles, ["least"], count, number)
    out = held.join(to, ["scene_id", "x", "i"]).join(onward, ["scene_id", "x", "k"])
    return out.select("scene_id", "j", "id1", "id2", "a", "rel1", F.col("x").alias("b"), "rel2", "c")


def sample_chains_of(graph: Edges, count: int, number: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """As `sample_chains` of all that `find` lists, normalized: only the edges of the middles that are drawn are listed, numbered by their order, without ids."""
    middles = graph.least(False, graph.degrees().where("n_in > 0 AND n_out > 0")).withColumn("first", F.least("ord", "at")).withColumn("second", F.greatest("ord", "at"))
    middles = checkpointed(middles.select("scene_id", F.col("ord").alias("x"), "n_in", "n_out", "second", "pos", F.struct("first", block_of(F.col("second")).alias("block")).alias("block")))
    held = checkpointed(_numbers_held(middles, ["second", "pos"], count, number))
    own = checkpointed(placed(graph.of(held.select("scene_id", F.col("x").alias("ord")))).withColumn("rel", F.coalesce(_map(NORMAL)[F.col("rel")], F.col("rel"))))
    to = own.where("NOT onward").select("scene_id", F.col("ord").alias("x"), "i", F.col("other").alias("a"), F.col("rel").alias("rel1"), F.col("name").alias("b"))
    onward = own.where("onward").select("scene_id", F.col("ord").alias("x"), F.col("i").alias("k"), F.col("rel").alias("rel2"), F.col("other").alias("c"))
    return held.join(to, ["scene_id", "x", "i"]).join(onward, ["scene_id", "x", "k"]).select("scene_id", "j", "a", "rel1", "b", "rel2", "c")


# The text of the SQL.
PLACEHOLDER_SQL = """EXPLAIN ANALYZE
    WITH Related_to_{e1} AS (
        SELECT t2.name, t2.{geom}
        FROM {table} AS t1, {table} AS t2
        WHERE t1.name = '{e1}'
          AND {f1}(t1.{geom}, t2.{geom})
          AND t2.name != '{e1}'
    )
    
    SELECT T1.name
    FROM Related_to_{e1} AS T1, {table} AS T2
    WHERE T2.name = '{e2}'
      AND {f2}(T1.{geom}, T2.{geom});"""


def placeholder_questions(spark: SparkSession, table: str = "polygons", geom: str = "geom", entities: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """All questions over ordered pairs of entities and pairs of relations: 12 x 49 with the usual entities."""
    # Local rows come in many partitions, and products multiply them: one each here.
    e = spark.createDataFrame([(x,) for x in entities], "e string").coalesce(1)
    r = spark.createDataFrame(list(PLACEHOLDER_PREDICATES.items()), "r string, f string").coalesce(1)
    rows = e.select(F.col("e").alias("e1")).join(e.select(F.col("e").alias("e2")), F.col("e1") != F.col("e2"))
    rows = rows.crossJoin(r.select(F.col("r").alias("r1"), F.col("f").alias("f1"))).crossJoin(r.select(F.col("r").alias("r2"), F.col("f").alias("f2")))  # small fixed tables
    v = {c: F.col(c) for c in ("e1", "e2", "r1", "r2", "f1", "f2")} | {"table": F.lit(identifier(table)), "geom": F.lit(identifier(geom))}
    steps = F.array(
        _text("Step 1 (Filtering by {e1}): Identify the set of all shape(s) that have a '{r1}' topological relationship with the '{e1}'", **v),
        _text("Step 2 (Filtering by {e2}): From the results of Step 1 further filter this set to include only the polygons that also have a '{r2}' topological relationship with the '{e2}'.", **v),
        F.lit("Step 3 (Output): Return the names of the shape(s) remaining after both filtering steps."),
    )
    question = _text("Question: Which objects in the database {r2} the '{e2}', but also {r1} the '{e1}'? List only the names of the resulting polygons.", **v)
    return rows.select("e1", "e2", "r1", "r2", question.alias("question"), steps.alias("reasoning"), _text(PLACEHOLDER_SQL, **v).alias("sql"))


def report(records: DataFrame) -> DataFrame:
    """One text per record: question, steps, and the SQL in a fence behind EXPLAIN."""
    steps = F.array_join(F.transform("reasoning", lambda s: F.concat(F.lit("* "), s)), "\n")
    body = F.concat(F.lit("Question\n\n"), F.col("question"), F.lit("\n\n---\n\nComposition\n\n"), steps, F.lit("\n\n---\n\nPostGIS/PostgreSQL Query\n\n```sql\nEXPLAIN (ANALYZE, BUFFERS)\n"), F.col("sql"), F.lit("\n```"))
    return records.select("*", body.alias("report"))
