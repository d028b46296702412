"""Audit of how the words of a language's sources diverge, as plain relations.

Every match of a regular expression in a text is exploded to a row, rows are counted by language,
source and term, and a language keeps the terms that enough of its documents hold.  Groups
(a language's sources) are crossed with the kept vocabulary of their language, so that terms
which a group lacks have their zero; the dense rows are joined with themselves on language
and term; the divergences of two groups are summed, and windows rank them.

A share of counts is p = 1 + floor(10^9 * (n + 1) / (N + V)), the divergence of two shares
floor((p - q)^2 / q), all in whole numbers: the division goes in three steps of a thousand, so
that counts up to 9 * 10^15 are exact in 64 bits.

Two shuffles carry counts, after the map tasks have combined theirs; a very frequent word or a
source with most of all rows is one row a task there.  Neither the crossing nor the self-join
leaves the partition of its term: each key of the self-join has one row a source of its
language.  The languages with their sources go to all tasks only up to GROUPS_SENT sources;
beyond, rows are dealt to copies of what their key joins to.

Defined results: null text, language and source are the empty string.  A group without kept
terms is there, with zero for each other source of its language where nothing is kept at all.
Repeated rows count as often as they stand there, ids are not looked at; other columns never
take part.  Equal values rank by item, in the order of UTF-8 bytes.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hot_keys, lower_az, salted_join, whole_text, written

# Fixed values of the contract: what parts terms (all of ASCII but its letters), in how many documents a term must stand, the scale, ranks kept.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 3
SCALE_STEPS = 3  # of a thousand each
TOP_TERMS = 200
GROUP_PARTS = 16
GROUPS_SENT = 100_000


def share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + kinds)) by long division; total + kinds isn't zero."""
    whole = total + kinds
    out, rest = F.lit(0).cast("long"), n + 1
    for _ in range(SCALE_STEPS):
        digits = _div(rest * 1000, whole)
        out, rest = out * 1000 + digits, (rest * 1000) % whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, for numbers that aren't negative."""
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _numbered(docs: DataFrame, text_col: str, lang_col: str, source_col: str, sent: int) -> tuple[DataFrame, DataFrame]:
    """lang, g, text of all rows, and lang, source, g of all groups: g numbers the sources of a language."""
    rows = docs.select(whole_text(lang_col).alias("lang"), whole_text(source_col).alias("source"), whole_text(text_col).alias("text"))
    counts = rows.groupBy("lang", "source").agg(F.count("lang").alias("n_rows"))
    groups = written(counts.withColumn("g", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1), "groups")
    if groups.count() <= sent:
        return rows.join(F.broadcast(groups), ["lang", "source"]).select("lang", "g", "text"), groups
    key = F.struct("lang", "source")
    of = groups.select(key.alias("key"), "g", "n_rows")
    return salted_join(rows.withColumn("key", key), of, "key", hot_keys(of, "key", "n_rows")).select("lang", "g", "text"), groups


def term_counts(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, own (array of g and n): the kept terms with their counts by group, from lang, g, text."""
    # A term is what lies between gaps; the empty strings at a text's ends are none.
    found = rows.select("lang", "g", F.explode(F.array(F.split(lower_az(F.col("text")), GAP))).alias("terms"))
    # A row for each occurrence, then one for each term of the document.
    both = found.select("lang", "g", F.size("terms").alias("k"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    occurs = F.when(F.col("at") < F.col("k"), 1).otherwise(0)
    counts = both.where("term <> ''").groupBy("lang", "g", "term").agg(F.sum(occurs).alias("n"), F.sum(1 - occurs).alias("d"))
    terms = counts.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.collect_list(F.struct("g", "n")).alias("own"))
    return terms.where(F.col("docs") >= least_docs).select("lang", "term", "own")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, sent: int = GROUPS_SENT) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from each other one of its language, and its own terms."""
    rows, groups = _numbered(docs, text_col, lang_col, source_col, sent)
    terms = written(term_counts(rows, least_docs), "terms")
    sums = terms.select("lang", F.explode("own").alias("o")).groupBy("lang", F.col("o.g").alias("g")).agg(F.sum("o.n").alias("total"))
    kinds = terms.groupBy("lang").agg(F.count("term").alias("kinds"))
    # A row a language, with its sources' totals in the order of their numbers.
    totals = groups.select("lang", "g").join(sums, ["lang", "g"], "left").na.fill(0, ["total"])
    langs = totals.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "total"))), lambda x: x["total"]).alias("totals"), F.sum("total").alias("lang_total"))
    langs = written(langs.join(kinds, "lang"), "langs")
    if groups.count() <= sent:
        wide = terms.repartition("lang", "term").join(F.broadcast(langs), "lang")
    else:
        wide = salted_join(terms, langs, "lang", hot_keys(terms.groupBy("lang").agg(F.count("term").alias("n")), "lang", "n")).repartition("lang", "term")
    return _pairs(wide, groups).unionByName(_terms(wide, groups, top))


def _cells(wide: DataFrame, g: str, p: str) -> DataFrame:
    """lang, term, and for each source of the language its number and its share of the term."""
    rows = wide.select("lang", "term", F.map_from_entries("own").alias("own"), "kinds", F.posexplode("totals").alias(g, "total"))
    n = F.coalesce(F.col("own")[F.col(g)], F.lit(0).cast("long"))
    return rows.select("lang", "term", g, share(n, F.col("total"), F.col("kinds")).alias(p))


def _pairs(wide: DataFrame, groups: DataFrame) -> DataFrame:
    # Both sides lie by term already.
    two = _cells(wide, "g", "p").join(_cells(wide, "h", "q"), ["lang", "term"]).where("g <> h")
    sums = two.groupBy("lang", "g", "h").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("value"))
    # Few rows from here on: the pairs of a language's sources.
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"))
    every = groups.join(other, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left")
    every = every.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return every.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(wide: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    whole = F.aggregate("own", F.lit(0).cast("long"), lambda s, o: s + o["n"])
    held = wide.select("lang", F.col("term").alias("item"), "totals", "kinds", share(whole, F.col("lang_total"), F.col("kinds")).alias("q"), F.explode("own").alias("o"))
    held = held.select("lang", F.col("o.g").alias("g"), "item", "q", share(F.col("o.n"), F.col("totals")[F.col("o.g")], F.col("kinds")).alias("p"))
    held = held.where("p > q").select("lang", "g", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    # The best of every part of a group first, so that no task meets all of a large one.
    best = [F.desc("value"), "item"]
    held = held.withColumn("part_of", F.pmod(F.xxhash64("item"), F.lit(GROUP_PARTS))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "g", "part_of").orderBy(*best))).where(F.col("rank") <= top)
    ranked = held.withColumn("rank", F.row_number().over(W.partitionBy("lang", "g").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(groups.select("lang", "g", "source"), ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
