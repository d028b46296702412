"""Mixing sources to target weights.

The words of each source form one stream that is packed into blocks of a fixed length.
Every output shard draws how many blocks it takes from each source (a multinomial draw,
seeded by the shard's number).  A source's slots, counted over all shards, go through a
pseudorandom permutation of its block numbers (a Feistel network with cycle walking), a new
one for each pass over the source, and the slots are joined to the blocks by number.  Slots
beyond a source's quota stay empty, what the draws left short goes to shards at the end,
and a source's last slot takes only the words that are still due, so that small sources
come near their targets, too.

The stream's order is that of hashes of id and content.  Rows equal in source, id and text
lie together, as copies of one entry: the result is the same however the table is cut to
files and tasks.  Positions are running sums in two steps: inside buckets of some thousand
entries of a source, then over the buckets, so that no task sorts a source.

Defined results: a null text has no words; a null source is a source of its own, after all
others; documents without words take nothing.  Repeated rows are documents of their own; in
`mixed_documents` the other columns of rows equal in source, id and text are those of any
one of them.  Ids may be null.  An empty table gives an empty result.  `bound` sources at
most, checked: their names and sizes are the only thing the driver and the tasks hold of
all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, checkpointed, packed, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 64
SHARD_BLOCKS = 1024
SOURCES_BOUND = 100_000
BUCKET_ROWS = 4096
SEED = 11


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares of `share` of all sizes by weight; none above `cap` times its size, the excess reshared."""
    left, open_, out = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in above:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, at i: four Feistel rounds, walked until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 62, size=4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    x = once(i.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _catalogue(entries: DataFrame, weights: tuple, share: float, cap: float, block_words: int, bound: int) -> pd.DataFrame:
    """A row per source, in code point order and null last: size, target, blocks, quota of slots, words of the last slot, buckets."""
    found = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("rows")).limit(bound + 1).collect()
    if len(found) > bound:
        raise ValueError(f"mixing: more than {bound} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    cat = pd.DataFrame({"sid": range(len(found)), "source": [r.source for r in found], "source_size": [int(r["size"]) for r in found], "rows": [int(r["rows"]) for r in found]})
    cat["weight"] = [float(weights[i % len(weights)]) for i in range(len(cat))]
    cat["target"] = targets(cat.source_size.tolist(), cat.weight.tolist(), share, cap)
    cat["blocks"] = -(-cat.source_size // block_words)
    quota, last = [], []
    for size, blocks, target in zip(cat.source_size.tolist(), cat.blocks.tolist(), cat.target.tolist()):
        passes = int(target // size) if size else 0
        rest = round(target - passes * size) if size else 0
        full, words = divmod(rest, block_words)
        more = words > 0 and full < blocks
        quota.append(passes * blocks + min(full, blocks) + more)
        last.append(words if more else block_words)
    cat["quota"], cat["last"] = quota, last
    cat["buckets"] = -(-cat["rows"] // BUCKET_ROWS)
    return cat


_CAT = "sid int, source string, source_size long, rows long, weight double, target double, blocks long, quota long, last long, buckets long"


def _draws(quota: np.ndarray, shard_blocks: int, seed: int):
    total = int(quota.sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = quota / max(1, total)
        for b in batches:
            for shard in b["id"]:
                k = min(shard_blocks, total - int(shard) * shard_blocks)
                n = np.random.default_rng([seed, int(shard)]).multinomial(k, p)
                sid = np.flatnonzero(n)
                yield pd.DataFrame({"shard": int(shard), "sid": sid.astype(np.int32), "n": n[sid]})

    return run


def _expanded(blocks: np.ndarray, quota: np.ndarray, last: np.ndarray, block_words: int, seed: int, most: int = 1 << 19):
    """Rows (shard, sid, first, n) to one row a slot, with the pass over the source, the permuted block and the words to take of it."""

    def part(shard: np.ndarray, sid: np.ndarray, first: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        of = np.repeat(np.arange(len(n)), n)
        t = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
        source = sid[of]
        epoch, at = np.divmod(t, blocks[source])
        number = np.empty_like(t)
        order = np.lexsort((epoch, source))
        cuts = np.flatnonzero(np.diff(source[order], prepend=-1) | np.diff(epoch[order], prepend=-1))
        for rows in np.split(order, cuts[1:]):
            if len(rows):
                s, e = int(source[rows[0]]), int(epoch[rows[0]])
                number[rows] = permuted(at[rows], int(blocks[s]), hash((seed, s, e)) & 0x7FFFFFFF)
        return pd.DataFrame({"shard": shard[of], "sid": source.astype(np.int32), "epoch": epoch.astype(np.int32), "block": number, "words": np.where(t == quota[source] - 1, last[source], block_words)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, count = [], 0
            for shard, sid, first, n in zip(*(b[c].tolist() for c in ("shard", "sid", "first", "n"))):
                while n:
                    k = min(n, most - count)
                    held.append((shard, sid, first, k))
                    first, n, count = first + k, n - k, count + k
                    if count == most:
                        yield part(*map(np.array, zip(*held)))
                        held, count = [], 0
            if held:
                yield part(*map(np.array, zip(*held)))

    return run


def slots(spark, cat: pd.DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(shard, sid, epoch, block, words): a row for each block that the mix takes, and how many of its words."""
    quota, blocks = cat.quota.to_numpy(dtype=np.int64), cat.blocks.to_numpy(dtype=np.int64)
    shards = int(-(-quota.sum() // shard_blocks))
    drawn = spark.range(0, max(1, shards), 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism + shards // 4096))).where(F.lit(shards > 0)).mapInPandas(_draws(quota, shard_blocks, seed), "shard long, sid int, n long")
    # Slots of a source before a shard: inside groups of shards, then over the groups.
    drawn = checkpointed(drawn).withColumn("part", F.col("shard") / F.lit(4096))
    drawn = drawn.withColumn("part", F.floor("part"))
    inside = W.partitionBy("sid", "part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    parts = drawn.groupBy("sid", "part").agg(F.sum("n").alias("all"))
    over = W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("sid", "part", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("before"))
    limits = spark.createDataFrame(cat[["sid", "quota"]].astype({"sid": "int32"}), "sid int, quota long")
    placed = (
        drawn.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(parts, ["sid", "part"]).join(F.broadcast(limits), "sid")
        .select("shard", "sid", (F.col("before") + F.col("within")).alias("first"), "n", "quota")
        .select("shard", "sid", "first", F.least(F.col("n"), F.col("quota") - F.col("first")).alias("n")).where("n > 0")
    )
    short = drawn.groupBy("sid").agg(F.sum("n").alias("had"))
    topped = (
        limits.join(short, "sid", "left").select("sid", F.coalesce("had", F.lit(0)).alias("first"), "quota")
        .where("first < quota").select(F.lit(shards).alias("shard") + F.col("sid"), "sid", "first", (F.col("quota") - F.col("first")).alias("n"))
        .toDF("shard", "sid", "first", "n")
    )
    # A row stands for many slots: dealt evenly before they are written out.
    return placed.unionByName(topped).repartition(spread_of(int(quota.sum()), spark), "shard", "sid").mapInPandas(_expanded(blocks, quota, cat["last"].to_numpy(dtype=np.int64), block_words, seed), "shard long, sid int, epoch int, block long, words long")


def spread_of(n: int, spark, per_task: int = 1 << 18) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n // per_task))


def _entries(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, doc_id, h, size, n): rows equal in source, id and text counted as one entry of n copies."""
    text = whole_text(text_col)
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    return rows.groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("n"))


def _positions(entries: DataFrame) -> DataFrame:
    """Entries, of size over 0, with off, the first word's place in the source's stream."""
    b = entries.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.col("buckets")))
    all_words = F.col("size") * F.col("n")
    inside = W.partitionBy("sid", "bucket").orderBy("doc_id", "h", "size").rowsBetween(W.unboundedPreceding, -1)
    totals = b.groupBy("sid", "bucket").agg(F.sum(all_words).alias("all"))
    over = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("sid", "bucket", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("before"))
    b = b.withColumn("within", F.coalesce(F.sum(all_words).over(inside), F.lit(0)))
    return b.join(totals, ["sid", "bucket"]).withColumn("off", F.col("before") + F.col("within")).drop("bucket", "buckets", "before", "within")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE,
        cap: float = CAP, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, bound: int = SOURCES_BOUND) -> tuple[DataFrame, DataFrame]:
    """Two tables: entries (sid, source, doc_id, h, size, n, source_size, target) of documents,
    and what the mix takes of them, spans (sid, doc_id, h, size, n, copy, shard, epoch, lo, hi)
    in words of a copy, hi exclusive.  h is the text's hash, n the number of equal rows.
    """
    spark = docs.sparkSession
    entries = checkpointed(_entries(docs, id_col, text_col, source_col))
    cat = _catalogue(entries, weights, share, cap, block_words, bound)
    named = spark.createDataFrame(list(cat.astype(object).itertuples(index=False, name=None)), _CAT).select("sid", F.col("source").alias("of"), "source_size", "target", "buckets")
    entries = entries.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    first, last = F.floor(F.col("off") / block_words), F.floor((F.col("off") + F.col("size") * F.col("n") - 1) / block_words)
    held = _positions(entries).select("sid", "doc_id", "h", "size", "n", "off", F.explode(F.sequence(first, last)).alias("block"))
    met = slots(spark, cat, block_words, shard_blocks, seed).join(held, ["sid", "block"])
    at, all_words = F.col("block") * block_words, F.col("size") * F.col("n")
    lo, hi = F.greatest(at, F.col("off")) - F.col("off"), F.least(at + F.col("words"), F.col("off") + all_words) - F.col("off")
    met = met.select("sid", "doc_id", "h", "size", "n", "shard", "epoch", lo.alias("from"), hi.alias("to")).where(F.col("from") < F.col("to"))
    # A block may hold several copies of a short text.
    met = met.withColumn("copy", F.explode(F.sequence(F.floor(F.col("from") / F.col("size")), F.floor((F.col("to") - 1) / F.col("size")))))
    start = F.col("copy") * F.col("size")
    spans = met.select("sid", "doc_id", "h", "size", "n", "copy", "shard", "epoch", (F.greatest("from", start) - start).alias("lo"), (F.least(F.col("to"), start + F.col("size")) - start).alias("hi"))
    return entries.drop("buckets"), spans


def _copies(entries: DataFrame, step: int = 1000) -> DataFrame:
    """A row per document, with its number among equal ones; a large number of them is dealt out in two steps."""
    one = entries.where("n = 1").withColumn("copy", F.lit(0).cast("long"))
    parts = entries.where("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step)))).repartition("h", "part")
    many = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * step, F.least(F.col("n"), (F.col("part") + 1) * step) - 1))).drop("part")
    return one.unionByName(many)


def taken(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document with the words that the mix takes of it, repeats counted."""
    sums = spans.groupBy(F.col("sid").alias("sid_"), F.col("doc_id").alias("id_"), F.col("h").alias("h_"), F.col("copy").alias("copy_")).agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    same = (F.col("sid") == F.col("sid_")) & F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")) & (F.col("copy") == F.col("copy_"))
    return _copies(entries).join(sums, same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(text: pd.Series, size: pd.Series, spans: pd.Series) -> pd.Series:
    import re

    word = re.compile(WORD)
    out = []
    for t, n, parts in zip(text, size, spans):
        runs: list[list[int]] = []
        for lo, hi in sorted((int(p["lo"]), int(p["hi"])) for p in parts):
            if runs and runs[-1][1] == lo:
                runs[-1][1] = hi
            else:
                runs.append([lo, hi])
        if runs == [[0, n]]:
            out.append(t)
            continue
        places = [m.span() for m in word.finditer(t)]
        out.append("\n".join(t[places[lo][0] : places[hi - 1][1]] for lo, hi in runs))
    return pd.Series(out)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents with the input's columns: for each pass that takes words of a
    document one row whose text is the words taken, in the document's order; a passage whose
    neighbours aren't taken begins a new line.
    """
    entries, spans = mix(docs, id_col, text_col, source_col, **options)
    names = entries.groupBy("sid").agg(F.first("source").alias("source"))
    per = spans.groupBy("sid", "doc_id", "h", "size", "n", "copy", "epoch").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    per = per.join(F.broadcast(names), "sid").select(F.col("source").alias("s_"), F.col("doc_id").alias("id_"), F.col("h").alias("h_"), "size", "n", "parts")
    text = whole_text(text_col)
    rows = packed(docs, id=F.col(id_col), source=F.col(source_col).cast("string"), h=F.xxhash64(text), body=text)
    same = F.col("id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("s_")) & (F.col("h") == F.col("h_"))
    again = entries.where("n > 1 and size > 0").select(F.col("source").alias("s_"), F.col("doc_id").alias("id_"), F.col("h").alias("h_"))
    found = rows.join(per.where("n = 1"), same).unionByName(rows.join(again, same, "left_semi").dropDuplicates(["id", "source", "h"]).join(per.where("n > 1"), same))
    cut = F.pandas_udf(_cut, "string")
    # Computed once: behind a generator it isn't written out again where a part of it is named.
    found = found.select("row", F.explode(F.array(cut(F.col("body"), F.col("size"), F.col("parts")))).alias("text"))
    out = F.col("row").withField(f"`{text_col}`", F.col("text"))
    if length_col in docs.columns:
        out = out.withField(f"`{length_col}`", F.length("text").cast(docs.schema[length_col].dataType))
    return found.select(out.alias("row")).select("row.*")
