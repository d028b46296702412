"""Numbers of rows within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 1 << 16


def block_of(key: Column) -> Column:
    """The block of a whole number: numbers in a row share one."""
    return F.floor(key / BLOCK)


def numbered(rows: DataFrame, group: list[str], block: list[Column], order: list, name: str, keys: DataFrame | None = None) -> DataFrame:
    """rows with `name`: 1, 2, ... within each group, in the order of `block` and then of `order`.

    A task numbers the rows of a block; the rows of earlier blocks come from counts by block,
    so that only those counts are in one place for each group.  `block` should part a group
    into pieces of bounded size, as `block_of` a unique key does.  Null counts as a value of
    group and block, the first; rows that `block` and `order` don't tell apart are numbered in
    any order.  An empty table stays empty.  keys: the same rows with what group and block
    need alone, where that is cheaper to read than rows.
    """
    # One struct as key: its nulls equal each other, and the join takes the window's partitioning.
    key = F.struct(F.struct(*group).alias("group"), F.struct(*(b.alias(f"b{i}") for i, b in enumerate(block))).alias("block"))
    counts = (rows if keys is None else keys).select(key.alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("_key.group").orderBy("_key.block").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_key", F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = rows.withColumn("_key", key).withColumn("_own", F.row_number().over(W.partitionBy("_key").orderBy(*order)))
    return own.join(counts, "_key").select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))
