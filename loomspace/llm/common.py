"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the contracts: the ASCII letters that are folded, and what a word is.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text_col: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where that setting is absent, a local session takes a folder of its own; a cluster's raises.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder there that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage by a Parquet table of its own in the shared folder, which later steps read by columns."""
    path = os.path.join(shared_folder(df.sparkSession), f"{what}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The input's row as one struct `row`, beside computed columns: no name of the input can clash with theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Keys that more than a ten-thousandth of all rows, and more than a thousand rows, have; so 10,000 keys at most.

    counts: a row for each key with its number of rows.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > max(1000, total // 10_000)).select(F.col(key).alias("hot"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner", parts: int = 32) -> DataFrame:
    """left joined to right, which has one row for each key; rows of hot keys are dealt to `parts` copies of their right row.

    The rows of left come from a scan, or by an order that a rerun repeats.
    """
    hot = F.broadcast(hot)
    number = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
    a = left.withColumn("salt", number).join(hot, F.col(key) == F.col("hot"), "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.col("salt")).otherwise(0)).drop("hot")
    copies = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(hot, F.col(key) == F.col("hot"), "left").withColumn("salt", F.explode(copies)).drop("hot")
    return a.join(b, [key, "salt"], how).drop("salt")


def trim() -> None:
    """Gives what a task has freed back to the system, as its worker process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, turned to Python objects a few at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in b.slice(at, rows).columns))


def sampled(df: DataFrame, id_col: str, count: int, bound: int, seed: int = 7) -> DataFrame:
    """About `bound` of `count` rows at most, chosen by a hash of the id; all of them if there are no more."""
    if count <= bound:
        return df
    grain = 1 << 30
    keep = int(grain * bound / count)
    return df.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(grain)) < keep)
