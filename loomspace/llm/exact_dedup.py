"""Exact deduplication as a Grace hash job.

Records are dealt to buckets by the leading bits of a hash of their content (Spark's
shuffle files are the spill files).  A bucket whose distinct content doesn't fit the memory
of one open-addressing table is partitioned again by further bits, and so on, until every
bucket fits or is a single hash; buckets that fit stay as they are.  The sizes come from a
table of (hash, length), so that no text moves while buckets are parted.  A shuffle
partition holds many buckets, sorted, and its bytes are fixed, whatever the buckets are.
Each bucket streams through an open-addressing table that compares complete contents.  The
same table first runs inside every map task, so that a content which a third of all rows
share reaches its bucket once a task.

Defined results: a null text is the empty text, and all empty texts are one group.  A null
id never wins against another id; a group of null ids keeps null.  Rows that repeat an id
and a text are one document: all of them carry kept = true in `classify`, and `keep_one`
returns one of them.  An empty table gives an empty result.  Other columns never take part
and may have any names.  What is broadcast are the prefixes of buckets that are parted
again: one for each bucket_bytes of content at most, eight bytes each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hot_keys, lower_az, packed, salted_join, slices, trim, whole_text

BUCKET_BYTES = 32 << 20
PARTITION_BYTES = 128 << 20
MAP_BYTES = 16 << 20  # of the table inside a map task
SPLIT_BITS = 2
ROW_BYTES = 400  # what a content takes in a table beside its text
_RECORD = "bucket long, h long, sha string, body string, keep_id long, n_rows long, n_keep long"


class ContentTable:
    """Open addressing with linear probing; two records are one only if their contents are equal."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.entries: list[list] = []
        self.bytes = 0

    def _probe(self, h: int, body: str | None) -> int:
        mask = len(self.slots) - 1
        at = (h ^ (h >> 29)) & mask
        while (k := self.slots[at]) >= 0:
            if body is not None and self.hashes[k] == h and self.entries[k][3] == body:
                return at
            at = (at + 1) & mask
        return at

    def add(self, bucket: int, h: int, sha: str, body: str, doc_id: int | None, n: int, n_keep: int) -> None:
        at = self._probe(h, body)
        k = self.slots[at]
        if k >= 0:
            e = self.entries[k]
            e[5] += n
            if doc_id == e[4]:
                e[6] += n_keep
            elif doc_id is not None and (e[4] is None or doc_id > e[4]):
                e[4], e[6] = doc_id, n_keep
            return
        self.slots[at] = len(self.entries)
        self.hashes.append(h)
        self.entries.append([bucket, h, sha, body, doc_id, n, n_keep])
        self.bytes += sys.getsizeof(body) + ROW_BYTES
        if 2 * len(self.entries) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
            for i, g in enumerate(self.hashes):
                self.slots[self._probe(g, None)] = i


_SCHEMA = pa.schema([("bucket", pa.int64()), ("h", pa.int64()), ("sha", pa.string()), ("body", pa.string()), ("keep_id", pa.int64()), ("n_rows", pa.int64()), ("n_keep", pa.int64())])


def _flushed(table: ContentTable, with_body: bool, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    part, chars = [], 0
    for i, e in enumerate(table.entries):
        part.append(e if with_body else [*e[:3], None, *e[4:]])
        chars += len(e[3]) if with_body else 0
        if chars >= most or len(part) >= 2000 or i == len(table.entries) - 1:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*part), _SCHEMA)], schema=_SCHEMA)
            part, chars = [], 0
    table.clear()


def _through(table_bytes: int, by_bucket: bool):
    """A pass of records through tables: one for each bucket, or one emptied whenever it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, now = ContentTable(), None
        for row in slices(batches):
            if by_bucket and row[0] != now:
                yield from _flushed(t, False)
                now = row[0]
            t.add(*row)
            if not by_bucket and t.bytes > table_bytes:
                yield from _flushed(t, True)
        yield from _flushed(t, not by_bucket)
        trim()

    return run


def _prefix(depth: int):
    """The leading bits of the hash h, the others zero."""
    mask = ((1 << depth) - 1) << (64 - depth)
    return F.col("h").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def grace_levels(sizes: DataFrame, bucket_bytes: int, split_bits: int = SPLIT_BITS) -> tuple[int, list[tuple[int, DataFrame]], int]:
    """The first depth, for each further depth the prefixes before it that are parted again, and all bytes.

    sizes: distinct (h, n_bytes), the bytes that a content takes in a table.  The first depth is where the average bucket is half of
    what fits; only buckets of more than one content that are too large go on.
    """
    total = int(sizes.agg(F.sum("n_bytes")).first()[0] or 0)
    first = depth = max(0, int(2 * total // bucket_bytes)).bit_length()
    left, levels = sizes, []
    while depth < 64:
        summed = left.withColumn("bucket", _prefix(depth)).groupBy("bucket").agg(F.sum("n_bytes").alias("bytes"), F.count("h").alias("n"))
        over = checkpointed(summed.where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes)).select("bucket"))
        if over.isEmpty():
            break
        left = left.withColumn("bucket", _prefix(depth)).join(F.broadcast(over), "bucket", "left_semi").drop("bucket")
        depth = min(64, depth + split_bits)
        levels.append((depth, over))
    return first, levels, total


def _bucketed(records: DataFrame, first: int, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    records = records.withColumn("bucket", _prefix(first)).withColumn("fits", F.lit(False))
    for depth, over in levels:
        # A bucket that was parted has its start's prefix in the level's list.
        mark = F.broadcast(over.select(F.col("bucket").alias("parted")))
        records = records.join(mark, (F.col("bucket") == F.col("parted")) & ~F.col("fits"), "left")
        records = records.withColumn("fits", F.col("parted").isNull()).withColumn("bucket", F.when(F.col("parted").isNotNull(), _prefix(depth)).otherwise(F.col("bucket"))).drop("parted")
    return records.drop("fits")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row for each distinct content: sha, keep_id, n_rows, n_keep (rows that have keep_id)."""
    body = lower_az(whole_text(text_col))
    sizes = docs.select(F.xxhash64(body).alias("h"), (F.octet_length(body).cast("long") + ROW_BYTES).alias("n_bytes")).distinct()
    first, levels, total = grace_levels(checkpointed(sizes), bucket_bytes)
    records = docs.select(F.col(id_col).cast("long").alias("keep_id"), body.alias("body")).select(F.xxhash64("body").alias("h"), F.sha2("body", 256).alias("sha"), "body", "keep_id")
    one = F.lit(1).cast("long")
    records = _bucketed(records, first, levels).select("bucket", "h", "sha", "body", "keep_id", one.alias("n_rows"), one.alias("n_keep"))
    partitions = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // PARTITION_BYTES))
    dealt = records.mapInArrow(_through(min(MAP_BYTES, bucket_bytes), False), _RECORD).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_through(bucket_bytes, True), _RECORD).select("sha", "keep_id", "n_rows", "n_keep")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: the id, keep_id, group_size, kept, text_sha256."""
    of = docs.select(F.col(id_col).alias("doc_id"), F.sha2(lower_az(whole_text(text_col)), 256).alias("text_sha256"))
    found = checkpointed(classes(docs, id_col, text_col, bucket_bytes).withColumnRenamed("sha", "text_sha256"))
    return salted_join(of, found, "text_sha256", hot_keys(found, "text_sha256", "n_rows")).select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The input's rows without copies, with its columns: of equal contents the largest id stays."""
    found = classes(docs, id_col, text_col, bucket_bytes).withColumnRenamed("sha", "of_sha")
    marked = packed(docs, id=F.col(id_col).cast("long"), sha=F.sha2(lower_az(whole_text(text_col)), 256))
    # The join is by content and id together, so that the copies of one content spread.
    winners = marked.join(found, (F.col("sha") == F.col("of_sha")) & F.col("id").eqNullSafe(F.col("keep_id")))
    single = winners.where("n_keep = 1").select("row.*")
    # Rows that repeat id and content: any one of them stays.
    again = winners.where("n_keep > 1").dropDuplicates(["sha"]).select("row.*")
    return single.unionByName(again)
