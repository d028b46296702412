"""SimHash near-deduplication with pivot distance tables.

A fingerprint is the bitwise majority of the XXH64 of a text's word shingles.  For every
distinct fingerprint Hamming distances to reference fingerprints are computed: to one base,
to references that differ from the base in a bit of one segment of the bits, and to random
ones.  The differences of a segment's references' distances and the base's depend on that
segment alone.  Two fingerprints at most two bits apart agree on two of four segments at
least, and so on all those differences of some pair of segments; that is the key on which
the six tables are joined.  Pairs with a distance coordinate more than two apart are
discarded, and the survivors are verified by their exact Hamming distance.

The fingerprints of a key are paired only where they are `crowd` at most.  A larger key has
pivot tables of its own: what the key leaves open is cut to four segments of half the size,
and so on, from 16 to 8 to 4 bits.  Those that then share a key agree on 56 bits, so that
they are 256 at most.  So no link is lost and no large group is paired.

Defined results: null is the empty text; a text without words has fingerprint zero and is
linked like any other; a text of fewer words than a shingle is one shingle.  Copies share a
fingerprint and are linked through it.  Null ids stay in the result, with the least id of
their group.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hot_keys, lower_az, packed, salted_join, trim, whole_text
from .components import components

SHINGLE = 3
LINK_BITS = 2
SEED = 42
CROWD = 64
WIDTHS = (16, 8, 4)  # of the four segments, level by level
RANDOM_PIVOTS = 24


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _draw(n: int, bits: int = 64, seed: int = 20) -> list[int]:
    return [int(x) & ((1 << bits) - 1) for x in np.random.default_rng(seed).integers(0, 1 << 64, size=n, dtype=np.uint64)]


BASE = _draw(1)[0]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text whose letters are folded already."""
    words = text.encode().split()  # bytes.split() parts at space and 09-0D, nothing else
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    ends = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    counts, n, size = np.zeros(64, dtype=np.int64), max(1, len(words) - shingle + 1), 1 << 16
    grams = zip(*ends)
    for _ in range(0, n, size):
        part = np.fromiter((h(b" ".join(g), SEED) for g in islice(grams, size)), dtype=np.uint64)
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    """The last column, a text, is replaced by its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.columns[-1]), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out.view(np.int64))], names=[*b.schema.names[:-1], "fp"])
        trim()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lower_az(whole_text(text_col)).alias("body"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(_signed(b)) if isinstance(b, int) else b)).cast("int")


def pivots(n: int = RANDOM_PIVOTS) -> Column:
    """The distances of fp to the base and to n random references."""
    return F.array(*(_distance(F.col("fp"), r) for r in (BASE, *_draw(n, seed=22))))


def _keyed(rows: DataFrame, width: int) -> DataFrame:
    """(fp, key, free): rows (fp, key, free) with a key for each two of the four segments that begin at the bits `free`.

    The new `free` are the beginnings of the halves of the two other segments.
    """
    own = _distance(F.col("fp"), BASE)
    # The references of a segment differ from the base in one of its bits: fp ^ m is as far from the base as fp from base ^ m.
    local = lambda s: F.transform(F.array(*(F.lit(1 << i).cast("long") for i in range(width))), lambda m: _distance(F.col("fp").bitwiseXOR(F.call_function("shiftleft", m, s)), BASE) - own)
    rows = rows.withColumn("of", F.transform("free", local))
    some = []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        at = lambda x: F.col("free")[x]
        rest = F.array(at(k), at(k) + width // 2, at(m), at(m) + width // 2)
        some.append(F.struct(F.xxhash64("key", F.lit(t), F.col("of")[i], F.col("of")[j]).alias("key"), rest.alias("free")))
    return rows.select("fp", F.explode(F.array(*some)).alias("s")).select("fp", "s.key", "s.free")


def links(distinct: DataFrame, bits: int = LINK_BITS, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v), u < v: all pairs of fingerprints within two bits."""
    if bits != 2:
        raise ValueError("four segments are for two differing bits")
    rows, found = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.array(*(F.lit(16 * s) for s in range(4))).alias("free")), None
    for width in WIDTHS:
        keyed = _keyed(rows, width)
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        shared = checkpointed(keyed.join(sizes, "key"))
        last = width == WIDTHS[-1]
        few = shared if last else shared.where(F.col("n") <= crowd)
        few = few.select("key", "fp", pivots().alias("d"))
        a, b = few.select("key", F.col("fp").alias("u"), F.col("d").alias("du")), few.select("key", F.col("fp").alias("v"), F.col("d").alias("dv"))
        near = F.array_max(F.zip_with("du", "dv", lambda x, y: F.abs(x - y))) <= bits
        pairs = a.join(b, "key").where("u < v").where(near).where(_distance(F.col("u"), F.col("v")) <= bits).select("u", "v")
        found = pairs if found is None else found.unionByName(pairs)
        rows = shared.where(F.col("n") > crowd).select("fp", "key", "free")
        if last or rows.isEmpty():
            return found.distinct()


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id that can be reached)."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), crowd=crowd))
    of = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    joined = salted_join(marked, named, "fp", hot_keys(distinct, "fp", "n"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """The input's rows, one document of each component: that with the least id, a null id after all others.

    Ids needn't tell documents apart: a row is known by its id and its content together.  Of
    contents with the same least id, or with null ids, that of the least hash stays; of rows
    that share id and content any one.
    """
    body = lower_az(whole_text(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("sha"), body.alias("body"))
    marked = checkpointed(rows.mapInArrow(_fingerprints(SHINGLE), "doc_id long, sha binary, fp long"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")
    first = checkpointed(marked.groupBy("fp").agg(F.min(order).alias("first")))
    roots = components(links(first.select("fp"), crowd=crowd))
    of = first.join(roots, first.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    keep = of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("keep_id"), F.col("first.sha").alias("keep_sha"))
    again = marked.groupBy("doc_id", "sha").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("r_id"), F.col("sha").alias("r_sha"))
    keep = keep.join(again, F.col("keep_id").eqNullSafe(F.col("r_id")) & (F.col("keep_sha") == F.col("r_sha")), "left")
    keep = keep.select("keep_id", "keep_sha", F.col("r_sha").isNotNull().alias("again"))
    named = packed(docs, id=F.col(id_col).cast("long"), sha=F.unhex(F.sha2(body, 256)))
    found = named.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")))
    return found.where(~F.col("again")).select("row.*").unionByName(found.where("again").dropDuplicates(["keep_sha"]).select("row.*"))
