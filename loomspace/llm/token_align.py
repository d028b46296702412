"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut the bytes of a space and the text to tokens; their tokens are intervals of
bytes.  A task cuts its texts to units that begin with a space after a character that is no
white space.  No token of either tokenizer crosses the start of a unit: the byte-level pattern
never leaves white space in the middle, and the piece model has no piece with its space mark
behind another character (checked when it is loaded).  So the units are tokenized and aligned
apart, each distinct one once a task, and a text is the sequence of its units.

DuckDB does the work of a partition: tables of the tokens' intervals; two ASOF joins that find
the first and the last B token under an A token, and a range join for all between; window sums
over the common ends, which number the groups; and the join of documents with their units'
links.  A task counts the documents of each pair of ids, Spark adds up these partial counts,
and a second pass over the documents' stored pairs sums what each of them holds.

The table of pairs goes to all tasks only up to PAIRS_SENT rows; beyond, pairs are joined by
shuffle, those of many documents dealt to copies.

Defined results: texts that are null, empty, or whose tokens' bytes differ from the space and
the text have no tokens: zeros, and the empty string as digest.  Special tokens' strings are
ordinary text.  Rows are kept as they come, repeated or not; repeated rows count as documents
of their own.  A text of any length is handled whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import salted_join, slices, trim, written

UNIT = re.compile(r"\x20\s*(?:\S+(?:[^\S\x20]\s*\S*)*)?")
MARK = "▁"  # a space, in pieces
UNITS_KEPT = 700_000  # a task of 16 MB of Parquet meets about 540,000; forgetting has them learnt again
STRETCH_CHARS = 2000
BATCH_CHARS = 1 << 20
COUNTS_KEPT = 1_000_000
PAIRS_SENT = 2_000_000
MEMORY = "400MB"
SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, pair long, docs long"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteTokens:
    """The byte-level tokenizer: a file of the `tokenizers` library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        of, self.size = _byte_of(), max(vocabulary.values()) + 1
        self.bytes = [b""] * self.size
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """The piece tokenizer: a model of the `sentencepiece` library, which adds the space in front itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.bytes = self.own.get_piece_size(), []
        for i in range(self.size):
            piece = self.own.id_to_piece(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"a piece with a space behind another character: {piece!r}")
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece) if self.own.is_byte(i) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The texts begin with the space that the model adds; it adds none to nothing."""
        return [own or [self.own.piece_to_id(MARK)] for own in self.own.encode([t[1:] for t in texts], num_threads=1)]


def _tokenized(t: ByteTokens | PieceTokens, units: list[str], sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All units' ids, and how many each has; -1 for a unit whose tokens' bytes differ from its own.

    Units that end in a character are encoded many at once, as neighbours don't change their
    tokens, and told apart by their bytes; those of a stretch that differs one by one.
    """
    ids: list[np.ndarray] = []
    counts = np.full(len(units), -1, dtype=np.int64)
    stretches, at, chars = [[0, 0]], 0, 0
    for k, u in enumerate(units):
        chars += len(u)
        if k and (chars > STRETCH_CHARS or units[k - 1][-1].isspace()):
            stretches.append([k, k])
            chars = len(u)
        stretches[-1][1] = k + 1
    texts = ["".join(units[a:b]) for a, b in stretches]
    for (a, b), text, own in zip(stretches, texts, t.encode(texts)):
        flat = np.array(own, dtype=np.int64)
        ends = np.cumsum(lengths[flat])
        cuts = np.searchsorted(ends, np.cumsum(sizes[a:b]))
        if b"".join(map(t.bytes.__getitem__, own)) == text.encode() and (ends[cuts] == np.cumsum(sizes[a:b])).all():
            counts[a:b] = np.diff(cuts, prepend=-1)
            ids.append(flat)
            continue
        for k, alone in zip(range(a, b), t.encode(units[a:b])):
            if b"".join(map(t.bytes.__getitem__, alone)) == units[k].encode():
                counts[k] = len(alone)
                ids.append(np.array(alone, dtype=np.int64))
    return np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64), counts


# The pairs of overlapping tokens: an A token meets the B tokens from the last that starts at or before its start to the last that starts before its end.
LINKS = """
INSERT INTO links
SELECT span.unit, span.id * {size} + b.id AS pair, count(*) AS n
FROM (SELECT a.unit, a.id, f.i AS first, l.i AS last FROM a ASOF JOIN b f ON a.s >= f.s ASOF JOIN b l ON a.e > l.s) span
JOIN b ON b.i BETWEEN span.first AND span.last
GROUP BY ALL
"""
# The tokens in the order of the groups between common ends, A before B; a unit's end is such an end.
GROUPS = """
WITH cut AS (SELECT a.e FROM a JOIN b ON a.e = b.e),
t AS (SELECT a.unit, 0 AS side, a.i, a.id, cut.e IS NOT NULL AS ends FROM a LEFT JOIN cut ON a.e = cut.e UNION ALL SELECT b.unit, 1, b.i, b.id, cut.e IS NOT NULL FROM b LEFT JOIN cut ON b.e = cut.e)
SELECT unit, side, id, sum(ends::BIGINT) OVER (PARTITION BY side ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT - ends::BIGINT AS g FROM t ORDER BY g, side, i
"""
PAIRS = "CREATE OR REPLACE TEMP TABLE held AS SELECT doc, pair, sum(times * n)::INT AS times FROM used JOIN links ON used.unit = links.unit GROUP BY ALL"


class Aligner:
    """Aligns the texts of a task, with a table of the units met before."""

    def __init__(self, a: ByteTokens, b: PieceTokens) -> None:
        import duckdb

        self.a, self.b = a, b
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (a, b))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
        self.run("CREATE TEMP TABLE partial (pair BIGINT, docs BIGINT)")
        self.written = [f"{x}{i}" for i in range(max(a.size, b.size)) for x in ("", ";", "|", ",")]  # each id behind each separator
        self.forget()

    def run(self, sql: str) -> None:
        self.db.execute(sql).complete()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), dtype=np.int64)  # n_a, n_b, n_groups, n_links; -1 for a unit whose bytes differ
        self.run("CREATE OR REPLACE TEMP TABLE links (unit BIGINT, pair BIGINT, n BIGINT)")

    def learn(self, fresh: list[str]) -> None:
        """Tokenizes and aligns units that weren't met before."""
        first = len(self.groups)
        lengths = np.array([len(u.encode()) for u in fresh], dtype=np.int64)
        (ids_a, n_a), (ids_b, n_b) = (_tokenized(t, fresh, lengths, own) for t, own in ((self.a, self.len_a), (self.b, self.len_b)))
        ids_a, ids_b = ids_a[np.repeat(n_b >= 0, np.maximum(n_a, 0))], ids_b[np.repeat(n_a >= 0, np.maximum(n_b, 0))]
        good = np.flatnonzero((n_a >= 0) & (n_b >= 0))
        self.known.update(zip(fresh, range(first, first + len(fresh))))
        self.groups += [""] * len(fresh)
        sizes = np.full((len(fresh), 4), -1, dtype=np.int64)
        if len(good):
            for name, ids, n, own in (("a", ids_a, n_a, self.len_a), ("b", ids_b, n_b, self.len_b)):
                e = np.cumsum(own[ids])
                self.db.register(name, pa.table({"i": np.arange(len(ids)), "unit": np.repeat(good + first, n[good]), "id": ids, "s": e - own[ids], "e": e}))
            self.run(LINKS.format(size=self.b.size))
            got = self.db.sql(GROUPS).to_arrow_table()
            unit, side, g = (got[c].to_numpy() for c in ("unit", "side", "g"))
            start = np.concatenate(([True], g[1:] != g[:-1]))
            fresh_unit = np.concatenate(([True], unit[1:] != unit[:-1]))
            sign = np.where(fresh_unit, 0, np.where(start, 1, np.where(np.concatenate(([False], side[1:] != side[:-1])), 2, 3)))
            parts = list(map(self.written.__getitem__, (got["id"].to_numpy() * 4 + sign).tolist()))
            cuts = [*np.flatnonzero(fresh_unit).tolist(), len(parts)]
            for k, a, b in zip(unit[fresh_unit].tolist(), cuts, cuts[1:]):
                self.groups[k] = "".join(parts[a:b])
            sizes[good, 0], sizes[good, 1] = n_a[good], n_b[good]
            sizes[:, 2] = np.where(sizes[:, 0] < 0, -1, np.bincount(unit[start] - first, minlength=len(fresh)))
            sums = self.db.sql(f"SELECT unit, sum(n)::BIGINT AS n FROM links WHERE unit >= {first} GROUP BY unit").to_arrow_table()
            sizes[sums["unit"].to_numpy() - first, 3] = sums["n"].to_numpy()
            self.db.unregister("a")
            self.db.unregister("b")
        self.sizes = np.concatenate([self.sizes, sizes])

    def align(self, texts: list[str]) -> tuple[list[tuple], pa.Table]:
        """n_a, n_b, n_groups, n_links, digest of each text, and a table (doc, pairs, times) of those with links."""
        split = [UNIT.findall(" " + t) if t else [] for t in texts]
        fresh = list(set().union(*split).difference(self.known))
        if len(self.known) + len(fresh) > UNITS_KEPT and self.known:
            self.forget()
            fresh = list(set().union(*split))
        if fresh:
            self.learn(fresh)
        out, docs, units, times = [], [], [], []
        for k, own in enumerate(split):
            at = np.fromiter(map(self.known.__getitem__, own), dtype=np.int64, count=len(own))
            if not len(at) or self.sizes[at, 0].min() < 0:
                out.append((0, 0, 0, 0, ""))
                continue
            kinds, n = np.unique(at, return_counts=True)
            sums = self.sizes[kinds].T @ n
            digest = hashlib.sha256(";".join(map(self.groups.__getitem__, at.tolist())).encode()).hexdigest()
            out.append((*sums.tolist(), digest))
            docs.append(np.full(len(kinds), k))
            units.append(kinds)
            times.append(n)
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        self.db.register("used", pa.table({"doc": joined(docs), "unit": joined(units), "times": joined(times)}))
        self.run(PAIRS)
        self.run("INSERT INTO partial SELECT pair, count(*) FROM held GROUP BY pair")
        held = self.db.sql("SELECT doc, list(pair) AS pairs, list(times) AS times FROM held GROUP BY doc").to_arrow_table()
        self.db.unregister("used")
        return out, held

    def counts(self, last: bool = False) -> pa.Table | None:
        """Partial counts (pair, docs), once there are many of them, and at the end."""
        if not last and self.db.sql("SELECT count(*) FROM partial").fetchall()[0][0] < 2 * COUNTS_KEPT:
            return None
        self.run("CREATE OR REPLACE TEMP TABLE partial AS SELECT pair, sum(docs)::BIGINT AS docs FROM partial GROUP BY pair")
        if not last and self.db.sql("SELECT count(*) FROM partial").fetchall()[0][0] < COUNTS_KEPT:
            return None
        got = self.db.sql("SELECT pair, docs FROM partial").to_arrow_table()
        self.run("DELETE FROM partial")
        return got


def _aligned(a_path: str, b_path: str):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = {"groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}

    def rows(n: int, **columns) -> pa.RecordBatch:
        of = lambda c: types.get(c, pa.int64())
        flat = lambda x, c: (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x, of(c))).cast(of(c))
        return pa.RecordBatch.from_arrays([flat(columns[c], c) if c in columns else pa.nulls(n, of(c)) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(ByteTokens(a_path), PieceTokens(b_path)), TaskContext.get().partitionId() << 40

        def counted(last: bool) -> Iterator[pa.RecordBatch]:
            if (got := aligner.counts(last)) is not None:
                for at in range(0, len(got), 100_000):
                    part = got.slice(at, 100_000)
                    yield rows(len(part), pair=part["pair"], docs=part["docs"])

        def done(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            told, held = aligner.align(texts)
            where = np.full(len(texts), -1)
            where[held["doc"].to_numpy()] = np.arange(len(held))
            index = pa.array(where, mask=where < 0)
            own = zip(*told)
            columns = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), own))
            yield rows(len(texts), row=np.arange(number, number + len(texts)), doc_id=ids, **columns, pairs=held["pairs"].take(index), times=held["times"].take(index))
            number += len(texts)
            yield from counted(False)

        ids, texts, chars = [], [], 0
        for i, t in slices(batches):
            ids.append(i)
            texts.append(t or "")
            chars += len(texts[-1])
            if chars >= BATCH_CHARS:
                yield from done(ids, texts)
                ids, texts, chars = [], [], 0
        if texts:
            yield from done(ids, texts)
        yield from counted(True)
        del aligner
        trim()

    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", pairs_sent: int = PAIRS_SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row. The paths lead to both tokenizers' files on all machines."""
    rows = written(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_aligned(a_path, b_path), SCHEMA), "aligned")
    counts = rows.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("docs"))
    size = PieceTokens(b_path).size
    # An A id has as many pairs as B has ids at most.
    best = F.col("docs") == F.max("docs").over(W.partitionBy(F.floor(F.col("pair") / size)))
    counts = written(counts.select("pair", "docs", best.alias("best")), "pairs")
    own = rows.where("row IS NOT NULL").drop("pair", "docs")
    links = own.select("row", F.explode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))).alias("l")).select("row", "l.*")
    n, n_docs = counts.count(), None
    if n <= pairs_sent:
        judged = links.join(F.broadcast(counts), "pair")
    else:
        n_docs = own.count()
        hot = counts.where(F.col("docs") > max(1000, n_docs // 1000)).select(F.col("pair").alias("hot"))
        judged = salted_join(links, counts, "pair", hot)
    sums = judged.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = own.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
