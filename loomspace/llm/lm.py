"""Scores of texts under a bigram model with deleted interpolation.

The probability of a word after another is a mixture of the bigram's and the word's
maximum-likelihood estimates and a uniform share.  The weights of the mixture depend on how
frequent the context is (buckets of powers of two); expectation-maximisation learns them on
a fold of the training documents, held out from the counts that it is given.  For that the
two estimates of a held-out token, as multiples of the uniform one, are rounded to half
octaves and counted, so that the driver holds a table of fixed size, whatever the corpus;
scores use the estimates themselves.  In the end all training documents count.

How it runs: documents are packed to chunks of some MB, each with the hashes of its
distinct words and the numbers of its tokens.  A chunk sends the sorted keys of its words
and bigrams, once each, with its counts, as packed arrays to buckets of the key space; a
bucket adds up equal keys and answers each chunk with totals in the order of its keys.  So
a frequent word is one key a chunk, and no task holds more than a bucket or a chunk; their
numbers grow with the input.  A chunk has a row for each bucket in which it has keys: the
rows grow faster than the input until most hold a single key, and in proportion to the
chunks' distinct keys from there on, as in any count by key.  Texts are read once; after
that chunks and answers meet by chunk.  Keys are 63-bit hashes.

Defined results: null is the empty text, which has one token, its end.  With no training
text every count is zero and every probability uniform.  Repeated rows count as often as
they come; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fold, trim, whole_text

CHUNK_BYTES = 13 << 20
BUCKET_TOKENS = 1_500_000
COUNTED, DELETED, UNSEEN = 0, 1, 2  # documents that count, those the weights are learned on (they count too), others
MAIN, LATE = 0, 1  # chunks of counted and unseen documents, and of those the weights are learned on
OCTAVE = 2  # bins for the ratio of two estimates, for each power of two
BINS = 128  # more than any ratio of 64-bit counts needs
CONTEXT_BUCKETS = 48
_END = xxhash.xxh64_intdigest(b"\n")
_BEGIN = xxhash.xxh64_intdigest(b"\n\n")


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_keys(h: np.ndarray) -> np.ndarray:
    return _mixed(h) | np.uint64(1)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * np.uint64(0x9E3779B97F4A7C15) + second) & ~np.uint64(1)


_CHUNK = "chunk long, part int, ids binary, tokens binary, sizes binary, vocabulary binary, n_learned long, n_unseen long"


class _Builder:
    def __init__(self, part: int) -> None:
        self.part = part
        self.clear()

    def clear(self) -> None:
        self.ids: list[tuple[bool, int, bool]] = []
        self.sizes: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.seen: dict[bytes, int] = {}
        self.bytes = 0

    def add(self, doc_id: int | None, unseen: bool, text: str) -> None:
        words = text.encode().lower().split()  # both know ASCII only
        seen = self.seen
        self.tokens.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint32, count=len(words)))
        self.ids.append((doc_id is not None, doc_id or 0, unseen))
        self.sizes.append(len(words))
        self.bytes += len(text)

    def row(self, chunk: int) -> dict:
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.seen), dtype=np.uint64, count=len(self.seen))
        tokens = np.concatenate([*self.tokens, np.empty(0, dtype=np.uint32)])
        # Frequent words first: their numbers then are small and pack well.
        order = np.argsort(-np.bincount(tokens, minlength=len(h)), kind="stable")
        rank = np.empty(len(h), dtype=np.uint32)
        rank[order] = np.arange(len(h), dtype=np.uint32)
        unseen = sum(n + 1 for n, i in zip(self.sizes, self.ids) if i[2])
        out = {
            "chunk": chunk, "part": self.part, "ids": pack(np.array(self.ids, dtype=np.int64).reshape(-1)),
            "tokens": pack(rank[tokens].astype(np.uint32)), "sizes": pack(np.array(self.sizes, dtype=np.uint64)),
            "vocabulary": h[order].tobytes(), "n_learned": len(tokens) + len(self.sizes) - unseen, "n_unseen": unseen,
        }
        self.clear()
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = (TaskContext.get().partitionId() << 24) if TaskContext.get() else 0
    builders, n = [_Builder(MAIN), _Builder(LATE)], 0
    for b in batches:
        for doc_id, kind, text in zip(*(c.to_pylist() for c in b.columns)):
            x = builders[LATE if kind == DELETED else MAIN]
            x.add(doc_id, kind == UNSEEN, text)
            if x.bytes >= CHUNK_BYTES:
                yield pa.RecordBatch.from_pylist([x.row(place + n)], schema=_chunk_schema())
                n += 1
    for x in builders:
        if x.ids:
            yield pa.RecordBatch.from_pylist([x.row(place + n)], schema=_chunk_schema())
            n += 1
    trim()


def _chunk_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _CHUNK.split(", ")])


class Chunk:
    """A chunk's tokens, each text's end among them, and the keys that it asks for."""

    def __init__(self, ids: bytes, tokens: bytes, sizes: bytes, vocabulary: bytes) -> None:
        n = unpack(sizes, np.uint64).astype(np.int64)
        self.ids = unpack(ids, np.int64).reshape(-1, 3)
        h = np.append(np.frombuffer(vocabulary, dtype=np.uint64), np.uint64(_END))
        t = unpack(tokens, np.uint32)
        self.ends = np.cumsum(n + 1) - 1  # places of the ends of texts
        self.word = np.full(len(t) + len(n), len(h) - 1, dtype=np.int64)
        inside = np.ones(len(self.word), dtype=bool)
        inside[self.ends] = False
        self.word[inside] = t
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)).astype(np.int64) if len(n) else np.empty(0, dtype=np.int64)
        self.sizes = n + 1
        own = h[self.word]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[self.starts] = np.uint64(_BEGIN)
        learned = np.repeat(self.ids[:, 2] == 0, self.sizes)
        self.pairs, self.pair = np.unique(pair_keys(before, own), return_inverse=True)
        pair_counts = np.bincount(self.pair[learned], minlength=len(self.pairs))
        word_counts = np.bincount(self.word[learned], minlength=len(h))
        words = word_keys(h)
        both, counts = np.concatenate((words, self.pairs)), np.concatenate((word_counts, pair_counts)).astype(np.uint64)
        order = np.argsort(both, kind="stable")
        self.keys, self.counts = both[order], counts[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.word_at, self.pair_at = place[: len(words)], place[len(words) :]  # where the answers lie

    def of_words(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every token the totals of the word, of its context and of both."""
        of = totals[self.word_at]
        word = of[self.word]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[self.starts] = of[-1]  # a beginning is a context as often as there are texts
        return word, context, totals[self.pair_at][self.pair]


_ASKED = "bucket long, chunk long, part int, keys binary, counts binary"


def _asked(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                c = Chunk(r.ids, r.tokens, r.sizes, r.vocabulary)
                bucket = (c.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(c.keys), dtype=np.int64)
                cuts = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]))
                rows = []
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    keys = c.keys[lo:hi]
                    steps = np.diff(keys, prepend=np.uint64(bucket[lo] << (64 - bits) if bits else 0)).astype(np.uint64)
                    rows.append((bucket[lo], r.chunk, r.part, pack(steps), pack(c.counts[lo:hi])))
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "part", "keys", "counts"])
        trim()

    return run


_ANSWER = "chunk long, bucket long, part int, totals binary, counted binary, distinct long"


def _answers(bits: int):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        base = np.uint64(int(b["bucket"].iloc[0]) << (64 - bits) if bits else 0)
        keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) + base for k in b["keys"]]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros((2, len(distinct)), dtype=np.uint64)
        cuts = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        for lo, hi, part, counts in zip(cuts[:-1], cuts[1:], b["part"], b["counts"]):
            totals[part][at[lo:hi]] += unpack(counts, np.uint64)  # a chunk has each key once
        both = totals.sum(axis=0)
        known = int(((distinct & np.uint64(1)).astype(bool) & (both > 0)).sum())
        # Only chunks that the weights are learned on need to know what the others alone have counted.
        rows = [(c, b["bucket"].iloc[0], part, pack(both[at[lo:hi]]), pack(totals[MAIN][at[lo:hi]]) if part == LATE else None, 0) for c, part, lo, hi in zip(b["chunk"], b["part"], cuts[:-1], cuts[1:])]
        return pd.DataFrame([*rows, (-1, b["bucket"].iloc[0], -1, None, None, known)], columns=[f.split()[0] for f in _ANSWER.split(", ")])

    return run


def _estimates(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n: float, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bigram's and the word's estimates and the bucket of the context."""
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(context > 0, pair / context, 0.0)
    one = word / n if n else np.zeros(len(word))
    return two, one, np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0).clip(0, CONTEXT_BUCKETS - 1)


def _bin(ratio: np.ndarray) -> np.ndarray:
    """0 for no share, else a bin of the ratio to the uniform estimate."""
    return np.where(ratio > 0, 1 + (OCTAVE * np.log2(np.maximum(ratio, 1e-300)) + BINS // 2).round().clip(0, BINS - 2), 0).astype(np.int64)


def _met(chunk: pd.DataFrame, answers: pd.DataFrame, column: str) -> tuple[Chunk, np.ndarray]:
    r = chunk.iloc[0]
    answers = answers.sort_values("bucket")
    return Chunk(r.ids, r.tokens, r.sizes, r.vocabulary), np.concatenate([unpack(x, np.uint64) for x in answers[column]]).astype(np.float64)


def _events(n: float, v: int):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if chunk.empty:
            return pd.DataFrame({"code": [], "n": []})
        c, counted = _met(chunk, answers, "counted")
        two, one, bucket = _estimates(*c.of_words(counted), n, v)
        code, times = np.unique((bucket * BINS + _bin(two * (v + 1))) * BINS + _bin(one * (v + 1)), return_counts=True)
        return pd.DataFrame({"code": code, "n": times})

    return run


def learn_weights(codes: np.ndarray, times: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Rows of weights (bigram, word, uniform) for every bucket of contexts, by expectation-maximisation.

    A bucket without events has the weights of all events together.
    """
    bucket, rest = np.divmod(codes, BINS * BINS)
    bins = np.stack(np.divmod(rest, BINS))
    ratio = np.where(bins > 0, 2.0 ** ((bins - 1 - BINS // 2) / OCTAVE), 0.0)
    parts = np.stack([ratio[0], ratio[1], np.ones(len(codes))], axis=1)

    def fitted(of: np.ndarray) -> np.ndarray:
        w, x, t = np.full(3, 1 / 3), parts[of], times[of].astype(np.float64)
        for _ in range(rounds):
            share = x * w
            share *= (t / share.sum(axis=1))[:, None]
            w = (share.sum(axis=0) + 1e-3) / (t.sum() + 3e-3)
        return w

    everything = fitted(np.arange(len(codes))) if len(codes) else np.array([0.0, 0.0, 1.0])
    return np.array([fitted(of) if len(of := np.flatnonzero(bucket == k)) else everything for k in range(CONTEXT_BUCKETS)])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(n: float, v: int, weights: np.ndarray):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if chunk.empty:
            return pd.DataFrame({k.split()[0]: [] for k in _SCORES.split(", ")})
        c, totals = _met(chunk, answers, "totals")
        word, context, pair = c.of_words(totals)
        two, one, bucket = _estimates(word, context, pair, n, v)
        w = weights[bucket]
        with np.errstate(divide="ignore"):
            model = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (v + 1))
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
        add = lambda x: np.add.reduceat(x, c.starts)
        doc_id = pd.array(c.ids[:, 1], dtype="Int64")
        doc_id[c.ids[:, 0] == 0] = pd.NA
        return pd.DataFrame({"doc_id": doc_id, "held_out": c.ids[:, 2] == 1, "n_tokens": c.sizes, "n_known": add((word > 0).astype(np.int64)), "base_score": add(base), "score": add(model)})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unseen=None, deleted=None, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    unseen and deleted: conditions on the id, of documents not to learn from, and of those
    among the others that the weights are learned on.
    """
    unseen = unseen or (lambda c: fold(c) == 1)
    deleted = deleted or (lambda c: fold(c) == 2)
    kind = F.when(unseen(id_col), UNSEEN).when(deleted(id_col), DELETED).otherwise(COUNTED)
    chunks = checkpointed(docs.select(F.col(id_col).cast("long"), kind, whole_text(text_col)).mapInArrow(_chunks, _CHUNK))
    tokens = {r.part: r for r in chunks.groupBy("part").agg(F.sum("n_learned").alias("learned"), F.sum("n_unseen").alias("unseen")).collect()}
    of = lambda part, what: tokens[part][what] if part in tokens else 0
    n_counted, n = of(MAIN, "learned"), of(MAIN, "learned") + of(LATE, "learned")
    bits = max(0, -(-(n + of(MAIN, "unseen")) // bucket_tokens) - 1).bit_length()
    answers = checkpointed(chunks.mapInPandas(_asked(bits), _ASKED).groupBy("bucket").applyInPandas(_answers(bits), _ANSWER))
    v = answers.where("chunk = -1").agg(F.sum("distinct")).first()[0] or 0

    def met(some: DataFrame, told: DataFrame, what, schema: str) -> DataFrame:
        return some.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(what, schema)

    late = F.col("part") == LATE
    events = met(chunks.where(late), answers.where(late).select("chunk", "bucket", "counted"), _events(n_counted, v), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    got = events.limit(CONTEXT_BUCKETS * BINS * BINS).toPandas()  # that many codes at most
    weights = learn_weights(got["code"].to_numpy(dtype=np.int64), got["n"].to_numpy(dtype=np.int64))
    out = met(chunks, answers.where("chunk >= 0").select("chunk", "bucket", "totals"), _scores(n, v, weights), _SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
