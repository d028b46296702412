"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words (matches of the tokenizer's pattern) of a batch of documents lie one
after the other in one array of symbols.  An inverted index leads from the rank of a token
to the positions whose symbol and its neighbour join to that token.  The ranks are taken in
order; each applies to all its positions in all words at once, and only the pairs with the
touched neighbours are entered anew.  A position whose new pair has a lower rank than the
one just applied would call for another order inside its word: such words are encoded one
by one, so that the ids are those of the greedy rule in every case.

The corpus of a replay is a batch of one task, not all documents: a word's ids don't depend
on other words, and so no text or token is shuffled.  The index is keyed by the token that a
pair joins to, which stands for all pairs that join to it.  A bounded table of words met before saves replays.

Defined results: a null text is the empty text and has no ids.  Special tokens are ordinary
text.  Rows are kept as they come, repeated or not; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, trim, whole_text

WORDS_KEPT = 100_000
BATCH_CHARS = 2 << 20


class Ranks:
    """A vocabulary of ranks: bytes of each token, and the token that two tokens join to."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.single = np.full(256, -1, dtype=np.int64)
        for b, i in ranks.items():
            if len(b) == 1:
                self.single[b[0]] = i
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks some single bytes")
        self.base = max(ranks.values()) + 1
        keys, to = [], []
        for b, i in ranks.items():
            for cut in range(1, len(b)):
                if (x := ranks.get(b[:cut])) is not None and (y := ranks.get(b[cut:])) is not None:
                    keys.append(x * self.base + y)
                    to.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.pairs, self.joined = np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int64)[order]

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token of each pair, -1 where there is none."""
        keys = a * self.base + b
        at = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
        return np.where(self.pairs[at] == keys, self.joined[at], -1) if len(self.pairs) else np.full(len(keys), -1)

    def greedy(self, word: bytes) -> list[int]:
        """One word: the neighbours of the lowest rank join, the leftmost first; a heap holds the pairs."""
        n = len(word)
        part, after, before = [word[i : i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has joined elsewhere since
            part[i], part[j], after[i] = part[i] + part[j], b"", after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := self.ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
        return [self.ranks[p] for p in part if p]


def parse_ranks(text: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(str.split, filter(None, text.splitlines()))}


def replay(words: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each word (none empty) as little-endian unsigned 32-bit integers."""
    text = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(text)
    sym = ranks.single[text]
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    after = np.arange(1, n + 1)  # the next symbol of the same word, n at its end
    after[first[1:]] = n
    before = np.arange(-1, n - 1)
    before[first[:n]] = -1
    odd = np.zeros(n, dtype=bool)  # positions of words to encode one by one
    mark = np.zeros(n + 1, dtype=bool)
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    waiting: list[int] = []

    def enter(at: np.ndarray, rank: np.ndarray) -> None:
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
        for a, b, r in zip(cuts, cuts[1:], rank[cuts[:-1]].tolist()):
            if r not in index:
                heapq.heappush(waiting, r)
            index[r].append(at[a:b])

    left = np.flatnonzero(after < n)
    rank = ranks.join(sym[left], sym[after[left]])
    enter(left[rank >= 0], rank[rank >= 0])
    while waiting:
        r = heapq.heappop(waiting)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[(sym[at] >= 0) & (after[at] < n)]
        at = at[ranks.join(sym[at], sym[after[at]]) == r]
        if not len(at):
            continue
        if len(at) > 1:
            at.sort()
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            mark[at] = True
            if mark[after[at]].any():
                at = _apart(at, after)
            mark[at] = False
        gone = after[at]
        mark[gone] = False
        sym[at] = r
        sym[gone] = -1
        after[at] = after[gone]
        more = at[after[at] < n]
        before[after[more]] = more
        prior = before[at]
        touched = np.concatenate((more, prior[prior >= 0]))
        new = ranks.join(sym[touched], sym[after[touched]])
        good = new >= 0
        touched, new = touched[good], new[good]
        odd[touched[new <= r]] = True
        enter(touched, new)
    kept = sym >= 0
    ids = sym[kept].astype("<u4").tobytes()
    cuts = (4 * np.concatenate(([0], np.cumsum(kept)))[starts]).tolist()
    out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
    for w in np.unique(np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1):
        out[w] = np.array(ranks.greedy(words[w]), dtype="<u4").tobytes()
    return out


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places that overlap (a a a), every other one from the left; at is sorted."""
    keep, used = [], set()
    for p, q in zip(at.tolist(), after[at].tolist()):
        if p not in used:
            keep.append(p)
            used.add(q)
    return np.array(keep, dtype=np.int64)


class Codec:
    """Encodes lists of texts with a table of the words met before, and decodes ids."""

    def __init__(self, ranks: Ranks, pattern: str) -> None:
        self.ranks, self.pattern, self.known = ranks, regex.compile(pattern), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        fresh = list(set().union(*split).difference(self.known))
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.known, fresh = {}, list(set().union(*split))
        if fresh:
            self.known.update(zip(fresh, replay([w.encode() for w in fresh], self.ranks)))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=1)
def _ranks(text: str) -> Ranks:
    """One vocabulary stays in a worker; the words that a task has met go with the task."""
    return Ranks(parse_ranks(text))


def _batches(rows: Iterator[tuple], size: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Lists of rows of some million characters; a row's last value is its text."""
    part, chars = [], 0
    for row in rows:
        part.append(row)
        chars += len(row[-1])
        if chars >= size:
            yield part
            part, chars = [], 0
    if part:
        yield part


def vocabulary(spark: SparkSession, path: str):
    """The rank file's text for the tasks: some hundred KB, of a size that no data changes."""
    with open(path, encoding="ascii") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    ranks = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(_ranks(ranks.value), pattern)
        for part in _batches(slices(batches)):
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in codec.encode([t for *_, t in part])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        del codec
        trim()

    return docs.select(F.col(id_col).cast("long"), whole_text(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes binary): what the ids stand for; null ids count as none, null entries are skipped."""
    ranks = vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {i: b for b, i in parse_ranks(ranks.value).items()}
        for b in batches:
            out = [b"".join(of[i] for i in ids or () if i is not None) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col(id_col).cast("long"), ids_col).mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded again and digested in one task."""
    ranks = vocabulary(docs.sparkSession, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(_ranks(ranks.value), pattern)
        for part in _batches(slices(batches)):
            ids = codec.encode([t for _, t in part])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in part], pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]),
                ],
                names=names,
            )
        del codec
        trim()

    return docs.select(F.col(id_col).cast("long"), whole_text(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
