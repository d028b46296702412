"""Language identification by a byte convolutional network.

A text's UTF-8 is cut to windows of a fixed number of bytes, the last filled with zeros.
Bytes have learned vectors; filters of several widths run over a window, the largest value
of each filter goes on, and a softmax names the language.  The network is trained in numpy
with Adam on all windows of a bounded sample of documents: about `per_lang` of each language,
twice as many for all languages together at most, chosen by hashes of id and text (rows that
repeat both count once).  To apply it, each filter's offsets are multiplied with the byte
vectors once, in pairs of bytes, so that a filter's value is a sum of table entries.

A text's language is that of the largest mean probability over all its windows, and the
score is that mean.

Defined results: null texts and texts without a letter are `und` with score 0; so are all
texts where nothing can be learned.  A null language is no label.  Repeated rows stay; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, trim, whole_text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
VECTOR = 8
PER_LANG = 400
LANGS_BOUND = 500
_LETTER = regex.compile(r"\p{L}")


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text as rows of bytes; none for an empty text."""
    n = -(-len(text) // size)
    return np.frombuffer(text.ljust(n * size, b"\0"), dtype=np.uint8).reshape(n, size)


class Network:
    """Byte vectors, filters of each width with largest-value pooling, softmax."""

    def __init__(self, langs: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.5, (256, VECTOR)), "u": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "v": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p |= {f"k{w}": rng.normal(0, 1 / np.sqrt(w * VECTOR), (w * VECTOR, FILTERS)), f"b{w}": np.zeros(FILTERS)}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean loss over windows x of languages y."""
        p, (n, size), back = self.p, x.shape, {}
        e = p["e"][x]
        pooled, best, wide = [], [], []
        for w in WIDTHS:
            m = np.concatenate([e[:, i : size - w + 1 + i] for i in range(w)], axis=2)
            a = m @ p[f"k{w}"] + p[f"b{w}"]
            at = a.argmax(axis=1)
            best.append(at)
            wide.append(m)
            pooled.append(np.take_along_axis(a, at[:, None], axis=1)[:, 0])
        h = np.concatenate(pooled, axis=1)
        r = np.maximum(h, 0)
        s = r @ p["u"] + p["v"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        g = s / s.sum(axis=1, keepdims=True)
        g[np.arange(n), y] -= 1
        g /= n
        back["u"], back["v"] = r.T @ g, g.sum(axis=0)
        gh = (g @ p["u"].T) * (h > 0)
        ge = np.zeros_like(p["e"])
        for j, w in enumerate(WIDTHS):
            gw = gh[:, j * FILTERS : (j + 1) * FILTERS]
            rows = wide[j][np.arange(n)[:, None], best[j]]  # n, filters, width * vector
            back[f"k{w}"], back[f"b{w}"] = np.einsum("nfd,nf->df", rows, gw), gw.sum(axis=0)
            gm = (gw[:, :, None] * p[f"k{w}"].T[None]).reshape(n, FILTERS, w, VECTOR)
            for i in range(w):
                np.add.at(ge, x[np.arange(n)[:, None], best[j] + i], gm[:, :, i])
        back["e"] = ge
        return back

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 4e-3, seed: int = 6) -> Network:
        rng, t = np.random.default_rng(seed), 0
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                t += 1
                part = order[at : at + batch]
                for k, g in self.step(x[part], y[part]).items():
                    a, b = m[k]
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    self.p[k] -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> tuple:
        """For every width the sums of its filters over pairs of bytes, and over a last single byte."""
        e, out = self.p["e"], []
        for w in WIDTHS:
            k = self.p[f"k{w}"].reshape(w, VECTOR, FILTERS)
            one = [(e @ k[i]).astype(np.float32) for i in range(w)]
            parts = [(one[i][:, None] + one[i + 1][None]).reshape(65536, FILTERS) for i in range(0, w - 1, 2)]
            out.append((w, parts, one[-1] if w % 2 else None, self.p[f"b{w}"].astype(np.float32)))
        return out, self.p["u"].astype(np.float32), self.p["v"].astype(np.float32), self.langs


def probabilities(x: np.ndarray, tables: tuple) -> np.ndarray:
    """The softmax of every window, by sums of table entries."""
    out, u, v, _ = tables
    pooled = []
    pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
    size = x.shape[1]
    for w, parts, last, bias in out:
        n = size - w + 1
        a = parts[0][pair[:, :n]]
        for i, p in enumerate(parts[1:], 1):
            a += p[pair[:, 2 * i : 2 * i + n]]
        if last is not None:
            a += last[x[:, w - 1 : w - 1 + n]]
        pooled.append(a.max(axis=1) + bias)
    s = np.maximum(np.concatenate(pooled, axis=1), 0) @ u + v
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True)


def _fit(langs: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        x, y, at = [], [], {name: i for i, name in enumerate(langs)}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                w = windows(text.encode())
                if len(w) and _LETTER.search(text):
                    x.append(w)
                    y += [at[lang]] * len(w)
        if x:
            yield pd.DataFrame({"model": [pickle.dumps(Network(langs).fit(np.concatenate(x), np.array(y)).tables())]})

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn=None, per_lang: int = PER_LANG, bound: int = LANGS_BOUND) -> bytes | None:
    """The pickled tables of a network (under 30 MB for any data); None where nothing can be learned."""
    known = docs.where(F.col(lang_col).isNotNull())
    if learn is not None:
        known = known.where(learn(id_col))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().limit(bound + 1).collect()}
    if len(counts) > bound:
        raise ValueError(f"language identification: more than {bound} languages")
    if not counts:
        return None
    langs, grain = sorted(counts), 1 << 30
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(grain, int(grain * per_lang / counts[lang])))))
    number = F.xxhash64(F.col(id_col).cast("string"), whole_text(text_col), F.lit(9))
    lang = F.col(lang_col).cast("string")
    rows = known.select(whole_text(text_col).alias("text"), lang.alias("lang"), number.alias("o")).where(F.pmod("o", F.lit(grain)) < share[F.col("lang")])
    # Bounded by per_lang and the number of languages: one task trains.
    rows = rows.dropDuplicates(["o", "lang"]).orderBy("o", "lang").limit(2 * per_lang * len(langs)).select("text", "lang")
    got = rows.mapInPandas(_fit(langs), "model binary").collect()
    return bytes(got[0].model) if got else None


def predict(docs: DataFrame, model: bytes | None, id_col: str = "doc_id", text_col: str = "text", chunk: int = 256) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        tables = pickle.loads(sent.value) if sent.value else None
        for b in batches:
            found = [("und", 0.0)] * len(b)
            held: list[np.ndarray] = []
            owner: list[int] = []
            sums = np.zeros((len(b), len(tables[3]) if tables else 1))
            number = np.ones(len(b))

            def flush() -> None:
                if held:
                    x = np.concatenate(held)
                    np.add.at(sums, np.array(owner), probabilities(x, tables))
                    held.clear()
                    owner.clear()

            for i, text in enumerate(b["text"]):
                if tables is None or not _LETTER.search(text):
                    continue
                w = windows(text.encode())
                number[i] = len(w)
                for at in range(0, len(w), chunk):
                    held.append(w[at : at + chunk])
                    owner += [i] * len(held[-1])
                    if len(owner) >= chunk:
                        flush()
                found[i] = None
            flush()
            mean = sums / number[:, None]
            found = [f or (tables[3][k := int(m.argmax())], float(m[k])) for f, m in zip(found, mean)]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": [f[0] for f in found], "score": [min(1.0, f[1]) for f in found]})
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the ids whose fold isn't 0."""
    model = train(docs, id_col, text_col, lang_col, learn=lambda c: fold(c) != 0, **options)
    return predict(docs, model, id_col, text_col).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")
