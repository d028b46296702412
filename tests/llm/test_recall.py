"""Toxicity on held-out rows of the given tables, by the operator's own features and fit."""

import zlib
from pathlib import Path

import numpy as np
import pytest

from loomspace.llm import toxicity

WHERE = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not WHERE.exists(), reason="no tables here")
def test_most_held_out_toxic_texts_are_found():
    import pyarrow.parquet as pq

    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(WHERE / "documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(WHERE / "labels.parquet").to_pylist() if r["toxic"] is not None and r["doc_id"] in texts}
    places, stems = toxicity.Places(), toxicity.Stems()
    rows = [(zlib.crc32(str(i).encode()) % 5, np.unique(toxicity.features(texts[i], places, stems)).astype(np.int32), y) for i, y in sorted(labels.items())]
    bias, at, w = toxicity.averaged([(f, y) for k, f, y in rows if k])
    dense = np.zeros(1 << toxicity.BITS, dtype=np.float32)
    dense[at] = w
    told = [(y, bias + float(dense[f].sum()) >= 0) for k, f, y in rows if k == 0]
    found, toxic = sum(y and t for y, t in told), sum(y for y, _ in told)
    assert found >= 0.85 * toxic
    assert sum(t and not y for y, t in told) <= 0.01 * len(told)
