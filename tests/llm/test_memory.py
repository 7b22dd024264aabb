"""What a worker holds at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from heliogable.llm import pieces, substring


def test_pieces_in_small_runs(monkeypatch):
    """Texts are taken apart a few hundred at a time, whatever the batch; each row comes out once, in order."""
    seen = []

    class Stub:
        def encode(self, texts):
            seen.append(len(texts))
            yield from (np.full(len(t), k, np.int32) for k, t in enumerate(texts))

    monkeypatch.setattr(pieces, "model", lambda path: Stub())
    monkeypatch.setattr(pieces, "BATCH_IDS", 1000)
    n = 3 * pieces.TEXTS + 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None if k % 9 == 0 else "x" * (k % 5) for k in range(n)])], names=["doc_id", "text"])
    out = pa.Table.from_batches(pieces._run("", [], False)(iter([batch])))
    assert out["doc_id"].to_pylist() == list(range(n)) and max(seen) <= pieces.TEXTS
    assert out["n_pieces"].to_pylist() == [0 if k % 9 == 0 else k % 5 for k in range(n)]


def test_chunk_without_its_texts(tmp_path):
    """Steps that need only hashes drop a chunk's texts."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c", None])], names=["id", "text"])
    (row,) = substring._pack(f"file://{tmp_path}", [])(iter([batch]))
    path = row["chunk"][0].as_py()
    assert not hasattr(substring._Chunk(path), "texts") and not hasattr(substring._Chunk(path, checked=True), "table")
    assert substring._Chunk(path, whole=True).texts == [b"a b c", b""]
