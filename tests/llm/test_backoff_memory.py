"""Texts of the backoff scores move compressed, and a chunk's n-grams are sorted once."""

import numpy as np
import pyarrow as pa

from textdist.llm import backoff as B


def test_texts_move_compressed_and_come_back():
    texts = ["the same few words again " * 40, "x", "", None, "é " * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([0] * 5, pa.int32()), pa.array(texts)], names=["_k", "chunk", "_t"])
    small = pa.Table.from_batches(list(B._shrunk([batch])))
    assert B._texts(small).cast(pa.string()).to_pylist() == texts
    assert sum(len(t or b"") for t in small.column("_t").to_pylist()) < 300


def test_places_against_look_ups():
    rng = np.random.default_rng(4)
    words, bounds = rng.integers(0, 5, 60).astype(np.uint64), np.array([0, 0, 20, 21, 60])
    text, grams = B._grams(words, bounds, 3)
    hashes, _ = B._distinct(grams, len(words))
    places, whole = B._places(text, grams)
    assert hashes[whole] == B.WHOLE
    for (g, ok), (at, own) in zip(grams, places):
        assert (hashes[at] == g[ok]).all()
        mine = list(zip(text[ok], g[ok]))
        assert own.tolist() == [mine.count(m) for m in mine]
