"""What the kernels of quality and of near duplicates hold at once in a Python worker, besides the batch itself."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tidelode.llm import ngram_join, quality, shingles

WORDS = [f"w{i % 997}{'.,;'[i % 3]}" for i in range(2500)]
#: 8 MB in texts of 8 kB, with null and empty ones.
TEXT = pa.array([None, "", *[" ".join(WORDS[i % 50 : i % 50 + 1400]) for i in range(1000)]])


def peak_mb(f):
    shingles._powers.clear()
    f()  # what is made once
    shingles._powers.clear()
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def gather(monkeypatch, text):
    """The rows that a task of context_sums makes of one batch."""
    caught = []
    monkeypatch.setattr(quality, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))

    class Rows:
        sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda name: "16"))

        def mapInArrow(self, f, schema):
            caught.append(f)
            return self

        def repartition(self, *by):
            return self

        def collect(self):
            return []

    quality.context_sums(Rows())
    out = next(caught[0](iter([pa.RecordBatch.from_arrays([text], names=["text"])])))
    return np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in out.column(2)]).reshape(quality.BUCKETS, -1)


def test_scores_take_little_memory():
    vectors = np.ones((quality.BUCKETS, quality.DIMS), np.float32)
    assert peak_mb(lambda: quality.pooled(TEXT, vectors)) < 20


def test_context_sums_take_little_memory(monkeypatch):
    assert peak_mb(lambda: gather(monkeypatch, TEXT)) < 30


def test_context_sums_are_those_of_plain_python(monkeypatch):
    text = TEXT.slice(0, 5)
    dims, signs = quality._index_vectors()
    sums = np.zeros((quality.BUCKETS, quality.DIMS + 1), np.int64)
    for _, _, words, n in quality._words(text):
        for doc in np.split(words, np.cumsum(n)[:-1]):
            for i, w in enumerate(doc):
                sums[w, quality.DIMS] += 1
                for j in range(max(0, i - quality.WINDOW), min(len(doc), i + quality.WINDOW + 1)):
                    for d in range(quality.SPIKES * (j != i)):
                        sums[w, dims[doc[j], d]] += signs[doc[j], d]
    for size in (quality.CHUNK_BYTES, 64):
        monkeypatch.setattr(quality, "CHUNK_BYTES", size)
        assert (gather(monkeypatch, text) == sums).all()


def test_a_block_of_the_join_takes_little_memory():
    chunk = [np.arange(i, i + 300_000, dtype=np.uint32) * 2 for i in range(0, 375, 75)]  # most fingerprints are in each
    rows = [(0, i, 0, x.tobytes(), np.zeros(len(x), np.uint16).tobytes(), b"") for i, x in enumerate(chunk)]
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), ngram_join._DEALT, strict=True)], names=["block", "chunk", "kind", "data", "owners", "more"])
    assert peak_mb(lambda: ngram_join._meet(True)(table)) < 65
