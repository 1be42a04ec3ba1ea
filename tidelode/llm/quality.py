"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network on them.

Words are runs of letters and digits, and runs of other marks, case kept. Each hashes to one of
BUCKETS; a bucket has a sparse random index vector, and its context vector is the sum of the index
vectors of all words within WINDOW places of it, over all documents: whole numbers, so that the
sums are the same in whatever order they come. The table of context vectors has a fixed size (BUCKETS
by DIMS numbers, 2 MB) and is broadcast. A document is pooled into the mean of its words' vectors and
the mean absolute difference of neighbours.

The network is fitted on the driver on at most ``train_rows`` labelled documents (those least by a
hash of doc_id), which is a documented bound; one fifth of them sets the temperature that calibrates
its probabilities. Everything else covers all rows and whole texts.

Cases: null, empty and wordless texts are pooled into zeros and get the score of that. Labels that
are null or whose document isn't there are ignored; of several labels for a document the least
counts. Without labels the score is 0.5, with one class only it is that class. Rows with equal doc_id
each get their score; of their texts one is learnt from. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name
from .shingles import _power_tables, mix

BUCKETS = 1 << 14
DIMS = 32
SPIKES = 2
WINDOW = 2
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
_BLOCKS = 16
#: Bytes of text hashed at once; the arrays in flight take some hundred times as much, in each Python worker of an executor.
CHUNK_BYTES = 1 << 16
_U = np.uint64
#: 0 white space, 1 letters, digits and all beyond ASCII, 2 other marks.
_KIND = np.full(256, 2, np.uint8)
_KIND[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_KIND[[32, 9, 10, 11, 12, 13]] = 0


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket: SPIKES dimensions, and a sign for each."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, DIMS, (BUCKETS, SPIKES)), rng.choice(np.array([-1, 1]), (BUCKETS, SPIKES))


def _words(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bucket of each word, words of each document) of chunks of documents."""
    text = text.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(text):
            b = min(max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK_BYTES, side="right")) - 1), len(text))
            part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            size = len(part)
            if not size:
                yield a, b, np.zeros(0, np.int64), np.zeros(b - a, np.int64)
                a = b
                continue
            kind = _KIND[part]
            cut = np.ones(size + 1, bool)
            cut[1:size] = kind[1:] != kind[:-1]
            cut[o] = True
            ink = kind > 0
            s, e = np.flatnonzero(cut[:-1] & ink), np.flatnonzero(cut[1:] & ink) + 1
            power, inverse = _power_tables(size)
            sums = np.zeros(size + 1, _U)
            np.cumsum((part.astype(_U) + _U(1)) * power[:size], out=sums[1:])
            h = mix((sums[e] - sums[s]) * inverse[s])
            yield a, b, (h % _U(BUCKETS)).astype(np.int64), np.diff(np.searchsorted(s, o))
            a = b


def context_sums(text: DataFrame) -> np.ndarray:
    """BUCKETS x (DIMS + 1) whole numbers over all texts: context vectors, and how often each bucket occurs."""
    spark = text.sparkSession
    groups = max(1, min(64, int(spark.conf.get("spark.sql.shuffle.partitions")) // _BLOCKS))
    schema = "block int, part int, sums binary"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = _index_vectors()
        total = np.zeros(BUCKETS * DIMS, np.int64)
        count = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, w, n in _words(batch.column(0)):
                count += np.bincount(w, minlength=BUCKETS)
                doc = np.repeat(np.arange(len(n)), n)
                for d in range(1, WINDOW + 1):
                    same = doc[d:] == doc[:-d]
                    x, y = w[:-d][same], w[d:][same]
                    for i, j in ((x, y), (y, x)):
                        np.add.at(total, (i[:, None] * DIMS + dims[j]).ravel(), signs[j].ravel())
        both = np.concatenate((total.reshape(BUCKETS, DIMS), count[:, None]), 1).reshape(_BLOCKS, -1)
        part = pa.array([TaskContext.get().partitionId() % groups] * _BLOCKS, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), part, pa.array([x.tobytes() for x in both], pa.binary())], names=["block", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(x.as_buffer(), np.int64)
                sums[block] = sums[block] + x if block in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "part", "sums"])

    parts = text.mapInArrow(gather, schema)
    if groups > 1:  # as a tree: many tasks' sums meet in groups before
        parts = parts.repartition(_BLOCKS * groups, "block", "part").mapInArrow(add, schema)
    parts = parts.repartition(_BLOCKS, "block").mapInArrow(add, schema)
    out = np.zeros((_BLOCKS, BUCKETS // _BLOCKS * (DIMS + 1)), np.int64)
    for block, _, sums in parts.collect():  # _BLOCKS rows, 4 MB together
        out[block] += np.frombuffer(sums, np.int64)
    return out.reshape(BUCKETS, DIMS + 1)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors, frequent words weighing less."""
    v, n = sums[:, :DIMS].astype(np.float64), sums[:, DIMS].astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    share = n / max(n.sum(), 1)
    return (v * (1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def pooled(text: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of 2 * DIMS + 1 numbers for each text."""
    out = np.zeros((len(text), 2 * DIMS + 1), np.float32)
    for a, b, w, n in _words(text):
        ends = np.concatenate(([0], np.cumsum(n)))
        full = np.flatnonzero(n)
        if not len(full):
            continue
        v = vectors[w]
        out[a + full, :DIMS] = np.add.reduceat(v, ends[full], axis=0) / n[full, None]
        gap = np.abs(v[1:] - v[:-1])
        gap = np.concatenate((gap, np.zeros((1, DIMS), np.float32)))
        gap[ends[1:][full] - 1] = 0  # from a document's last word to the next one's first
        out[a + full, DIMS : 2 * DIMS] = np.add.reduceat(gap, ends[full], axis=0) / np.maximum(n[full, None] - 1, 1)
        out[a + full, 2 * DIMS] = 1
    return out


@dataclass
class Network:
    """Two layers on standardised inputs; probability of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 400, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Full-batch Adam on four fifths of the rows; the temperature from the rest."""
    if len(y) == 0 or y.min() == y.max():
        return Network(*(np.zeros(1),) * 5, 0.0, constant=float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    held = rng.permutation(len(y)) % 5 == 0
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    d = x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    xt, yt = z[~held], y[~held]
    for t in range(1, steps + 1):
        a = xt @ p[0] + p[1]
        h = np.maximum(a, 0)
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - yt) / len(yt)
        gh = np.outer(g, p[2]) * (a > 0)
        grads = [xt.T @ gh + decay * p[0], gh.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
        for i, q in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * q
            v[i] = 0.999 * v[i] + 0.001 * q * q
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logits, truth = net.logits(x[held]), y[held]
    loss = lambda t: np.mean(np.logaddexp(0, -logits / t * (2 * truth - 1)))
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, str]:
    """docs with one more column, the score; and that column's name."""
    spark = docs.sparkSession
    vectors = word_vectors(context_sums(docs.select("text")))
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sent = spark.sparkContext.broadcast(vectors)
    width = 2 * DIMS + 1

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(2), sent.value)
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["doc_id", "quality", "x"])

    # at most train_rows rows are broadcast, and about as many come back
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    rows = rows.mapInArrow(pool, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # of equal ids one text
    got = sorted(rows.toLocalIterator(), key=lambda r: (r[0], bytes(r[2])))
    x = np.array([np.frombuffer(r[2], np.float32) for r in got]).reshape(-1, width)
    net = spark.sparkContext.broadcast(fit_network(x, np.array([r[1] for r in got])))
    name = own_name(docs, "score")

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(net.value.score(pooled(text, sent.value)))

    return docs.withColumn(name, score(F.col("text"))), name


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold."""
    scored, name = score_documents(docs, labels)
    return scored.where(F.col(name) >= threshold).drop(name)
