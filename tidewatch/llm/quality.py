"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated output.

Every word has a sparse index vector drawn from its hash; a word's context vector is the sum of its neighbours'
index vectors over the whole corpus. Words share `BUCKETS` rows by hash, so the vectors are one table of fixed size
whatever the corpus, built by integer additions in each task and summed per block of rows. Next to the
words themselves their shapes (case, digits, marks, length) are indexed as a second vocabulary, which gives
unseen words a vector too.

A document is the mean and the spread of its words' and of its shapes' vectors. A two-layer network is fitted in numpy on a bounded sample
of labelled documents, and one temperature is fitted on a part that the network has not seen.

Defined cases: null and empty texts pool to zeros and get the network's answer for those; with one class or no labels
the score is that class's value, or 0; repeated rows are judged each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._vec import SPACE, Words, pieces

DIMS, NONZERO, REACH = 32, 4, 2
BUCKETS, SHAPES, BLOCK = 8192, 1024, 512
SAMPLE = {0: 2500, 1: 4000}
HIDDEN, POOLED = 24, 4 * DIMS

_KIND = np.zeros((5, 256), dtype=bool)  # large, small, digit, mark, other bytes
_KIND[0, 65:91] = _KIND[1, 97:123] = _KIND[2, 48:58] = _KIND[4, 128:] = True
_KIND[3, :128] = ~(_KIND[0] | _KIND[1] | _KIND[2])[:128]
_KIND_OF = _KIND.argmax(axis=0)


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, shape rows, documents' borders) of a run of documents; shapes lie behind the words' rows."""
    w = Words(data, off, SPACE, lower=False)
    n = w.end - w.start
    word = (w.hashes() % np.uint64(BUCKETS)).astype(np.int32)
    kind = _KIND_OF[w.data]
    code = (kind[w.start] if len(n) else np.zeros(0, np.int64)).astype(np.int64)
    for k in range(5):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        code = code * 3 + np.minimum(total[w.end] - total[w.start] - (kind[w.start] == k), 2)
    last = w.data[w.end - 1].astype(np.int64) if len(n) else np.zeros(0, np.int64)
    code = (code * 257 + np.where(_KIND[3][last], last, 0)) * 8 + np.minimum(n // 3, 7)
    shape = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int32)
    return word, shape + BUCKETS, w.first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the nonzero places of every row's index vector."""
    rng = np.random.default_rng(2011)
    return rng.integers(0, DIMS, (BUCKETS + SHAPES, NONZERO)), rng.choice(np.array([-1, 1]), (BUCKETS + SHAPES, NONZERO))


def _add_contexts(table: np.ndarray, ids: np.ndarray, first: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for o in range(1, REACH + 1):
        near = np.flatnonzero(doc[:-o] == doc[o:]) if len(doc) > o else np.zeros(0, int)
        for a, b in ((ids[near], ids[near + o]), (ids[near + o], ids[near])):
            for k in range(NONZERO):
                flat = a.astype(np.int64) * DIMS + places[b, k]
                table += np.bincount(flat, signs[b, k], table.size).astype(np.int64).reshape(table.shape)


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all rows over all documents, scaled to length one (zeros stay). docs: text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        table = np.zeros((BUCKETS + SHAPES, DIMS), dtype=np.int64)
        for batch in batches:
            for _, _, data, off in pieces(batch.column(0), 1 << 20):
                word, shape, first = units(data, off)
                for ids in (word, shape):
                    _add_contexts(table, ids, first, places, signs)
        blocks = range(0, len(table), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in blocks], pa.int32()), pa.array([table[b : b + BLOCK].astype("<i8" if np.abs(table).max() > 2**31 - 1 else "<i4").tobytes() for b in blocks], pa.binary())], names=["block", "sums"])

    def add(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in tables:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_py()
                part = np.frombuffer(raw, "<i8" if len(raw) == BLOCK * DIMS * 8 else "<i4").astype(np.int64)
                total[block] = total.get(block, 0) + part
        for block, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["block", "sums"])

    n = (BUCKETS + SHAPES) // BLOCK
    schema = "block int, sums binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(n, "block").mapInArrow(add, schema).collect()
    table = np.zeros((BUCKETS + SHAPES, DIMS))
    for r in rows:
        table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["sums"], "<i8").reshape(BLOCK, DIMS)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, size, out=np.zeros_like(table), where=size > 0).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of every text's word vectors and shape vectors, side by side."""
    out = np.zeros((len(column), POOLED), dtype=np.float32)
    for first_row, to, data, off in pieces(column):
        word, shape, first = units(data, off)
        n = np.diff(first)
        some = np.flatnonzero(n)
        for k, ids in enumerate((word, shape)):
            if len(some):
                v, rows, at = vectors[ids], first_row + some, 2 * k * DIMS
                mean = np.add.reduceat(v, first[some], axis=0) / n[some, None]
                square = np.add.reduceat(v * v, first[some], axis=0) / n[some, None]
                out[rows, at : at + DIMS] = mean
                out[rows, at + DIMS : at + 2 * DIMS] = np.sqrt(np.maximum(square - mean**2, 0))
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(column, self.vectors)) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, sizes: dict[int, int], vectors: np.ndarray, epochs: int = 60, seed: int = 5) -> QualityModel:
    """Fit the network on four fifths of the rows and its temperature on the rest, classes weighted to their shares among all labels."""
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    y = np.asarray(y, dtype=np.float64)
    if len(np.unique(y)) < 2:
        return QualityModel(vectors, np.zeros(dims), np.ones(dims), np.zeros((dims, 1)), np.zeros(1), np.zeros(1), 500.0 if len(y) and y[0] else -500.0)
    n1, n0 = max(1, sizes.get(1, int(y.sum()))), max(1, sizes.get(0, int(len(y) - y.sum())))
    weight = np.where(y > 0, n1 / y.sum(), n0 / (len(y) - y.sum())) / (n1 + n0) * len(y)
    order = rng.permutation(len(y))
    tune, fit_rows = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[fit_rows].mean(axis=0), x[fit_rows].std(axis=0) + 1e-3
    p = [rng.normal(0, 1 / np.sqrt(dims), (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(n1 / n0))]
    m1, m2, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    z = (x - mean) / scale
    for epoch in range(epochs):
        rng.shuffle(fit_rows)
        for a in range(0, len(fit_rows), 64):
            rows = fit_rows[a : a + 64]
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = weight[rows] * (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
            dh = d[:, None] * p[2] * (1 - h**2)
            grads = [z[rows].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum()]
            step += 1
            for i, g in enumerate(grads):
                m1[i], m2[i] = 0.9 * m1[i] + 0.1 * g, 0.999 * m2[i] + 0.001 * g**2
                p[i] = p[i] - 0.01 * (1 - 0.9 * epoch / epochs) * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-9)
    model = QualityModel(vectors, mean, scale, p[0], p[1], p[2], float(p[3]))
    if len(tune):
        logits = model.logits(x[tune])
        trial = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [float((weight[tune] * np.logaddexp(0, np.where(y[tune] > 0, -1, 1) * logits / t)).sum()) for t in trial]
        model.temperature = float(trial[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, ids: DataFrame, sizes: dict[int, int]) -> QualityModel:
    """Vectors from all of docs (doc_id, text); labels from the bounded sample ids (doc_id, y)."""
    vectors = corpus_vectors(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in pooled(batch.column(1), vectors)], pa.binary())], names=["doc_id", "y", "v"])

    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id bigint, y int, v binary").toPandas()
    got = got.sort_values(["doc_id", "v"]).drop_duplicates("doc_id")  # of texts that share an id always the same one
    x = np.stack([np.frombuffer(v, np.float32) for v in got["v"]]) if len(got) else np.zeros((0, POOLED), np.float32)
    return train(x, got["y"].to_numpy(), sizes, vectors)
