"""Counterfactually regularised toxicity classifier.

A text's features are which words and which word beginnings (4 to 6 bytes) it holds, anywhere in the whole
text, as 32-bit hashes. From a bounded sample of labelled documents the features that tell the classes apart
are chosen, and a logistic model is fitted on them by numpy. For every sampled text that names a
group, copies with that name swapped for others of its class are made, and the squared change of the
score's logit between a text and its swaps is added to the loss. So the model can't lean on which group is named.

Classes are weighted back to their shares among all open labels, so 0.5 is the even point on the real mix.

Defined cases: null and empty texts have no features and get the base score; with no labels the score is 0.5
times the share of nothing, that is 0; repeated rows are judged each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.llm._vec import NONWORD, Words, buffers, pieces

SAMPLE = {1: 1500, 0: 3000}
PREFIXES, MOST_FEATURES = (4, 5, 6), 2000

#: Names of groups; within a line one can stand for another.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "indigenous"],
    ["african", "european", "american", "mexican", "chinese", "indian", "arab"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["immigrants", "refugees", "citizens", "foreigners", "locals"],
    ["disabled", "deaf", "blind", "autistic"],
    ["old", "young", "elderly", "teenage"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden"],
]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit feature hashes, document of each), repeats included."""
    w = Words(data, off, NONWORD)
    doc = w.doc
    hashes, docs = [w.hashes() >> np.uint64(32)], [doc]
    length = w.end - w.start
    for k in PREFIXES:
        long = length > k
        h = w.span_hash(w.start[long], w.start[long] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        hashes.append(h >> np.uint64(32))
        docs.append(doc[long])
    return np.concatenate(hashes).astype(np.uint32), np.concatenate(docs)


def feature_sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct features of every text of a column."""
    out: list[np.ndarray] = []
    for first, to, data, off in pieces(column):
        h, doc = features(data, off)
        both = np.unique(doc.astype(np.uint64) << np.uint64(32) | h)
        edges = np.searchsorted(both >> np.uint64(32), np.arange(to - first + 1, dtype=np.uint64))
        low = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out += [low[edges[i] : edges[i + 1]] for i in range(to - first)]
    return out


@dataclass
class ToxicModel:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float
    counterfactuals: int = 0

    def scores(self, column: pa.Array) -> np.ndarray:
        seen = np.zeros(1 << 16, dtype=bool)  # most features are told off by their upper half
        seen[self.keys >> np.uint32(16)] = True
        out = np.zeros(len(column))
        for first, to, data, off in pieces(column):
            h, doc = features(data, off)
            maybe = np.flatnonzero(seen[h >> np.uint32(16)])
            h, doc = h[maybe], doc[maybe]
            at = np.searchsorted(self.keys, h)
            hit = at < len(self.keys)
            hit[hit] = self.keys[at[hit]] == h[hit]
            pairs = np.unique(doc[hit] * np.int64(len(self.keys)) + at[hit]) if hit.any() else np.zeros(0, np.int64)
            z = self.bias + np.bincount(pairs // max(1, len(self.keys)), self.weights[pairs % max(1, len(self.keys))], to - first)
            out[first:to] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


@lru_cache(maxsize=8)
def _swap_tables(terms: tuple[tuple[str, ...], ...]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Per line of terms: the terms' own hashes, and all features of each."""
    return [(np.array([features(*buffers(pa.array([t])))[0][0] for t in line]), feature_sets(pa.array(line))) for line in terms]


def swaps(found: np.ndarray, terms: list[list[str]]) -> list[np.ndarray]:
    """For every group name among the features `found`: the features with it swapped for each other name of its line."""
    out = []
    for whole, sets in _swap_tables(tuple(map(tuple, terms))):
        at = np.minimum(np.searchsorted(found, whole), max(0, len(found) - 1))
        for i in np.flatnonzero(found[at] == whole) if len(found) else []:
            out += [np.union1d(np.setdiff1d(found, sets[i]), sets[j]) for j in range(len(sets)) if j != i]
    return out


def train(sets: list[np.ndarray], y: np.ndarray, sizes: dict[int, int], terms: list[list[str]] | None = None, balance: float = 4.0, shrink: float = 0.002, steps: int = 300) -> ToxicModel:
    """Choose features and fit weights. `balance` weighs the counterfactual penalty, `shrink` the L1 and L2 terms."""
    terms = IDENTITY_TERMS if terms is None else terms
    y = np.asarray(y, dtype=np.float64)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return ToxicModel(np.zeros(0, np.uint32), np.zeros(0), 500.0 if n1 else -500.0)
    keys, total = np.unique(np.concatenate(sets), return_counts=True)
    toxic_keys, toxic_hits = np.unique(np.concatenate([s for s, t in zip(sets, y, strict=True) if t > 0]), return_counts=True)
    hits1 = np.zeros(len(keys))
    hits1[np.searchsorted(keys, toxic_keys)] = toxic_hits
    hits0 = total - hits1
    lift = np.log((hits1 + 0.1) / (n1 + 0.2)) - np.log((hits0 + 0.1) / (n0 + 0.2))
    spread = np.sqrt(1 / (hits1 + 0.3) + 1 / (hits0 + 0.3))
    z = np.where(hits1 + hits0 >= 4, np.abs(lift) / spread, 0)
    named = np.unique(np.concatenate([s for line in terms for s in feature_sets(pa.array(line))])) if terms else np.zeros(0, np.uint32)
    chosen = np.flatnonzero((z > 2.5) | np.isin(keys, named))
    chosen = np.sort(chosen[np.argsort(-(z[chosen] + 1e6 * np.isin(keys[chosen], named)), kind="stable")[:MOST_FEATURES]])
    kept = keys[chosen]

    def entries(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of every chosen feature that the sets hold."""
        found = [np.flatnonzero(np.isin(kept, s, assume_unique=True)) for s in of]
        return np.repeat(np.arange(len(of)), [len(f) for f in found]), np.concatenate([np.zeros(0, np.int64), *found])

    row, col = entries(sets)
    pairs = [(i, s) for i, f in enumerate(sets) for s in swaps(f, terms)] if len(kept) else []
    swap_row, swap_col = entries([s for _, s in pairs])
    base_row, base_col = entries([sets[i] for i, _ in pairs])
    crow, ccol = np.concatenate([swap_row, base_row]), np.concatenate([swap_col, base_col])
    csign = np.concatenate([np.ones(len(swap_row)), -np.ones(len(base_row))])
    share = sizes.get(1, n1) / max(1, sizes.get(1, n1) + sizes.get(0, n0))
    weight = np.where(y > 0, share / n1, (1 - share) / n0)
    w, b, m1, m2 = np.zeros(len(kept)), float(np.log(share / (1 - share))), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], len(sets)) + b)))
        d = weight * (p - y)
        g = np.bincount(col, d[row], len(kept)) + shrink * 0.1 * w
        if pairs:
            change = np.bincount(crow, csign * w[ccol], len(pairs))
            g += balance * 2 * np.bincount(ccol, csign * change[crow], len(kept)) / len(pairs)
        full = np.append(g, d.sum())
        m1, m2 = 0.9 * m1 + 0.1 * full, 0.999 * m2 + 0.001 * full**2
        move = 0.1 * (1 - 0.7 * step / steps) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - shrink * 0.05, 0)
    used = w != 0
    return ToxicModel(kept[used], w[used], b, len(pairs))


def sample_features(docs: DataFrame, ids: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature sets and labels of the sampled documents; ids is a bounded sample, so it is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = feature_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "y", "f"])

    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id bigint, y int, f binary").toPandas()
    got = got.sort_values(["doc_id", "f"]).drop_duplicates("doc_id")  # of texts that share an id always the same one
    return [np.frombuffer(f, np.uint32) for f in got["f"]], got["y"].to_numpy()


def fit(docs: DataFrame, ids: DataFrame, sizes: dict[int, int], **options) -> ToxicModel:
    sets, y = sample_features(docs, ids)
    return train(sets, y, sizes, **options)


def score(docs: DataFrame, model, keep_text: bool = False) -> DataFrame:
    """docs (text, and columns to keep) with the model's score behind, and without the text unless it is to stay; a column
    of docs that is named score gives way. `model` has scores(column)."""
    keep = [f for f in docs.schema.fields if f.name != "score" and (keep_text or f.name != "text")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), pa.array(model.scores(batch.column(at("text"))), pa.float64())], names=[*names, "score"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, StructType([*keep, StructField("score", DoubleType())]))
