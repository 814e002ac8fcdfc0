"""Language identification: a byte convolutional network over fixed-length windows, trained in numpy.

A window is `WINDOW` bytes. Bytes are embedded, filters of widths 2, 3 and 4 slide over them, each filter's
largest answer is kept, and a softmax layer reads those. A document's probabilities are the mean of its windows',
weighted by their letters; every byte of the text lies in a window.

For prediction the network is folded into two tables, one row per pair of bytes: a filter's answer at a place is a
row for bytes 0-1 plus a row for bytes 2-3. So the work per byte is two gathers, an addition and a maximum.

Training reads at most `per_language` rows of each language (chosen by a hash of the id) and a few windows of each,
whatever the size of the input. Only text and language reach the model.

Defined cases: null text, empty text and text without a letter are `und` with score 0; with no labelled row at all
every text is `und`; repeated rows are judged each on its own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewatch.llm._io import kept
from tidewatch.llm._vec import pieces

WINDOW, WIDTHS, FILTERS, DIMS = 128, (2, 3, 4), 12, 8
PER_LANGUAGE, SPANS, SPAN_CHARS, SPARE = 400, 3, 160, 4
_REACH = max(WIDTHS) - 1

_LETTER_BYTE = np.zeros(256, dtype=bool)
_LETTER_BYTE[65:91] = _LETTER_BYTE[97:123] = _LETTER_BYTE[128:] = True


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray  # 256 x DIMS
    conv: list[np.ndarray]  # per width: width x DIMS x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair table of bytes 0-1 for all filters, pair table of bytes 2-3 for the wider ones)."""
        t = [[self.embed @ w[j] for j in range(len(w))] for w in self.conv]
        head = np.concatenate([t[k][0] for k in range(3)], axis=1)[:, None] + np.concatenate([t[k][1] for k in range(3)], axis=1)[None]
        tail = np.concatenate([t[1][2], t[2][2]], axis=1)[:, None] + np.concatenate([np.zeros_like(t[1][2]), t[2][3]], axis=1)[None]
        return head.reshape(65536, -1).astype(np.float32), tail.reshape(65536, -1).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows as WINDOW + reach bytes padded with spaces, document of each) over a run of documents."""
    size = np.diff(off)
    per = np.maximum(-(-size // WINDOW), 0)
    doc = np.repeat(np.arange(len(size)), per)
    start = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
    at = start[:, None] + np.arange(WINDOW + _REACH)
    inside = at < off[doc + 1][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 32).astype(np.uint8) if len(doc) else np.zeros((0, WINDOW + _REACH), np.uint8), doc


def train(texts: list[bytes], labels: list[str], epochs: int = 6, seed: int = 7) -> ByteNet:
    """Fit the network on short labelled texts; each gives one window per started WINDOW bytes."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    x, doc = windows(joined, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    y = np.array([langs.index(s) for s in labels])[doc] if len(doc) else np.zeros(0, int)
    p = {"e": rng.normal(0, 0.5, (256, DIMS)), "b": np.zeros(3 * FILTERS), "v": rng.normal(0, 0.2, (3 * FILTERS, len(langs))), "c": np.zeros(len(langs))}
    p |= {f"w{k}": rng.normal(0, 0.35, (k, DIMS, FILTERS)) for k in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, step, size = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0, 64
    share = np.bincount(y, minlength=len(langs)).astype(np.float32)
    weight = (share.sum() / np.maximum(share, 1) / len(langs)) if len(y) else share
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), size):
            rows = order[a : a + size]
            b, t, n = x[rows], y[rows], len(rows)
            tops, args = [], []
            for k in WIDTHS:
                s = sum((p["e"] @ p[f"w{k}"][j])[b[:, j : j + WINDOW]] for j in range(k))
                arg = s.argmax(axis=1)
                tops.append(np.take_along_axis(s, arg[:, None], 1)[:, 0])
                args.append(arg)
            pre = np.concatenate(tops, axis=1) + p["b"]
            h = np.maximum(pre, 0)
            d = _softmax(h @ p["v"] + p["c"])
            d[np.arange(n), t] -= 1
            d *= weight[t][:, None] / n
            g = {"v": h.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
            dh = (d @ p["v"].T) * (pre > 0)
            g["b"] = dh.sum(axis=0)
            for i, k in enumerate(WIDTHS):
                dk, gw = dh[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(p[f"w{k}"])
                for j in range(k):
                    byte = b[np.arange(n)[:, None], args[i] + j].astype(np.int64)
                    dt = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), dk.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
                    gw[j] = p["e"].T @ dt
                    g["e"] += dt @ p[f"w{k}"][j].T
                g[f"w{k}"] = gw
            step += 1
            rate = 0.004 * (1 - 0.8 * epoch / epochs)
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return ByteNet(langs, p["e"], [p[f"w{k}"] for k in WIDTHS], p["b"], p["v"], p["c"])


class Predictor:
    def __init__(self, net: ByteNet):
        self.net = net
        self.head, self.tail = net.tables()

    def window_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.net.languages)), dtype=np.float32)
        for a in range(0, len(x), 256):
            b = x[a : a + 256].astype(np.int32)
            pair = b[:, :-1] << 8 | b[:, 1:]
            s = self.head[pair[:, :WINDOW]]
            s[:, :, FILTERS:] += self.tail[pair[:, 2 : WINDOW + 2]]
            while s.shape[1] > 1:
                half = s.shape[1] // 2
                s = np.maximum(s[:, :half], s[:, half:])
            out[a : a + 256] = _softmax(np.maximum(s[:, 0] + self.net.bias, 0) @ self.net.out + self.net.out_bias)
        return out

    def documents(self, column: pa.Array) -> tuple[list[str], list[float]]:
        """(language, probability) of every text of a column."""
        names: list[str] = []
        scores: list[float] = []
        for first, to, data, off in pieces(column):
            n = to - first
            x, doc = windows(data, off)
            letters = _LETTER_BYTE[x[:, :WINDOW]].sum(axis=1).astype(np.float64)
            total = np.bincount(doc, letters, n)
            if not self.net.languages:
                total[:] = 0
                sums = np.zeros((n, 1))
            else:
                prob = self.window_probabilities(x)
                sums = np.stack([np.bincount(doc, prob[:, k] * letters, n) for k in range(prob.shape[1])], axis=1)
            best = sums.argmax(axis=1)
            ascii_letter = np.bincount(doc, ((x[:, :WINDOW] < 128) & _LETTER_BYTE[x[:, :WINDOW]]).any(axis=1), n) > 0
            for i in range(n):
                known = total[i] > 0 and (ascii_letter[i] or any(c.isalpha() for c in bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace")))
                names.append(self.net.languages[best[i]] if known else "und")
                scores.append(min(1.0, float(sums[i, best[i]] / total[i])) if known else 0.0)
        return names, scores


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The `per_language` labelled rows of each language with the smallest hashes, each with a few short spans of its text;
    equal rows count once. docs: doc_id, text, lang.

    Hashes below a bound that some SPARE times as many rows reach are ranked only, so no task ranks a whole language."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    order = F.xxhash64("doc_id", "lang", F.xxhash64("text"))
    # equal rows count once here too, or a language with many copies of a row would have next to no hash below its bound
    many = kept(known.groupBy("lang").agg(F.approx_count_distinct(order, 0.02).alias("many")), "languages")
    room = F.greatest(F.length("text") - SPAN_CHARS, F.lit(1))
    spans = F.concat_ws("", *[F.substring("text", F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(k)), room).cast("int"), F.lit(SPAN_CHARS)) for k in range(SPANS)])
    rank = F.row_number().over(W.partitionBy("lang").orderBy("o", "spans"))
    # `many` is a stored table, so the planner knows its size and broadcasts it while it is small
    drawn = known.select("lang", order.alias("o"), spans.alias("spans")).join(many, "lang").where(F.pmod("o", F.lit(1 << 40)) < F.lit(float(1 << 40) * SPARE * per_language) / F.col("many"))
    return drawn.groupBy("lang", "o").agg(F.min("spans").alias("spans")).withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "spans")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNet:
    rows = training_rows(docs, per_language).toPandas().sort_values(["lang", "spans"])
    return train([re.sub(r"\s+", " ", s).encode() for s in rows["spans"]], list(rows["lang"]))


def predict(docs: DataFrame, net: ByteNet, keep_text: bool = False) -> DataFrame:
    """docs (text, and any columns to keep) plus lang_pred and score, and without the text unless it is to stay; columns of
    docs that are named lang_pred or score give way."""
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score") and (keep_text or f.name != "text")]
    schema = StructType([*keep, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(net)
        for batch in batches:
            lang, score = predictor.documents(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)
