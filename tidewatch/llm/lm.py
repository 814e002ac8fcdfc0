"""Document likelihood: a smoothed word model, and a subword lattice that sums over all segmentations.

The lattice model takes the pieces and scores of an existing vocabulary. Its scores are ranks, so a piece's
probability is read as Zipf's, in proportion to 1 / (rank + `ZIPF_SHIFT`), over all pieces and the 256 bytes that
stand in for unknown characters. A word is the piece mark and its bytes; a log-space forward recursion over the word's
positions adds the probabilities of every way to cut it into pieces. Whole words of the training documents are pieces
too: absolute discounting takes the share `discount` (n1 / (n1 + 2 n2), from all words seen once and twice) off each count
and gives what that saves to the vocabulary's pieces. So the model grows with the corpus, and a word is never impossible.
A text is a run of words, after each of which it ends with the share of end tokens among all training tokens. So the score is
the marginal probability of the text.

Word counts are exact and cover all training documents. Words seen often enough that at most `FREQUENT` of them exist
are looked up from a broadcast table of that bounded size. The others, by their nature spread over few documents,
are joined: one row per document and rare word, no hot key. A pass over the texts is made for the counts and one for
the scores; both work on byte buffers.

Defined cases: null text is empty and scores as the end alone; with no training document N is 0 and every word is
unknown; repeated rows are scored each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._io import kept
from tidewatch.llm._vec import SPACE, Words, pieces

FREQUENT, FLUSH, RUN = 200_000, 1_000_000, 1 << 20  # RUN: bytes of text whose distinct words are looked at together
ZIPF_SHIFT = 2.7
_MARK = "▁".encode()


class Pieces:
    """The vocabulary as per-length hash tables of inner pieces and of word-opening pieces, with log10 probabilities."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names, ranks = [], []
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and sp.get_score(i) > -1e8:
                names.append(sp.id_to_piece(i).encode())
                ranks.append(-sp.get_score(i))
        self.fill(names, np.array(ranks, dtype=np.float64))

    def fill(self, names: list[bytes], ranks: np.ndarray) -> None:
        mass = 1 / (np.maximum(ranks, 0) + ZIPF_SHIFT)
        byte = 1 / (max(ranks.max(initial=0), 1) + ZIPF_SHIFT)
        logp = np.log10(mass / (mass.sum() + 256 * byte))
        self.byte = float(np.log10(byte / (mass.sum() + 256 * byte)))
        self.weights = dict(zip(names, logp, strict=True))
        self.bare = self.weights.get(_MARK, self.byte)  # a vocabulary without the bare mark gives it the least weight
        inner = {n: p for n, p in self.weights.items() if not n.startswith(_MARK)}
        opening = {n[len(_MARK) :]: p for n, p in self.weights.items() if n.startswith(_MARK) and len(n) > len(_MARK) and _MARK not in n[1:]}
        self.inner, self.opening = self._tables(inner), self._tables(opening)
        self.longest = max([0, *self.inner, *self.opening])

    @staticmethod
    def _tables(found: dict[bytes, float]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """length -> (hashes in order, log10 probabilities, bitmap over the upper 16 bits)."""
        out = {}
        by: dict[int, list[tuple[bytes, float]]] = {}
        for n, p in found.items():
            by.setdefault(len(n), []).append((n, p))
        for length, rows in by.items():
            data = np.frombuffer(b"".join(n for n, _ in rows), np.uint8)
            w = Words(data, np.arange(0, len(data) + 1, length), np.zeros(256, dtype=bool), lower=False)
            h, p = w.hashes(), np.array([x for _, x in rows])
            order = np.argsort(h)
            bits = np.zeros(1 << 16, dtype=bool)
            bits[h >> np.uint64(48)] = True
            out[length] = (h[order], p[order], bits)
        return out


@lru_cache(maxsize=2)
def _pieces(model: str) -> Pieces:
    return Pieces(model)


def _look_up(h: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(indices of h that are in the table, their values)."""
    keys, values, bits = table
    maybe = np.flatnonzero(bits[h >> np.uint64(48)])
    at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    hit = keys[at] == h[maybe]
    return maybe[hit], values[at[hit]]


def lattice(w: Words, start: np.ndarray, end: np.ndarray, vocab: Pieces) -> np.ndarray:
    """log10 of the summed probability of all segmentations of each word data[start:end]."""
    size = end - start
    base = np.concatenate([[0], np.cumsum(size + 1)])  # every word has size + 1 positions
    alpha = np.full(base[-1], -np.inf)
    alpha[base[:-1]] = vocab.bare
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)  # offset of every byte in its word
    byte_at = np.repeat(start, size) + inside
    left = np.repeat(size, size) - inside
    state = base[owner] + inside
    edges_from, edges_end, edges_len, edges_p = [], [], [], []
    for length in range(1, vocab.longest + 1):
        if length in vocab.opening:
            words = np.flatnonzero(size >= length)
            hit, p = _look_up(w.span_hash(start[words], start[words] + length), vocab.opening[length])
            to = base[words[hit]] + length
            alpha[to] = np.logaddexp(alpha[to] * _LN, p * _LN) / _LN
        if length == 1:
            weight = np.full(len(owner), vocab.byte)
            if 1 in vocab.inner:
                hit, p = _look_up(w.span_hash(byte_at, byte_at + 1), vocab.inner[1])
                weight[hit] = np.logaddexp(weight[hit] * _LN, p * _LN) / _LN
            edges_from.append(state)
            edges_end.append(inside + 1)
            edges_len.append(np.ones(len(owner), np.int64))
            edges_p.append(weight)
        elif length in vocab.inner:
            able = np.flatnonzero(left >= length)
            hit, p = _look_up(w.span_hash(byte_at[able], byte_at[able] + length), vocab.inner[length])
            able = able[hit]
            edges_from.append(state[able])
            edges_end.append(inside[able] + length)
            edges_len.append(np.full(len(able), length))
            edges_p.append(p)
    if not edges_from:
        return alpha[base[1:] - 1]
    source, stop, step, p = (np.concatenate(x) for x in (edges_from, edges_end, edges_len, edges_p))
    order = np.argsort(stop.astype(np.uint16) if stop.max(initial=0) < 65536 else stop, kind="stable")  # within a stop by length
    source, stop, step, p = source[order], stop[order], step[order], p[order]
    cut = np.flatnonzero(np.diff(stop, prepend=-1) | np.diff(step, prepend=-1)) if len(stop) else np.zeros(0, int)
    for a, b in zip(cut, [*cut[1:], len(stop)], strict=False):  # all edges of one end offset and length reach different states
        to = source[a:b] + step[a]
        alpha[to] = np.logaddexp(alpha[to] * _LN, (alpha[source[a:b]] + p[a:b]) * _LN) / _LN
    return alpha[base[1:] - 1]


_LN = np.log(10.0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash as bigint, count) over all of docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

        for batch in batches:
            for _, _, data, off in pieces(batch.column(0), RUN):
                held.append(np.unique(Words(data, off, SPACE).hashes(), return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["word", "c"])
                        held, size = [], 0
        if held:
            k, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["word", "c"])

    return docs.select("text").mapInArrow(count, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[int, np.ndarray, np.ndarray]:
    """(smallest count, words in order, counts) of the frequent words: all with a count of at least a bound that at most `most` words reach."""
    bucket = F.floor(F.log2("c") * 8)
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("low")).orderBy(F.desc("b")).collect()
    total, bound = 0, (1 << 62)
    for r in sizes:
        total += r["n"]
        if total > most:
            break
        bound = r["low"]
    found = counts.where(F.col("c") >= bound).toPandas()
    words = found["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    return bound, words[order], found["c"].to_numpy(dtype=np.int64)[order]


def discount(once: int, twice: int) -> float:
    """What is taken off every count: the usual estimate from the numbers of words seen once and twice, inside 0.1 to 0.9."""
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


PARTS = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, word bigint, c bigint, inner double"


def score_documents(docs: DataFrame, train: DataFrame, model: str, most: int = FREQUENT) -> DataFrame:
    """Scores of docs (doc_id, held_out, text) under models learned from train (text)."""
    counts = kept(word_counts(train), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    ends = train.count()
    total, kinds = int(sums["n"]) + ends, int(sums["v"]) + (ends > 0)
    below = total + 0.5 * (kinds + 1)
    stop = (ends + 0.5) / (total + 1)  # share of ends, smoothed
    log_end, log_on = float(np.log10(stop)), float(np.log10(1 - stop))
    end_base, end_known = float(np.log10((ends + 0.5) / below)), int(ends > 0)
    _, known, known_c = frequent_words(counts, most)
    known_log = np.log10((known_c + 0.5) / below)
    off = discount(int(sums["n1"]), int(sums["n2"]))
    seen = max(1, int(sums["n"]))
    saved = float(np.log10(off * sums["v"] / seen)) if sums["v"] else 0.0  # without a training word the pieces have it all
    known_share = np.log10((known_c - off) / seen)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _pieces(model)
        uid = TaskContext.get().partitionId() << 40
        bits = np.zeros(1 << 22, dtype=bool)
        bits[known >> np.uint64(42)] = True
        for batch in batches:
            for first_row, to, data, off in pieces(batch.column(2), RUN):
                rows = to - first_row
                w = Words(data, off, SPACE)
                h = w.hashes()
                doc = w.doc
                words, at, where = np.unique(h, return_index=True, return_inverse=True)
                marginal = lattice(w, w.start[at], w.end[at], vocab) if len(words) else np.zeros(0)
                marginal += saved
                n = np.diff(w.first)
                spot = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
                hit = known[spot] == words if len(known) else np.zeros(len(words), dtype=bool)
                value = np.zeros(len(words))
                value[hit] = known_log[spot[hit]]
                whole = np.zeros(len(words))
                whole[hit] = np.logaddexp(known_share[spot[hit]] * _LN, marginal[hit] * _LN) / _LN
                log_p = np.bincount(doc, whole[where], rows) + n * log_on + log_end
                base = np.bincount(doc, value[where], rows) + end_base
                n_known = np.bincount(doc, hit[where], rows).astype(np.int64) + end_known
                ids = uid + np.arange(rows, dtype=np.int64)
                uid += rows
                none = lambda t, k: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), batch.column(0).slice(first_row, rows), batch.column(1).slice(first_row, rows), pa.array(n + 1), pa.array(n_known), pa.array(base), pa.array(log_p), none(pa.int64(), rows), none(pa.int64(), rows), none(pa.float64(), rows)],
                    names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "c", "inner"],
                )
                rare = np.flatnonzero(~hit[where])
                pair, times = np.unique(doc[rare].astype(np.int64) * max(1, len(words)) + where[rare], return_counts=True)
                k = len(pair)
                if k:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[pair // len(words)]), none(pa.int64(), k), none(pa.bool_(), k), none(pa.int64(), k), none(pa.int64(), k), none(pa.float64(), k), none(pa.float64(), k), pa.array(words[pair % len(words)].view(np.int64)), pa.array(times.astype(np.int64)), pa.array(marginal[pair % len(words)])],
                        names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "c", "inner"],
                    )

    parts = kept(docs.select(F.col("doc_id").cast("bigint"), "held_out", "text").mapInArrow(score, PARTS), "lm-parts")
    rare = parts.where("word IS NOT NULL").select("uid", "word", F.col("c").alias("times"), "inner")
    c = F.coalesce("c", F.lit(0))
    # log10 of the sum of two powers of ten, from the larger one, so that none is lost to underflow
    own = F.log10((F.col("c") - F.lit(off)) / F.lit(float(seen)))
    both = F.greatest(own, "inner") + F.log10(1 + F.pow(F.lit(10.0), -F.abs(own - F.col("inner"))))
    scored = F.sum(F.col("times") * F.coalesce(both, "inner")).alias("rare_score")
    looked = rare.join(counts, "word", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(below))).alias("rare_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"), scored)
    whole = parts.where("word IS NULL").join(looked, "uid", "left")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
