"""Benchmark decontamination: a BM25 index of the test items, searched with every training passage by block-max WAND.

The roles of a search engine are turned round: the benchmark is the collection and each window of a training
document is a query. Scores are divided by the score of an item against itself, so one threshold says which share of an
item's weight a passage must hold, and block-max WAND may skip every item whose upper bound stays below
it. All items above the threshold are retrieved, none are cut off. A window whose terms' upper bounds together
stay below the threshold is dropped before any list is opened; that is the same bound taken over the
whole index, and it is computed for all windows of a batch at once from running sums.

A retrieved pair counts as a leak once the words agree in order: of the k-word shingles of the item's question and of
its answer at least the given shares stand in the document; a part of fewer than k words is one shingle of all its words.
The answer is the item's last sentence, or the last half of an item of one sentence.

A window is twice as long as the longest item of its index and moves by half of its length, so every item lies whole in
one, however long it is. Items of up to `SHORT` words share an index; longer ones are indexed by length, one index for each doubling.

The indexes of a block of items are broadcast. Its size is checked: items are cut into as many blocks by the hash of
their id and text as keep each near `BLOCK_BYTES` of text, and the documents are searched once per block. Document
frequencies and the mean length are counted over all items.

Defined cases: null or empty texts of documents and items match nothing; repeated rows are searched each on its own;
items that are equal are one, items that share an id only are each their own and give a row each;
an empty benchmark gives no pairs and takes no document away; other columns are ignored or handed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.licenses import BREAK
from tidewatch.llm._vec import NONWORD, Words, buffers, pieces, shingles

K1, B = 1.2, 0.75
THRESHOLD, QUESTION_SHARE, ANSWER_SHARE, SHINGLE = 0.6, 0.5, 0.5, 2
BLOCK_BYTES, POSTING_BLOCK, SHORT = 16 << 20, 8, 256


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item: its last sentence with a word is the answer; a lone sentence is halved."""
    cuts = [m.end() for m in re.finditer(r"[.?!\n]+\s*", text)]
    for at in reversed(cuts):
        if re.search(r"\w", text[at:]) and re.search(r"\w", text[:at]):
            return text[:at], text[at:]
    words = text.split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])


@dataclass
class Index:
    """Normalised BM25 weights of a block of items as posting lists, and what verification needs."""

    items: np.ndarray  # item ids
    terms: np.ndarray  # term hashes in order
    first: np.ndarray  # posting lists' borders
    posting: np.ndarray  # item numbers, rising in every list
    weight: np.ndarray
    most: np.ndarray  # largest weight of every list
    question: list[Part]
    answer: list[Part]
    window: int

    def __post_init__(self) -> None:
        """Largest weight of every term in every block of items, as lists per term over rising blocks."""
        owner = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        block = self.posting // POSTING_BLOCK
        opens = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.n_blocks = -(-len(self.items) // POSTING_BLOCK)
        self.block_max = np.maximum.reduceat(self.weight, opens) if len(opens) else np.zeros(0)
        self.block_of, self.block_at = block[opens], np.append(opens, len(self.posting))
        self.block_first = np.searchsorted(owner[opens], np.arange(len(self.terms) + 1))

    def search(self, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all (item number, score) of at least the threshold for a query of distinct term numbers.

        Block borders are the same for all terms, so the bounds of all blocks are one sum; blocks below the threshold
        are skipped without reading a posting, the others are walked by pivots."""
        low, high = self.block_first[query], self.block_first[query + 1]
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        bound = np.bincount(self.block_of[at], self.block_max[at], self.n_blocks)
        out: list[tuple[int, float]] = []
        for block in np.flatnonzero(bound >= threshold - 1e-9):
            out += self._walk([(int(self.block_at[k]), int(self.block_at[k + 1]), float(self.block_max[k])) for k in at[self.block_of[at] == block]], threshold - 1e-9)
        return out

    def _walk(self, lists: list[tuple[int, int, float]], least: float) -> list[tuple[int, float]]:
        """WAND over posting ranges (begin, end, largest weight) of one block."""
        posting, weight = self.posting, self.weight
        heads = [[int(posting[a]), a, b, top] for a, b, top in lists]
        out = []
        while heads:
            heads.sort(key=lambda x: x[0])
            bound = 0.0
            for pivot, x in enumerate(heads):
                bound += x[3]
                if bound >= least:
                    break
            else:
                break
            item = heads[pivot][0]
            if heads[0][0] == item:
                score = 0.0
                for x in heads:
                    if x[0] != item:
                        break
                    score += float(weight[x[1]])
                if score >= least:
                    out.append((item, score))
                target = item + 1
            else:
                target = item
            for x in heads:
                while x[0] < target:
                    x[1] += 1
                    x[0] = int(posting[x[1]]) if x[1] < x[2] else 1 << 62
            heads = [x for x in heads if x[1] < x[2]]
        return out

    def candidates(self, h: np.ndarray, threshold: float) -> dict[int, float]:
        """item number -> best window score over all windows of a document with word hashes h."""
        best: dict[int, float] = {}
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == h)
        if not len(hit):
            return best
        term = at[hit]
        step = self.window // 2
        last = max(0, -(-(len(h) - self.window) // step))
        reach = np.concatenate([[0.0], np.cumsum(self.most[term])])
        begin = np.searchsorted(hit, np.arange(last + 1) * step)
        end = np.searchsorted(hit, np.arange(last + 1) * step + self.window)
        for k in np.flatnonzero(reach[end] - reach[begin] >= threshold - 1e-9):
            for item, score in self.search(np.unique(term[begin[k] : end[k]]), threshold):
                best[item] = max(score, best.get(item, 0.0))
        return best


Part = tuple[int, np.ndarray]  # words of a shingle, hashes of the distinct shingles


def _part(text: str, k: int) -> Part:
    """The shingles of a question or an answer, of k words or of all it has, whichever is less."""
    w = Words(*buffers(pa.array([text])), NONWORD)
    size = min(k, len(w))
    return (size, np.unique(shingles(w.hashes(), w.first, size)[0])) if size else (0, np.zeros(0, np.uint64))


def share(part: Part, held: dict[int, np.ndarray]) -> float:
    """Which share of a part's shingles a document holds, of which `held` has the shingles by length; 1 for a part without a word."""
    size, wanted = part
    return float(np.isin(wanted, held[size], assume_unique=True).mean()) if size else 1.0


def build(rows: list[tuple[int, str]], frequency: dict[int, int], n_items: int, mean_length: float, k: int = SHINGLE) -> Index:
    """The index of some items; frequency, n_items and mean_length speak of the whole benchmark."""
    rows = sorted(rows, key=lambda r: (len(r[1]), r[0]))  # items of one length share a block, which keeps its bounds tight
    postings: dict[int, list[tuple[int, float]]] = {}
    longest = 1
    for number, (_, text) in enumerate(rows):
        h = Words(*buffers(pa.array([text])), NONWORD).hashes()
        terms, times = np.unique(h, return_counts=True)
        idf = np.array([np.log(1 + (n_items - frequency[int(t)] + 0.5) / (frequency[int(t)] + 0.5)) for t in terms])
        w = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(h) / mean_length))
        longest = max(longest, len(h))
        for t, x in zip(terms.tolist(), (w / w.sum()).tolist(), strict=True):
            postings.setdefault(t, []).append((number, x))
    terms = np.array(sorted(postings), dtype=np.uint64)
    lists = [postings[int(t)] for t in terms]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    parts = [split_item(text) for _, text in rows]
    return Index(
        np.array([i for i, _ in rows], dtype=np.int64), terms, first,
        np.array([i for x in lists for i, _ in x], dtype=np.int64), np.array([s for x in lists for _, s in x]),
        np.array([max(s for _, s in x) for x in lists]),
        [_part(q, k) for q, _ in parts], [_part(a, k) for _, a in parts], 2 * longest,
    )


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every distinct term of every item."""
    for batch in batches:
        for first_row, to, data, off in pieces(batch.column(0)):
            w = Words(data, off, NONWORD)
            h = w.hashes()
            terms = [np.unique(h[w.first[i] : w.first[i + 1]]) for i in range(to - first_row)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(terms).view(np.int64))], names=["term"])


def length_class(words: int) -> int:
    """0 for items of up to SHORT words, 1 for up to twice as many, and so on."""
    return max(0, (words - 1) // SHORT).bit_length()


def indexes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The indexes of all blocks, one by one."""
    for block in index_blocks(benchmark, block_bytes):
        yield from block


def index_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Index]]:
    """The indexes of each block of items, by length; so many blocks that none holds much over `block_bytes` of text. benchmark: item_id, text."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    blocks = -(-int(size["b"] or 0) // block_bytes)
    terms = items.select("text").mapInArrow(_term_rows, "term bigint")
    counts = terms.groupBy("term").agg(F.count("*").alias("df"))
    words = F.size(F.array_remove(F.split("text", BREAK, -1), ""))
    mean_length = items.agg(F.avg(words).alias("w")).first()["w"] or 1.0
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted((r["item_id"], r["text"]) for r in block.collect())
        known = block.select("text").mapInArrow(_term_rows, "term bigint").distinct()
        frequency = {r["term"] & (1 << 64) - 1: r["df"] for r in known.join(counts, "term").collect()}
        classes: dict[int, list[tuple[int, str]]] = {}
        for r in rows:
            if n := len(Words(*buffers(pa.array([r[1]])), NONWORD).hashes()):
                classes.setdefault(length_class(n), []).append(r)
        if classes:
            yield [build(classes[c], frequency, int(size["n"]), float(mean_length)) for c in sorted(classes)]


PAIRS = "doc_id bigint, item_id bigint, score double, question_share double, answer_share double"
Hit = tuple[int, float, float, float]  # item id, score, question share, answer share


def _verified(block: list[Index], own: np.ndarray, threshold: float, question: float, answer: float, k: int) -> Iterator[Hit]:
    """The items of a block that a document with word hashes `own` holds."""
    found = [(index, item, score) for index in block for item, score in sorted(index.candidates(own, threshold).items())]
    sizes = {size for index, item, _ in found for size, _ in (index.question[item], index.answer[item]) if size}
    held = {n: np.unique(shingles(own, np.array([0, len(own)]), n)[0]) for n in sizes}
    for index, item, score in found:
        q, a = share(index.question[item], held), share(index.answer[item], held)
        if q >= question and a >= answer:
            yield int(index.items[item]), min(1.0, score), q, a


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_SHARE, answer: float = ANSWER_SHARE, k: int = SHINGLE) -> DataFrame:
    """Every (document, item) pair that is retrieved and verified. docs: doc_id, text; benchmark: item_id, text."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())

    def searched(block: list[Index]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                for first_row, to, data, off in pieces(batch.column(1)):
                    w = Words(data, off, NONWORD)
                    h, ids = w.hashes(), batch.column(0).slice(first_row, to - first_row)
                    for i in range(to - first_row):
                        rows += [(ids[i].as_py(), *hit) for hit in _verified(block, h[w.first[i] : w.first[i + 1]], threshold, question, answer, k)]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "score", "question_share", "answer_share"])

        return slim.mapInArrow(run, PAIRS)

    out = docs.sparkSession.createDataFrame([], PAIRS)
    for block in index_blocks(benchmark):
        out = out.union(searched(block))
    return out


def without(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_SHARE, answer: float = ANSWER_SHARE, k: int = SHINGLE) -> DataFrame:
    """The rows of docs (text and any columns) whose own text holds no item, whatever their ids; no join and no shuffle."""

    def cleaned(rest: DataFrame, block: list[Index]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for first_row, to, data, off in pieces(batch.column(batch.schema.get_field_index("text"))):
                    w = Words(data, off, NONWORD)
                    h = w.hashes()
                    for i in range(to - first_row):
                        clean[first_row + i] = next(_verified(block, h[w.first[i] : w.first[i + 1]], threshold, question, answer, k), None) is None
                yield batch.filter(pa.array(clean))

        return rest.mapInArrow(run, rest.schema)

    for block in index_blocks(benchmark):
        docs = cleaned(docs, block)
    return docs
