"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join, and the form that each stands for.

Of two words one edit apart, the edit falls into one half of the shorter one, so the other half stands unchanged in the longer
one: at the same place from the start if it is the first half, at the same place from the end if it is the second. Each word is indexed by its
two halves; words of the same length or one longer probe with the parts of theirs at those places. A bucket is named by the indexed length, the text
fixed from the start (head) and from the end (tail): halving starts from nothing fixed.

A bucket with more than `bucket` squared candidate pairs is halved again: its members agree on head and tail, so the edit lies in what is between,
and the same step applies to that. This goes on until one code point is between, where nearly all candidates are one edit apart, so
the candidates follow the links, however common a beginning or an ending is. Verification is the join's condition: only
pairs one edit apart leave it; they are made distinct since a pair may meet in several buckets.

Forms are followed to their ends by doubling: a form is at least `ratio` times as frequent, so chains are short.

Defined cases: null text has no run; a null doc_id counts as empty text in the deletion rule; repeated rows count each; a run that
loses its code point counts as what is left; an empty table has no word; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._io import kept
from tidewatch.llm._vec import LOWER, pieces

#: A code point of one run in so many is deleted, by the crc32 of its document and text.
DELETES = 199
LEAST_LENGTH, LEAST_COUNT, RATIO, BUCKET = 6, 5, 5, 64
#: Different runs that a task counts before it hands them on.
HELD = 200_000


def runs_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (C3 and one byte more) in UTF-8 bytes."""
    lead = data == 0xC3
    inside = lead | ((data | 32) - np.uint8(97) < 26)
    inside[1:] |= lead[:-1]
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[off] = True
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1] | begin[1 : len(data)]
        closes[:-1] &= ~inside[1:] | begin[1 : len(data)]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_counts(docs: DataFrame, deletes: int = DELETES, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) that are long and frequent enough, counted over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids = ["" if x is None else str(x) for x in batch.column(0).to_pylist()]
            for first, _, data, off in pieces(batch.column(1)):
                data = LOWER[data]
                start, end, doc = runs_of(data, off)
                text = data.tobytes()
                edge = np.searchsorted(doc, np.arange(len(off)))
                for i in np.flatnonzero(np.diff(edge)).tolist():
                    salt, a, b = zlib.crc32(f"{ids[first + i]}:".encode()), edge[i], edge[i + 1]
                    words = [text[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                    for j, word in enumerate(words):
                        if (h := zlib.crc32(word, salt)) % deletes == 0:
                            points = word.decode()
                            at = h % len(points)
                            words[j] = (points[:at] + points[at + 1 :]).encode()
                    counts.update(words)
                    if len(counts) >= HELD:
                        yield told()
        yield told()

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summed = named.mapInArrow(run, "word string, n bigint").where(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") >= least_count)


def _between() -> Column:
    """Code points of an indexed word of the bucket that are not fixed."""
    return F.col("length") - F.char_length("head") - F.char_length("tail")


def _halved(rows: DataFrame) -> DataFrame:
    """The buckets below those of rows (word, longer, length, head, tail): the first half of what is between joins the head, or the second the tail."""
    first = F.floor(_between() / 2).cast("int")
    free = F.expr("substring(word, char_length(head) + 1, char_length(word) - char_length(head) - char_length(tail))")
    cut = rows.withColumn("free", free).withColumn("first", first)
    ways = F.array(
        F.struct(F.concat("head", F.substring("free", F.lit(1), F.col("first"))).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), F.concat(F.substring("free", F.col("first") + F.col("longer") + 1, F.char_length("free")), F.col("tail")).alias("tail")),
    )
    return cut.select("word", "longer", "length", F.explode(ways).alias("way")).select("word", "longer", "length", "way.head", "way.tail")


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) once for every two words (word) that differ by exactly one inserted, deleted or replaced code point."""
    once = words.select("word").distinct()
    both = once.select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    rows = _halved(both.select("word", "longer", (F.char_length("word") - F.col("longer")).alias("length"), F.lit("").alias("head"), F.lit("").alias("tail")).where("length > 0"))
    name, found = ["length", "head", "tail"], None
    while True:
        rows = kept(rows, "spelling-buckets")
        sizes = rows.groupBy(*name).agg(F.count_if(F.col("longer") == 0).alias("held"), F.count("*").alias("size")).where("held > 0 AND size > 1")
        hot = (F.col("held") * F.col("size") > bucket * bucket) & (_between() > 1)
        sizes = kept(sizes.select(*name, hot.alias("hot")), "spelling-sizes")
        few = rows.join(sizes.where("NOT hot").drop("hot"), name)
        held = few.where("longer = 0").select(*name, F.col("word").alias("a"))
        met = held.join(few.select(*name, "longer", F.col("word").alias("b")), name)
        pairs = kept(met.where(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "spelling-pairs")
        found = pairs if found is None else found.union(pairs)
        hot_rows = rows.join(sizes.where("hot").drop("hot"), name).select("word", "longer", *name)
        if sizes.where("hot").isEmpty():
            return found.distinct()
        rows = _halved(hot_rows).distinct()


def variants(counts: DataFrame, ratio: int = RATIO, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of counts (word, n)."""
    counts = kept(counts.select("word", "n"), "spelling-words")
    near = near_words(counts, bucket)
    both = near.union(near.select("b", "a")).toDF("word", "other")
    best = both.join(counts.select(F.col("word").alias("other"), F.col("n").alias("m")), "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    joined = counts.join(best, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    formed = kept(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "spelling-forms")
    up = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each step doubles how far a word has been followed
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = kept(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if up.where("moved").isEmpty():
            break
        up = up.select("word", "root")
    return formed.join(up.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of docs (doc_id, text)."""
    return variants(word_counts(docs))
