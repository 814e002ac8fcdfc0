"""SimHash fingerprints, and their components within a Hamming radius by covering locality-sensitive hashing.

A covering of some bits gives each of them a non-zero vector m of GF(2)^(radius + 1), as evenly as it can; the mask of a
vector v holds the bits with <m, v> = 1. Up to `radius` differing bits leave some v other than 0 that is orthogonal to all of
them, so every pair within the radius agrees on all bits of some mask, and meets in that mask's table: no pair is missed.

A bucket is named by the bits that it fixes (mask) and their values (key). Fingerprints start in the one bucket that fixes
nothing; a level deals a bucket's fingerprints to 2^(radius + 1) - 1 buckets each. Buckets of up to `bucket` fingerprints are
compared in one task, which gives one link a fingerprint. In larger ones each fingerprint is compared with the bucket's hub, that of most
documents; those that then hold more than one component still are dealt again, by a covering of the bits that are
free in them. A level fixes half of the free bits and a bucket with f free bits has at most 2^f fingerprints, so four levels
reach the size that a task compares. No join lists the pairs of a bucket.

Defined cases: null text and text without a word have fingerprint zero, which links like any other; a text of fewer than k words is
one shingle; repeated rows share their fingerprint; component_id is the smallest doc_id of the component, null if all are null; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewatch.llm._io import kept
from tidewatch.llm._vec import SPACE, Words, pieces
from tidewatch.llm.components import components

K, SEED, RADIUS, BUCKET = 4, 42, 4, 256
#: Hashes that are taken apart into bits at a time.
BITS_STEP = 1 << 15


def fingerprints_of(column: pa.Array | pa.ChunkedArray, k: int = K, seed: int = SEED) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, fingerprints as uint64) for runs of whole texts."""
    for first, to, data, off in pieces(column):
        w = Words(data, off, SPACE)
        # the words of all documents, one blank after each: a shingle is a slice
        size = w.end - w.start
        at = np.concatenate([[0], np.cumsum(size + 1)])
        flat = np.full(at[-1], 32, dtype=np.uint8)
        move = np.repeat(at[:-1] - w.start, size)
        source = np.arange(len(move)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(w.start, size)
        flat[source + move] = w.data[source]
        text, counts = flat.tobytes(), np.diff(w.first)
        out = np.zeros(to - first, dtype=np.uint64)
        for i in np.flatnonzero(counts):
            a, b = int(w.first[i]), int(w.first[i + 1])
            last = max(b - k + 1, a + 1)
            starts, ends = at[a:last].tolist(), (at[min(a + k, b) : b + 1] - 1).tolist()
            h = np.fromiter((xxh64_intdigest(text[x:y], seed) for x, y in zip(starts, ends, strict=True)), np.uint64, last - a)
            ones = np.zeros(64, dtype=np.int64)
            for j in range(0, len(h), BITS_STEP):
                ones += np.unpackbits(h[j : j + BITS_STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h)).view(">u8")[0]
        yield first, to, out


def fingerprints(docs: DataFrame, k: int = K, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a bigint, of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, to, fp in fingerprints_of(batch.column(1), k, seed):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, to - first), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


@lru_cache(maxsize=4096)
def covering(mask: int, radius: int, bits: int = 64) -> tuple[int, ...]:
    """The masks, each with all of `mask`, of which two values that agree on `mask` and differ in at most `radius` bits share one at least."""
    free = [b for b in range(bits) if not mask >> b & 1]
    vectors = sorted(range(1, 1 << radius + 1), key=lambda v: (v.bit_count(), v))  # those of one bit first: radius + 1 free bits fix one at least
    m = {b: vectors[i % len(vectors)] for i, b in enumerate(free)}
    return tuple(dict.fromkeys(mask | sum(1 << b for b in free if (m[b] & v).bit_count() & 1) for v in vectors))


def _dealt(rows: DataFrame, radius: int) -> DataFrame:
    """(mask, key, fp) of the buckets below those of rows (mask, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, fps = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            for mask in np.unique(masks):
                fp = fps[masks == mask]
                for below in covering(int(mask), radius):
                    m = np.full(len(fp), below, dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (m, fp & m, fp)], names=["mask", "key", "fp"])

    return rows.select("mask", "fp").mapInArrow(run, "mask bigint, key bigint, fp bigint")


def _near_in_lists(lists: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join what is near within each list fps, one a member at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, off = np.asarray(column.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths())])
            a, b = [], []
            for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                fp = values[x:y]
                near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
                if near.sum() == len(fp):
                    continue
                label = np.arange(len(fp))
                while True:
                    least = np.where(near, label[None, :], len(fp)).min(axis=1)
                    least = least[least]
                    if (least == label).all():
                        break
                    label = least
                moved = label != np.arange(len(fp))
                a.append(fp[moved])
                b.append(fp[label[moved]])
            out = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b"])

    return lists.select("fps").mapInArrow(run, "a bigint, b bigint")


def near_components(weights: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(node, root) of every fingerprint that is not the root of its component; weights: fp, weight, one row a fingerprint."""
    if bucket < 2:
        raise ValueError("a bucket holds two fingerprints at least")
    front, links, roots = weights.select(F.lit(0).cast("bigint").alias("mask"), "fp"), None, None
    while True:
        rows = _dealt(front, radius).distinct() if links is not None else _dealt(front, radius)
        sizes = kept(rows.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1"), "simhash-buckets")
        small = rows.join(sizes.where(F.col("size") <= bucket).select("mask", "key"), ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        found = _near_in_lists(small, radius).distinct()
        large = sizes.where(F.col("size") > bucket).select("mask", "key")
        if large.isEmpty():
            found = kept(found, "simhash-links")
            return components(found if links is None else links.union(found))
        hot = kept(rows.join(large, ["mask", "key"]).join(weights, "fp"), "simhash-hot")
        hub = hot.groupBy("mask", "key").agg(F.max(F.struct("weight", "fp")).alias("hub"))
        told = hot.join(hub, ["mask", "key"]).where((F.col("fp") != F.col("hub.fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= radius))
        found = found.union(told.select(F.col("fp").alias("a"), F.col("hub.fp").alias("b"))).distinct()
        links = kept(found if links is None else links.union(found), "simhash-links")
        roots = kept(components(links), "simhash-roots")
        named = hot.join(roots, hot.fp == roots.node, "left").select("mask", "key", "fp", F.coalesce("root", "fp").alias("comp"))
        open_ = named.groupBy("mask", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("mask", "key")
        front = kept(hot.join(open_, ["mask", "key"], "left_semi").select("mask", "fp").distinct(), "simhash-front")
        if front.isEmpty():
            return roots


def near_duplicates(docs: DataFrame, k: int = K, radius: int = RADIUS, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs (doc_id, text)."""
    rows = kept(fingerprints(docs, k, seed), "fingerprints")
    weights = kept(rows.groupBy("fp").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = near_components(weights.select("fp", "weight"), radius, bucket)
    named = weights.join(roots, weights.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
