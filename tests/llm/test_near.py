"""Covering SimHash, spelling variants and hard negatives against brute force, and on the awkward inputs."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.llm import negatives, simhash, spelling
from tidewatch.llm.entry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, fp bigint, word string, n bigint"  # the last three clash with names inside


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    names = sorted(set(fps))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(names, dtype=np.uint64)
    for i, x in enumerate(names):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius).tolist():
            root[find(names[j])] = find(x)
    return {f: find(f) for f in names}


def plain_near_duplicates(docs):
    fps = [(d, plain_fingerprint(t)) for d, t in docs]
    comp = plain_components([f for _, f in fps])
    least = {}
    for d, f in fps:
        if d is not None:
            least[comp[f]] = min(least.get(comp[f], d), d)
    return sorted(((d, f"{f:016x}", least.get(comp[f])) for d, f in fps), key=repr)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice("abcdefgh") * 3
    return " ".join(out)


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 3, 4, 40, 300]))] for _ in range(40)]
    docs = [(i, edited(rng, w, rng.choice([0, 0, 1, 2]))) for i, w in enumerate(base * 4)]
    docs += [(900, None), (901, ""), (902, " \t"), (None, "Ünï cöde TEXT of five words"), (None, "ünï cöde text of five words"), (3, docs[3][1]), (3, docs[3][1]), (903, "very long " * 9000)]
    df = spark.createDataFrame([(*d, 7, "x", 1) for d in docs], DOCS)
    assert rows(simhash.near_duplicates(df)) == plain_near_duplicates(docs)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_a_covering_misses_no_pair():
    rng = random.Random(1)
    for fixed in (0, (1 << 33) - 1, (1 << 50) - 1, (1 << 58) - 1):
        masks = simhash.covering(fixed, 4)
        free = [b for b in range(64) if not fixed >> b & 1]
        assert all(m & fixed == fixed and m != fixed for m in masks) and len(masks) <= 31
        for _ in range(2000):
            differ = sum(1 << b for b in rng.sample(free, rng.randint(1, min(4, len(free)))))
            assert any(m & differ == 0 for m in masks)


@pytest.mark.parametrize("bucket", [4, 256])
def test_buckets_of_any_size_give_the_same_components(spark, bucket):
    """A third of all fingerprints lies around one; small buckets make every level of the covering work."""
    rng = random.Random(bucket)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(250)}
    chain = rng.getrandbits(64)
    fps |= {rng.getrandbits(64) for _ in range(300)} | {chain ^ ((1 << 3 * i) - 1) for i in range(20)} | {(chain & ~0xFFF) | i for i in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    weights = spark.createDataFrame([(f, 1) for f in signed], "fp bigint, weight bigint")
    roots = {r.node: r.root for r in simhash.near_components(weights, 4, bucket).collect()}
    want, got = plain_components(list(fps)), {}
    for f, s in zip(fps, signed, strict=True):
        got.setdefault(roots.get(s, s), set()).add(f)
    groups = {}
    for f, c in want.items():
        groups.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def plain_variants(docs):
    counts = {}
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return plain_forms({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def plain_forms(n):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(found[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(3)
    stems = ["Analysis", "colours", "straße", "ÀÉÎõü÷", "organise", "naïveté", "aaaaaa", "ababab"]
    docs = [(i, " ".join(rng.choice(stems) + rng.choice(["", "", "", "s", "x", "", "er"]) for _ in range(60)) + ", it's-fine 日本analysis " + "ANALYSIS" * (i % 2)) for i in range(60)]
    docs += [(None, "analysis " * 30), (7, None), (8, ""), (9, "12 34 --"), (10, "colour " * 8000), (10, "colour " * 8000)]
    df = spark.createDataFrame([(*d, 7, "x", 1) for d in docs], DOCS)
    got = rows(spelling.spelling_variants(df))
    assert got == plain_variants(docs) and any(r[1] for r in got)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [1, 64])
def test_common_beginnings_and_endings_lose_no_pair(spark, bucket):
    rng = random.Random(bucket)
    words = {p + "".join(rng.choice("abé") for _ in range(rng.randint(0, 4))) + s for p in ("common", "in") for s in ("ation", "") for _ in range(60)}
    n = {w: rng.choice([5, 6, 30, 200, 5000]) for w in words if len(w) >= 6}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = rows(spelling.variants(df, bucket=bucket))
    assert got == plain_forms(n) and any(r[2] != r[1] for r in got if r[1])


def plain_negatives(vectors, k=5, m=3):
    one = {}
    for i, v, lab in vectors:
        if v is None or lab is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        one[(i, lab, tuple(int(np.floor(256 * float(x))) for x in v))] = None
    every, out = list(one), []
    width = max((len(q) for _, _, q in every), default=0)
    place = lambda i: (i is None, i or 0)
    for a in every:
        if a[0] is None or a[0] % 50:
            continue
        pad = lambda q: np.array([*q, *[0] * (width - len(q))], dtype=object)
        score = {r: int((pad(a[2]) * pad(r[2])).sum()) if width else 0 for r in every if r != a}
        best = lambda rs: sorted(rs, key=lambda r: (-score[r], place(r[0])))
        for p in best([r for r in score if r[1] == a[1]])[:k]:
            fits = [r for r in score if r[1] != a[1] and 50 * score[p] <= 100 * score[r] <= 95 * score[p]]
            out += [(a[0], p[0], j + 1, r[0], score[p], score[r]) for j, r in enumerate(best(fits)[:m])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [True, False])
def test_hard_negatives_equal_brute_force(spark, small):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 7))
    vectors = [(i, (centre[rng.integers(6)] + rng.normal(scale=0.4, size=7)).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(700)]
    vectors += [(1000 + i, centre[0].astype(np.float32).tolist(), i % 2) for i in range(250)]  # one very common vector
    vectors += [(50, None, 1), (2000, [1.0] * 7, None), (2001, [float("nan")] * 7, 1), (2002, [float("inf")] * 7, 1), (2003, [None] * 7, 1), (2050, [], 1), (2051, [0.5], 2), (None, centre[0].tolist(), 2), vectors[0], vectors[0]]
    df = spark.createDataFrame([(*v, 1.0, 3) for v in vectors], "vec_id bigint, embedding array<float>, label int, score double, key bigint")
    sizes = {"sample": 100, "cells": 16, "block": 60, "leaf": 8} if small else {}
    got = rows(negatives.hard_negatives(negatives.vectors_of(df), F.col("vec_id") % 50 == 0, **sizes))
    assert got == plain_negatives([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in vectors])
    assert negatives.hard_negatives(negatives.vectors_of(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(negatives.vectors_of(df.where("vec_id = 50")), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_bounds_hold():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(300, 5)), np.zeros((100, 5))])
    tree = negatives.grow(points, 16)
    put = points[tree.order]
    low, high = negatives.within(tree.way, tree.span, negatives.distances(points[tree.vantage], put))
    queries = rng.normal(size=(20, 5))
    near, far = negatives.gaps(negatives.distances(queries, points[tree.vantage]), tree.way, low, high)
    d = negatives.distances(queries, put)
    for i, (a, b) in enumerate(tree.span):
        assert b - a <= 16 and (d[:, a:b].min(axis=1) >= near[:, i] - 1e-9).all() and (d[:, a:b].max(axis=1) <= far[:, i] + 1e-9).all()
    assert sorted(tree.order.tolist()) == list(range(400))


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def test_op11_equals_brute_force(spark, documents):
    assert rows(QUERIES["op11_simhash"](spark, DATA)) == plain_near_duplicates(documents)


def test_op12_equals_brute_force(spark, documents):
    assert rows(QUERIES["op12_spelling_variants"](spark, DATA)) == plain_variants(documents)


def test_op13_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = duckdb.sql(ORACLE_SQL["op13_hard_negatives"])
    df = QUERIES["op13_hard_negatives"](spark, DATA)
    assert df.columns == want.columns and rows(df) == sorted(want.fetchall(), key=repr)


def test_fingerprints_of_plain_texts():
    texts = ["a b c d e", "A  b\tc d", "", None, "x"]
    got = [int(x) for _, _, fp in simhash.fingerprints_of(pa.array(texts)) for x in fp]
    assert got == [plain_fingerprint(t) for t in texts] and got[2] == got[3] == 0
