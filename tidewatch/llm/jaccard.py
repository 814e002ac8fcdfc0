"""N-gram Jaccard self-join with adaptive multi-match prefixes, reduced to components.

A document is the set of its distinct k-word shingles; equal sets are one class, and only classes are joined. A class's
shingles are ordered from rare to common by a frequency sketch over the whole corpus. If two sets overlap in at least
o shingles, their l-prefixes (the first |s| - o + l) share at least l shingles, for any l. Each class picks the l that the
sketch says is cheapest: a longer prefix posts more shingles but asks for more matches before a pair is
verified. A pair uses the smaller l of its two classes, and the prefixes that its own needed overlap, num/(num+den) of both sizes,
leaves: shorter ones than either class had to post for its smallest partners. Postings carry their position for that.

Texts are read for the sketch, for the prefixes, and for the sets of the classes to verify in each step. Sets are not
stored but for these, since hashes are longer than the texts they come from. Postings of a shingle that a single class has posted go at once, then those of classes that are left with fewer
postings than any partner asks for.

Only which documents are connected is asked for, so a pair inside a known component is of no use. Linear rounds come first:
of the components that post a shingle, the one with the plainest member (the shingle stands earliest in its order, so it has
the fewest rare shingles) is the shingle's hub; every other component is verified against the hub that it meets in
most shingles, and what links is merged. A large group of near copies collapses onto its original there. Rounds go on while
they add a tenth of the links found so far. Then components are joined with components, one row per shingle and component, with bounds that no pair of
their members can beat; only for the component pairs that stay, and the shingles by which they met, are pairs of classes
listed, counted and verified, all of them.
No pair is dropped for any other reason than these filters, which lose nothing; no pair is verified twice.

A shingle that the sketch finds in very many sets is dealt by (shingle, salt), and the joins are plain sort-merge joins that
AQE splits, so no shingle needs to fit a task. All tables between steps lie in the shared folder.

Defined cases: null text and text without a word have the empty set, which links with nothing, not even another; a
text of fewer than k words is one shingle; repeated rows are in one class; a component's id is its smallest doc_id, and
null if all its ids are null; other columns are ignored. Sets are compared by 64-bit hashes of their shingles. Classes are told
apart by 128 bits: a class's 64-bit name that two sets share is given up for the other half.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.llm._io import kept
from tidewatch.llm._vec import SPACE, Words, buffers, mix, pieces, shingles
from tidewatch.llm.components import components

K, NUM, DEN = 5, 80, 100
LEVELS = 4
CELL_BITS, BLOCK_BITS, BITMAP_BITS = 21, 14, 26
SALT_ROWS, PAYS = 20_000, 10


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingle hashes in order per document, borders) without repeats inside a document."""
    for first, to, data, off in pieces(column):
        w = Words(data, off, SPACE)
        s, border = shingles(w.hashes(), w.first, k)
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            s[a:b].sort()
        new = np.ones(len(s), dtype=bool)
        new[1:] = s[1:] != s[:-1]
        new[border[:-1][np.diff(border) > 0]] = True
        yield first, to, s[new], np.concatenate([[0], np.cumsum(new)])[border]


def signatures(s: np.ndarray, border: np.ndarray, seed: int = 0xA24BAED4963EE407) -> np.ndarray:
    """A signed 64-bit signature of every set, whatever the order of its members; 0 for the empty set."""
    n = np.diff(border)
    total = np.zeros(len(s) + 1, dtype=np.uint64)
    np.cumsum(mix(s ^ np.uint64(seed)), dtype=np.uint64, out=total[1:])
    sig = mix((total[border[1:]] - total[border[:-1]]) + n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return np.where(n > 0, np.where(sig == 0, np.uint64(1), sig), np.uint64(0)).view(np.int64)


SECOND = 0x2545F4914F6CDD1D


def names_of(s: np.ndarray, border: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """The class names of the sets: the signature, or the second one where the first is in `clash`."""
    sig = signatures(s, border)
    return np.where(np.isin(sig, clash), signatures(s, border, SECOND), sig) if len(clash) else sig


def _packed(s: np.ndarray, border: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The sets for which `keep` is true, as binary values."""
    size = np.diff(border)
    data = s[np.repeat(keep, size)].astype("<u8")
    offsets = np.concatenate([[0], np.cumsum(size[keep] * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


FACTS = "doc_id bigint, cls bigint, cls2 bigint, n bigint, part int, block int, cells binary"


def _facts(docs: DataFrame, k: int) -> DataFrame:
    """Per row its class and set size; per task its part of the frequency sketch, over the classes it met."""
    names = [f.split()[0] for f in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, dtype=np.int64)
        part = TaskContext.get().partitionId()
        seen: set[tuple[int, int]] = {(0, 0)}
        for batch in batches:
            for first, to, s, border in sets_of(batch.column(1), k):
                sig, sig2, rows = signatures(s, border), signatures(s, border, SECOND), to - first
                keep = np.zeros(rows, dtype=bool)
                keep[[i for i, c in enumerate(zip(sig.tolist(), sig2.tolist(), strict=True)) if not (c in seen or seen.add(c))]] = True
                cell, times = np.unique(s[np.repeat(keep, np.diff(border))] >> np.uint64(64 - CELL_BITS), return_counts=True)
                cells[cell.astype(np.int64)] += times
                none = pa.nulls(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(sig), pa.array(sig2), pa.array(np.diff(border).astype(np.int64)), none, none, pa.nulls(rows, pa.binary())], names=names)
        step = 1 << BLOCK_BITS
        blocks = [(b, zlib.compress(x.astype("<i8").tobytes(), 1)) for b in range(len(cells) // step) if (x := cells[b * step : (b + 1) * step]).any()]
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([part] * len(blocks), pa.int32()), pa.array([b for b, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], names=names)

    return docs.mapInArrow(run, FACTS)


def _sketch(facts: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each cell, summed over all tasks in two levels; a table of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        for b, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1)], pa.binary())], names=["block", "cells"])

    blocks = facts.where("block IS NOT NULL")
    level = blocks.repartition("block", "part").select("block", "cells").mapInArrow(add, "block int, cells binary")
    summed = level.repartition(1 << (CELL_BITS - BLOCK_BITS - 2), "block").mapInArrow(add, "block int, cells binary")
    out = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for r in summed.collect():
        out[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(r["cells"]), "<i8")
    return out.astype(np.int32) if out.max(initial=0) < 2**31 else out


def prefix(s: np.ndarray, frequency: np.ndarray, load: float, num: int = NUM, den: int = DEN, levels: int = LEVELS) -> tuple[np.ndarray, int]:
    """(members of the chosen prefix as indices of s, in order; chosen l) of a set of hashes s with sketch counts `frequency`.

    The cost of l is the postings that its prefix meets, plus a verification (as long as the set) for each of the
    candidates, of which every l postings make at most one."""
    n = len(s)
    least = -(-num * n // den)
    most = min(levels, least)
    longest = n - least + most
    order = np.lexsort((s, frequency))[:longest]
    met = np.cumsum(np.maximum(frequency[order] - load, 0.1))
    ends = n - least + np.arange(1, most + 1)
    cost = met[ends - 1] * (1 + n / np.arange(1, most + 1))
    level = int(np.argmin(cost)) + 1
    return order[: n - least + level], level


POSTINGS = "shingle bigint, salt int, cls bigint, n bigint, pos int, ell int"


def smallest_set(num: int, den: int) -> int:
    """The smallest size of a set that can link with another than its equal."""
    return next(n for n in range(1, den + num + 2) if n * den >= num * (n + 1))


def _postings(docs: DataFrame, sketch: np.ndarray, clash: list[int], k: int, num: int, den: int, salt_rows: int) -> DataFrame:
    """The chosen prefix of every class; a class that several tasks meet is posted by each."""
    load, smallest, clashing = float(sketch.mean()), smallest_set(num, den), np.array(clash, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, to, s, border in sets_of(batch.column(1), k):
                cls = names_of(s, border, clashing)
                count = sketch[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                out: list[tuple] = []
                for i in range(to - first):
                    a, b, c = int(border[i]), int(border[i + 1]), int(cls[i])
                    if b - a < smallest or c in seen:
                        continue
                    seen.add(c)
                    at, ell = prefix(s[a:b], count[a:b], load, num, den)
                    salts = 1 + count[a:b][at].astype(np.int64) // salt_rows
                    out.append((s[a:b][at].view(np.int64), np.where(salts > 1, 1 + c % salts, 0).astype(np.int32), np.full(len(at), c), np.full(len(at), b - a), np.arange(len(at), dtype=np.int32), np.full(len(at), ell, np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["shingle", "salt", "cls", "n", "pos", "ell"])

    return docs.mapInArrow(run, POSTINGS)


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of shingles that more than one class has posted (salted shingles stay in any case), of classes
    that are left with as many of them as some partner asks for."""
    group = W.partitionBy("shingle", "salt")
    marked = postings.select("*", F.min("cls").over(group).alias("lo"), F.max("cls").over(group).alias("hi"), F.min("ell").over(group).alias("asked"))
    found = marked.where("lo <> hi OR salt > 0").withColumn("asked", F.when(F.col("salt") > 0, 1).otherwise(F.col("asked"))).drop("lo", "hi", "salt").distinct()
    own = W.partitionBy("cls")
    counted = found.select("*", F.count("*").over(own).alias("have"), F.min("asked").over(own).alias("want"))
    return counted.where("have >= want").select("shingle", "cls", "n", "pos", "ell")


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """A bitmap of 2^BITMAP_BITS bits in 64-bit words, with the bit of every wanted class set; made by the executors."""
    bit = F.pmod("cls", F.lit(1 << BITMAP_BITS))
    words = wanted.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(cls, {1 << BITMAP_BITS}) & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, clash: list[int], k: int) -> DataFrame:
    """(cls, members) once for each class in the stored table `wanted` (cls). A bitmap of fixed size keeps most others from the shuffle."""
    bitmap, clashing = zlib.compress(_bitmap(wanted).tobytes(), 1), np.array(clash, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(bitmap), np.uint64)
        seen: set[int] = {0}
        for batch in batches:
            for _, _, s, border in sets_of(batch.column(1), k):
                cls = names_of(s, border, clashing)
                at = cls & ((1 << BITMAP_BITS) - 1)
                keep = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                keep &= [not (hit and (c in seen or seen.add(c))) for c, hit in zip(cls.tolist(), keep.tolist(), strict=True)]
                keep &= np.diff(border) > 0
                yield pa.RecordBatch.from_arrays([pa.array(cls[keep]), _packed(s, border, keep)], names=["cls", "members"])

    near = docs.mapInArrow(run, "cls bigint, members binary").join(wanted, "cls", "left_semi")
    nth = F.row_number().over(W.partitionBy("cls").orderBy("cls"))  # one of equal sets
    return near.withColumn("nth", nth).where("nth = 1").drop("nth")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) for the pairs (a, b), compared in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x_data, x_off), (y_data, y_off) = buffers(batch.column(2)), buffers(batch.column(3))
            good = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = x_data[x_off[i] : x_off[i + 1]].view("<u8"), y_data[y_off[i] : y_off[i + 1]].view("<u8")
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], names=["a", "b", "linked"])

    # pairs are a stored table: while it is small, its size is known and no set is shuffled but those of a
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("x")), "a")
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("y")).join(pairs.select("b"), "b", "left_semi")
    return left.join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, linked boolean")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    return pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")


def _hub_pairs(across: DataFrame, tried: DataFrame | None, num: int, den: int) -> DataFrame:
    """For every component but the hub of each shared shingle, a pair (a, b) of its plainest member with that of a hub: of
    the pairs not tried yet that meet often enough, the one that meets most often. across: shingle, cls, n, pos, ell, comp."""
    one = across.groupBy("shingle", "comp").agg(F.min(F.struct("pos", "cls", "n", "ell")).alias("x"))
    hub = one.groupBy("shingle").agg(F.min(F.struct("x", "comp")).alias("h"))
    fits = F.least("x.n", "h.x.n") * den >= F.greatest("x.n", "h.x.n") * num
    met = one.join(hub, "shingle").where((F.col("comp") != F.col("h.comp")) & fits)
    pair = met.groupBy("comp", *_ordered(F.col("x.cls"), F.col("h.x.cls"))).agg(F.count("*").alias("c"), F.min(F.least("x.ell", "h.x.ell")).alias("ell")).where("c >= ell")
    best = _untried(pair, tried).groupBy("comp").agg(F.max(F.struct("c", "a", "b")).alias("best"))
    return best.select("best.a", "best.b").distinct()


def _across(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """shared with each class's component, of shingles that more than one component has posted."""
    labelled = shared.join(roots, F.col("cls") == F.col("node"), "left").select("shingle", "cls", "n", "pos", "ell", F.coalesce("root", "cls").alias("comp"))
    open_ = labelled.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    return labelled.join(open_, "shingle", "left_semi")


def _near_components(across: DataFrame, num: int, den: int) -> DataFrame:
    """The multi-match join on components: the shingles by which pairs (comp_1, comp_2) may have members that share enough.

    A shingle at pos counts for classes of n and m members if (num + den) * pos < den * n - num * m + (num + den) * l; the
    best member of a component is put against the smallest of the other."""
    both = num + den
    facts = across.groupBy("shingle", "comp").agg(F.max(F.lit(den) * F.col("n") - F.lit(both) * F.col("pos")).alias("reach"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("ell").alias("ell"), F.max("ell").alias("top"), F.count("*").alias("many"))
    one, two = (facts.select("shingle", *[F.col(c).alias(f"{c}_{i}") for c in ("comp", "reach", "low", "high", "ell", "top", "many")]) for i in (1, 2))
    room = F.least("top_1", "top_2") * both
    fits = (F.col("high_1") * den >= F.col("low_2") * num) & (F.col("high_2") * den >= F.col("low_1") * num)
    met = one.join(two, "shingle").where((F.col("comp_1") < F.col("comp_2")) & fits & (F.col("reach_1") + room > F.col("low_2") * num) & (F.col("reach_2") + room > F.col("low_1") * num))
    pair = W.partitionBy("comp_1", "comp_2")
    counted = met.select("*", F.count("*").over(pair).alias("c"), F.min(F.least("ell_1", "ell_2")).over(pair).alias("ell")).where("c >= ell")
    swap = F.col("many_1") > F.col("many_2")  # the component with fewer members at the shingle comes first
    other = {c: F.when(swap, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(c) for c in ("low", "high", "top", "comp")}
    return counted.select(F.when(swap, F.col("comp_2")).otherwise(F.col("comp_1")).alias("comp_1"), other["comp"].alias("comp_2"), "shingle", other["low"], other["high"], other["top"])


def _match_pairs(across: DataFrame, near: DataFrame, num: int, den: int) -> DataFrame:
    """The multi-match join of classes, for the component pairs in `near` and the shingles by which they met: pairs that
    share enough of their own prefixes. A member that reaches no class of the other component by a shingle is not listed."""
    one, two = (across.select("shingle", *[F.col(c).alias(f"{c}_{i}") for c in ("cls", "n", "pos", "ell", "comp")]) for i in (1, 2))
    # the overlap that this pair needs; it is at least what either class asked for, so the prefixes in hand are long enough
    need = F.expr(f"({num} * (n_1 + n_2) + {num + den - 1}) DIV {num + den}")
    ell = F.least("ell_1", "ell_2")
    fits = F.least("n_1", "n_2") * den >= F.greatest("n_1", "n_2") * num
    reaches = F.lit(num + den) * F.col("pos_1") < F.col("n_1") * den - F.col("low") * num + F.least("ell_1", "top") * (num + den)
    near_n = (F.col("n_1") * den >= F.col("low") * num) & (F.col("high") * den >= F.col("n_1") * num)
    some = near.join(one, ["comp_1", "shingle"]).where(reaches & near_n).drop("low", "high", "top")
    met = some.join(two, ["comp_2", "shingle"]).where(fits & (F.col("pos_1") < F.col("n_1") - need + ell) & (F.col("pos_2") < F.col("n_2") - need + ell))
    counted = met.groupBy(*_ordered(F.col("cls_1"), F.col("cls_2"))).agg(F.count("*").alias("c"), F.min(ell).alias("ell"))
    return counted.where("c >= ell").select("a", "b")


def _clashes(rows: DataFrame) -> list[int]:
    """The class names that stand for two sets. About one pair in 2^64 does, so the list is short: some tens at 10^10 sets."""
    clash = rows.groupBy("cls").agg(F.min("cls2").alias("lo"), F.max("cls2").alias("hi")).where("lo <> hi").select("cls")
    names = [r["cls"] for r in clash.limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 names of classes clash; that can't be chance")
    return sorted(names)


def _classes(docs: DataFrame, k: int, num: int, den: int, salt_rows: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(doc_id, cls and n of every row; node and root of the linked classes that aren't their component's root; clashing names)."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = kept(_facts(slim, k), "shingle-facts")
    rows = facts.where("block IS NULL").select("doc_id", "cls", "cls2", "n")
    if clash := _clashes(rows):
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(clash), F.col("cls2")).otherwise(F.col("cls")))
    shared = kept(_shared(_postings(slim, _sketch(facts), clash, k, num, den, salt_rows)), "shared-shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = kept(pairs, "pairs")
        wanted = kept(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "pairs-classes")
        return kept(_verified(pairs, kept(_sets(slim, wanted, clash, k), "pairs-sets"), num, den), "verified-pairs")

    tried, across, pays, links = None, shared.withColumn("comp", F.col("cls")), True, 0
    while pays:
        more = verified(_hub_pairs(across, tried, num, den))
        linked = more.where("linked").count()
        links += linked
        pays = linked * PAYS > links
        tried = more if tried is None else tried.union(more)
        if linked:
            across = kept(_across(shared, components(tried.where("linked"))), "open-shingles")
    near = kept(_near_components(across, num, den), "near-components")
    tried = tried.union(verified(_untried(_match_pairs(across, near, num, den), tried)))
    return rows.select("doc_id", "cls", "n"), components(tried.where("linked")), clash


def similar_components(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN, salt_rows: int = SALT_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    rows, roots, _ = _classes(docs, k, num, den, salt_rows)
    least = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    joined = least.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("comp"))
    named = joined.join(joined.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("cls", "component_id")
    out = rows.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN, salt_rows: int = SALT_ROWS) -> DataFrame:
    """docs (doc_id, text and any sortable columns) with one row of each component: that of the smallest doc_id, then of
    the smallest class, then the smallest row. Decided per row: rows that share an id but not the text are apart, a null id is
    as good as another (but the last choice), and rows without a word all stay."""
    names = docs.columns
    rows, roots, clash = _classes(docs, k, num, den, salt_rows)
    clashing = np.array(clash, dtype=np.int64)
    keys = rows.where("n > 0").groupBy("doc_id", "cls").agg(F.count("*").alias("times"))
    keys = keys.join(roots, F.col("cls") == F.col("node"), "left").select("doc_id", "cls", "times", F.coalesce("root", "cls").alias("comp"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls").alias("key"))
    first = keys.groupBy("comp").agg(F.min("key").alias("first"), F.sum("times").alias("all")).where("`all` > 1").select("comp", "first")
    marks = kept(keys.join(first, "comp").select(F.col("doc_id").alias("id_"), F.col("cls").alias("cls_"), (F.col("key") != F.col("first")).alias("gone"), "times").where("gone OR times > 1"), "copies")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            cls = np.concatenate([names_of(s, border, clashing) for _, _, s, border in sets_of(text, k)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls)], names=[*batch.schema.names, "cls_of"])

    slim = docs.withColumn("text", F.col("text").cast("string")).select(*names, F.col("doc_id").cast("bigint").alias("id_of"))
    schema = StructType([*slim.schema.fields, StructField("cls_of", LongType())])
    marked = slim.mapInArrow(name, schema).join(marks, F.col("id_of").eqNullSafe(F.col("id_")) & (F.col("cls_of") == F.col("cls_")), "left")
    single = marked.where("gone IS NULL").select(*names)
    repeated = marked.where("NOT gone").groupBy("id_of", "cls_of").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return single.unionByName(repeated)
