"""Hard negatives: rows of another label whose score with an anchor lies in a window below that of a positive.

A row x of integer components gets one more, sqrt(M^2 - |x|^2), with M the largest norm: all rows then have norm M, an anchor a (with 0
there) is at distance d with d^2 = |a|^2 + M^2 - 2 a.x, and a window of scores is an annulus of distances around the anchor.

Index: a vantage-point tree fitted on at most `SAMPLE` rows of smallest hash deals all rows to at most `CELLS` cells. A cell is cut by
hash into blocks of about `BLOCK` rows, so copies of one vector don't meet in a task. Each block is a row of a stored table and a vantage-point tree
of its own: a node's first row is its vantage point, the others are cut at the median distance, and each half keeps the least and the largest
distance to it. Trees split by position, so equal rows don't deepen them.

Search: by the triangle inequality a cell or a leaf outside the annulus is left out. Queries go in batches of one cell, first to their own cell, whose k-th
row narrows the window; then to every other cell whose distances still meet it. In a block a batch visits leaves nearest first, and each query
drops those beyond its k-th row so far. Nothing else is dropped, so the result is exact: integer scores decide, distances only skip.
Positives are the search without a window among rows of the anchor's label; negatives have one window for each positive.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part; rows that are equal in id,
label and vector are one; rows that share an id but not the rest are apart, and none is its own positive; a null id is no anchor and comes last among
ties; shorter vectors are filled up with zeros; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm._io import kept

SAMPLE, CELLS, BLOCK, LEAF, BATCH = 4096, 512, 1024, 64, 256
POSITIVES, NEGATIVES = 5, 3
#: Distances are floating-point numbers, so annuli are widened by this share of the largest.
SLACK = 1e-9
NO_ID = 2**63 - 1


def vectors_of(rows: DataFrame, label: Column | None = None, scale: int = 256) -> DataFrame:
    """vec_id, label, q (array<bigint> of floor(scale * component)) and key of the rows (vec_id, embedding, label) that take part, each once."""
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    one = rows.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), (F.col("label") if label is None else label).cast("bigint").alias("label"), q.alias("q"))
    return one.select("*", F.xxhash64("vec_id", "label", "q").alias("key")).distinct()


def extended(q: np.ndarray, top: float) -> np.ndarray:
    """The rows of q with the component that makes all norms sqrt(top)."""
    wide = q.astype(np.float64)
    return np.concatenate([wide, np.sqrt(np.maximum(top - (wide * wide).sum(axis=1), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Tree:
    """A vantage-point tree over rows. order: rows by leaf; vantage: each node's row; way[leaf]: (node, 1 if outer) from the root on; span: places of each leaf."""

    order: np.ndarray
    vantage: np.ndarray
    cut: np.ndarray
    way: list[list[tuple[int, int]]]
    span: list[tuple[int, int]]


def shape(n: int, leaf: int) -> tuple[list[tuple[int, int, int]], list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """(places and half of every node, parents first; way and span of every leaf) of a tree of n rows: it depends on nothing else."""
    nodes, ways, spans, todo = [], [], [], [(0, n, [])]
    while todo:
        a, b, path = todo.pop()
        if b - a <= leaf:
            ways.append(path)
            spans.append((a, b))
            continue
        half = a + (b - a) // 2
        todo += [(half, b, [*path, (len(nodes), 1)]), (a, half, [*path, (len(nodes), 0)])]
        nodes.append((a, half, b))
    return nodes, ways, spans


def grow(points: np.ndarray, leaf: int) -> Tree:
    """The tree over `points` with at most `leaf` rows a leaf. A node's vantage point is its row farthest from the vantage point above."""
    nodes, way, span = shape(len(points), leaf)
    order, vantage, cut = np.arange(len(points)), [], []
    for a, half, b in nodes:
        top = order[b - 1]
        d = np.sqrt(((points[order[a:b]] - points[top]) ** 2).sum(axis=1))
        by = np.argsort(d, kind="stable")
        order[a:b] = order[a:b][by]
        vantage.append(int(top))
        cut.append(float(d[by[half - a]]))
    return Tree(order, np.array(vantage, dtype=np.int64), np.array(cut), way, span)


def descend(points: np.ndarray, vantage: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf of every point, by the cuts."""
    outer = distances(points, vantage) >= tree.cut[None, :] if len(vantage) else np.zeros((len(points), 0), dtype=bool)
    leaf = np.zeros(len(points), dtype=np.int64)
    for i, path in enumerate(tree.way):
        inside = np.ones(len(points), dtype=bool)
        for node, side in path:
            inside &= outer[:, node] == side
        leaf[inside] = i
    return leaf


def gaps(to_vantage: np.ndarray, way: list[list[tuple[int, int]]], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest possible distance) of each query to a row of each leaf; low and high: by leaf and level, the leaf's distances to that level's vantage point."""
    near, far = np.zeros((len(to_vantage), len(way))), np.full((len(to_vantage), len(way)), np.inf)  # a tree of one leaf has no vantage point
    for i, path in enumerate(way):
        for level, (node, _) in enumerate(path):
            d = to_vantage[:, node]
            near[:, i] = np.maximum(near[:, i], np.maximum(d - high[i, level], low[i, level] - d))
            far[:, i] = np.minimum(far[:, i], d + high[i, level])
    return near, far


def annulus(square: np.ndarray, top: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inner, outer) distances of rows whose score is within [low, high], for anchors of squared norm `square`."""
    slack = SLACK * (1 + top + square)
    return np.sqrt(np.maximum(square + top - 2 * high - slack, 0)), np.sqrt(np.maximum(square + top - 2 * low + slack, 0))


def scores_of(a: np.ndarray, b: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products; floating-point sums are exact below 2^53."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < 2**53 else a @ b.astype(np.int64).T


class Best:
    """Of each query the k best rows so far: by score, then by id, then by key."""

    def __init__(self, queries: int, k: int):
        self.k, self.query, self.rows = k, np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in range(3)]
        self.kth = np.full(queries, -(2**62), dtype=np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, key: np.ndarray) -> None:
        q = np.concatenate([self.query, query])
        rows = [np.concatenate(x) for x in zip(self.rows, (score, vec_id, key), strict=True)]
        by = np.lexsort((rows[2], rows[1], -rows[0], q))
        q, rows = q[by], [x[by] for x in rows]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        self.query, self.rows = q[nth < self.k], [x[nth < self.k] for x in rows]
        full = nth == self.k - 1
        self.kth[q[full]] = rows[0][full]


HIT = "key bigint, win int, score bigint, hit_id bigint, hit_key bigint"
BLOCKS = "cell int, rows int, ids binary, keys binary, labels binary, matrix binary, vantage binary, low binary, high binary, least array<double>, most array<double>"


def columns(queries: pa.StructArray) -> dict[str, pa.Array]:
    return dict(zip([f.name for f in queries.type], queries.flatten(), strict=True))


def within(tree_way: list[list[tuple[int, int]]], span: list[tuple[int, int]], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) distance by leaf and level of a leaf's rows to that level's vantage point; d: by node and place."""
    depth = max(len(p) for p in tree_way)
    low, high = np.zeros((len(tree_way), depth)), np.zeros((len(tree_way), depth))
    for i, (path, (a, b)) in enumerate(zip(tree_way, span, strict=True)):
        for level, (node, _) in enumerate(path):
            low[i, level], high[i, level] = d[node, a:b].min(), d[node, a:b].max()
    return low, high


class Index:
    """The stored rows as blocks, and what the driver knows of their cells: a tree of at most CELLS leaves."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, cells: int = CELLS, block: int = BLOCK, leaf: int = LEAF):
        """rows: vec_id, label, q, key."""
        spark = rows.sparkSession
        square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        facts = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width"), F.max(square).alias("top")).first()
        self.spark, self.n, self.width, self.top, self.leaf = spark, int(facts["n"]), int(facts["width"] or 0), float(facts["top"] or 0), leaf
        if not self.n:
            return
        drawn = rows.orderBy(F.xxhash64("key"), "key").select("q").limit(sample).collect()
        points = extended(self.filled([r["q"] for r in drawn]), self.top)
        self.tree = grow(points, max(1, -(-len(points) * block // self.n), -(-2 * len(points) // cells)))
        self.vantage = points[self.tree.vantage]
        self._place(rows, block)

    def filled(self, vectors: list) -> np.ndarray:
        out = np.zeros((len(vectors), self.width), dtype=np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def packed(self, column: pa.Array) -> np.ndarray:
        """A batch's column of vectors as a matrix."""
        sizes = np.asarray(column.value_lengths())
        values = np.asarray(column.flatten())
        if (sizes == self.width).all():
            return values.reshape(-1, self.width)
        out = np.zeros((len(sizes), self.width), dtype=np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
        return out

    def kinds(self) -> list[str]:
        """Types of a block's ids, keys, labels, matrix, vantage, low and high; no component is larger than sqrt(top)."""
        return ["<i8", "<i8", "<i8", "<i2" if self.top < 2**30 else "<i4" if self.top < 2**62 else "<i8", "<i4", "<f8", "<f8"]

    def homes(self, queries: DataFrame) -> DataFrame:
        """queries (q, ...) with the cell that their vector falls into."""
        index = self.bare()
        names = queries.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = descend(extended(index.packed(batch.column(names.index("q"))), index.top), index.vantage, index.tree)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*names, "cell"])

        return queries.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields) + ", cell int")

    def bare(self) -> Index:
        """What tasks need of it: no session, no tables."""
        other = object.__new__(Index)
        other.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("spark", "blocks")}
        return other

    def _place(self, rows: DataFrame, block: int) -> None:
        """Deal the rows to cells and blocks, store the blocks, and gather each cell's distances to the vantage points above it."""
        placed = kept(self.homes(rows.select("key", "vec_id", "label", "q")), "negatives-rows")
        sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        self.sizes = np.array([sizes.get(i, 0) for i in range(len(self.tree.way))])
        parts = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // block))) for n in self.sizes]), F.col("cell") + 1)
        index = self.bare()

        def build(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batch = pa.Table.from_batches(list(group)).combine_chunks().to_batches()[0]  # one block: about `block` rows, whatever the cell holds
            q, cell = index.packed(batch.column(3)), batch.column(4)[0].as_py()
            points = extended(q, index.top)
            tree = grow(points, index.leaf)
            above = distances(points, index.vantage[[n for n, _ in index.tree.way[cell]]])
            low, high = within(tree.way, tree.span, distances(points[tree.vantage], points[tree.order]))
            facts = [np.asarray(batch.column(1).fill_null(NO_ID))[tree.order], *(np.asarray(batch.column(i))[tree.order] for i in (0, 2)), q[tree.order], np.argsort(tree.order)[tree.vantage]]
            stored = [*(x.astype(kind).tobytes() for x, kind in zip(facts, index.kinds(), strict=False)), low.tobytes(), high.tobytes()]
            values = [cell, len(q), *stored, above.min(axis=0).tolist(), above.max(axis=0).tolist()]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7, *[pa.list_(pa.float64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        cut = placed.select("key", "vec_id", "label", "q", "cell", F.pmod(F.xxhash64("key", F.lit(1)), parts).cast("int").alias("part"))
        self.blocks = kept(cut.groupBy("cell", "part").applyInArrow(build, BLOCKS), "negatives-blocks")
        depth = max((len(p) for p in self.tree.way), default=0)
        self.low, self.high = np.zeros((len(self.sizes), depth)), np.full((len(self.sizes), depth), np.inf)
        levels = self.blocks.select("cell", F.posexplode(F.arrays_zip("least", "most")).alias("level", "x")).groupBy("cell", "level").agg(F.min("x.least").alias("lo"), F.max("x.most").alias("hi"))
        for r in levels.collect():  # a row a cell and level, at most CELLS * log2(CELLS)
            self.low[r["cell"], r["level"]], self.high[r["cell"], r["level"]] = r["lo"], r["hi"]

    def search(self, batches: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
        """HIT rows of the batches' queries, at most k of each block: in their own cell (home), or in all others that their annulus meets."""
        index = self.bare()

        def annuli(queries: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Vectors, vectors with a 0 more, and the annulus of each query."""
            q = index.packed(queries["q"])
            anchor = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)
            return q, anchor, *annulus((anchor * anchor).sum(axis=1), index.top, *(np.asarray(queries[n]).astype(np.float64) for n in ("low", "high")))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    own, some = batch.column(0)[i].as_py(), batch.column(1).slice(i, 1)
                    if home:
                        cells = [own]
                    else:
                        _, anchor, inner, outer = annuli(columns(some.flatten()))
                        near, far = gaps(distances(anchor, index.vantage), index.tree.way, index.low, index.high)
                        meets = ((near <= outer[:, None]) & (far >= inner[:, None])).any(axis=0) & (index.sizes > 0)
                        cells = [c for c in np.flatnonzero(meets).tolist() if c != own]
                    for c in cells:
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), some], names=["cell", "queries"])

        def visit(queries: dict[str, pa.Array], n: int, block: list[np.ndarray]) -> pa.RecordBatch:
            _, way, span = shape(n, index.leaf)
            ids, keys, labels, rows, vantage, leaf_low, leaf_high = block
            rows = rows.reshape(n, -1)
            q, anchor, inner, outer = annuli(queries)
            key, label, low, high = (np.asarray(queries[c]) for c in ("key", "label", "low", "high"))
            square = (anchor * anchor).sum(axis=1)
            near, far = gaps(distances(anchor, extended(rows[vantage], index.top)), way, leaf_low.reshape(len(way), -1), leaf_high.reshape(len(way), -1))
            best, least = Best(len(q), k), low
            for leaf in np.argsort(near.min(axis=0), kind="stable").tolist():
                a, b = span[leaf]
                active = np.flatnonzero((near[:, leaf] <= outer) & (far[:, leaf] >= inner))
                score = scores_of(q[active], rows[a:b], index.top)
                fits = (score >= least[active, None]) & (score <= high[active, None]) & ((label[active, None] == labels[None, a:b]) == same) & (key[active, None] != keys[None, a:b])
                x, y = np.nonzero(fits)
                if len(x):
                    best.add(active[x], score[x, y], ids[a:b][y], keys[a:b][y])
                    least = np.maximum(low, best.kth)
                    outer = annulus(square, index.top, least.astype(np.float64), high.astype(np.float64))[1]
            out = [key[best.query], np.asarray(queries["win"])[best.query], *best.rows]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[x.split()[0] for x in HIT.split(", ")])

        def find(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pairs:
                for i in range(batch.num_rows):
                    block = [np.frombuffer(batch.column(2 + j)[i].as_py(), kind) for j, kind in enumerate(index.kinds())]
                    yield visit(columns(batch.column(0).slice(i, 1).flatten()), batch.column(1)[i].as_py(), block)

        dealt = batches.select("cell", "queries").mapInArrow(spread, f"cell int, queries {batches.schema['queries'].dataType.simpleString()}")
        payload = ["rows", "ids", "keys", "labels", "matrix", "vantage", "low", "high"]
        # neither side is small: a batch goes to many cells, which Spark can't tell from its function
        return dealt.hint("merge").join(self.blocks.select("cell", *payload), "cell").select("queries", *payload).mapInArrow(find, HIT)

    def batches(self, queries: DataFrame, size: int = BATCH) -> DataFrame:
        """(cell, queries): queries of one cell in lists of about `size`."""
        homed = kept(self.homes(queries), "negatives-queries")
        sizes = {r["cell"]: r["n"] for r in homed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        parts = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(i, 0) // size))) for i in range(len(self.tree.way))]), F.col("cell") + 1)
        dealt = homed.withColumn("part", F.pmod(F.xxhash64("key", F.lit(2)), parts))
        return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("key", "label", "q", "win", "low", "high")).alias("queries")).select("cell", "queries")

    def top_rows(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """HIT and rank (from 1) of the k best rows of every query (QUERY columns)."""
        order = [F.col("score").desc(), "hit_id", "hit_key"]
        own = kept(ranked(self.search(self.batches(queries), k, same, True), k, order), "negatives-home")
        kth = own.where(F.col("rank") == k).select("key", "win", F.col("score").alias("kth"))
        narrow = queries.join(kth, ["key", "win"], "left").withColumn("low", F.greatest("low", "kth")).drop("kth").select(*queries.columns)
        rest = self.search(self.batches(narrow), k, same, False)
        return ranked(own.drop("rank").unionByName(rest), k, order)


def ranked(hits: DataFrame, k: int, order: list) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("key", "win").orderBy(*order))).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), positives: int = POSITIVES, negatives: int = NEGATIVES, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vectors_of) that `anchor` holds for.

    A negative's score is within [low, high] times its positive's, each a fraction of positive integers; below a score of 0 that is no window."""
    rows = kept(rows, "negatives-vectors")
    index = Index(rows, **sizes)
    if not index.n:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    anchors = rows.where(anchor & F.col("vec_id").isNotNull())
    everything = anchors.select("key", "vec_id", "label", "q", F.lit(0).alias("win"), F.lit(-(2**61)).cast("bigint").alias("low"), F.lit(2**61).cast("bigint").alias("high"))
    found = kept(index.top_rows(everything, positives, True), "negatives-positives")
    (a, b), (c, d) = low, high
    window = found.where("score >= 0").select("key", F.col("rank").alias("win"), F.expr(f"({a} * score + {b - 1}) DIV {b}").alias("low"), F.expr(f"({c} * score) DIV {d}").alias("high"))
    wanted = anchors.select("key", "vec_id", "label", "q").join(window, "key").where("low <= high").select("key", "vec_id", "label", "q", "win", "low", "high")
    hits = index.top_rows(wanted, negatives, False).select("key", "win", F.col("rank"), F.col("hit_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("key", F.col("rank").alias("win"), F.col("hit_id").alias("positive_id"), F.col("score").alias("positive_score"))
    given = lambda name: F.when(F.col(name) != NO_ID, F.col(name)).alias(name)
    out = hits.join(named, ["key", "win"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return out.select("anchor_id", given("positive_id"), F.col("rank").cast("int").alias("rank"), given("negative_id"), "positive_score", "negative_score")
