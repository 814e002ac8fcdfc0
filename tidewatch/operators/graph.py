"""Closure, cycles and impact on edge tables, as loops of joins.

A loop's rows grow in one folder that each step appends to, so what a step reads is one scan however many steps came before; the
frontier is that step's rows. Paths without a branch are chains: a step takes a whole chain, whose nodes are numbered
by doubling pointers, so a path of n nodes costs log2(n) steps. A step touches only what the step before found.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_top(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session whose workers are on this machine may go without; a cluster is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return top or os.path.join(tempfile.gettempdir(), "tidewatch-shared")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written to the folder that all machines share and read back."""
    spark = df.sparkSession
    top = shared_top(spark)
    path = f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Grown:
    """Rows gathered over the steps of a loop, in one folder."""

    def __init__(self, spark: SparkSession, what: str, schema: StructType):
        self.spark, self.schema, self.path, self.steps = spark, schema, f"{shared_top(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}", 0

    def add(self, df: DataFrame) -> DataFrame:
        """Append the rows, and give them back as they are stored."""
        at = f"{self.path}/step={self.steps}"
        df.select(*self.schema.names).write.parquet(at)
        self.steps += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/step={k}" for k in range(self.steps)])


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b) that is not the smallest of its component; nodes are of any sortable type.

    Alternating stars: every node turns its larger neighbours, then its smaller ones, towards the smallest it knows."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")

    def mark(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        return int(r["n"]), int(r["s"])

    now = mark(edges)
    while now[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b")))
        edges, before = stored(small.distinct(), "links"), now
        now = mark(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def chain_links(steps: DataFrame) -> DataFrame:
    """The steps (src, dst; distinct) whose src has no other way out and whose dst no other way in."""
    one_out = steps.groupBy("src").agg(F.count("*").alias("n")).where("n = 1").select("src")
    one_in = steps.groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select("dst")
    return steps.join(one_out, "src", "left_semi").join(one_in, "dst", "left_semi").select("src", "dst")


def chains(steps: DataFrame) -> DataFrame:
    """(node, chain, rank, loop) of every node of steps (src, dst; distinct, no loops of one node), stored.

    src -> dst is a link if src has no other way out and dst no other way in; chains are the longest runs of links, named by their first node, rank counts
    from it. Links that run in a circle are a chain named by its smallest node (loop), all of rank 0. All other edges run from a chain's last node to another's first."""
    links = chain_links(steps)
    nodes = steps.select(F.col("src").alias("node")).union(steps.select(F.col("dst").alias("node"))).distinct()
    at = nodes.join(links.select(F.col("dst").alias("node"), F.col("src").alias("up")), "node", "left")
    at = at.select("node", F.coalesce("up", "node").alias("up"), F.col("up").isNotNull().cast("bigint").alias("rank"), F.least("node", "up").alias("low"), F.lit(True).alias("moved"), F.col("up").isNull().alias("done"))
    done = Grown(steps.sparkSession, "chains-done", at.select("node", "up", "rank").schema)
    at = stored(at, "chains")
    before = None
    while True:
        done.add(at.where("done"))
        open_ = at.where("NOT done").drop("done")
        now = open_.agg(F.count("*").alias("n"), F.count_if("moved").alias("moved")).first()
        if not now["n"] or (now["n"] == before and not now["moved"]):  # what is left runs in circles, and knows its smallest node
            break
        before = now["n"]
        higher = open_.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("rank").alias("more"), F.col("low").alias("lower"), F.lit(False).alias("ends"))
        higher = higher.union(done.rows().select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("rank").alias("more"), F.col("node").alias("lower"), F.lit(True).alias("ends")))
        at = open_.join(higher, "up").select("node", F.col("next").alias("up"), (F.col("rank") + F.col("more")).alias("rank"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("moved"), F.col("ends").alias("done"))
        at = stored(at, "chains")
    straight = done.rows().select("node", F.col("up").alias("chain"), "rank", F.lit(False).alias("loop"))
    return stored(straight.union(open_.select("node", F.col("low").alias("chain"), F.lit(0).cast("bigint").alias("rank"), F.lit(True).alias("loop"))), "chains")


def between_chains(steps: DataFrame, chain: DataFrame) -> DataFrame:
    """(src, dst) of chains: the edges that leave one, distinct and stored; one that leads back to its own start too."""
    ends = steps.join(chain.select(F.col("node").alias("src"), F.col("chain").alias("a"), F.col("loop")), "src").join(chain.select(F.col("node").alias("dst"), F.col("chain").alias("b"), F.col("rank")), "dst")
    return stored(ends.where("NOT loop AND rank = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "between")


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node): everything that a seed reaches, itself included. Only the seeds' closures are built, chain by chain."""
    steps = stored(edges.select("src", "dst").where("src <> dst").distinct(), "steps")
    chain = chains(steps)
    over = between_chains(steps, chain)
    begun = stored(seeds.select(F.col("node").alias("seed")).distinct().join(chain, F.col("seed") == F.col("node"), "left").select("seed", "chain", "rank", "loop"), "reach-seeds")
    found = Grown(seeds.sparkSession, "reach", begun.select("seed", "chain").schema)
    front = found.add(begun.join(over, begun.chain == over.src).select("seed", F.col("dst").alias("chain")).distinct())
    while not front.isEmpty():
        new = front.join(over, front.chain == over.src).select("seed", F.col("dst").alias("chain")).distinct()
        front = found.add(new.join(found.rows(), ["seed", "chain"], "left_anti"))
    whole = found.rows().join(chain.select("chain", "node"), "chain").select("seed", "node")
    own = begun.join(chain.select("chain", "node", F.col("rank").alias("r")), "chain").where("r >= rank").select("seed", "node")
    return whole.union(own).union(begun.where("chain IS NULL").select("seed", F.col("seed").alias("node"))).distinct()


def bounded(edges: DataFrame, requested: DataFrame) -> DataFrame:
    """Edges out of nodes that the requested ones (node) reach. One set of chains is grown for all of them."""
    steps = stored(edges.select("src", "dst").where("src <> dst").distinct(), "steps")
    chain = chains(steps)
    over = between_chains(steps, chain)
    begun = stored(chain.join(requested.select("node").distinct(), "node", "left_semi").groupBy("chain").agg(F.min("rank").alias("rank")), "bound-begun")
    found = Grown(edges.sparkSession, "bound", begun.select("chain").schema)
    front = found.add(begun.join(over, begun.chain == over.src).select(F.col("dst").alias("chain")).distinct())
    while not front.isEmpty():
        new = front.join(over, front.chain == over.src).select(F.col("dst").alias("chain")).distinct()
        front = found.add(new.join(found.rows(), "chain", "left_anti"))
    first = begun.union(found.rows().withColumn("rank", F.lit(0).cast("bigint"))).groupBy("chain").agg(F.min("rank").alias("least"))
    inside = chain.join(first, "chain").where("rank >= least").select(F.col("node").alias("src"))
    loops = requested.select(F.col("node").alias("src")).distinct()  # a node whose only edge leads to itself is in no chain
    return edges.join(inside.union(loops).distinct(), "src", "left_semi").select(*edges.columns)


def _trimmed(steps: DataFrame) -> DataFrame:
    """steps without nodes that nothing leads to or that lead nowhere, one layer."""
    left = steps.join(steps.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(steps.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return stored(left.select("src", "dst"), "core")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other; component is the smallest of them, nodes on no cycle are left out.

    A chain lies on a cycle as a whole or not at all, so chains become nodes, and nodes that nothing leads to or that lead nowhere go, again and again: a tree of any
    depth is gone in a logarithm of its size. In what is left every node takes the smallest node that reaches it as its colour; those of a colour that reach the node it is named
    after are that node's component. They are taken out, and what is left starts anew. A step holds one row a node or edge."""
    spark = edges.sparkSession
    core = stored(edges.select("src", "dst").where("src <> dst").distinct(), "core")
    names = stored(core.select(F.explode(F.array("src", "dst")).alias("given")).distinct().withColumn("node", F.col("given")), "names")  # which nodes each node in hand stands for
    kind = core.schema["src"].dataType
    found = Grown(spark, "components", StructType([StructField("node", kind), StructField("component", kind)]))

    def told(member: DataFrame) -> None:
        """Keep member (node, component) as given nodes, named by the smallest."""
        full = stored(member.join(names, "node").select(F.col("given").alias("node"), "component"), "member")
        found.add(full.join(full.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component")))

    found.add(names.select("node", F.col("node").alias("component")).limit(0))
    size = core.count()
    while size:
        before = None
        while size and size != before:  # a node that leads to itself stands for a cycle from the first round on
            core = _trimmed(core)
            if not chain_links(core).isEmpty():
                chain = chains(core)
                told(chain.where("loop").select("node", F.col("chain").alias("component")))
                names = stored(names.join(chain.where("NOT loop"), "node").select("given", F.col("chain").alias("node")), "names")
                core = between_chains(core, chain)
            before, size = size, core.count()
        if not size:
            break
        colour = stored(core.select(F.col("src").alias("node"), F.col("src").alias("colour"), F.lit(True).alias("new")).distinct(), "colour")
        while not (front := colour.where("new")).isEmpty():
            spread = front.join(core, front.node == core.src).select(F.col("dst").alias("node"), "colour", F.lit(None).cast(kind).alias("old"))
            least = colour.select("node", "colour", F.col("colour").alias("old")).union(spread).groupBy("node").agg(F.min("colour").alias("colour"), F.min("old").alias("old"))
            colour = stored(least.select("node", "colour", (F.col("colour") < F.col("old")).alias("new")), "colour")
        of = colour.select("node", "colour")
        inner = stored(core.join(of.select(F.col("node").alias("src"), "colour"), "src").join(of.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other").select("src", "dst"), "inner")
        grown = Grown(spark, "member", of.select("node", F.col("colour").alias("component")).schema)
        front = grown.add(of.where("node = colour").select("node", F.col("colour").alias("component")))
        while not front.isEmpty():
            new = front.join(inner, front.node == inner.dst).select(F.col("src").alias("node"), "component").distinct()
            front = grown.add(new.join(grown.rows(), "node", "left_anti"))
        member = grown.rows()
        several = member.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").select("component")
        cycles = several.union(core.where("src = dst").select(F.col("src").alias("component"))).distinct()
        told(member.join(cycles, "component", "left_semi"))
        gone = member.select("node")
        core = stored(core.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "core")
        size = core.count()
    return found.rows()


def new_cycles(after: DataFrame, before: DataFrame) -> DataFrame:
    """(component, members): cycles of the after side that no cycle of the before side contains."""
    a = strong_components(after)
    b = strong_components(before).select("node", F.col("component").alias("old"))
    joined = a.join(b, "node", "left").groupBy("component").agg(F.count("*").alias("members"), F.count("old").alias("known"), F.count_distinct("old").alias("olds"))
    return joined.where("NOT (known = members AND olds = 1)").select("component", "members")


def closing_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges that run inside one component."""
    c = components
    return edges.join(c.select(F.col("node").alias("src"), F.col("component").alias("ca")), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("cb")), "dst").where("ca = cb").select("src", "dst", "refs", F.col("ca").alias("component"))


def call_cycles(edges: DataFrame, subjects: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(component, members, judged): cycles that hold a judged routine; components are those of the edges, if known."""
    c = strong_components(edges) if components is None else components
    judged = c.join(subjects.select("node").distinct().withColumn("j", F.lit(1)), "node", "left")
    return judged.groupBy("component").agg(F.count("*").alias("members"), F.count("j").alias("judged")).where("judged > 0")


def reachable_complexity(subjects: DataFrame, edges: DataFrame, nodes: DataFrame, most: float | None = None) -> DataFrame:
    """node, reached, complexity, unmeasured of each subject that the graph holds; above `most` only, if given. nodes: node, complexity."""
    seeds = subjects.select("node").distinct().join(nodes.select("node"), "node", "left_semi")
    summed = reach(seeds, edges).join(nodes, "node", "left").groupBy(F.col("seed").alias("node")).agg(F.count("*").alias("reached"), F.coalesce(F.sum("complexity"), F.lit(0.0)).alias("complexity"), F.count_if(F.col("complexity").isNull()).alias("unmeasured"))
    return summed if most is None else summed.where(F.col("complexity") > most)


def labelled(nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node of either table: its cycle's name, or its own."""
    c = strong_components(edges) if components is None else components
    every = nodes.select("node").union(edges.select(F.col("src").alias("node"))).union(edges.select(F.col("dst").alias("node"))).distinct()
    return every.join(c.select("node", F.col("component").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def reach_components(nodes: DataFrame, edges: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(seed, node): every pair of components of which the first reaches the second, itself included.

    All members of a component reach the same, so the closure is taken over the acyclic graph of components: a large cycle is one row."""
    label = stored(labelled(nodes, edges), "label") if label is None else label
    ends = edges.select("src", "dst").join(label.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    between = stored(ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "between")
    return reach(label.select(F.col("component").alias("node")).distinct(), between)


def whole_reachable_complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """reachable_complexity with every node of `nodes` as a subject, by way of the graph of components.

    Components are numbered in blocks of 64: a row (node, block, bits) tells which of a block's components reach a component, so a step
    sends 64 pairs a row, and a task adds up 64 sums a block without listing them."""
    label = stored(labelled(nodes, edges), "label")
    weight = label.join(nodes, "node", "left").groupBy(F.col("component").alias("node")).agg(F.count("*").alias("n"), F.sum("complexity").alias("c"), F.count_if(F.col("complexity").isNull()).alias("u"))
    weight = stored(weight.select("node", "n", F.coalesce("c", F.lit(0.0)).alias("c"), "u"), "weights")
    ends = edges.select("src", "dst").join(label.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    between = stored(ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "between")
    number = numbered(weight.select("node"))
    begun = number.select("node", F.floor(F.col("id") / 64).alias("block"), F.expr("shiftleft(1L, cast(id % 64 AS int))").alias("bits"))
    found = Grown(nodes.sparkSession, "reach-bits", begun.schema)
    front = found.add(begun)
    while not front.isEmpty():
        new = front.join(between, front.node == between.src).groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("bits").alias("bits"))
        old = found.rows().join(new.select("node", "block"), ["node", "block"], "left_semi").groupBy("node", "block").agg(F.bit_or("bits").alias("old"))
        fresh = new.join(old, ["node", "block"], "left").select("node", "block", F.expr("bits & ~coalesce(old, 0L)").alias("bits"))
        front = found.add(fresh.where("bits <> 0"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bits, *weights = (np.asarray(c) for c in batch.columns)
            names, at = np.unique(block, return_inverse=True)
            on = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total = [np.zeros((len(names), 64)) for _ in weights]
            for x, w in zip(total, weights, strict=True):
                np.add.at(x, at, on * w[:, None].astype(np.float64))
            some = np.nonzero(total[0])
            out = [pa.array(names[some[0]] * 64 + some[1]), pa.array(total[0][some].astype(np.int64)), pa.array(total[1][some]), pa.array(total[2][some].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "n", "c", "u"])

    parts = found.rows().join(weight, "node").select("block", "bits", "n", "c", "u").mapInArrow(sums, "id bigint, n bigint, c double, u bigint")
    summed = parts.groupBy("id").agg(F.sum("n").alias("reached"), F.sum("c").alias("complexity"), F.sum("u").alias("unmeasured"))
    return nodes.select("node").distinct().join(label, "node").join(number.select(F.col("node").alias("component"), "id"), "component").join(summed, "id").select("node", "reached", "complexity", "unmeasured")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with id from 0 without gaps, in no order, stored: a place in the row's task after the sizes of the tasks before."""
    placed = rows.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    placed = stored(placed, "numbered")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row a task
    starts = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))
    return stored(placed.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("start") + F.col("nth")).alias("id")), "numbered")


#: Up to so many nodes of a step are put together in one row of their start; a start with more has a row for each.
LISTED = 1 << 16


def _stepped(front: DataFrame, known: DataFrame, back: DataFrame, listed: int = LISTED) -> DataFrame:
    """(start, node), distinct: where a step of back (at, to) leads from front (start, node) and known (start, node) hasn't been.

    A start's ways are joined as lists, one for each node of its front, so a shuffle has a row for an edge and not for each pair that comes of it."""
    degree = back.groupBy("at").agg(F.count("*").alias("n"))
    ways = front.join(degree, front.node == degree.at).select("start", "n").union(known.select("start", F.lit(1).cast("bigint")))
    many = ways.groupBy("start").agg(F.sum("n").alias("n")).where(F.col("n") > listed).select("start")
    lists = back.join(degree.where(F.col("n") <= listed).select("at"), "at", "left_semi").groupBy("at").agg(F.collect_list("to").alias("tos"))
    few = front.join(many, "start", "left_anti").join(lists, F.col("node") == F.col("at")).groupBy("start").agg(F.flatten(F.collect_list("tos")).alias("tos"))
    past = known.join(many, "start", "left_anti").groupBy("start").agg(F.collect_list("node").alias("past"))
    light = few.join(past, "start", "left").select("start", F.explode(F.array_except("tos", F.coalesce("past", F.slice("tos", 1, 0)))).alias("node"))
    heavy = front.join(many, "start", "left_semi").join(back, F.col("node") == F.col("at")).select("start", F.col("to").alias("node")).distinct().join(known, ["start", "node"], "left_anti")
    return light.union(heavy)


def impact(start: DataFrame, edges: DataFrame, depth: int = 3, opaque: DataFrame | None = None) -> DataFrame:
    """(start, node, depth): who refers to a start, at the nearest depth; opaque nodes are passed without using up a level.

    The last step is not stored: it is most of the result."""
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to")).where("at <> to").distinct()
    if opaque is not None:
        through = opaque.select(F.col("node").alias("at")).distinct()
        hop = back.join(through, "at", "left_semi")
        inner = hop.join(through.select(F.col("at").alias("to")), "to", "left_semi")
        closure = reach(through.select(F.col("at").alias("node")), inner.select(F.col("at").alias("src"), F.col("to").alias("dst")))
        via = back.join(closure.select(F.col("seed").alias("to"), F.col("node").alias("mid")), "to").select("at", F.col("mid").alias("m")).join(hop.select(F.col("at").alias("m"), "to"), "m").select("at", "to")
        back = back.union(via).distinct().join(through.select(F.col("at").alias("to")), "to", "left_anti").where("at <> to").select("at", "to")
    back = stored(back, "impact-back")
    begun = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    found = Grown(start.sparkSession, "impact", begun.schema)
    front = found.add(begun)
    for d in range(1, depth + 1):
        new = _stepped(front.select("start", "node"), found.rows().select("start", "node"), back).withColumn("depth", F.lit(d))
        if d == depth:
            return found.rows().where("depth > 0").union(new)
        front = found.add(new)
    return found.rows().where("depth > 0")
