"""Dependency structure: edges (src, dst, refs) merged, rolled up, compared between sides and held against rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("refs").alias("refs"))


def import_time_only(edges: DataFrame) -> DataFrame:
    """Edges that run at import, and those not measured."""
    return edges.where("import_time IS NULL OR import_time > 0")


def roll_up(edges: DataFrame, members: DataFrame, root: str = "") -> DataFrame:
    """Edges between architecture nodes: members (node, path) replaces both ends; self and root edges go."""
    m = members.select("path", "node")
    ends = edges.join(m.withColumnRenamed("path", "src").withColumnRenamed("node", "a"), "src").join(m.withColumnRenamed("path", "dst").withColumnRenamed("node", "b"), "dst")
    return ends.where((F.col("a") != F.col("b")) & (F.col("a") != root) & (F.col("b") != root)).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("refs").alias("refs"))


def crossing(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges with crosses: both ends have a node, and not the same one."""
    one = members.groupBy("path").agg(F.min("node").alias("node"))
    a, b = one.select(F.col("path").alias("src"), F.col("node").alias("a")), one.select(F.col("path").alias("dst"), F.col("node").alias("b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumn("crosses", F.coalesce(F.col("a") != F.col("b"), F.lit(False))).drop("a", "b")


def fan(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out: distinct neighbours without the node itself."""
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    ends = pairs.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def fan_findings(after: DataFrame, before: DataFrame, most_in: int, most_out: int, subjects: DataFrame | None = None) -> DataFrame:
    """node, rule, value, before, limit, kind: fans over their limits, and fan-outs that grew (the ratchet)."""
    now, was = fan(after), fan(before).select("node", F.col("fan_in").alias("in_was"), F.col("fan_out").alias("out_was"))
    both = now.join(was, "node", "left")
    if subjects is not None:
        both = both.join(subjects.select("node").distinct(), "node", "left_semi")

    def rows(kind: str, rule: str, value: str, old: str, limit: int, where):
        return both.where(where).select("node", F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.col(value).alias("value"), F.col(old).alias("before"), F.lit(limit).alias("limit"))

    out = rows("threshold", "structure.fan_in", "fan_in", "in_was", most_in, F.col("fan_in") > most_in)
    out = out.union(rows("threshold", "structure.fan_out", "fan_out", "out_was", most_out, F.col("fan_out") > most_out))
    return out.union(rows("ratchet", "structure.fan_out", "fan_out", "out_was", most_out, F.col("fan_out") > F.col("out_was")))


def new_edges(after: DataFrame, before: DataFrame) -> DataFrame:
    """Pairs of the after side that the before side lacks; reference counts don't matter."""
    return after.select("src", "dst").distinct().join(before.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def layer_findings(after: DataFrame, before: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """New edges between nodes whose target the source's rule doesn't allow. rules: layer, node, may (array). The last member row of a path wins."""
    where = members.groupBy("path").agg(F.max_by("node", "ordinal").alias("node"))
    edges = new_edges(after, before).join(where.select(F.col("path").alias("src"), F.col("node").alias("src_node")), "src").join(where.select(F.col("path").alias("dst"), F.col("node").alias("dst_node")), "dst")
    judged = edges.where("src_node <> dst_node").join(F.broadcast(rules.withColumnRenamed("node", "src_node")), "src_node")
    return judged.where(~F.array_contains("may", F.col("dst_node"))).select("layer", "src", "dst", "src_node", "dst_node")


def coupling_findings(node_edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Directed references between two nodes above their rule's maximum. rules: src, dst, most; a pair without edges has 0."""
    merged = merge_edges(node_edges)
    return F.broadcast(rules).join(merged, ["src", "dst"], "left").select("src", "dst", F.coalesce("refs", F.lit(0)).alias("refs"), "most").where("refs > most")


def without_namespaces(edges: DataFrame, measures: DataFrame) -> DataFrame:
    """Edges whose target isn't an empty file: a measured code line count of exactly 0."""
    empty = measures.where("metric = 'CountLineCode' AND value = 0").select(F.col("path").alias("dst")).distinct()
    return edges.join(empty, "dst", "left_anti").select(*edges.columns)


def new_dependencies(after: DataFrame, before: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """src, added: affected files with more than `most` new distinct targets."""
    added = new_edges(after, before).where("src <> dst").join(files.select(F.col("path").alias("src")).distinct(), "src", "left_semi")
    return added.groupBy("src").agg(F.count("*").alias("added")).where(F.col("added") > most)


def affected(changes: DataFrame, after: DataFrame, before: DataFrame) -> DataFrame:
    """path: changed files that still exist, and files whose set of targets changed; deleted files and targets don't count.

    changes: status (A, M, D, R), path, old_path."""
    gone = changes.where("status = 'D'").select("path").union(changes.where("status = 'R'").select("old_path")).distinct()
    staged = changes.where("status <> 'D'").select("path")

    def live(edges: DataFrame) -> DataFrame:
        return edges.select("src", "dst").distinct().join(gone.select(F.col("path").alias("dst")), "dst", "left_anti").select("src", "dst")

    a, b = live(after), live(before)
    moved = a.exceptAll(b).union(b.exceptAll(a)).select(F.col("src").alias("path"))
    return staged.union(moved).distinct().join(gone, "path", "left_anti")


def neighbourhood(files: DataFrame, changes: DataFrame, after: DataFrame, before: DataFrame) -> DataFrame:
    """path: one step around the affected files, and former dependents of deleted ones, without either."""
    gone = changes.where("status = 'D'").select("path").union(changes.where("status = 'R'").select("old_path")).distinct()
    out = after.join(files.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path"))
    into = after.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path"))
    former = before.join(gone.select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path"))
    return out.union(into).union(former).distinct().join(files, "path", "left_anti").join(gone, "path", "left_anti")


def ring(seeds: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """path: the seeds widened k steps along edges in both directions."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    out = seeds.select("path").distinct()
    for _ in range(k):
        step = both.join(out.withColumnRenamed("path", "src"), "src", "left_semi").select(F.col("dst").alias("path"))
        out = out.union(step).distinct()
    return out


def narrow(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with both ends in the one-ring of the files."""
    near = ring(files, edges, 1)
    return edges.join(near.withColumnRenamed("path", "src"), "src", "left_semi").join(near.withColumnRenamed("path", "dst"), "dst", "left_semi").select(*edges.columns)


def duplicate_definitions(definitions: DataFrame, most_files: int = 1) -> DataFrame:
    """name, value, files: bindings of one value in more than so many files; unknown values don't count."""
    return definitions.where("value IS NOT NULL").groupBy("name", "value").agg(F.count_distinct("path").alias("files")).where(F.col("files") > most_files)
