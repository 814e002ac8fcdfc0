"""Architecture trees cut at a depth, and regions of a file tree that are of one kind.

A node is named by its segments, as a path is; "" is the root. Trees are tables of rows, and each row carries its own way up as an array
of prefixes, so a level needs no step of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import matches_any, path_prefixes

#: Roles by rank, the strongest first, and the words that declare them.
ROLES = ["not-analysed", "generated", "vendored", "tests", "product"]
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored"}
GENERATED_MARKS = [r"(?i)@generated\b", r"(?i)\bdo not edit\b", r"(?i)\bautomatically generated\b"]


def level(node: Column) -> Column:
    return F.when(node == "", 0).otherwise(F.size(F.split(node, "/")))


def cut_members(members: DataFrame, depth: int, root: str = "", nodes: DataFrame | None = None) -> DataFrame:
    """(path, node): each file (members: node, path) at every node of the cut that it lies in, or at `root` if it lies in none.

    The cut takes the nodes `depth` levels below the root, and of shallower ones those without children; a file of a shallower node that has
    children is in none. nodes (node): those of the tree that hold no file themselves."""
    rows = members.select("path", F.col("node").alias("own")).distinct()
    known = rows.select(F.col("own").alias("node")) if nodes is None else rows.select(F.col("own").alias("node")).union(nodes.select("node"))
    ways = known.distinct().select(F.explode(F.concat(F.array(F.lit("")), path_prefixes(F.col("node")))).alias("node"), F.col("node").alias("below"))
    parents = ways.where("node <> below").groupBy("node").agg(F.lit(True).alias("parent")).select(F.col("node").alias("own"), "parent")
    marked = rows.join(parents, "own", "left").withColumn("level", level(F.col("own")))
    node = F.when(F.col("level") >= depth, F.array_join(F.slice(F.split("own", "/"), 1, depth), "/") if depth else F.lit("")).when(F.col("parent").isNull(), F.col("own"))
    placed = marked.select("path", node.alias("node")).distinct()
    some = placed.groupBy("path").agg(F.count("node").alias("n"))
    return placed.join(some, "path").where("node IS NOT NULL OR n = 0").select("path", F.coalesce("node", F.lit(root)).alias("node"))


def nodes_of(placed: DataFrame) -> DataFrame:
    """(path, nodes): every node of a file, sorted."""
    return placed.groupBy("path").agg(F.sort_array(F.collect_set("node")).alias("nodes"))


def deepest_cover(files: DataFrame, nodes: DataFrame, root: str = "") -> DataFrame:
    """(path, node): the deepest of the nodes that a file's path (path) lies below, or `root`."""
    ways = files.select("path").distinct().select("path", F.explode(path_prefixes(F.col("path"))).alias("node"))
    met = ways.where("node <> path").join(nodes.select("node").distinct(), "node").groupBy("path").agg(F.max_by("node", F.length("node")).alias("node"))
    return files.select("path").distinct().join(met, "path", "left").select("path", F.coalesce("node", F.lit(root)).alias("node"))


def declared_regions(attribute_files: DataFrame) -> DataFrame:
    """(role, pattern, source, detail) that attribute files (path, text) declare, patterns from the top of the tree.

    A line is a pattern, in quotes if it holds blanks, and words; -word, !word and word=false don't set it. Comments and macros declare
    nothing. A pattern with a slash inside starts at the file's folder, any other lies at any depth below it."""
    lines = attribute_files.select("path", F.explode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line")).select("path", F.trim("line").alias("line"))
    some = lines.where(r"line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '[attr]%'")
    fields = some.select("path", F.regexp_extract("line", r'^(?:"([^"]*)"|([^"\s]\S*))(.*)$', 1).alias("quoted"), F.regexp_extract("line", r'^(?:"([^"]*)"|([^"\s]\S*))(.*)$', 2).alias("bare"), F.regexp_extract("line", r'^(?:"([^"]*)"|([^"\s]\S*))(.*)$', 3).alias("rest"))
    words = fields.select("path", F.concat("quoted", "bare").alias("given"), F.explode(F.split(F.trim("rest"), r"\s+")).alias("word")).where("given <> ''")
    name, value = F.regexp_extract("word", r"^([^=!-][^=]*)", 1), F.lower(F.regexp_extract("word", "=(.*)$", 1))
    off = F.col("word").contains("=") & value.isin("false", "0", "")
    role = F.coalesce(*[F.when(name == k, v) for k, v in ATTRIBUTES.items()])
    base = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    core = F.regexp_replace("given", "/+$", "")
    rooted = F.regexp_replace(core, "^/+", "")
    pattern = F.concat(base, F.when(rooted.contains("/") | core.startswith("/"), rooted).otherwise(F.concat(F.lit("**/"), core)))
    told = words.select(role.alias("role"), pattern.alias("pattern"), F.col("path").alias("source"), F.concat_ws(" ", "given", "word").alias("detail"), off.alias("off"))
    return told.where("role IS NOT NULL AND NOT off").drop("off").distinct()


def marked_files(files: DataFrame, test_folders: list[str], head: int = 2048) -> DataFrame:
    """(path, role, evidence) of every file (path, text): what its first characters or its folders say; null if nothing does."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    begun = F.substring(F.coalesce("text", F.lit("")), 1, head)
    made, tests = matches_any(begun, GENERATED_MARKS), F.arrays_overlap(folders, F.array(*[F.lit(x) for x in test_folders]).cast("array<string>"))
    role = F.when(made, "generated").when(tests, "tests")
    return files.select("path", role.alias("role"), F.when(made, "header").when(tests, "folder").alias("evidence"))


def uniform_regions(files: DataFrame) -> DataFrame:
    """dir, role, files, evidence, pattern: the largest subtrees of which every file (path, role, evidence) has the same role.

    Counts of every folder come up from its files in one aggregation, which combines before it shuffles, so a folder with most files is as
    cheap as any; a folder counts if its own folder does not. A file may be a region of its own; evidence is that of the first file."""
    way = files.select("role", F.struct("path", "evidence").alias("first"), F.explode(F.concat(F.array(F.lit("")), path_prefixes(F.col("path")))).alias("dir"), "path")
    counted = way.groupBy("dir").agg(F.count("*").alias("files"), F.count("role").alias("known"), F.min("role").alias("role"), F.max("role").alias("other"), F.min("first").alias("first"), F.bool_or(F.col("dir") == F.col("path")).alias("leaf"))
    whole = counted.where("files = known AND role = other")
    parent = F.when(F.col("dir").contains("/"), F.regexp_extract("dir", "^(.*)/[^/]*$", 1)).when(F.col("dir") != "", F.lit(""))
    above = whole.select(F.col("dir").alias("parent"))
    top = whole.withColumn("parent", parent).join(above, "parent", "left_anti")
    pattern = F.when(F.col("leaf"), F.col("dir")).when(F.col("dir") == "", "**").otherwise(F.concat("dir", F.lit("/**")))
    return top.select("dir", "role", "files", F.concat_ws(": ", "first.path", "first.evidence").alias("evidence"), pattern.alias("pattern"))


def covered(regions: DataFrame, files: DataFrame) -> DataFrame:
    """regions (role, pattern, ...) with covered, the number of files (path) below them: a pattern's leading folders without a wildcard
    are joined with the files' own folders, and only those files are held against its regex."""
    fixed = F.regexp_extract("pattern", r"^((?:[^*?/]+/)*)", 1)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("pattern"), r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\*\*/", "\u0001"), r"\*\*", "\u0002"), r"\*", "[^/]*"), r"\?", "[^/]")
    regex = F.concat(F.lit("^"), F.replace(F.replace(body, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*")), F.lit("(?:/.*)?$"))
    named = regions.withColumn("at", F.regexp_replace(fixed, "/$", "")).withColumn("regex", regex)
    ways = files.select("path").distinct().select("path", F.explode(F.concat(F.array(F.lit("")), path_prefixes(F.col("path")))).alias("at"))
    hits = named.select("at", "regex", "pattern").distinct().join(ways, "at").where(F.rlike("path", "regex")).groupBy("pattern").agg(F.count_distinct("path").alias("covered"))
    return regions.join(hits, "pattern", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def proposal(regions: DataFrame) -> DataFrame:
    """line, pattern, evidence, rank: what a configuration would say of regions (role, pattern, covered, evidence). Generated and vendored ones are excludes, tests
    a scope; a region that covers nothing is left out. Nothing is applied."""
    line = F.when(F.col("role").isin("generated", "vendored"), "exclude").when(F.col("role") == "tests", "scope")
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    note = F.concat(F.col("evidence"), F.lit(" ("), F.col("covered").cast("string"), F.lit(" files)"))
    return regions.where(F.col("covered") > 0).select(line.alias("line"), "pattern", note.alias("evidence"), rank.alias("rank")).where("line IS NOT NULL")
