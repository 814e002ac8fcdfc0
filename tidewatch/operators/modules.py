"""Imports and definitions of source files (path, text): what runs when a module is imported, and what only stands in it.

Files are parsed once each; everything after that is joins of lines with intervals of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.source import initialiser_text, module_outline
from tidewatch.operators.facts import lines_in_spans
from tidewatch.operators.graph import stored


def outlines(files: DataFrame) -> DataFrame:
    """path, text, parsed, quiet, imports, bindings of every file, stored."""
    return stored(files.select("path", "text", module_outline("text").alias("o")).select("path", "text", "o.*"), "outlines")


def deferred_lines(outline: DataFrame) -> DataFrame:
    """(path, line) of the lines that an import of their file doesn't run: bodies of functions, and what only a type checker reads."""
    return outline.select("path", F.explode("quiet").alias("q")).select("path", F.explode(F.sequence("q.start", "q.stop")).alias("line")).distinct()


def import_edges(outline: DataFrame, modules: DataFrame) -> DataFrame:
    """src, dst, refs, import_time between files; modules (target, path) names the file of an import. Imports of anything else are no edges.

    import_time counts the imports on lines that run, by a join of import lines with the intervals that don't."""
    found = outline.select("path", F.explode("imports").alias("i")).select("path", "i.line", "i.target")
    quiet = outline.select("path", F.posexplode("quiet").alias("key", "q")).select("path", "key", "q.start", "q.stop")
    later = lines_in_spans(found.select("path", "line").distinct(), quiet).select("path", "line").distinct().withColumn("later", F.lit(1))
    marked = found.join(later, ["path", "line"], "left").join(modules.select("target", F.col("path").alias("dst")), "target")
    return marked.groupBy(F.col("path").alias("src"), "dst").agg(F.count("*").alias("refs"), F.count_if(F.col("later").isNull()).alias("import_time"))


def definitions(outline: DataFrame) -> DataFrame:
    """name, path, line, value: the names that a file binds at its top, with their initialisers."""
    bound = outline.select("path", "text", F.explode("bindings").alias("b"))
    return bound.select("b.name", "path", "b.line", initialiser_text(F.col("text"), F.col("b.line")).alias("value"))
