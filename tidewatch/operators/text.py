"""Repeated lines: windows of k code lines are hashed by a window function per file, equal windows meet by an equi-join on
the key, and runs of neighbouring matches are islands of code-line number minus row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.scalars import line_hash


def code_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line, idx, hash: code lines without white space; empty lines are no rows, idx counts those left from 0."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "raw"))
    kept = lines.select("path", (F.col("at") + 1).alias("line"), F.regexp_replace("raw", r"\s+", "").alias("code")).where("code <> ''")
    return kept.select("path", "line", (F.row_number().over(W.partitionBy("path").orderBy("line")) - 1).alias("idx"), line_hash(F.col("code")).alias("hash"))


def windows(lines: DataFrame, k: int) -> DataFrame:
    """path, idx, line, last_line, key: every run of k code lines."""
    ahead = W.partitionBy("path").orderBy("idx").rowsBetween(0, k - 1)
    whole = lines.select("path", "idx", "line", F.collect_list("hash").over(ahead).alias("h"), F.max("line").over(ahead).alias("last_line")).where(F.size("h") == k)
    return whole.select("path", "idx", "line", "last_line", F.sha2(F.concat_ws(",", "h"), 256).alias("key"))


def repeated_windows(lines: DataFrame, k: int) -> DataFrame:
    """windows that stand at more than one place, with their number of places."""
    w = windows(lines, k)
    many = w.groupBy("key").agg(F.count("*").alias("places")).where("places > 1")
    return w.join(many, "key")


def duplicate_blocks(lines: DataFrame, k: int = 12, subjects: DataFrame | None = None) -> DataFrame:
    """path, start, stop, code_lines, elsewhere: maximal runs of repeated windows with another place outside their own range.

    A place has one window, so the places of a run are those of its distinct keys, and no place is listed: the number of each
    key's places is known, and those inside the range are the run's own and some of the k - 1 windows that follow it."""
    rep = repeated_windows(lines, k)
    judged = rep if subjects is None else rep.join(subjects.select("path").distinct(), "path", "left_semi")
    runs = judged.withColumn("island", F.col("idx") - F.row_number().over(W.partitionBy("path").orderBy("idx")))
    blocks = runs.groupBy("path", "island").agg(F.min("line").alias("start"), F.max("last_line").alias("stop"), F.max("idx").alias("end"), (F.max("idx") - F.min("idx") + k).alias("code_lines"))
    keys = runs.groupBy("path", "island", "key").agg((F.max("places") - F.count("*")).alias("others"))
    after = blocks.where(F.lit(k > 1)).select("path", "island", F.explode(F.sequence(F.col("end") + 1, F.col("end") + max(1, k - 1))).alias("idx"))
    tail = after.join(rep.select("path", "idx", "key"), ["path", "idx"]).select("path", "island", "key", F.lit(-1).cast("bigint").alias("others")).join(keys.select("path", "island", "key"), ["path", "island", "key"], "left_semi")
    counted = keys.unionByName(tail).groupBy("path", "island").agg(F.sum("others").alias("elsewhere")).where("elsewhere > 0")
    return blocks.join(counted, ["path", "island"]).select("path", "start", "stop", "code_lines", "elsewhere")
