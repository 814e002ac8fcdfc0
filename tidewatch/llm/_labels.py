"""Bounded samples of labelled documents, the only rows that a classifier's labels come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._io import bucket_of


def training_ids(labels: DataFrame, target: str, per_class: dict[int, int], held: tuple[int, int] = (5, 0), id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(sample of doc_id and y, size of each class among the rows open for training).

    Open are labelled rows whose crc32(id) mod held[0] is not held[1]. Of each class the sample takes the rows of
    smallest id hash, at most per_class[y]: the sample, not the input, bounds what reaches the driver.
    """
    open_rows = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull() & (bucket_of(id_col, held[0]) != held[1])).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(target).cast("int").alias("y"))
    sizes = {int(r["y"]): int(r["n"]) for r in open_rows.where(F.col("y").isin(list(per_class))).groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [open_rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in per_class.items()]
    rows = [(r["doc_id"], r["y"]) for part in parts for r in part.collect()]
    one = dict(rows)  # a document labelled twice counts once
    return labels.sparkSession.createDataFrame(list(one.items()) or [], "doc_id bigint, y int"), sizes
