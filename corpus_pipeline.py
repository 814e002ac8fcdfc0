"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the folder that
all machines share and read again as the next stage's documents. All stages but the last return the columns
of documents, unchanged, of the rows that they keep. The models of the first two stages learn from the columns that their
stage is given, in bounded samples; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontam, jaccard, langid, toxicity
from tidewatch.llm._io import bucket_of, kept, table
from tidewatch.llm._labels import training_ids
from tidewatch.llm.entry import BYTE_BPE, BYTE_BPE_SPECIALS
from tidewatch.llm.packing import pack_documents

#: A document goes if its toxicity score reaches the first, or if no language is told with the second.
TOXIC, SURE = 0.5, 0.3

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; the labels are those of sf_dir. Each row is judged on its own text; a
    text that is null or empty is not toxic, and without labels no text is."""
    model = toxicity.fit(docs, *training_ids(table(spark, sf_dir, "labels"), "toxic", toxicity.SAMPLE))
    return toxicity.score(docs, model, keep_text=True).where(F.col("score") < TOXIC).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which one of the learned languages is told with a probability of SURE or more; `und` goes."""
    net = langid.fit(docs.where(bucket_of("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    told = langid.predict(docs, net, keep_text=True)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest doc_id, for each group of near copies; rows without words stay, and ids don't link rows."""
    return jaccard.one_of_each_group(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no item of the benchmark of sf_dir; rows without a text stay."""
    return decontam.without(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of at most 1024 tokens; a text that is null or empty
    gives its end token, rows that repeat are packed each on its own, no rows give none."""
    return pack_documents(docs, BYTE_BPE, BYTE_BPE_SPECIALS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_copies", keep_one_per_group),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The stages' models are beyond SQL; the tests hold the last three stages against brute force and the first two against planted rows.
ORACLE_SQL: str | None = None
