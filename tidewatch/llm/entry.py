"""The queries of this subpackage: thin callables over the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontam, jaccard, langid, lm, negatives, quality, simhash, spelling, toxicity
from tidewatch.llm._io import bucket_of, table
from tidewatch.llm._labels import training_ids
from tidewatch.llm.licenses import scan_licenses
from tidewatch.llm.mpeg import media_digest
from tidewatch.llm.packing import pack_documents
from tidewatch.llm.warc import read_bundles, write_bundles

#: The ranks file holds the vocabulary of byte_bpe_50k.json; tests hold the ids against that file's.
BYTE_BPE, BYTE_BPE_SPECIALS = public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = (bucket_of("doc_id", 3) == 1).alias("held_out")
    net = langid.fit(docs.where(bucket_of("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", held, "text"), net).select("doc_id", "held_out", "lang_pred", "score")


def op2_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"))).drop("bundle", "frame", "frame_offset")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, *training_ids(table(spark, sf_dir, "labels"), "toxic", toxicity.SAMPLE))
    scored = toxicity.score(docs.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "text"), model)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, *training_ids(table(spark, sf_dir, "labels"), "quality", quality.SAMPLE))
    scored = toxicity.score(docs.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "text"), model)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = bucket_of("doc_id", 5) == 1
    return lm.score_documents(docs.select("doc_id", held.alias("held_out"), "text"), docs.where(~held).select("text"), PIECE_MODEL)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, BYTE_BPE_SPECIALS)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.vectors_of(rows, label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mpeg_media": op2_mpeg_media,
    "op3_warc_bundles": op3_warc_bundles,
    "op4_decontamination": op4_decontamination,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ngram_join": op10_ngram_join,
    "op11_simhash": op11_simhash,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM s a JOIN s b USING (shingle) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            WHERE a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n
            HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor, r.vec_id AS other, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
            FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
        SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 3
    """,
    "op3_warc_bundles": """
        SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN n < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n < 1000 OR page_id = top THEN NULL ELSE top END AS refers_to
        FROM (SELECT page_id, body, strlen(body) AS n, max(page_id) OVER (PARTITION BY body) AS top
              FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))
    """,
}
