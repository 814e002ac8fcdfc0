"""Strict reading of snapshot documents: every field that the schema doesn't know, every value of another type, and every key that stands twice.

Documents are parsed once, to variants. A level of the loop takes all values of one depth apart, each with the pattern of its path (array places are [], map keys {}),
and a small table of the schema's patterns says what may stand there; what may not is an issue and is not looked into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, MapType, StringType, StructType

from tidewatch.operators.graph import Grown, stored
from tidewatch.sources.readers import SNAPSHOT

ISSUE = "doc string, at string, issue string, detail string"


def patterns(schema: StructType) -> list[tuple[str, str]]:
    """(pattern, kind) of everything that a document may hold."""
    out: list[tuple[str, str]] = []

    def walk(at: str, kind: DataType) -> None:
        if isinstance(kind, StructType):
            out.append((at, "object"))
            for f in kind.fields:
                walk(f"{at}.{f.name}", f.dataType)
        elif isinstance(kind, ArrayType):
            out.append((at, "array"))
            walk(f"{at}[]", kind.elementType)
        elif isinstance(kind, MapType):
            out.append((at, "map"))
            walk(f"{at}{{}}", kind.valueType)
        else:
            out.append((at, "integer" if isinstance(kind, IntegralType) else "number" if isinstance(kind, FractionalType) else "boolean" if isinstance(kind, BooleanType) else "string" if isinstance(kind, StringType) else "any"))

    walk("$", schema)
    return out


#: The names by which Spark tells what a variant holds, by what the schema asks for.
HOLDS = {"object": "^OBJECT<|^VOID$", "map": "^OBJECT<|^VOID$", "array": "^ARRAY<|^VOID$", "integer": "^BIGINT$|^VOID$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$|^VOID$", "boolean": "^BOOLEAN$|^VOID$", "string": "^STRING$|^VOID$", "any": ""}


def issues(documents: DataFrame, schema: StructType | None = None, keyed: str | None = "$.entities[].ref.key") -> DataFrame:
    """doc, at, issue, detail: what is wrong with documents (doc, text), a row each. Issues: malformed (no JSON, or an object that has a field twice), unknown field,
    wrong type, duplicate key (a value at the pattern `keyed` that another one of the document equals). A null text is malformed; a document without issues gives no row."""
    spark = documents.sparkSession
    schema = spark.createDataFrame([], SNAPSHOT).schema if schema is None else schema
    known = spark.createDataFrame(patterns(schema), "pattern string, kind string")  # as many rows as the schema has fields
    holds = F.coalesce(*[F.when(F.col("kind") == k, F.col("type").rlike(v)) for k, v in HOLDS.items()])
    parsed = documents.select(F.col("doc").cast("string").alias("doc"), F.try_parse_json("text").alias("v"))
    level = stored(parsed.select("doc", F.lit("$").alias("pattern"), F.lit("$").alias("at"), "v"), "wire")
    found = Grown(spark, "wire-issues", spark.createDataFrame([], ISSUE).schema)
    keys = Grown(spark, "wire-keys", spark.createDataFrame([], "doc string, at string, text string").schema)
    found.add(level.where("v IS NULL").select("doc", "at", F.lit("malformed").alias("issue"), F.lit(None).cast("string").alias("detail")))
    level = level.where("v IS NOT NULL")
    while True:
        told = level.withColumn("type", F.schema_of_variant("v")).join(F.broadcast(known), "pattern", "left")
        issue = F.when(F.col("kind").isNull(), "unknown field").when(~holds, "wrong type")
        told = told.withColumn("issue", issue).withColumn("inner", F.expr("issue IS NULL AND kind IN ('object', 'array', 'map') AND type <> 'VOID'"))
        is_key = F.lit(False) if keyed is None else (F.col("pattern") == keyed) & F.col("issue").isNull()
        told = told.withColumn("is_key", is_key).where("issue IS NOT NULL OR inner OR is_key")  # a plain value that may stand there is done with
        told = stored(told.withColumn("v", F.when(F.col("inner") | F.col("is_key"), F.col("v"))), "wire")
        found.add(told.where("issue IS NOT NULL").select("doc", "at", "issue", F.when(F.col("issue") == "wrong type", F.concat_ws(" for ", "type", "kind")).alias("detail")))
        if keyed is not None:
            keys.add(told.where("is_key").select("doc", "at", F.to_json("v").alias("text")))
        inner = told.where("inner")
        if inner.isEmpty():
            break
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("doc", "pattern", "kind", "at", "pos", "key", "value")
        step = F.when(F.col("kind") == "array", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        below = F.when(F.col("kind") == "array", F.concat("pattern", F.lit("[]"))).when(F.col("kind") == "map", F.concat("pattern", F.lit("{}"))).otherwise(F.concat("pattern", F.lit("."), "key"))
        level = parts.select("doc", below.alias("pattern"), F.concat("at", step).alias("at"), F.col("value").alias("v"))
    if keyed is not None:
        twice = keys.rows().groupBy("doc", "text").agg(F.min("at").alias("at"), F.count("*").alias("n")).where("n > 1")
        found.add(twice.select("doc", "at", F.lit("duplicate key").alias("issue"), F.col("text").alias("detail")))
    return found.rows()


def strict(spark: SparkSession, path: str) -> DataFrame:
    """The issues of the snapshot documents at a path, one document a file."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))
    return issues(texts)
