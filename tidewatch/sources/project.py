"""The order tables read as two snapshots of a measured code base.

Routines are customers (path: nation, longname: name, parameters: segment) measured by their orders; the before side is
what was ordered until `CUT`, the after side the rest. Files are nations, architecture nodes regions. File edges are line items from
the customer's to the supplier's nation, call edges run between the parts of neighbouring lines of an order. Definitions are
events, code lines the lines of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUT = "1998-07-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side_of(df: DataFrame) -> DataFrame:
    return df.withColumn("side", F.when(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"), "before").otherwise("after"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, scope, path, longname, parameters, metric, value."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    sums = side_of(orders).groupBy("side", "o_custkey").agg(
        F.count("*").cast("double").alias("CountOrders"),
        F.round(F.max("o_totalprice"), 2).alias("MaxPrice"),
        F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("CountOpen"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("MaxNesting"),
    )
    named = sums.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = named.select("side", F.lit("routine").alias("scope"), F.col("n_name").alias("path"), F.col("c_name").alias("longname"), F.col("c_mktsegment").alias("parameters"), "CountOrders", "MaxPrice", "CountOpen", "MaxNesting")
    return wide.unpivot(["side", "scope", "path", "longname", "parameters"], ["CountOrders", "MaxPrice", "CountOpen", "MaxNesting"], "metric", "value")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(after, before) measures."""
    m = measures(spark, sf_dir)
    return m.where("side = 'after'").drop("side"), m.where("side = 'before'").drop("side")


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, src, dst, refs."""
    orders, customer, lineitem, supplier, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "supplier", "nation"))
    n1, n2 = nation.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("src")), nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("dst"))
    from_ = side_of(orders).join(customer, F.col("o_custkey") == F.col("c_custkey")).select("side", "o_orderkey", "c_nationkey")
    to = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("n"))
    refs = from_.join(to, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("side", "c_nationkey", "s_nationkey").agg(F.sum("n").alias("refs"))
    return refs.join(F.broadcast(n1), F.col("c_nationkey") == F.col("k1")).join(F.broadcast(n2), F.col("s_nationkey") == F.col("k2")).select("side", "src", "dst", "refs")


def strong_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(after, before): the tenth of the file edges of each side with most references (nearest rank, ties kept)."""
    edges = file_edges(spark, sf_dir)
    cut = edges.groupBy("side").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY refs)").alias("cut"))  # 625 edges a side at most
    top = edges.join(F.broadcast(cut), "side").where("refs >= cut").select("side", "src", "dst", "refs")
    return top.where("side = 'after'").drop("side"), top.where("side = 'before'").drop("side")


def arch_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, path, ordinal."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("node"), F.col("n_name").alias("path"), F.col("n_nationkey").alias("ordinal"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, refs between all parts that stand next to each other in an order, however seldom."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return steps.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("refs"))


def call_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, complexity of every part; keys divisible by 7 are unmeasured."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("complexity"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, value, path."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("props").alias("value"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"))


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
