"""Small summaries of a run: counts, worst entities, evidence, and the findings that no limit table gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.scalars import glob_regex, shown

#: Scopes in the order in which counts are told, with their plural.
SCOPES = [("routine", "routines"), ("class", "classes"), ("file", "files"), ("arch", "nodes"), ("project", "projects")]
KEY = ["path", "longname", "parameters"]


def entity_counts(entities: DataFrame) -> DataFrame:
    """scope, entities: distinct keys of each scope. entities: scope, path, longname, parameters."""
    return entities.select("scope", *KEY).distinct().groupBy("scope").agg(F.count("*").alias("entities"))


def counts_line(counts: DataFrame) -> DataFrame:
    """One row: the scopes that were measured, in their order, as '12 routines, 3 classes'."""
    told = [F.max(F.when((F.col("scope") == s) & (F.col("entities") > 0), F.format_string(f"%d {many}", "entities"))) for s, many in SCOPES]
    return counts.agg(F.concat_ws(", ", *told).alias("line"))


def ignored_counts(entities: DataFrame, globs: list[str]) -> DataFrame:
    """scope, ignored: distinct keys whose path an ignore glob covers."""
    rx = [glob_regex(g) for g in globs if g]
    hit = F.lit(False)
    for r in rx:
        hit = hit | F.col("path").rlike(r)
    return entity_counts(entities.where(hit)).withColumnRenamed("entities", "ignored")


def population_vectors(long: DataFrame) -> DataFrame:
    """scope, metric, value, n: each population as its distinct values with their number; no array is built."""
    return long.where("value IS NOT NULL").groupBy("scope", "metric", "value").agg(F.count("*").alias("n"))


def project_values(vectors: DataFrame) -> DataFrame:
    """metric, value: what a metric without a reducer means for a scope without entities: the largest of its vector."""
    return vectors.groupBy("metric").agg(F.max("value").alias("value"))


def worst(long: DataFrame, n: int = 3) -> DataFrame:
    """The n entities of the largest values of each (scope, metric), ties by key; ranked per (scope, metric, salt) first, so
    that no task sorts a whole population."""
    order = [F.col("value").desc(), *KEY]
    some = long.where("value IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(64)))
    near = some.withColumn("rank", F.row_number().over(W.partitionBy("scope", "metric", "salt").orderBy(*order))).where(F.col("rank") <= n)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("scope", "metric").orderBy(*order))).where(F.col("rank") <= n).drop("salt")


def top_values(long: DataFrame, n: int = 10) -> DataFrame:
    """The n largest values of all metrics, ties by metric and key."""
    return long.where("value IS NOT NULL").orderBy(F.col("value").desc(), "metric", *KEY).limit(n)


def deviations(advice: DataFrame) -> DataFrame:
    """The rules whose proposal differs from what is configured, with a line of evidence. advice: as stats.recommend gives it."""
    line = F.concat(F.lit("p95 "), shown(F.col("p95")), F.lit(" of "), F.col("n").cast("string"), F.lit(", largest "), shown(F.col("maximum")))
    return advice.where("verdict = 'raise'").select("metric", "configured", "proposed", line.alias("evidence"))


def heaviest(reached: DataFrame, nodes: DataFrame, n: int = 3) -> DataFrame:
    """(seed, rank, node, complexity): the n heaviest measured nodes that a seed reaches, itself left out."""
    order = W.partitionBy("seed").orderBy(F.col("complexity").desc(), "node")
    heavy = reached.where("seed <> node").join(nodes.where("complexity IS NOT NULL"), "node")
    return heavy.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("seed", "rank", "node", "complexity")


def latest(entries: DataFrame, keys: list[str], time: str, n: int = 8, tie: str = "id") -> DataFrame:
    """The n newest entries of each key; the larger id keeps a tie."""
    order = W.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def accuracy_findings(figures: DataFrame, floor: float | None) -> DataFrame:
    """A warning, never blocking, for each side whose figure is known and below the floor. figures: side, accuracy."""
    low = figures.where(F.col("accuracy") < floor) if floor is not None else figures.limit(0)
    return low.select(F.lit("analysis.accuracy").alias("rule"), "side", F.col("accuracy").alias("value"), F.lit(floor).cast("double").alias("limit"), F.lit("warning").alias("severity"), F.lit(False).alias("blocking"))


def relative(path: Column, root: str | None) -> Column:
    """The path below the root; a path that isn't below it stays as it is."""
    if not root:
        return path
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30)).otherwise(path)


def checker_findings(violations: DataFrame, severity: str, root: str | None = None) -> DataFrame:
    """Rows of an outside checker as findings. violations: check_id, path, line, message; line 0 means the file."""
    path = relative(F.replace("path", F.lit("\\"), F.lit("/")), root)
    return violations.select(F.concat(F.lit("codecheck."), F.col("check_id")).alias("rule"), path.alias("path"), F.when(F.col("line") > 0, F.col("line")).alias("line"), "message", F.lit(severity).alias("severity"), F.lit(severity == "error").alias("blocking"))


def net_growth(net: DataFrame, most: float | None, severity: str = "warning", statements: str = "net_CountStmt") -> DataFrame:
    """One finding if a change adds more statements than `most`; exactly as many are inside. net: the row of rules.net_delta."""
    over = net.where(F.col(statements) > most) if most is not None else net.limit(0)
    return over.select(F.lit("structure.net_growth").alias("rule"), F.col(statements).alias("value"), F.lit(most).cast("double").alias("limit"), "entities", F.lit(severity).alias("severity"), F.lit(severity == "error").alias("blocking"))


def touched(changes: DataFrame) -> DataFrame:
    """path: every path that a change names, the old side of renames included."""
    return changes.select(F.explode(F.array("path", "old_path")).alias("path")).where("path IS NOT NULL").distinct()


def with_extra_metrics(wide: DataFrame, extra: DataFrame, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entities with the extra metrics that they have, metrics that no entity has). wide: key, ...; extra: key, metric, value,
    read for the entities in `wide` only."""
    mine = extra.where(F.col("metric").isin(wanted)).join(wide.select("key").distinct(), "key", "left_semi")
    maps = mine.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("metric", "value")))).alias("extra"))
    spark = wide.sparkSession
    missing = spark.createDataFrame([(m,) for m in wanted], "metric string").join(mine.select("metric").distinct(), "metric", "left_anti")
    return wide.join(maps, "key", "left"), missing
