"""Readers of the snapshot pair and of what other tools say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.scalars import first_glob, loose_number

REF = "struct<key:struct<scope:string,path:string,longname:string,parameters:string,ordinal:int>,kind:string,name:string,line:int>"
LEAN = "struct<callers:int,callees:int,forwards_to:string,overrides:boolean,unused_parameters:array<string>,referenced:boolean,derived:array<string>,referrers:int>"
EDGE = "array<struct<src:string,dst:string,refs:bigint,crosses_arch:boolean,import_time:int>>"
SNAPSHOT = (
    f"entities array<struct<ref:{REF},language:string,metrics:map<string,double>,archs:array<string>,is_new:boolean,referenced:boolean,lean:{LEAN}>>, file_edges {EDGE}, class_edges {EDGE}, arch_edges {EDGE}, call_edges {EDGE}, "
    "call_nodes array<struct<node:string,complexity:double,unresolved_calls:int>>, call_resolution map<string,struct<resolved:bigint,external:bigint,unresolved:bigint>>, "
    "arch_nodes array<struct<path:string,members:array<string>>>, populations map<string,map<string,array<double>>>, unavailable map<string,array<string>>, "
    "parse_errors array<struct<path:string,line:int,message:string>>, definitions array<struct<name:string,path:string,line:int,value:string,referenced:boolean>>, method_declarations map<string,bigint>, "
    "tokens struct<vocabulary:array<string>,files:map<string,array<array<string>>>,routines:map<string,struct<path:string,start:int,end:int,shape:array<int>,statements:int>>,unreadable:array<string>>"
)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents as rows; a malformed document fails the read."""
    return spark.read.schema(SNAPSHOT).json(path, multiLine=True, mode="FAILFAST")


def entities(snapshots: DataFrame) -> DataFrame:
    """One row per entity: the key's fields, kind, name, line, language, metrics, architecture nodes, referenced, lean facts."""
    e = snapshots.select(F.explode("entities").alias("e"))
    return e.select("e.ref.key.*", "e.ref.kind", "e.ref.name", "e.ref.line", "e.language", "e.metrics", "e.archs", "e.referenced", "e.lean")


def measures(entities_: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Long view of the metrics maps; wanted ones only, if given."""
    metrics = F.col("metrics") if wanted is None else F.map_filter("metrics", lambda k, _: k.isin(wanted))
    return entities_.select("scope", "path", "longname", "parameters", F.explode(metrics).alias("metric", "value"))


def unavailable(entities_: DataFrame, wanted: list[str]) -> DataFrame:
    """language, metrics: those asked for that some entity of the language lacks, sorted."""
    gaps = entities_.select("language", F.explode(F.array_except(F.array(*[F.lit(m) for m in wanted]), F.map_keys("metrics"))).alias("metric"))
    return gaps.groupBy("language").agg(F.sort_array(F.collect_set("metric")).alias("metrics"))


def edges(snapshots: DataFrame, level: str) -> DataFrame:
    """Edges of one level: file, class, arch or call."""
    return snapshots.select(F.explode(f"{level}_edges").alias("e")).select("e.*")


def parse_errors(*sides: DataFrame) -> DataFrame:
    """path, line, message of all sides, each kept once; the first side's come first."""
    parts = [s.select(F.explode("parse_errors").alias("e"), F.lit(i).alias("side")).select("e.*", "side") for i, s in enumerate(sides)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("path", "line", "message").agg(F.min("side").alias("side"))


#: The names that a column of the checker's file may have, letters and digits only.
CSV_NAMES = {"check_id": ["checkid", "id", "check"], "check_name": ["checkname", "name", "checktitle"], "directory": ["directory", "folder"], "path": ["file", "path", "filename"], "line": ["line", "linenumber"], "column": ["column", "columnnumber"], "message": ["violation", "message", "text"], "entity": ["entity"]}


def violations_csv(spark: SparkSession, path: str) -> DataFrame:
    """check_id, check_name, path, line, column, message, entity; a field is the leftmost column with one of its names. Each file has its own header line, which must be
    that of the others; rows without a file group others and go."""
    rows = spark.read.csv(path, header=True, enforceSchema=False, mode="FAILFAST", multiLine=True)
    if not rows.columns:
        raise ValueError("a checker's file needs a header")
    names = ["".join(c for c in h.lower() if c.isalnum()) for h in rows.columns]

    def pick(field: str) -> Column:
        at = next((i for i, n in enumerate(names) if n in CSV_NAMES[field]), None)
        return F.col(f"`{rows.columns[at]}`") if at is not None else F.lit(None).cast("string")

    full = F.when(pick("directory").isNotNull() & ~pick("path").contains("/"), F.concat_ws("/", pick("directory"), pick("path"))).otherwise(pick("path"))
    return rows.where(pick("path").isNotNull() & (F.trim(pick("path")) != "")).select(
        pick("check_id").alias("check_id"), pick("check_name").alias("check_name"), F.replace(full, F.lit("\\"), F.lit("/")).alias("path"),
        F.coalesce(loose_number(pick("line")).cast("int"), F.lit(0)).alias("line"), loose_number(pick("column")).cast("int").alias("column"), pick("message").alias("message"), pick("entity").alias("entity"),
    )


SARIF = "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,name:string>>>>,artifacts:array<struct<location:struct<uri:string>>>,results:array<struct<ruleId:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string,index:int>,region:struct<startLine:int,startColumn:int>>>>>>>>"


def violations_sarif(spark: SparkSession, path: str) -> DataFrame:
    """The same rows out of a SARIF document; a file is named inline or by its place among the artifacts."""
    runs = spark.read.schema(SARIF).json(path, multiLine=True, mode="FAILFAST").select(F.explode("runs").alias("r"))
    rows = runs.select("r.artifacts", "r.tool.driver.rules", F.explode("r.results").alias("x")).select("artifacts", "rules", "x", F.get("x.locations", F.lit(0))["physicalLocation"].alias("at"))
    inline, index = F.col("at.artifactLocation.uri"), F.col("at.artifactLocation.index")
    return rows.select(
        F.col("x.ruleId").alias("check_id"), F.get(F.filter("rules", lambda r: r["id"] == F.col("x.ruleId")), F.lit(0))["name"].alias("check_name"),
        F.coalesce(inline, F.get("artifacts", index)["location"]["uri"]).alias("path"), F.coalesce("at.region.startLine", F.lit(0)).alias("line"), F.col("at.region.startColumn").alias("column"), F.col("x.message.text").alias("message"), F.lit(None).cast("string").alias("entity"),
    )


def analysis_log(lines: DataFrame) -> DataFrame:
    """path, line, message: each error with the location that follows it; a newer error replaces, a warning cancels one that waits. lines: run, n, text."""
    kind = F.when(F.col("text").rlike(r"(?i)^\s*error\b"), "error").when(F.col("text").rlike(r"(?i)^\s*warning\b"), "warning").when(F.col("text").rlike(r"^\s*File:\s"), "location")
    marked = lines.withColumn("kind", kind).where("kind IS NOT NULL")
    order = W.partitionBy("run").orderBy("n")
    paired = marked.withColumn("was", F.lag("kind").over(order)).withColumn("error", F.lag("text").over(order)).where("kind = 'location' AND was = 'error'")
    return paired.select(F.regexp_extract("text", r"File:\s*(.+?)\s+Line:\s*\d+", 1).alias("path"), F.regexp_extract("text", r"Line:\s*(\d+)", 1).cast("int").alias("line"), F.trim(F.regexp_replace("error", r"(?i)^\s*error:?\s*", "")).alias("message")).distinct()


def accuracy(lines: DataFrame) -> DataFrame:
    """run, accuracy: clean by parsed files of the first line that says so; null if none does or nothing was parsed."""
    got = lines.select("run", "n", F.regexp_extract("text", r"(\d+) of (\d+) files", 1).alias("a"), F.regexp_extract("text", r"(\d+) of (\d+) files", 2).alias("b"))
    share = F.try_divide(F.col("a").try_cast("double"), F.nullif(F.col("b").try_cast("double"), F.lit(0.0)))
    return got.groupBy("run").agg(F.min_by(F.when(F.col("a") != "", share), F.when(F.col("a") != "", F.col("n"))).alias("accuracy"))


def name_status(stream: str) -> list[tuple[str, str, str | None]]:
    """(status, path, old_path) of a NUL-separated change list; copies are additions, only renames keep the old path."""
    fields = stream.split("\0")
    fields = fields[:-1] if fields and not fields[-1] else fields
    out, rest = [], iter(fields)
    for token in rest:
        letter = token[:1]
        try:
            first = next(rest)
            second = next(rest) if letter in "RC" else None
        except StopIteration:
            raise ValueError(f"the change list ends inside {token}") from None
        out.append({"R": ("R", second, first), "C": ("A", second, None)}.get(letter, (letter if letter in "AMD" else "M", first, None)))
    return out


def keep_paths(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Files under an include glob (all, if there is none) and under no exclude glob."""
    inside = first_glob(F.col("path"), include).isNotNull() if include else F.lit(True)
    return files.where(inside & first_glob(F.col("path"), exclude).isNull())


def enrolled(files: DataFrame, suffixes: DataFrame, languages: list[str]) -> DataFrame:
    """Files whose suffix belongs to an enabled language; no list means all. suffixes: suffix, language."""
    known = suffixes if not languages else suffixes.where(F.lower("language").isin([x.lower() for x in languages]))
    return files.withColumn("suffix", F.regexp_extract("path", r"(\.[^./]+)$", 1)).join(F.broadcast(known.select("suffix").distinct()), "suffix", "left_semi").drop("suffix")


def sync_delta(held: DataFrame, current: DataFrame) -> DataFrame:
    """path, change: added, modified or deleted between two listings (path, digest)."""
    both = current.withColumnRenamed("digest", "new").join(held.withColumnRenamed("digest", "old"), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")
