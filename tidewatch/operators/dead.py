"""Dead code and needless layers: anti-joins on recorded facts, behind floors of trust.

facts: one row per entity with key (string), path, language, scope, and the nullable facts that a rule asks for. A fact
that was not measured is null, never false. A rule whose fact is missing on any judged entity reports nothing and
says so in a note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import matches_any

FLOOR = 0.75


def trust(resolution: DataFrame, accuracy: float | None, floor: float = FLOOR) -> DataFrame:
    """language, trusted, reason: the run's accuracy first, then each language's share of calls bound inside the project.

    resolution: language, resolved, external, unresolved. A figure that is missing or below the floor refuses."""
    inner = F.try_divide(F.col("resolved"), F.col("resolved") + F.col("unresolved"))
    run = F.when(F.lit(accuracy).isNull() | (F.lit(accuracy) < floor), "accuracy")
    reason = F.coalesce(run, F.when(inner.isNull() | (inner < floor), F.concat(F.lit("resolution of "), F.col("language"))))
    return resolution.select("language", reason.isNull().alias("trusted"), reason.alias("reason"))


def gated(found: DataFrame, trusted: DataFrame) -> DataFrame:
    """Findings whose language is trusted; a language that isn't listed is refused."""
    return found.join(F.broadcast(trusted.where("trusted").select("language")), "language", "left_semi")


def unavailable(facts: DataFrame, fact: str, any_missing: bool = True) -> DataFrame:
    """One row 'missing' when any judged entity lacks the fact (or all do); else no row."""
    gap = F.count_if(F.col(fact).isNull()) > 0 if any_missing else (F.count(fact) == 0) & (F.count("*") > 0)
    return facts.agg(gap.alias("missing"), F.lit(fact).alias("fact")).where("missing")


def unreferenced(facts: DataFrame, excused: list[str] | None = None, trusted: DataFrame | None = None) -> DataFrame:
    """Entities known to be unreferenced and not excused by name; with a gate, of trusted languages."""
    found = facts.where(F.col("referenced") == F.lit(False)).where(~matches_any(F.col("longname"), excused or []))
    return found if trusted is None else gated(found, trusted)


def unused_parameters(facts: DataFrame, declarations: DataFrame, excused: list[str] | None = None) -> DataFrame:
    """(key, parameter): unused, on a routine that overrides nothing and whose short name fewer than two classes declare. declarations: name, classes."""
    rows = facts.where(~F.coalesce("overrides", F.lit(False))).select("key", "longname", "path", F.element_at(F.split("longname", r"\."), -1).alias("name"), F.explode("unused_parameters").alias("parameter"))
    known = rows.join(declarations, "name", "left").where(F.coalesce("classes", F.lit(0)) < 2)
    return known.where(~matches_any(F.col("longname"), excused or [])).select("key", "parameter")


def method_declarations(classes: DataFrame) -> DataFrame:
    """name, classes: how many classes declare a method of that name. classes: class, method."""
    return classes.groupBy(F.col("method").alias("name")).agg(F.count_distinct("class").alias("classes"))


def pass_through(facts: DataFrame, most_statements: int = 2, excused: list[str] | None = None) -> DataFrame:
    """Routines with one caller and one named callee, no override, and at most so many measured statements."""
    return facts.where((F.col("callers") == 1) & (F.col("callees") == 1) & F.col("forwards_to").isNotNull() & ~F.coalesce("overrides", F.lit(False)) & (F.col("statements") <= most_statements)).where(~matches_any(F.col("longname"), excused or []))


def single_implementations(facts: DataFrame, touched: DataFrame, excused: list[str] | None = None) -> DataFrame:
    """Classes with one derived class and no other referrer, where the base or the derived class was touched. touched: key."""
    one = facts.where((F.size("derived") == 1) & (F.col("referrers") == 0)).select("key", "longname", F.element_at("derived", 1).alias("implementation"))
    near = touched.select("key").distinct()
    base = one.join(near, "key", "left_semi")
    derived = one.join(near.select(F.col("key").alias("implementation")), "implementation", "left_semi").select(*base.columns)
    return base.union(derived).distinct().where(~matches_any(F.col("longname"), excused or []))


def over_exports(entities: DataFrame, edges: DataFrame, variables: DataFrame) -> DataFrame:
    """path, importer: files that hold one routine or class, bind no variable, and have exactly one dependant."""
    single = entities.where(F.col("scope").isin("routine", "class")).groupBy("path").agg(F.count("*").alias("n")).where("n = 1").select("path")
    bare = single.join(variables.select("path").distinct(), "path", "left_anti")
    users = edges.where("src <> dst").groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("n"), F.min("src").alias("importer")).where("n = 1")
    return bare.join(users, "path").select("path", "importer")


def call_facts(calls: DataFrame) -> DataFrame:
    """key, callers, callees, forwards_to: distinct project callers and callees; the callee's name where there is one."""
    pairs = calls.where("src <> dst").select("src", "dst").distinct()
    into = pairs.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("callers"))
    out = pairs.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("callees"), F.min("dst").alias("one"))
    both = into.join(out, "key", "full_outer")
    return both.select("key", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"), F.when(F.col("callees") == 1, F.col("one")).alias("forwards_to"))


def ordinals(records: DataFrame, key: list[str]) -> DataFrame:
    """Rows of one key numbered from 0 in file order: line (null last), kind, name."""
    from pyspark.sql import Window as W

    return records.withColumn("ordinal", F.row_number().over(W.partitionBy(*key).orderBy(F.col("line").asc_nulls_last(), "kind", "name")) - 1)


def resolution_counts(calls: DataFrame, bucket: Column) -> DataFrame:
    """language, resolved, external, unresolved: calls by the given bucket."""
    return calls.withColumn("b", bucket).groupBy("language").agg(*[F.count_if(F.col("b") == n).alias(n) for n in ("resolved", "external", "unresolved")])
