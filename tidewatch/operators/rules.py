"""Limits, ratchet and classification over long measures.

Measures are long rows: scope, path, longname, parameters, metric, value. Thresholds are a small table: scope, metric,
most, least, severity, ratchet. Keys are compared null-safe on parameters, since a null signature is part of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import breach, glob_regex
from tidewatch.operators.graph import stored

KEY = ["scope", "path", "longname", "parameters"]
FINDING = ["kind", "rule", "metric", *KEY, "value", "before", "limit", "severity"]

#: Counts that splitting up an entity raises, and the metrics whose fall shows that it was split.
SPLIT_COUNTS = ["routine.CountLineCode", "routine.CountStmt", "file.CountDeclFunction", "file.CountDeclClass", "file.CountLineCode", "class.CountDeclMethod", "class.CountDeclMethodNonStub", "class.CountDeclInstanceVariable", "class.CountClassCoupled", "class.CountClassDerived"]
COMPLEXITY = ["CyclomaticStrict", "CyclomaticModified", "MaxNesting", "CountPath", "MaxCyclomaticStrict"]


def same_key(a: str, b: str) -> Column:
    return (F.col(f"{a}.scope") == F.col(f"{b}.scope")) & (F.col(f"{a}.path") == F.col(f"{b}.path")) & (F.col(f"{a}.longname") == F.col(f"{b}.longname")) & F.col(f"{a}.parameters").eqNullSafe(F.col(f"{b}.parameters"))


def above_floor(measures: DataFrame, floors: dict[str, tuple[str, float]]) -> DataFrame:
    """measures without those of a floored metric on an entity that is known to be below its floor. floors: metric -> (metric that is asked, minimum)."""
    for metric, (asked, least) in floors.items():
        low = measures.where((F.col("metric") == asked) & (F.col("value") < least)).select(*KEY).distinct().alias("l")
        some, rest = measures.where(F.col("metric") == metric).alias("m"), measures.where(F.col("metric") != metric)
        measures = some.join(low, same_key("m", "l"), "left_anti").select("m.*").unionByName(rest)
    return measures


def overlaid(measures: DataFrame, thresholds: DataFrame, scopes: list[dict] | None = None) -> DataFrame:
    """measures with most, least and severity as they hold on their path: every matching scope in declaration order replaces, disables or adds, rule
    by rule. Each measure asks for its own limit only, so nothing is made for each pair of a path and a limit. scopes: as in overlay_scopes."""
    out = measures.join(thresholds.select("scope", "metric", "most", "least", "severity", F.lit(True).alias("judged")), ["scope", "metric"], "left")
    for s in scopes or []:
        hit = F.col("path").rlike(glob_regex(s["pattern"]))
        for r in s["rules"]:
            mine = hit & (F.col("scope") == r["scope"]) & (F.col("metric") == r["metric"])
            if r.get("disabled"):
                out = out.withColumn("judged", F.when(mine, F.lit(False)).otherwise(F.col("judged")))
                continue
            judged = F.coalesce("judged", F.lit(False))
            if limited := "most" in r or "least" in r:
                out = out.withColumns({c: F.when(mine, F.lit(r.get(c)).cast("double")).otherwise(F.col(c)) for c in ("most", "least")})
            severity = F.lit(r["severity"]) if r.get("severity") else F.when(judged, F.col("severity")).otherwise(F.lit("error"))
            out = out.withColumn("severity", F.when(mine & (judged | F.lit(limited)), severity).otherwise(F.col("severity"))).withColumn("judged", F.when(mine & F.lit(limited), F.lit(True)).otherwise(F.col("judged")))
    return out.where("judged").drop("judged")


def evaluate_thresholds(measures: DataFrame, thresholds: DataFrame, scopes: list[dict] | None = None) -> DataFrame:
    """A finding for each measure outside its limit; a measure at its limit passes, a missing one is silent."""
    judged = overlaid(measures, thresholds, scopes).withColumn("bound", breach(F.col("value"), F.col("most"), F.col("least"))).where("bound IS NOT NULL")
    limit = F.when(F.col("bound") == "max", F.col("most")).otherwise(F.col("least"))
    return judged.select(F.lit("threshold").alias("kind"), F.concat_ws(".", "scope", "metric").alias("rule"), "metric", *KEY, "value", F.lit(None).cast("double").alias("before"), limit.alias("limit"), "severity")


def attach_before(findings: DataFrame, before: DataFrame, unparsed: DataFrame | None = None) -> DataFrame:
    """The before value of the same key (never of a paired one); files that the before side couldn't read give none."""
    if unparsed is not None:
        before = before.join(unparsed.select("path").distinct(), "path", "left_anti")
    f, b = findings.drop("before").alias("f"), before.alias("b")
    return f.join(b, same_key("f", "b") & (F.col("f.metric") == F.col("b.metric")), "left").select(*[F.col(f"f.{c}") if c != "before" else F.col("b.value").alias("before") for c in FINDING])


def pair_signatures(after: DataFrame, before: DataFrame) -> DataFrame:
    """(scope, path, longname, parameters, old_parameters): one removed and one added signature of a name are a pair; more are not."""
    a, b = after.select(*KEY).distinct().alias("a"), before.select(*KEY).distinct().alias("b")
    added, gone = a.join(b, same_key("a", "b"), "left_anti"), b.join(a, same_key("a", "b"), "left_anti")
    family = KEY[:3]

    def single(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*family).agg(F.count("*").alias("n"), F.first("parameters").alias(name)).where("n = 1").drop("n")

    return single(added, "parameters").join(single(gone, "old_parameters"), family)


def ratchet_pairs(after: DataFrame, before: DataFrame) -> DataFrame:
    """KEY, metric, was, now of every key on both sides, signatures paired where the exact key is missing."""
    pairs = pair_signatures(after, before)
    renamed = before.alias("b").join(pairs.alias("p"), (F.col("b.scope") == F.col("p.scope")) & (F.col("b.path") == F.col("p.path")) & (F.col("b.longname") == F.col("p.longname")) & F.col("b.parameters").eqNullSafe(F.col("p.old_parameters")))
    moved = renamed.select("b.scope", "b.path", "b.longname", "p.parameters", "b.metric", "b.value")
    old = before.select(*KEY, "metric", "value").union(moved).alias("o")
    now = after.alias("n")
    return now.join(old, same_key("n", "o") & (F.col("n.metric") == F.col("o.metric"))).select(*[f"n.{c}" for c in KEY], "n.metric", F.col("o.value").alias("was"), F.col("n.value").alias("now"))


def evaluate_ratchet(after: DataFrame, before: DataFrame, thresholds: DataFrame, unparsed: DataFrame | None = None, floor: tuple[str, float] | None = None) -> DataFrame:
    """A finding for each value that moved towards its bound: up under a maximum, else down over a minimum.

    Left out are limits that don't ratchet, files that the before side couldn't read, entities below the floor on either
    side, and counts that rose because the entity was split: some complexity metric fell and none rose."""
    if unparsed is not None:
        before = before.join(unparsed.select("path").distinct(), "path", "left_anti")
    pairs = ratchet_pairs(after, before)
    if floor is not None:
        low = pairs.where((F.col("metric") == floor[0]) & (F.least("was", "now") < floor[1])).select(*KEY).distinct().alias("l")
        pairs = pairs.alias("p").join(low, same_key("p", "l"), "left_anti").select("p.*")
    change = pairs.where(F.col("metric").isin(COMPLEXITY)).groupBy(*KEY).agg(F.bool_or(F.col("now") < F.col("was")).alias("fell"), F.bool_or(F.col("now") > F.col("was")).alias("rose"))
    simpler = change.where("fell AND NOT rose").select(*KEY, F.lit(True).alias("simpler")).alias("s")
    worse = F.when(F.col("most").isNotNull() & (F.col("now") > F.col("was")), F.col("most")).when(F.col("least").isNotNull() & (F.col("now") < F.col("was")), F.col("least"))
    judged = pairs.join(F.broadcast(thresholds.where("ratchet")), ["scope", "metric"]).withColumn("limit", worse).where("limit IS NOT NULL").alias("j")
    excused = F.concat_ws(".", F.col("j.scope"), F.col("j.metric")).isin(SPLIT_COUNTS) & F.coalesce(F.col("s.simpler"), F.lit(False))
    kept = judged.join(simpler, same_key("j", "s"), "left").where(~excused)
    return kept.select(F.lit("ratchet").alias("kind"), F.concat_ws(".", F.col("j.scope"), F.col("j.metric")).alias("rule"), "j.metric", *[f"j.{c}" for c in KEY], F.col("j.now").alias("value"), F.col("j.was").alias("before"), "j.limit", "j.severity")


def within_limit() -> Column:
    """Of a ratchet finding: the value is still inside the bound that it moved towards."""
    up = F.col("value") > F.col("before")
    return (F.col("kind") == "ratchet") & F.coalesce(F.when(up, F.col("value") <= F.col("limit")).otherwise(F.col("value") >= F.col("limit")), F.lit(False))


def preexisting() -> Column:
    """Of a threshold finding: the bound was broken before, and not by less."""
    above = F.col("value") >= F.col("limit")
    same = F.when(above, (F.col("before") > F.col("limit")) & (F.col("value") <= F.col("before"))).otherwise((F.col("before") < F.col("limit")) & (F.col("value") >= F.col("before")))
    return (F.col("kind") == "threshold") & F.coalesce(same, F.lit(False))


def classify(findings: DataFrame, strict: bool = False, severities: DataFrame | None = None, below_limit: str = "warning", first_measured: DataFrame | None = None) -> DataFrame:
    """severity, preexisting, blocking: the rule's severity, then the ceiling inside the limit, then what was there before.

    severities: rule, severity. first_measured: paths that the before side couldn't read."""
    if severities is not None:
        table = severities.select("rule", F.col("severity").alias("mapped"))
        findings = findings.join(F.broadcast(table), "rule", "left").withColumn("severity", F.coalesce("mapped", "severity")).drop("mapped")
    new = F.lit(False)
    if first_measured is not None:
        findings = findings.join(first_measured.select("path").distinct().withColumn("unread", F.lit(True)), "path", "left")
        new = F.coalesce("unread", F.lit(False)) & (F.col("kind") == "threshold")
    severity = F.when(within_limit() & (F.lit(below_limit) == "warning"), "warning").otherwise(F.col("severity"))
    out = findings.withColumn("preexisting", preexisting() | new).withColumn("severity", severity)
    return out.withColumn("blocking", (F.col("severity") == "error") & (F.lit(strict) | ~F.col("preexisting"))).select(*FINDING, "preexisting", "blocking")


def acknowledge(findings: DataFrame, globs: list[str]) -> DataFrame:
    """Parse findings on acknowledged paths don't block; their severity stays."""
    known = F.lit(False)
    for g in globs:
        known = known | F.col("path").rlike(glob_regex(g))
    return findings.withColumn("blocking", F.col("blocking") & ~((F.col("kind") == "parse") & known))


def overlay_scopes(paths: DataFrame, thresholds: DataFrame, scopes: list[dict]) -> DataFrame:
    """Limits per path: every matching scope in declaration order replaces, disables or adds, rule by rule; the last one wins.

    scopes: dicts with pattern and rules, a list of dicts scope, metric, and either disabled or any of most, least, severity."""
    out = paths.select("path").distinct().crossJoin(F.broadcast(thresholds.select("scope", "metric", "most", "least", "severity")))
    for s in scopes:
        hit = F.col("path").rlike(glob_regex(s["pattern"]))
        for r in s["rules"]:
            mine = hit & (F.col("scope") == r["scope"]) & (F.col("metric") == r["metric"])
            if r.get("disabled"):
                out = out.where(~mine)
                continue
            limited = "most" in r or "least" in r
            missing = paths.select("path").distinct().where(hit).join(out.where((F.col("scope") == r["scope"]) & (F.col("metric") == r["metric"])).select("path"), "path", "left_anti")
            new = {"most": F.lit(r.get("most")).cast("double"), "least": F.lit(r.get("least")).cast("double")}
            out = out.select("path", "scope", "metric", *[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if limited else F.col(c) for c in ("most", "least")], F.when(mine, F.lit(r.get("severity") or None)).otherwise(F.col("severity")).alias("severity") if r.get("severity") else F.col("severity"))
            if limited:
                out = out.union(missing.select("path", F.lit(r["scope"]), F.lit(r["metric"]), new["most"], new["least"], F.lit(r.get("severity", "error"))))
    return out


def full_outer_delta(after: DataFrame, before: DataFrame) -> DataFrame:
    """Movement of every metric of every key, missing counting as zero; unmoved ones are left out. change: added, removed, modified."""
    a, b = after.alias("a"), before.alias("b")
    both = a.join(b, same_key("a", "b") & (F.col("a.metric") == F.col("b.metric")), "full_outer")
    row = both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*KEY, "metric"]], F.coalesce("b.value", F.lit(0.0)).alias("was"), F.coalesce("a.value", F.lit(0.0)).alias("now"), F.when(F.col("b.scope").isNull(), "added").when(F.col("a.scope").isNull(), "removed").otherwise("modified").alias("change"))
    return row.withColumn("delta", F.col("now") - F.col("was")).where("change <> 'modified' OR delta <> 0")


def top_movements(deltas: DataFrame, n: int = 10) -> DataFrame:
    """The n largest movements either way; ties by key, then metric."""
    return deltas.orderBy(F.abs("delta").desc(), *KEY, "metric").limit(n)


def net_pairs(after: DataFrame, before: DataFrame) -> DataFrame:
    """KEY, the old side's key (old_path, old_longname, old_parameters) and stage of every routine of either side, each once. after, before: KEY, body.

    First equal keys (same), of what is left the one signature removed and the one added of a name (signature), of what is left
    then the bodies that stand once on each side (moved); the rest was added or removed. A stage sees what the stages before left over only."""
    a, b = stored(after.select(*KEY, "body").dropDuplicates(KEY), "net-after"), stored(before.select(*KEY, "body").dropDuplicates(KEY), "net-before")

    def apart(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.alias("x").join(y.alias("y"), same_key("x", "y"), "left_anti")

    def told(df: DataFrame, stage: str) -> DataFrame:
        return df.select("scope", *[F.col(c) for c in (*KEY[1:], *(f"old_{k}" for k in KEY[1:]))], F.lit(stage).alias("stage"))

    both = a.alias("x").join(b.alias("y"), same_key("x", "y")).select("x.scope", *[F.col(f"x.{c}").alias(c) for c in KEY[1:]], *[F.col(f"y.{c}").alias(f"old_{c}") for c in KEY[1:]])
    new, gone = stored(apart(a, b), "net-new"), stored(apart(b, a), "net-gone")
    signed = pair_signatures(new, gone).select("scope", "path", "longname", "parameters", F.col("path").alias("old_path"), F.col("longname").alias("old_longname"), "old_parameters")
    signed = stored(signed, "net-signed")
    old_of = lambda df: df.select("scope", *[F.col(f"old_{c}").alias(c) for c in KEY[1:]])
    new, gone = stored(apart(new, signed), "net-new"), stored(apart(gone, old_of(signed)), "net-gone")

    def single(df: DataFrame, prefix: str) -> DataFrame:
        once = df.where("body IS NOT NULL").groupBy("scope", "body").agg(F.count("*").alias("n"), F.first(F.struct(*KEY[1:])).alias("k")).where("n = 1")
        return once.select("scope", "body", *[F.col(f"k.{c}").alias(f"{prefix}{c}") for c in KEY[1:]])

    moved = stored(single(new, "").join(single(gone, "old_"), ["scope", "body"]).drop("body"), "net-moved")
    added, removed = apart(new, moved), apart(gone, old_of(moved))
    none = [F.lit(None).cast("string").alias(f"old_{c}") for c in KEY[1:]]
    parts = [told(both, "same"), told(signed, "signature"), told(moved, "moved"), told(added.select(*KEY, *none), "added")]
    parts.append(told(removed.select("scope", *[F.col(c).alias(f"old_{c}") for c in KEY[1:]], *[F.lit(None).cast("string").alias(c) for c in KEY[1:]]), "removed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def net_delta(after: DataFrame, before: DataFrame, metrics: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """One row: sum after minus sum before of each metric, and the number of entities on either side; with pairs (net_pairs), a routine that moved counts once."""
    a = after.where(F.col("metric").isin(metrics)).select(*KEY, "metric", F.round("value").alias("v"))
    b = before.where(F.col("metric").isin(metrics)).select(*KEY, "metric", (-F.round("value")).alias("v"))
    both = a.union(b)
    if pairs is not None:
        sums = both.agg(*[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("v"))), F.lit(0.0)).alias(f"net_{m}") for m in metrics])
        return sums.crossJoin(F.broadcast(pairs.agg(F.count("*").alias("entities"))))
    return both.agg(*[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("v"))), F.lit(0.0)).alias(f"net_{m}") for m in metrics], F.count_distinct(F.struct(*KEY)).alias("entities"))


def run_counts(findings: DataFrame) -> DataFrame:
    """Blocking, warning and pre-existing findings of a run, and the files they lie in."""
    return findings.agg(F.count_if("blocking").alias("blocking"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if("preexisting").alias("preexisting"), F.count_distinct("path").alias("files"))


def hints(findings: DataFrame, table: DataFrame) -> DataFrame:
    """The most specific hint: for the rule, else the metric, else the general one. table: key, hint."""
    t = F.broadcast(table)
    by_rule = findings.join(t.select(F.col("key").alias("rule"), F.col("hint").alias("h1")), "rule", "left")
    by_metric = by_rule.join(t.select(F.col("key").alias("metric"), F.col("hint").alias("h2")), "metric", "left")
    general = t.where("key = '*'").agg(F.first("hint").alias("h3"))
    return by_metric.crossJoin(F.broadcast(general)).withColumn("hint", F.coalesce("h1", "h2", "h3")).drop("h1", "h2", "h3")
