"""The whole check of a change, and its summary, out of two sides' tables.

A run is every rule family over the files that a change touches, as one table of findings. Families are independent plans that end in the same
columns, so Spark runs them side by side; a family whose tables or limits aren't given takes no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import dead, graph, rules, similar, stats, structure, summary, text
from tidewatch.operators.graph import stored

#: Exit codes of a run.
OK, VIOLATIONS = 0, 1

FOUND = [*rules.FINDING, "detail", "preexisting", "blocking"]


@dataclass
class Side:
    """One side of a change. Needed are measures (long), edges between files (src, dst, refs, and import_time if it is known) and the files that
    could not be read (path, line, message); the others are for the rules that ask for them."""

    measures: DataFrame
    edges: DataFrame
    unparsed: DataFrame
    members: DataFrame | None = None  # node, path, ordinal: files of the architecture
    calls: DataFrame | None = None  # src, dst, refs between routines
    facts: DataFrame | None = None  # key, path, longname, language, scope and the lean facts
    definitions: DataFrame | None = None  # name, value, path
    files: DataFrame | None = None  # path, text
    routines: DataFrame | None = None  # token, path, start, stop, shape
    accuracy: float | None = None


@dataclass
class Limits:
    """What a run holds its findings against; None switches a rule off."""

    thresholds: DataFrame  # scope, metric, most, least, severity, ratchet
    scopes: list[dict] = field(default_factory=list)
    floors: dict[str, tuple[str, float]] = field(default_factory=dict)
    baseline: DataFrame | None = None  # rule, value
    populations: DataFrame | None = None  # scope, metric, prefix, most, least, severity
    severities: DataFrame | None = None  # rule, severity
    hints: DataFrame | None = None  # key, hint
    acknowledged: list[str] = field(default_factory=list)
    strict: bool = False
    below_limit: str = "warning"
    fan_in: int | None = None
    fan_out: int | None = None
    new_dependencies: int | None = None
    cycles: bool = False
    layers: DataFrame | None = None  # layer, node, may
    couplings: DataFrame | None = None  # src, dst, most
    reachable_complexity: float | None = None
    definition_files: int | None = None
    net_growth: tuple[str, float] | None = None  # metric, most
    accuracy: float | None = None
    trust: DataFrame | None = None  # language, trusted
    unused: list[str] = field(default_factory=list)  # scopes of which unused entities are findings
    excused: list[str] = field(default_factory=list)
    pass_through: int | None = None
    duplicate_block: int | None = None
    similarity: float | None = None
    rule_severity: str = "error"
    lean_severity: str = "warning"


def _finding(df: DataFrame, kind: str, rule: Column | str, path: str | None, value: Column | None = None, limit: Column | None = None, severity: Column | str = "error", scope: str = "file", longname: str | None = None, before: Column | None = None, detail: Column | None = None) -> DataFrame:
    """Rows of a rule in the columns of a finding."""
    none, given = F.lit(None).cast("double"), lambda c: F.lit(c) if isinstance(c, str) else c
    number = lambda c: none if c is None else c.cast("double")
    where = F.lit("") if path is None else F.col(path).cast("string")
    sort = given(severity)
    return df.select(
        F.lit(kind).alias("kind"), given(rule).alias("rule"), F.lit(None).cast("string").alias("metric"), F.lit(scope).alias("scope"), where.alias("path"), (where if longname is None else F.col(longname).cast("string")).alias("longname"), F.lit(None).cast("string").alias("parameters"),
        number(value).alias("value"), number(before).alias("before"), number(limit).alias("limit"), sort.alias("severity"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"), F.lit(False).alias("preexisting"), (sort == "error").alias("blocking"),
    )


def effective(limits: Limits) -> DataFrame:
    """thresholds with the baseline applied: it only narrows, and one that contradicts a minimum is left out."""
    if limits.baseline is None:
        return limits.thresholds
    named = limits.thresholds.withColumn("rule", F.concat_ws(".", "scope", "metric"))
    narrowed = stats.baseline_apply(named, limits.baseline).select("rule", "most", "least")
    return named.drop("most", "least").join(narrowed, "rule").select(*limits.thresholds.columns)


def measured_findings(after: Side, before: Side, files: DataFrame, limits: Limits) -> DataFrame:
    """Limits and ratchet on the affected files; entities below a metric's floor are judged on neither side."""
    table = effective(limits)
    now, was = (rules.above_floor(s.measures, limits.floors) for s in (after, before))
    judged = now.join(files, "path", "left_semi").select(*after.measures.columns)
    found = rules.attach_before(rules.evaluate_thresholds(judged, table, limits.scopes), was, before.unparsed)
    moved = rules.evaluate_ratchet(judged, was, table, before.unparsed)
    done = rules.classify(found.unionByName(moved), limits.strict, None, limits.below_limit, before.unparsed)
    return done.select(*rules.FINDING, F.lit(None).cast("string").alias("detail"), "preexisting", "blocking")


def structure_findings(after: Side, before: Side, changes: DataFrame, files: DataFrame, limits: Limits) -> list[DataFrame]:
    """Fans, new dependencies, cycles, layers, couplings, reach and definitions."""
    out, hard = [], limits.rule_severity
    if limits.fan_in is not None or limits.fan_out is not None:
        near = files.union(structure.neighbourhood(files, changes, after.edges, before.edges)).select(F.col("path").alias("node"))
        none = 1 << 31
        fans = structure.fan_findings(after.edges, before.edges, none if limits.fan_in is None else limits.fan_in, none if limits.fan_out is None else limits.fan_out, near)
        out.append(_finding(fans if limits.fan_out is not None else fans.where("rule <> 'structure.fan_out'"), "structural", F.col("rule"), "node", F.col("value"), F.col("limit"), hard, before=F.col("before"), detail=F.col("kind")))
    plain = structure.without_namespaces(after.edges, after.measures)
    if limits.new_dependencies is not None:
        added = structure.new_dependencies(plain, before.edges, files, limits.new_dependencies)
        out.append(_finding(added, "structural", "structure.new_dependencies", "src", F.col("added"), F.lit(limits.new_dependencies), hard))
    if limits.cycles:
        timed = [structure.import_time_only(s.edges) if "import_time" in s.edges.columns else s.edges for s in (after, before)]
        out.append(_finding(graph.new_cycles(*timed), "structural", "structure.file_cycle", "component", F.col("members"), None, hard))
    if after.members is not None:
        if limits.layers is not None:
            broken = structure.layer_findings(after.edges, before.edges, after.members, limits.layers)
            out.append(_finding(broken, "structural", F.concat(F.lit("structure.layer."), "layer"), "src", None, None, hard, detail=F.concat_ws(" -> ", "src_node", "dst_node", "dst")))
        if limits.couplings is not None:
            tight = structure.coupling_findings(structure.roll_up(after.edges, after.members), limits.couplings)
            out.append(_finding(tight, "structural", "structure.coupling", "src", F.col("refs"), F.col("most"), hard, "project", detail=F.col("dst")))
        if limits.cycles and before.members is not None:
            rolled = [structure.roll_up(s.edges, s.members) for s in (after, before)]
            out.append(_finding(graph.new_cycles(*rolled), "structural", "structure.arch_cycle", "component", F.col("members"), None, hard, "project"))
    if after.calls is not None and limits.reachable_complexity is not None:
        weights = after.measures.where("metric = 'CyclomaticStrict' AND scope = 'routine'").select(F.col("longname").alias("node"), F.col("value").alias("complexity"))
        subjects = after.measures.where("scope = 'routine'").join(files, "path", "left_semi").select(F.col("longname").alias("node"), "path").distinct()
        heavy = graph.reachable_complexity(subjects, after.calls, weights, limits.reachable_complexity).join(subjects, "node")
        out.append(_finding(heavy, "structural", "structure.reachable_complexity", "path", F.col("complexity"), F.lit(limits.reachable_complexity), hard, "routine", "node"))
    if after.definitions is not None and limits.definition_files is not None:
        twice = structure.duplicate_definitions(after.definitions, limits.definition_files)
        mine = after.definitions.join(files, "path", "left_semi").select("name", "value", "path").distinct()
        here = twice.join(mine, ["name", "value"]).groupBy("name", "value", "files").agg(F.min("path").alias("path"))
        out.append(_finding(here, "structural", "structure.duplicate_definition", "path", F.col("files"), F.lit(limits.definition_files), limits.lean_severity, longname="name", detail=F.col("value")))
    return out


def lean_findings(after: Side, files: DataFrame, limits: Limits) -> list[DataFrame]:
    """What nothing uses, layers that only hand on, and text that stands twice. All but the last two ask the trust gate."""
    out, soft = [], limits.lean_severity
    if after.facts is not None and limits.trust is not None:
        mine = dead.gated(after.facts.join(files, "path", "left_semi"), limits.trust)
        for scope in limits.unused:
            idle = dead.unreferenced(mine.where(F.col("scope") == scope), limits.excused)
            out.append(_finding(idle, "structural", f"structure.unused_{scope}", "path", None, None, soft, scope, "longname"))
        if limits.pass_through is not None:
            thin = dead.pass_through(mine, limits.pass_through, limits.excused)
            out.append(_finding(thin, "structural", "structure.pass_through", "path", F.col("statements"), F.lit(limits.pass_through), soft, "routine", "longname", detail=F.col("forwards_to")))
    if after.files is not None and limits.duplicate_block is not None:
        blocks = text.duplicate_blocks(text.code_lines(after.files), limits.duplicate_block, files)
        out.append(_finding(blocks, "structural", "structure.duplicate_block", "path", F.col("code_lines"), F.lit(limits.duplicate_block), soft, detail=F.concat_ws("-", "start", "stop")))
    if after.routines is not None and limits.similarity is not None:
        touched = after.routines.join(files, "path", "left_semi").select("token")
        family = similar.similar_families(after.routines, touched, limits.similarity).where("family = token").join(after.routines.select("token", "path"), "token")
        out.append(_finding(family, "structural", "structure.similar_routine", "path", F.col("size"), F.lit(1), soft, "routine", "token", detail=F.round("weakest", 4)))
    return out


def parse_errors(side: Side, files: DataFrame) -> DataFrame:
    """path, errors, first (the message on its first line) of the files that could not be read."""
    return side.unparsed.join(files, "path", "left_semi").groupBy("path").agg(F.count("*").alias("errors"), F.min_by("message", "line").alias("first"))


def run_findings(after: Side, before: Side, files: DataFrame, limits: Limits, violations: DataFrame | None) -> list[DataFrame]:
    """What could not be read, how much was, what another checker says, whole populations, and the net movement."""
    out = [_finding(parse_errors(after, files), "parse", "analysis.parse_error", "path", F.col("errors"), detail=F.col("first"))]
    if limits.accuracy is not None:
        known = [(name, s.accuracy) for name, s in (("after", after), ("before", before)) if s.accuracy is not None]
        figures = after.measures.sparkSession.createDataFrame(known, "side string, accuracy double")
        out.append(_finding(summary.accuracy_findings(figures, limits.accuracy), "analysis", "analysis.accuracy", None, F.col("value"), F.col("limit"), "warning", "project", detail=F.col("side")))
    if violations is not None:
        told = summary.checker_findings(violations.join(files, "path", "left_semi").select(*violations.columns), limits.rule_severity)
        out.append(_finding(told, "codecheck", F.col("rule"), "path", F.col("line"), None, limits.rule_severity, detail=F.col("message")))
    if limits.populations is not None:
        wide = populations(after.measures, limits.populations)
        bound = F.when(F.col("value") > F.col("most"), F.col("most")).otherwise(F.col("least"))
        out.append(_finding(wide, "population", F.concat_ws(".", "scope", F.concat("prefix", "metric")), None, F.col("value"), bound, F.col("severity"), "project"))
    if limits.net_growth is not None:
        metric, most = limits.net_growth
        net = rules.net_delta(*(s.measures.join(files, "path", "left_semi").select(*s.measures.columns) for s in (after, before)), [metric])
        out.append(_finding(summary.net_growth(net, most, limits.lean_severity, f"net_{metric}"), "structural", "structure.net_growth", None, F.col("value"), F.col("limit"), limits.lean_severity, "project"))
    return out


def check(after: Side, before: Side, changes: DataFrame, limits: Limits, violations: DataFrame | None = None) -> DataFrame:
    """All findings (FOUND, and hint if hints are given) of the files that a change affects. changes: status, path, old_path; violations: rows of another checker.

    A rule's severity may be set (severities), which decides anew whether it blocks; what was there before blocks under `strict` only, and parse findings
    on acknowledged paths don't."""
    files = stored(structure.affected(changes, after.edges, before.edges), "affected")
    parts = [measured_findings(after, before, files, limits), *structure_findings(after, before, changes, files, limits), *lean_findings(after, files, limits), *run_findings(after, before, files, limits, violations)]
    out = parts[0].select(*FOUND)
    for p in parts[1:]:
        out = out.union(p.select(*FOUND))
    if limits.severities is not None:
        table = limits.severities.select("rule", F.col("severity").alias("mapped"))
        out = out.join(table, "rule", "left").withColumn("severity", F.when(rules.within_limit() & (F.lit(limits.below_limit) == "warning"), F.col("severity")).otherwise(F.coalesce("mapped", "severity")))
        out = out.withColumn("blocking", (F.col("severity") == "error") & (F.lit(limits.strict) | ~F.col("preexisting"))).select(*FOUND)
    out = rules.acknowledge(out, limits.acknowledged)
    return out if limits.hints is None else rules.hints(out, limits.hints).select(*FOUND, "hint")


def populations(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """Findings on populations: every reducer of each (scope, metric), held against limits with prefix, most and least."""
    wide = stats.reducers(measures, ["scope", "metric"], "value")
    names = {"AVG": "avg", "MEDIAN": "median", "MEDIANLOW": "median_low", "MEDIANHIGH": "median_high", "MEDIANGROUPED": "median_grouped", "MODE": "mode", "STDEV": "stdev", "VARIANCE": "variance"}
    long = wide.select("scope", "metric", F.explode(F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c))])).alias("prefix", "value"))
    return long.join(limits, ["scope", "metric", "prefix"]).where((F.col("value") > F.col("most")) | (F.col("value") < F.col("least")))


def exit_code(findings: DataFrame) -> int:
    return OK if findings.where("blocking").isEmpty() else VIOLATIONS


def explain(after: Side, before: Side, top: int = 10) -> dict[str, DataFrame]:
    """A change in frames: movements, the largest of them, new dependencies of files and of architecture nodes, who depends on what changed, and the net movement."""
    deltas = stored(rules.full_outer_delta(after.measures, before.measures), "deltas")
    frames = {"deltas": deltas, "top": rules.top_movements(deltas, top), "dependencies": structure.new_edges(after.edges, before.edges), "net": rules.net_delta(after.measures, before.measures, ["CountStmt", "CountLineCode"])}
    frames["impact"] = graph.impact(deltas.select(F.col("path").alias("node")).distinct(), after.edges)
    if after.members is not None and before.members is not None:
        frames["node_dependencies"] = structure.new_edges(*(structure.roll_up(s.edges, s.members) for s in (after, before)))
    return frames
