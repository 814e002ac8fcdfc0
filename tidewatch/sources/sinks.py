"""Findings as documents: JSON lines, SARIF, text and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(findings: DataFrame) -> DataFrame:
    """One JSON document per finding, nulls kept."""
    return findings.select(F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule, result: a SARIF result per finding; pre-existing ones are notes, findings without a file have no physical location."""
    level = F.when(F.col("preexisting"), "note").otherwise(F.col("severity"))
    where = F.when((F.col("path") != "") & (F.col("scope") != "arch"), F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))))
    text = F.format_string("%s of %s is %s, the limit is %s", "metric", "longname", F.col("value").cast("string"), F.col("limit").cast("string"))
    return findings.select("rule", F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), where.alias("locations"))).alias("result"))


def sarif(findings: DataFrame, version: str = "1.0") -> str:
    """A whole SARIF 2.1.0 log of a bounded report: rules by name, each result with its rule's place."""
    rows = sarif_results(findings).orderBy("rule", "result").collect()
    names = sorted({r["rule"] for r in rows})
    results = [json.loads(r["result"]) | {"ruleIndex": names.index(r["rule"])} for r in rows]
    run = {"tool": {"driver": {"name": "tidewatch", "version": version, "rules": [{"id": n} for n in names]}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]})


def human(findings: DataFrame) -> DataFrame:
    """path, report: the findings of each path, errors first, farthest outside first."""
    distance = F.when(F.col("kind") == "threshold", F.when(F.col("value") > F.col("limit"), F.try_divide(F.col("value"), F.col("limit"))).otherwise(F.try_divide(F.col("limit"), F.col("value"))))
    line = F.format_string("%s %s %s: %s (limit %s)", "severity", "rule", "longname", F.col("value").cast("string"), F.col("limit").cast("string"))
    rows = findings.select("path", F.struct((F.col("severity") != "error").alias("a"), (-F.coalesce(distance, F.lit(0.0))).alias("b"), F.col("rule").alias("c"), line.alias("line")).alias("x"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("report"))


def markdown(deltas: DataFrame, n: int = 20) -> str:
    """A table of the n largest movements."""
    rows = deltas.orderBy(F.abs("delta").desc(), "path", "longname", "metric").limit(n).collect()
    body = [f"| {r['path']} | {r['longname']} | {r['metric']} | {r['was']:g} | {r['now']:g} | {r['delta']:+g} |" for r in rows]
    return "\n".join(["| path | entity | metric | before | after | change |", "| --- | --- | --- | --- | --- | --- |", *body])


def between_markers(existing: str, snippet: str, begin: str = "<!-- tidewatch:begin -->", end: str = "<!-- tidewatch:end -->") -> str:
    """`existing` with the snippet between the markers, put at the end if they are missing; doing it twice changes nothing."""
    block = f"{begin}\n{snippet.strip()}\n{end}"
    if begin in existing and end in existing:
        return existing[: existing.index(begin)] + block + existing[existing.index(end) + len(end) :]
    return (existing.rstrip("\n") + "\n\n" if existing.strip() else "") + block + "\n"


def graph_dot(edges: DataFrame, name: str = "g") -> str:
    """A bounded edge list as DOT text."""
    rows = edges.select("src", "dst", "refs").orderBy("src", "dst").collect()
    return "\n".join([f"digraph {json.dumps(name)} {{", *[f"  {json.dumps(str(r['src']))} -> {json.dumps(str(r['dst']))} [label={r['refs']}];" for r in rows], "}"])
