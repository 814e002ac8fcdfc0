"""Layered settings and the tables that the rules read."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shipped limits, scope.metric -> a maximum, or a table with min.
DEFAULTS: dict[str, dict] = {
    "thresholds": {
        "routine": {"CyclomaticStrict": 10, "CyclomaticModified": 8, "Essential": 4, "MaxNesting": 3, "CountLineCode": 60, "CountStmt": 40, "CountParams": 5, "CountPath": 100, "CountLineComment": 20, "LinesPerStatement": 4.0},
        "class": {"CountDeclMethod": 20, "CountDeclMethodNonStub": 15, "CountDeclInstanceVariable": 10, "MaxInheritanceTree": 4, "CountClassDerived": 8, "CountClassCoupled": 12, "PercentLackOfCohesion": 70},
        "file": {"CountLineCode": 500, "CountDeclFunction": 25, "CountDeclClass": 3, "MaxCyclomaticStrict": 10, "RatioCommentToCode": {"min": 0.1}},
        "project": {"AVG:CyclomaticStrict": 3, "MaxCyclomaticStrict": 15, "AVG:CountLineCode": 30, "MaxNesting": 5},
    },
    "structure": {"arch_depth": 2, "cycles": "error", "max_new_dependencies": 5, "fan": {"file": {"in": 50, "out": 20}, "class": {"in": 30, "out": 12}}},
    "lean": {"min_duplicate_lines": 12, "similarity": 0.9, "min_statements": 6, "min_family": 2, "pass_through_statements": 2, "accuracy_floor": 0.75, "resolution_floor": 0.75},
    "ratchet": {"strict": False, "below_limit_severity": "warning"},
    "output": {"graphs_max": 20, "impact_depth": 3, "top": 10},
}

#: Counts that don't ratchet unless they are told to.
NO_RATCHET = ["file.CountDeclFunction", "file.CountDeclClass", "file.CountLineCode", "class.CountDeclMethod", "class.CountDeclMethodNonStub", "class.CountDeclInstanceVariable", "class.CountClassCoupled", "class.CountClassDerived"]


#: Shipped limits that warn.
SOFT = {"file.RatioCommentToCode", "class.PercentLackOfCohesion", "routine.Essential", "class.MaxInheritanceTree", "routine.CountLineComment", "routine.LinesPerStatement"}


def merge(layers: list[tuple[str, Mapping]]) -> tuple[dict, dict[str, str]]:
    """(settings, layer of every leaf): later layers win; tables merge, lists and scalars replace, and a bare number over a limit's table changes its maximum only."""
    out: dict = {}
    origin: dict[str, str] = {}

    def put(into: dict, new: Mapping, path: str, name: str) -> None:
        for key, value in new.items():
            at, old = f"{path}.{key}".lstrip("."), into.get(key)
            if isinstance(value, Mapping):
                if not isinstance(old, dict):
                    old = {"max": old} if isinstance(old, (int, float)) and not isinstance(old, bool) else {}
                into[key] = dict(old)
                put(into[key], value, at, name)
            elif isinstance(old, dict) and isinstance(value, (int, float)) and not isinstance(value, bool) and at.startswith("thresholds."):
                into[key] = old | {"max": value}
                origin[f"{at}.max"] = name
            else:
                into[key] = value
                origin[at] = name

    for name, layer in layers:
        put(out, layer, "", name)
    return out, origin


def load(*texts: tuple[str, str]) -> tuple[dict, dict[str, str]]:
    """The defaults under the given (name, TOML text) layers, in order."""
    return merge([("default", DEFAULTS), *[(name, tomllib.loads(text)) for name, text in texts]])


def thresholds(spark: SparkSession, settings: Mapping) -> DataFrame:
    """scope, prefix, metric, most, least, severity, ratchet: the nested limits as rows."""
    rows = []
    for scope, table in settings["thresholds"].items():
        for name, value in table.items():
            spec = value if isinstance(value, Mapping) else {"max": value}
            prefix, _, metric = name.rpartition(":")
            ratchet = spec.get("ratchet", f"{scope}.{name}" not in NO_RATCHET)
            rows.append((scope, prefix.upper() or None, metric, None if spec.get("max") is None else float(spec["max"]), None if spec.get("min") is None else float(spec["min"]), spec.get("severity", "warning" if f"{scope}.{name}" in SOFT else "error"), bool(ratchet)))
    return spark.createDataFrame(rows, "scope string, prefix string, metric string, most double, least double, severity string, ratchet boolean")


def usable(limits: DataFrame, available: DataFrame) -> DataFrame:
    """Limits whose metric some language offers at that scope. available: language, scope, metric."""
    return limits.join(F.broadcast(available.select("scope", "metric").distinct()), ["scope", "metric"], "left_semi")


def population_limits(limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(limits on elements, limits on populations): prefixed ones, and those of scopes without elements, speak of populations."""
    of_all = F.col("prefix").isNotNull() | F.col("scope").isin("project", "arch")
    return limits.where(~of_all), limits.where(of_all)
