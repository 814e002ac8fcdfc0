"""Figures that a gate keeps between runs, as streaming aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tightened(observed: DataFrame) -> DataFrame:
    """rule, value: the least worst value seen so far; it only falls. observed: a stream of rule, value. Update mode."""
    return observed.groupBy("rule").agg(F.min("value").alias("value"))


def last_accuracy(runs: DataFrame) -> DataFrame:
    """side, accuracy: the latest known figure of each side. runs: a stream of side, ts, accuracy; unknown figures keep the last one."""
    return runs.where("accuracy IS NOT NULL").groupBy("side").agg(F.max_by("accuracy", "ts").alias("accuracy"))


def findings_per_window(findings: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Blocking findings per rule and window of event time. findings: a stream of ts, rule, blocking. Append mode."""
    return findings.withWatermark("ts", late).groupBy(F.window("ts", length), "rule").agg(F.count_if("blocking").alias("blocking"), F.count("*").alias("findings"))


def remember_errors(errors: DataFrame, read: DataFrame, held: DataFrame) -> DataFrame:
    """Parse errors after a run: those held for files not read again, and the new ones; for use in foreachBatch."""
    return held.join(read.select("path").distinct(), "path", "left_anti").select(*held.columns).unionByName(errors)


HELD = "commit bigint, digest string, errors bigint, value double"
DELTA = "path string, commit bigint, change string, errors_before bigint, errors bigint, value_before double, value double"


def _plain(column: pd.Series) -> list:
    """A column's values, None for what is missing."""
    return [None if x is None or x != x else x for x in column.tolist()]


def _compared(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The deltas of one file's new commits against what the state holds of the last one; a commit that isn't newer is one that was seen."""
    last = state.get if state.exists else (None, None, None, None)
    rows = []
    new = [r for p in parts for r in zip(*(_plain(p[c]) for c in ("commit", "digest", "errors", "value")), strict=True)]
    for commit, digest, errors, value in sorted(new, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        if last[0] is not None and commit <= last[0]:
            continue
        old = last[1]
        if change := "added" if old is None and digest is not None else "deleted" if digest is None and old is not None else "modified" if digest != old else None:
            rows.append((key[0], int(commit), change, last[2], errors, last[3], value))
        last = (int(commit), digest, None if errors is None else int(errors), None if value is None else float(value))
    state.update(last)
    if not rows:
        return
    names = ("path", "commit", "change", "errors_before", "errors", "value_before", "value")
    yield pd.DataFrame({n: pd.Series(x, dtype=object) for n, x in zip(names, zip(*rows, strict=True), strict=True)}, copy=False)  # Arrow gives the types


def commit_deltas(changes: DataFrame) -> DataFrame:
    """What each commit did to each file (DELTA): one commit, one comparison. changes: a stream of path, commit, digest (null: the file is gone), errors, value, commits in order.

    The state of a file is its last commit, digest, errors and figure, so a run compares with the run before without reading it again; a restart goes on from
    the checkpoint, and a commit that comes twice is compared once."""
    return changes.groupBy("path").applyInPandasWithState(_compared, DELTA, HELD, "append", GroupStateTimeout.NoTimeout)


def commit_deltas_of(changes: DataFrame) -> DataFrame:
    """The same rows out of a whole table of changes."""
    order = W.partitionBy("path").orderBy("commit")
    lagged = changes.select("path", "commit", "digest", "errors", "value", *[F.lag(c).over(order).alias(f"{c}_before") for c in ("digest", "errors", "value")])
    new, old = F.col("digest"), F.col("digest_before")
    change = F.when(old.isNull() & new.isNotNull(), "added").when(new.isNull() & old.isNotNull(), "deleted").when(new != old, "modified")
    return lagged.select("path", "commit", change.alias("change"), "errors_before", "errors", "value_before", "value").where("change IS NOT NULL")
