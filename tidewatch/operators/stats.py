"""Population statistics: exact order statistics without a sort in one task, distributions, limit advice, baselines.

Order statistics start from value counts (map-side combined). The counts are cut into ranges at approximate quantiles;
running counts are taken inside a range and shifted by the sum of the ranges before it. So a population of any size,
even a single one, is ranked by many tasks, and the result is exact whatever the quantiles' error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.scalars import ladder_at_least, rungs_around
from tidewatch.operators.graph import stored

RANGES = 64
TAIL_RATIO = 50.0


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, upto (rows not above the value), total; one row per distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    cuts = stored(cuts, "cuts")  # they place rows twice below and must be the same
    cut = counts.join(cuts, keys) if keys else counts.crossJoin(F.broadcast(cuts))
    ranged = cut.withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    sums = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("rows"))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = sums.select(*keys, "part", (F.sum("rows").over(group.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(group).alias("total"))
    placed = ranged.join(before, [*keys, "part"])
    running = F.sum("n").over(W.partitionBy(*keys, "part").orderBy("value"))
    return placed.select(*keys, "value", "n", (running + F.col("before")).alias("upto"), "total")


def at_rank(rank: Column) -> Column:
    """Aggregate over value_ranks: the value of the given 1-based rank."""
    return F.min(F.when(F.col("upto") >= rank, F.col("value")))


def nearest_rank(share: float) -> Column:
    return at_rank(F.greatest(F.lit(1), F.ceil(F.round(F.col("total") * F.lit(share), 6))))


def reducers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The eight population reducers per key."""
    ranks = value_ranks(df, keys, value)
    n = F.col("total")
    low, high = at_rank(F.floor((n + 1) / 2)), at_rank(F.floor(n / 2) + 1)
    grouped = F.max(F.struct(F.col("n"), -F.col("value")))
    order = ranks.groupBy(*keys).agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("avg"), low.alias("median_low"), high.alias("median_high"), grouped.alias("m"), F.first("total").alias("total")
    )
    with_mid = order.select(*keys, "avg", "median_low", "median_high", ((F.col("median_low") + F.col("median_high")) / 2).alias("median"), (-F.col("m")["col2"]).alias("mode"), "total")
    joined = ranks.drop("total").join(with_mid, keys) if keys else ranks.drop("total").crossJoin(F.broadcast(with_mid))
    delta = F.col("value") - F.col("avg")
    last = joined.groupBy(*keys, "avg", "median", "median_low", "median_high", "mode", "total").agg(
        F.sum(F.when(F.col("value") < F.col("median_high"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("value") == F.col("median_high"), F.col("n")).otherwise(0)).alias("equal"),
        (F.sum(delta * delta * F.col("n")) / F.first("total")).alias("variance"),
    )
    return last.select(*keys, "avg", "median", "median_low", "median_high", (F.col("median_high") - 0.5 + (F.col("total") / 2 - F.col("below")) / F.col("equal")).alias("median_grouped"), "mode", F.sqrt("variance").alias("stdev"), "variance")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, nearest-rank p50, p90, p95, p99 and maximum per key."""
    return value_ranks(df, keys, value).groupBy(*keys).agg(F.first("total").alias("n"), *[nearest_rank(s / 100).alias(f"p{s}") for s in (50, 90, 95, 99)], F.max("value").alias("maximum"))


def outside_counts(df: DataFrame, keys: list[str], value: str, limits: DataFrame) -> DataFrame:
    """For each limit (keys, limit) of a small table: rows strictly above it, and their share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    joined = counts.join(F.broadcast(limits), keys) if keys else counts.crossJoin(F.broadcast(limits))
    above = F.sum(F.when(F.col("value") > F.col("limit"), F.col("n")).otherwise(0))
    return joined.groupBy(*keys, "limit").agg(above.alias("outside"), (above / F.sum("n")).alias("share_outside"))


def advice(ranks: DataFrame, keys: list[str], configured: DataFrame, target: float = 0.95) -> DataFrame:
    """Keep or raise each configured limit (keys, configured): a proposal only widens, and tells of a dominating tail. ranks: value_ranks."""
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "wanted": target}
    shape = ranks.groupBy(*keys).agg(F.first("total").alias("n"), *[nearest_rank(s).alias(name) for name, s in shares.items()], F.max("value").alias("maximum")).join(configured, keys)
    fit = ladder_at_least(F.col("wanted"))
    tail = F.col("maximum") / F.greatest("p95", F.lit(1.0))
    return shape.select(
        *keys, "n", "p50", "p90", "p95", "p99", "maximum", "configured",
        F.when(fit > F.col("configured"), "raise").otherwise("keep").alias("verdict"),
        F.when(fit > F.col("configured"), fit).alias("proposed"), tail.alias("tail_ratio"), (tail >= TAIL_RATIO).alias("tail_dominated"),
    )


def candidates(ranks: DataFrame, keys: list[str], advised: DataFrame) -> DataFrame:
    """keys, limit, outside, share_outside, is_configured, is_proposed: the configured limit, the proposal and the rungs within two places of either, up to
    the largest value (or the proposal), and how many values each leaves outside. One pass over the ranks answers all limits of a key."""
    anchor = F.coalesce("proposed", "configured")
    near = F.concat(F.array("configured", anchor), rungs_around(F.col("configured")), rungs_around(anchor))
    top = F.greatest("maximum", anchor)
    wanted = advised.select(*keys, "configured", "proposed", "n", F.array_sort(F.array_distinct(F.filter(near, lambda x: x <= top))).alias("limits"))
    over = ranks.select(*keys, "value", F.col("n").alias("times")).join(wanted.select(*keys, "limits"), keys).select(*keys, "times", F.explode(F.filter("limits", lambda x: x < F.col("value"))).alias("limit"))
    outside = over.groupBy(*keys, "limit").agg(F.sum("times").alias("outside"))
    every = wanted.select(*keys, "configured", "proposed", "n", F.explode("limits").alias("limit")).join(outside, [*keys, "limit"], "left")
    count = F.coalesce("outside", F.lit(0))
    return every.select(*keys, "limit", count.alias("outside"), (count / F.col("n")).alias("share_outside"), (F.col("limit") == F.col("configured")).alias("is_configured"), F.coalesce(F.col("limit") == F.col("proposed"), F.lit(False)).alias("is_proposed"))


def recommend(df: DataFrame, keys: list[str], value: str, configured: DataFrame, target: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(advice, candidates) of each configured limit (keys, configured); the population is ranked once for both."""
    ranks = stored(value_ranks(df, keys, value), "ranks")
    advised = stored(advice(ranks, keys, configured, target), "advice")
    return advised, candidates(ranks, keys, advised)


def highest(long: DataFrame, id_col: str) -> DataFrame:
    """The largest value per (scope, metric) and its holder; the smallest id keeps ties."""
    best = long.groupBy("scope", "metric").agg(F.max("value").alias("value"))
    return long.join(best, ["scope", "metric", "value"]).groupBy("scope", "metric", "value").agg(F.min(id_col).alias("holder"))


def baseline_capture(long: DataFrame, limits: DataFrame) -> DataFrame:
    """rule -> worst value: the maximum, or the minimum where only a minimum is set. limits: scope, metric, most, least."""
    ends = long.join(F.broadcast(limits), ["scope", "metric"]).groupBy("scope", "metric", "most", "least").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    return ends.select(F.concat_ws(".", "scope", "metric").alias("rule"), F.when(F.col("most").isNotNull(), F.col("hi")).otherwise(F.col("lo")).alias("value"))


def baseline_apply(limits: DataFrame, baseline: DataFrame) -> DataFrame:
    """Effective limits: a baseline only narrows; one below the configured minimum is an issue and is left out."""
    v, most, least = F.col("value"), F.col("most"), F.col("least")
    bad = most.isNotNull() & least.isNotNull() & (v < least) & (v < most)
    narrow_top = most.isNotNull() & (v < most) & ~F.coalesce(bad, F.lit(False))
    narrow_low = most.isNull() & least.isNotNull() & (v > least)
    return limits.join(baseline, "rule", "left").select(
        "rule", F.when(narrow_top, v).otherwise(most).alias("most"), F.when(narrow_low, v).otherwise(least).alias("least"),
        F.when(narrow_top | narrow_low, "baseline").otherwise("config").alias("source"), F.coalesce(bad, F.lit(False)).alias("issue"),
    )


def baseline_tighten(baseline: DataFrame, observed: DataFrame) -> DataFrame:
    """Stored values lowered where the run did better, never raised: rule, value, was."""
    return baseline.join(observed.withColumnRenamed("value", "seen"), "rule", "left").select("rule", F.least("value", "seen").alias("value"), F.col("value").alias("was"), F.coalesce(F.col("seen") < F.col("value"), F.lit(False)).alias("tightened"))
