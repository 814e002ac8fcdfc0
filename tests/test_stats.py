import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidewatch.operators import stats


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 20), min_size=1, max_size=60))
def test_reducers_equal_the_standard_library(spark, values):
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    r = stats.reducers(df, ["k"], "v").first()
    assert r.median == statistics.median(values) and r.median_low == statistics.median_low(values) and r.median_high == statistics.median_high(values)
    assert r.median_grouped == pytest.approx(statistics.median_grouped(values)) and r["mode"] == statistics.mode(sorted(values))
    assert r.avg == pytest.approx(statistics.mean(values)) and r.variance == pytest.approx(statistics.pvariance(values), abs=1e-9)


def test_distribution_is_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert tuple(stats.distribution(df, [], "v").first()) == (100, 50.0, 90.0, 95.0, 99.0, 100.0)
    assert tuple(stats.distribution(spark.createDataFrame([(7.0,)], "v double"), [], "v").first()) == (1, 7.0, 7.0, 7.0, 7.0, 7.0)
    assert stats.distribution(spark.createDataFrame([], "v double"), [], "v").first()["n"] is None


def test_baselines_only_narrow(spark):
    limits = spark.createDataFrame([("a", 10.0, None), ("b", 10.0, None), ("c", None, 2.0), ("d", 10.0, 5.0), ("e", 10.0, None)], "rule string, most double, least double")
    base = spark.createDataFrame([("a", 7.0), ("b", 12.0), ("c", 3.0), ("d", 4.0)], "rule string, value double")
    assert rows(stats.baseline_apply(limits, base)) == [("a", 7.0, None, "baseline", False), ("b", 10.0, None, "config", False), ("c", None, 3.0, "baseline", False), ("d", 10.0, 5.0, "config", True), ("e", 10.0, None, "config", False)]
    assert rows(stats.baseline_tighten(base, spark.createDataFrame([("a", 5.0), ("b", 13.0)], "rule string, value double")).where("tightened").select("rule", "value")) == [("a", 5.0)]


def test_advice_only_widens(spark):
    df = spark.createDataFrame([("m", float(v)) for v in [1] * 90 + [7] * 8 + [900] * 2], "metric string, value double")
    r = stats.recommend(df, ["metric"], "value", spark.createDataFrame([("m", 5.0)], "metric string, configured double"))[0].first()
    assert (r.verdict, r.proposed, r.tail_dominated) == ("raise", 8.0, True)
    assert stats.recommend(df, ["metric"], "value", spark.createDataFrame([("m", 50.0)], "metric string, configured double"))[0].first().verdict == "keep"


def test_candidates_stand_two_rungs_either_side(spark):
    """10 is kept, 7 is raised to 100; both give their neighbours up to the largest value, and a limit between rungs the ladder's first two."""
    values = [float(v) for v in range(1, 101)]
    df = spark.createDataFrame([(m, v) for m in ("kept", "raised", "top") for v in values], "metric string, v double")
    limits = spark.createDataFrame([("kept", 100.0), ("raised", 7.0), ("top", 60.0), ("unknown", 1.0)], "metric string, configured double")
    advised, near = stats.recommend(df, ["metric"], "v", limits)
    assert rows(advised.select("metric", "verdict", "proposed")) == [("kept", "keep", None), ("raised", "raise", 100.0), ("top", "raise", 100.0)]
    got = {m: [] for m in ("kept", "raised", "top")}
    for r in near.orderBy("limit").collect():
        got[r.metric].append(r["limit"])
        assert r.outside == sum(v > r["limit"] for v in values) and r.share_outside == pytest.approx(r.outside / 100) and r.is_configured == (r["limit"] == {"kept": 100, "raised": 7, "top": 60}[r.metric])
    assert got == {"kept": [60.0, 80.0, 100.0], "raised": [1.0, 2.0, 7.0, 60.0, 80.0, 100.0], "top": [10.0, 40.0, 50.0, 60.0, 80.0, 100.0]}
