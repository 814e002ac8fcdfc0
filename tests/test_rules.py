from tests.conftest import rows
from tidewatch.operators import rules

M = "scope string, path string, longname string, parameters string, metric string, value double"
T = "scope string, metric string, most double, least double, severity string, ratchet boolean"


def m(spark, data):
    return spark.createDataFrame([("routine", "f", n, p, k, v) for n, p, k, v in data], M)


def limit(spark, *data):
    return spark.createDataFrame([("routine", *d) for d in data], T)


def test_limits_are_exclusive(spark):
    got = rules.evaluate_thresholds(m(spark, [("a", None, "X", 10.0), ("b", None, "X", 11.0), ("c", None, "X", 1.0), ("d", None, "X", 0.5), ("e", None, "X", None), ("f", None, "Y", 99.0)]), limit(spark, ("X", 10.0, 1.0, "error", True)))
    assert rows(got.select("longname", "limit")) == [("b", 10.0), ("d", 1.0)]


def test_before_value_never_comes_from_a_paired_signature(spark):
    found = rules.evaluate_thresholds(m(spark, [("a", "int", "X", 11.0), ("b", None, "X", 12.0)]), limit(spark, ("X", 10.0, None, "error", True)))
    got = rules.attach_before(found, m(spark, [("a", "long", "X", 9.0), ("b", None, "X", 12.0)]))
    assert rows(got.select("longname", "before")) == [("a", None), ("b", 12.0)]


def test_signatures_pair_only_one_to_one(spark):
    after = m(spark, [("a", "x", "X", 2.0), ("b", "x", "X", 2.0), ("b", "y", "X", 2.0), ("c", None, "X", 1.0)])
    before = m(spark, [("a", "w", "X", 1.0), ("b", "v", "X", 1.0), ("b", "u", "X", 1.0), ("c", None, "X", 1.0)])
    assert rows(rules.pair_signatures(after, before).select("longname", "parameters", "old_parameters")) == [("a", "x", "w")]
    assert rows(rules.evaluate_ratchet(after, before, limit(spark, ("X", 10.0, None, "error", True))).select("longname", "before")) == [("a", 1.0)]


def test_a_split_entity_may_count_more(spark):
    after = m(spark, [("a", None, "CountStmt", 9.0), ("a", None, "MaxNesting", 1.0), ("b", None, "CountStmt", 9.0), ("b", None, "MaxNesting", 3.0)])
    before = m(spark, [("a", None, "CountStmt", 5.0), ("a", None, "MaxNesting", 2.0), ("b", None, "CountStmt", 5.0), ("b", None, "MaxNesting", 3.0)])
    got = rules.evaluate_ratchet(after, before, limit(spark, ("CountStmt", 40.0, None, "error", True)))
    assert rows(got.select("longname")) == [("b",)]
    assert rows(rules.evaluate_ratchet(after, before, limit(spark, ("CountStmt", 40.0, None, "error", True)), floor=("CountStmt", 6.0))) == []
    assert rows(rules.evaluate_ratchet(after, before, limit(spark, ("CountStmt", 40.0, None, "error", True)), unparsed=spark.createDataFrame([("f",)], "path string"))) == []


def test_classification(spark):
    f = "kind string, rule string, metric string, scope string, path string, longname string, parameters string, value double, before double, limit double, severity string"
    data = [("threshold", "r", "X", "routine", "f", n, None, v, b, 10.0, "error") for n, v, b in [("old", 12.0, 12.0), ("worse", 13.0, 12.0), ("new", 12.0, None)]]
    data += [("ratchet", "r", "X", "routine", "f", "inside", None, 9.0, 8.0, 10.0, "error"), ("ratchet", "r", "X", "routine", "f", "outside", None, 12.0, 11.0, 10.0, "error")]
    got = rules.classify(spark.createDataFrame(data, f))
    assert rows(got.select("longname", "severity", "preexisting", "blocking")) == [("inside", "warning", False, False), ("new", "error", False, True), ("old", "error", True, False), ("outside", "error", False, True), ("worse", "error", False, True)]
    strict = rules.classify(spark.createDataFrame(data, f), strict=True).where("blocking")
    assert {r.longname for r in strict.collect()} == {"new", "old", "outside", "worse"}
    demoted = rules.classify(spark.createDataFrame(data, f), severities=spark.createDataFrame([("r", "warning")], "rule string, severity string"))
    assert demoted.where("blocking").isEmpty()


def test_scopes_overlay_in_order(spark):
    paths = spark.createDataFrame([("src/a.py",), ("tests/b.py",)], "path string")
    table = limit(spark, ("X", 10.0, None, "error", True))
    scopes = [{"pattern": "tests", "rules": [{"scope": "routine", "metric": "X", "most": 50.0}]}, {"pattern": "**/b.py", "rules": [{"scope": "routine", "metric": "X", "most": 70.0}, {"scope": "routine", "metric": "Z", "most": 1.0}]}]
    assert rows(rules.overlay_scopes(paths, table, scopes).select("path", "metric", "most")) == [("src/a.py", "X", 10.0), ("tests/b.py", "X", 70.0), ("tests/b.py", "Z", 1.0)]
    off = [{"pattern": "tests", "rules": [{"scope": "routine", "metric": "X", "disabled": True}]}]
    assert rows(rules.overlay_scopes(paths, table, off).select("path")) == [("src/a.py",)]


def test_net_pairs_take_each_routine_once(spark):
    r = "scope string, path string, longname string, parameters string, body string"
    after = [("a", "f", "x", "1"), ("a", "g", "y", "2"), ("b", "h", None, "3"), ("b", "i", None, "4"), ("b", "j", None, None), ("b", "k", None, "6"), ("b", "k2", None, "6")]
    before = [("a", "f", "x", "9"), ("a", "g", "z", "2"), ("a", "h", None, "3"), ("c", "i", None, "5"), ("c", "j", None, None), ("c", "k", None, "6")]
    pairs = rules.net_pairs(spark.createDataFrame([("routine", *x) for x in after], r), spark.createDataFrame([("routine", *x) for x in before], r))
    assert rows(pairs.select("path", "longname", "old_path", "old_longname", "stage")) == sorted([
        ("a", "f", "a", "f", "same"), ("a", "g", "a", "g", "signature"), ("b", "h", "a", "h", "moved"), ("b", "i", None, None, "added"), ("b", "j", None, None, "added"), ("b", "k", None, None, "added"), ("b", "k2", None, None, "added"),
        (None, None, "c", "i", "removed"), (None, None, "c", "j", "removed"), (None, None, "c", "k", "removed"),
    ], key=repr)


def test_overlaid_limits_equal_limits_by_path(spark):
    scopes = [{"pattern": "gen/**", "rules": [{"scope": "routine", "metric": "A", "disabled": True}, {"scope": "routine", "metric": "B", "severity": "warning"}]}, {"pattern": "gen/x/**", "rules": [{"scope": "routine", "metric": "A", "most": 5.0}, {"scope": "routine", "metric": "C", "least": 2.0, "severity": "warning"}, {"scope": "routine", "metric": "D", "severity": "warning"}]}]
    th = spark.createDataFrame([("routine", "A", 3.0, None, "error", True), ("routine", "B", 9.0, None, "error", True)], "scope string, metric string, most double, least double, severity string, ratchet boolean")
    paths = ["a", "gen/a", "gen/x/a"]
    measures = spark.createDataFrame([("routine", p, "f", None, m, 1.0) for p in paths for m in "ABCD"], "scope string, path string, longname string, parameters string, metric string, value double")
    got = rules.overlaid(measures, th, scopes).select("path", "scope", "metric", "most", "least", "severity")
    assert rows(got) == rows(rules.overlay_scopes(measures.select("path"), th, scopes)) and got.count() == 6
    low = spark.createDataFrame([("routine", "p", n, None, m, v) for n, m, v in [("f", "L", 9.0), ("f", "S", 2.0), ("g", "L", 9.0), ("g", "S", 5.0), ("h", "L", 9.0)]], measures.schema)
    assert rows(rules.above_floor(low, {"L": ("S", 5)}).where("metric = 'L'").select("longname")) == [("g",), ("h",)]
