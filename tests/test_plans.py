import pytest

from tests.conftest import rows
from tidewatch.plans import check, settings
from tidewatch.sources import wire
from tidewatch.streaming import state

M = "scope string, path string, longname string, parameters string, metric string, value double"


def test_layers_merge_field_by_field(spark):
    merged, origin = settings.load(("user", "[thresholds.routine]\nMaxNesting = {max = 4, severity = 'warning'}\n"), ("repo", "[thresholds.routine]\nMaxNesting = 5\n[ratchet]\nstrict = true\n"))
    assert merged["thresholds"]["routine"]["MaxNesting"] == {"max": 5, "severity": "warning"} and merged["ratchet"]["strict"] is True
    assert origin["thresholds.routine.MaxNesting.max"] == "repo" and origin["ratchet.strict"] == "repo" and origin["output.top"] == "default"
    table = settings.thresholds(spark, merged)
    assert rows(table.where("metric = 'RatioCommentToCode'").select("most", "least")) == [(None, 0.1)]
    assert not table.where("scope = 'file' AND metric = 'CountDeclClass'").first().ratchet
    elements, populations = settings.population_limits(table)
    assert populations.count() == 4 and elements.where("prefix IS NOT NULL").isEmpty()
    assert settings.usable(table, spark.createDataFrame([("py", "file", "CountLineCode")], "language string, scope string, metric string")).count() == 1


def test_check_and_explain(spark):
    def side(values, edges):
        return check.Side(spark.createDataFrame([("routine", p, n, None, "CountStmt", v) for p, n, v in values], M), spark.createDataFrame(edges, "src string, dst string, refs bigint"), spark.createDataFrame([], "path string, line int, message string"))

    after = side([("a", "f", 50.0), ("a", "g", 41.0), ("b", "h", 90.0)], [("a", "b", 1)])
    before = side([("a", "f", 45.0), ("a", "g", 41.0), ("b", "h", 10.0)], [("a", "b", 1)])
    limits = spark.createDataFrame([("routine", "CountStmt", 40.0, None, "error", True)], "scope string, metric string, most double, least double, severity string, ratchet boolean")
    changes = spark.createDataFrame([("M", "a", None)], "status string, path string, old_path string")
    got = check.check(after, before, changes, check.Limits(limits))
    assert rows(got.select("kind", "longname", "blocking")) == [("ratchet", "f", True), ("threshold", "f", True), ("threshold", "g", False)]
    assert check.exit_code(got) == check.VIOLATIONS and check.exit_code(got.where("false")) == check.OK
    frames = check.explain(after, before)
    assert frames["net"].first()["net_CountStmt"] == 85.0 and frames["dependencies"].isEmpty()
    pop = spark.createDataFrame([("routine", "CountStmt", "AVG", 30.0, None)], "scope string, metric string, prefix string, most double, least double")
    assert check.populations(after.measures, pop).first()["value"] == pytest.approx(181 / 3)


def test_a_run_of_every_family(spark):
    """Two files are touched; what lies elsewhere is no finding, and each family gives the one that is planted for it."""
    t = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    m = lambda *xs: t([("routine", p, n, None, k, v) for p, n, k, v in xs], M)
    after_m = m(("a", "f", "CyclomaticStrict", 9.0), ("a", "g", "CyclomaticStrict", 2.0), ("z", "far", "CyclomaticStrict", 99.0), ("a", "f", "Lines", 50.0), ("a", "f", "CountStmt", 1.0), ("a", "g", "Lines", 60.0), ("a", "g", "CountStmt", 30.0))
    before_m = m(("a", "f", "CyclomaticStrict", 3.0), ("a", "g", "CyclomaticStrict", 2.0))
    e = "src string, dst string, refs bigint, import_time bigint"
    after_e, before_e = t([("a", "b", 1, 1), ("b", "a", 1, 1), ("a", "c", 1, 1), ("a", "z", 3, 0), ("z", "a", 1, 0)], e), t([("a", "b", 1, 1), ("z", "a", 1, 0)], e)
    bad = lambda *ps: t([(p, 4, f"{p} broke") for p in ps], "path string, line int, message string")
    members = t([("core", "a", 0), ("core", "b", 1), ("edge", "c", 2), ("edge", "z", 3)], "node string, path string, ordinal int")
    facts = t([("k1", "a", "f", "py", "routine", False, None, None, None, None, None), ("k2", "a", "g", "py", "routine", True, 1, 1, "far", False, 1), ("k3", "z", "far", "py", "routine", False, None, None, None, None, None), ("k4", "a", "h", "c", "routine", False, None, None, None, None, None)], "key string, path string, longname string, language string, scope string, referenced boolean, callers int, callees int, forwards_to string, overrides boolean, statements int")
    files = t([("a", "x=1\ny=2\nz=3"), ("z", "x=1\ny=2\nz=3")], "path string, text string")
    shape = [f"t{i}" for i in range(12)]
    routines = t([("a:f", "a", 1, 3, shape), ("z:far", "z", 1, 3, shape), ("b:q", "b", 1, 2, ["q"] * 9)], "token string, path string, start int, stop int, shape array<string>")
    after = check.Side(after_m, after_e, bad("a", "z", "b"), members, t([("f", "far", 1)], "src string, dst string, refs bigint"), facts, t([("N", "1", "a"), ("N", "1", "z"), ("O", "2", "z"), ("O", "2", "q")], "name string, value string, path string"), files, routines, 0.5)
    before = check.Side(before_m, before_e, bad(), members)
    th = "scope string, metric string, most double, least double, severity string, ratchet boolean"
    limits = check.Limits(
        t([("routine", "CyclomaticStrict", 20.0, None, "error", True), ("routine", "Lines", 40.0, None, "error", False)], th), floors={"Lines": ("CountStmt", 5)}, baseline=t([("routine.CyclomaticStrict", 8.0)], "rule string, value double"),
        populations=t([("routine", "CyclomaticStrict", "MODE", 1.0, None, "warning")], "scope string, metric string, prefix string, most double, least double, severity string"), acknowledged=["b"], fan_in=1, new_dependencies=1, cycles=True,
        layers=t([("L", "core", ["core"])], "layer string, node string, may array<string>"), couplings=t([("core", "edge", 3)], "src string, dst string, most bigint"), reachable_complexity=100.0, definition_files=1, net_growth=("CountStmt", 10), accuracy=0.9,
        trust=t([("py", True), ("c", False)], "language string, trusted boolean"), unused=["routine"], pass_through=2, duplicate_block=3, similarity=0.9,
    )
    changes = t([("M", "a", None), ("M", "b", None)], "status string, path string, old_path string")
    got = check.check(after, before, changes, limits, t([("C1", "a", 7, "bad"), ("C2", "q", 1, "no")], "check_id string, path string, line int, message string"))
    found = {(r.rule, r.path, r.longname): (r.value, r.blocking) for r in got.collect()}
    assert found.pop(("routine.CyclomaticStrict", "a", "f")) == (9.0, True) and found.pop(("routine.Lines", "a", "g")) == (60.0, True)  # f is below the floor of Lines
    assert {k[0]: v for k, v in found.items() if k[0] not in ("structure.layer.L", "analysis.parse_error")} == {
        "structure.fan_in": (2, True), "structure.new_dependencies": (2, True), "structure.file_cycle": (2, True), "structure.arch_cycle": (2, True), "structure.coupling": (4, True), "structure.reachable_complexity": (108.0, True), "structure.duplicate_definition": (2, False),
        "structure.unused_routine": (None, False), "structure.pass_through": (1, False), "structure.duplicate_block": (3, False), "structure.similar_routine": (2, False), "analysis.accuracy": (0.5, False), "codecheck.C1": (7, True),
        "routine.MODECyclomaticStrict": (2.0, False), "structure.net_growth": (31.0, False),
    }
    assert found[("analysis.parse_error", "a", "a")] == (1, True) and found[("analysis.parse_error", "b", "b")] == (1, False) and ("analysis.parse_error", "z", "z") not in found
    assert found[("structure.layer.L", "a", "a")] == (None, True) and ("structure.unused_routine", "a", "h") not in found and check.exit_code(got) == check.VIOLATIONS


def test_wire_issues(spark):
    ref = '{"key":{"scope":"routine","path":"p","longname":"f"},"line":%s}'
    good = '{"entities":[{"ref":%s,"metrics":{"A":1,"B":2.5}}],"file_edges":[{"src":"a","dst":"b","refs":2,"import_time":null}]}' % (ref % 3)
    docs = [("good", good), ("none", None), ("cut", '{"entities":['), ("again", '{"entities":[],"entities":[]}'), ("kinds", '{"entities":{},"file_edges":[{"src":1,"refs":"2"}],"method_declarations":{"m":1.5}}')]
    docs.append(("extra", '{"entities":[{"ref":%s,"metrics":{"A":"1"},"more":{"deep":1}},{"ref":%s}],"other":null}' % (ref % 1, ref % '"1"')))
    got = wire.issues(spark.createDataFrame(docs, "doc string, text string"))
    assert rows(got.select("doc", "at", "issue")) == sorted([
        ("none", "$", "malformed"), ("cut", "$", "malformed"), ("again", "$", "malformed"),
        ("kinds", "$.entities", "wrong type"), ("kinds", "$.file_edges[0].src", "wrong type"), ("kinds", "$.file_edges[0].refs", "wrong type"), ("kinds", "$.method_declarations.m", "wrong type"),
        ("extra", "$.entities[0].metrics.A", "wrong type"), ("extra", "$.entities[0].more", "unknown field"), ("extra", "$.entities[1].ref.line", "wrong type"), ("extra", "$.other", "unknown field"), ("extra", "$.entities[0].ref.key", "duplicate key"),
    ], key=repr)
    assert wire.issues(spark.createDataFrame([], "doc string, text string")).count() == 0


def test_commits_as_a_stream_equal_the_batch(spark, tmp_path):
    schema = "path string, commit bigint, digest string, errors bigint, value double"
    commits = [("a", 1, "x", 0, 1.0), ("a", 2, "x", 1, None), ("a", 3, "y", 1, 2.0), ("a", 5, None, None, None), ("a", 6, "y", 0, 3.0), ("b", 2, None, None, None), ("b", 4, "q", None, 0.5), ("c", 6, "z", 2, 1.0)]
    every = spark.createDataFrame(commits, schema)
    for turn in ((1, 2), (3, 4), (5, 6), (5, 6)):  # the last turn hands the same commits over once more
        every.where(f"commit BETWEEN {turn[0]} AND {turn[1]}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run = state.commit_deltas(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        run.awaitTermination()
    got = rows(spark.read.schema(state.DELTA).parquet(f"{tmp_path}/out"))
    assert got == rows(state.commit_deltas_of(every)) and ("a", 3, "modified", 1, 1, None, 2.0) in got and len(got) == 6


def test_streaming_state(spark, tmp_path):
    spark.createDataFrame([("a", 5.0), ("a", 3.0), ("b", 9.0)], "rule string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("rule string, value double").parquet(f"{tmp_path}/in")
    q = state.tightened(stream).writeStream.outputMode("complete").format("memory").queryName("tight").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    spark.createDataFrame([("a", 4.0), ("b", 1.0)], "rule string, value double").write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("SELECT * FROM tight")) == [("a", 3.0), ("b", 1.0)]
    e = "path string, message string"
    held, new = spark.createDataFrame([("a", "old"), ("b", "old")], e), spark.createDataFrame([("a", "new")], e)
    assert rows(state.remember_errors(new, spark.createDataFrame([("a",)], "path string"), held)) == [("a", "new"), ("b", "old")]


def test_strict_reading_stores_each_level_once_without_plain_values(spark, monkeypatch):
    from tidewatch.sources import wire

    kept = []
    monkeypatch.setattr(wire, "stored", lambda df, what, to=wire.stored: kept.append(to(df, what)) or kept[-1])
    docs = spark.createDataFrame([("d", '{"entities":[{"ref":{"key":{"path":"k"},"line":7}},{"ref":{"key":{"path":"k"},"line":"7"},"note":1}]}')], "doc string, text string")
    got = wire.issues(docs)
    assert sorted((r.at, r.issue) for r in got.collect()) == [("$.entities[0].ref.key", "duplicate key"), ("$.entities[1].note", "unknown field"), ("$.entities[1].ref.line", "wrong type")]
    assert len(kept) == 7  # the documents, and six levels
    assert not [r for k in kept[1:] for r in k.where("pattern LIKE '%.line' AND v IS NOT NULL").collect()]


def test_commit_deltas_takes_few_turns_and_equals_the_table(spark, monkeypatch):
    from tests.test_catalogue import DATA
    from tidewatch.plans import catalogue_check as cc

    turns = []
    monkeypatch.setattr(state, "commit_deltas", lambda df, to=state.commit_deltas: turns.append(1) or to(df))
    got = cc.commit_deltas(spark, DATA)
    assert rows(got) == rows(state.commit_deltas_of(cc._commits(spark, DATA))) and len(turns) == 2
