import numpy as np
import pytest

from tests.conftest import rows
from tests.test_catalogue import DATA, QUERIES, SQL, duck, plain  # noqa: F401
from tidewatch.operators import graph


@pytest.mark.parametrize(("seed", "n", "m"), [(0, 12, 14), (1, 14, 22), (2, 0, 0)])
def test_strong_components_equal_brute_force(spark, seed, n, m):
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))} if n else set()
    reach = {a: {a} for a in range(n)}
    for _ in range(n):
        for a, b in pairs:
            for x in reach.values():
                x |= {b} if a in x else set()
    same = {a: {b for b in reach[a] if a in reach[b]} for a in range(n)}
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src bigint, dst bigint, refs bigint")
    assert rows(graph.strong_components(df)) == sorted(((a, min(s)) for a, s in same.items() if len(s) > 1), key=repr)


@pytest.mark.parametrize("name", ["scc", "call_cycle", "closing_edges", "caller_callee_counts", "pass_through", "reach", "reachable_complexity", "impact"])
def test_whole_graph_equals_its_sql(spark, duck, name):  # noqa: F811
    df, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert sorted(df.columns) == sorted(want.columns) and got == plain(want.fetchall(), want.columns)
    parts, lines = duck.sql("SELECT count(DISTINCT l_partkey) FROM lineitem").fetchall()[0][0], len(got)
    assert name == "pass_through" or lines > (1 if name == "closing_edges" else 0)
    assert name != "caller_callee_counts" or lines == parts


def test_steps_by_lists_equal_steps_by_rows_and_the_last_is_not_stored(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (160, 2)) if a != b} | {(i, 0) for i in range(1, 40)})
    back = spark.createDataFrame(pairs, "to bigint, at bigint")
    front = spark.createDataFrame([(s, (s * 7) % 40) for s in range(12)], "start bigint, node bigint")
    known = front.union(spark.createDataFrame([(s, s) for s in range(40)], "start bigint, node bigint"))
    held = {tuple(r) for r in known.collect()}
    want = sorted({(r.start, a) for r in front.collect() for a, b in pairs if b == r.node} - held, key=repr)
    for listed in (0, 4, 10, 1 << 16):
        assert rows(graph._stepped(front, known, back, listed)) == want
    added = []
    monkeypatch.setattr(graph.Grown, "add", lambda self, df, to=graph.Grown.add: added.append(1) or to(self, df))
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    assert graph.impact(spark.createDataFrame([(0,)], "node bigint"), edges, 2).where("depth = 1").count() == 39 and len(added) == 2


@pytest.mark.parametrize("name", ["closing_edges", "reachable_complexity", "reach"])
def test_calls_are_read_once(spark, monkeypatch, name):
    read = []
    monkeypatch.setattr(graph, "stored", lambda df, what, to=graph.stored: read.append("lineitem" in df._jdf.queryExecution().optimizedPlan().toString() or "l_partkey" in df._jdf.queryExecution().optimizedPlan().toString()) or to(df, what))
    got = QUERIES[name](spark, DATA)
    assert sum(read) == 1 and "l_partkey" not in got._jdf.queryExecution().optimizedPlan().toString()
