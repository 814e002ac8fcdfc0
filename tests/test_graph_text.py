import random

from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.functions import scalars
from tidewatch.operators import dead, graph, structure, text
from tidewatch.sources import readers, sinks

E = "src string, dst string, refs bigint"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], E)


def test_cycles(spark):
    after = edges(spark, "ab", "bc", "ca", "cd", "dd", "ef", "fe")
    assert rows(graph.strong_components(after)) == [("a", "a"), ("b", "a"), ("c", "a"), ("e", "e"), ("f", "e")]
    assert rows(graph.new_cycles(after, edges(spark, "ab", "ba", "ef", "fe"))) == [("a", 3)]
    assert rows(graph.new_cycles(edges(spark, "ab", "ba"), after)) == []
    assert rows(graph.strong_components(edges(spark))) == []


def test_reach_and_impact(spark):
    e = edges(spark, "ab", "bc", "cb", "xa")
    seeds = spark.createDataFrame([("a",), ("z",)], "node string")
    assert rows(graph.reach(seeds, e)) == [("a", "a"), ("a", "b"), ("a", "c"), ("z", "z")]
    nodes = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 4.0)], "node string, complexity double")
    assert rows(graph.reachable_complexity(seeds, e, nodes)) == [("a", 3, 5.0, 1)]
    chain = edges(spark, "ba", "cb", "dc", "ed", "fe")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.impact(start, chain, 2)) == [("a", "b", 1), ("a", "c", 2)]
    hidden = spark.createDataFrame([("b",), ("c",)], "node string")
    assert rows(graph.impact(start, chain, 2, hidden)) == [("a", "d", 1), ("a", "e", 2)]


def test_structure_rules(spark):
    a, b = edges(spark, "ab", "ac", "aa", "ba"), edges(spark, "ab")
    assert rows(structure.fan(a)) == [("a", 1, 2), ("b", 1, 1), ("c", 1, 0)]
    assert rows(structure.new_edges(a, b)) == [("a", "a"), ("a", "c"), ("b", "a")]
    changes = spark.createDataFrame([("D", "c", None), ("M", "q", None)], "status string, path string, old_path string")
    assert rows(structure.affected(changes, a, b)) == [("a",), ("b",), ("q",)]
    d = spark.createDataFrame([("N", "1", "x"), ("N", "1", "y"), ("N", None, "z"), ("M", "1", "x"), ("M", "1", "x")], "name string, value string, path string")
    assert rows(structure.duplicate_definitions(d)) == [("N", "1", 2)]


def test_chains_of_any_length_cost_a_logarithm_of_steps(spark, monkeypatch):
    """A path of 10,000 nodes with a circle at its end, a circle of links alone, and a node on two circles."""
    n, written = 10_000, []
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("bigint").alias("refs"))
    more = [(n, n + 1, 1), (n + 1, n + 2, 1), (n + 2, n, 1), (20_000, 20_001, 1), (20_001, 20_002, 1), (20_002, 20_000, 1), (30_000, 30_001, 1), (30_001, 30_000, 1), (30_001, 30_002, 1), (30_002, 30_001, 1), (n + 2, 40_000, 1), (50, 50, 1)]
    e = e.union(spark.createDataFrame(more, "src bigint, dst bigint, refs bigint"))
    kept, add = graph.stored, graph.Grown.add
    monkeypatch.setattr(graph, "stored", lambda df, what: written.append(what) or kept(df, what))
    monkeypatch.setattr(graph.Grown, "add", lambda self, df: written.append("grown") or add(self, df))
    cycles = [(x, 20_000) for x in range(20_000, 20_003)] + [(x, 30_000) for x in range(30_000, 30_003)] + [(x, n) for x in range(n, n + 3)]
    assert rows(graph.strong_components(e)) == sorted(cycles, key=repr) and len(written) < 80
    written.clear()
    got = graph.reach(spark.createDataFrame([(5,), (9_999,), (77_777,)], "node bigint"), e)
    assert got.where("seed = 5").count() == n - 5 + 4 and got.where("seed = 9999").count() == 5 and got.where("seed = 77777").count() == 1 and len(written) < 80
    written.clear()
    inside = graph.bounded(e, spark.createDataFrame([(9_990,), (50,), (77_777,)], "node bigint"))
    assert inside.count() == n - 50 + 4 + 1 and len(written) < 80


def test_strong_components_equal_closures(spark):
    rng = random.Random(6)
    pairs = [(100 * g + rng.randrange(12), 100 * g + rng.randrange(12)) for g in range(40) for _ in range(rng.randint(3, 22))]
    step = {}
    for a, b in pairs:
        step.setdefault(a, set()).add(b)

    def closure(x):
        found, todo = set(), [x]
        while todo:
            for y in step.get(todo.pop(), ()):
                if y not in found:
                    found.add(y)
                    todo.append(y)
        return found

    nodes = {x for p in pairs for x in p}
    all_ = {x: closure(x) for x in nodes}
    both = {x: {y for y in all_[x] if x in all_[y]} | {x} for x in nodes}
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src bigint, dst bigint, refs bigint")
    assert rows(graph.strong_components(e)) == sorted(((x, min(c)) for x, c in both.items() if len(c) > 1), key=repr)
    weights = spark.createDataFrame([(x, float(x % 7) if x % 5 else None) for x in nodes], "node bigint, complexity double")
    want = sorted(((x, len(all_[x] | {x}), float(sum(y % 7 for y in all_[x] | {x} if y % 5)), sum(1 for y in all_[x] | {x} if y % 5 == 0)) for x in nodes), key=repr)
    assert rows(graph.whole_reachable_complexity(weights, e)) == want
    assert rows(graph.reachable_complexity(weights.select("node"), e, weights)) == want


def test_duplicate_blocks_leave_out_their_own_range(spark):
    files = spark.createDataFrame([("a", "x\n\ny\nz\nq"), ("b", "p\n x\ny \nz"), ("c", "k\nk\nk\nk"), ("d", None)], "path string, text string")
    got = text.duplicate_blocks(text.code_lines(files), 3)
    assert rows(got.select("path", "start", "stop", "code_lines", "elsewhere")) == [("a", 1, 4, 3, 1), ("b", 2, 4, 3, 1)]


def test_trust_and_dead_code(spark):
    res = spark.createDataFrame([("py", 3, 0, 1), ("c", 1, 5, 9), ("x", 0, 2, 0)], "language string, resolved bigint, external bigint, unresolved bigint")
    assert rows(dead.trust(res, 0.75).select("language", "trusted")) == [("c", False), ("py", True), ("x", False)]
    assert dead.trust(res, None).where("trusted").isEmpty()
    facts = spark.createDataFrame([("a", "py", False), ("b", "py", None), ("c", "c", False), ("skip_d", "py", False)], "longname string, language string, referenced boolean")
    assert rows(dead.unreferenced(facts, ["^skip"], dead.trust(res, 0.9)).select("longname")) == [("a",)]
    assert dead.unavailable(facts, "referenced").count() == 1 and dead.unavailable(facts, "referenced", any_missing=False).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("src/gen/a.py",), ("a.py",)], "path string")
    assert rows(df.select("path", scalars.first_glob(F.col("path"), ["", "gen", "/a.py"]).alias("g"))) == [("a.py", "/a.py"), ("src/gen/a.py", "gen")]
    assert rows(spark.range(1).select(scalars.ladder_at_least(F.lit(7.0)), scalars.ladder_at_least(F.lit(101.0)), scalars.ladder_at_least(F.lit(1e13)), scalars.loose_number(F.lit("1,234.5")), scalars.loose_number(F.lit("1,5")))) == [(8.0, 120.0, None, 1234.5, 1.5)]
    assert rows(spark.range(1).select(scalars.key_token(F.lit("routine"), F.lit("p"), F.lit("n"), F.lit(None).cast("string"), F.lit(2)))) == [('["routine","p","n",null,2]',)]


def test_sources_and_sinks(spark, tmp_path):
    assert readers.name_status("M\0a\0R100\0b\0c\0C75\0d\0e\0D\0f\0") == [("M", "a", None), ("R", "c", "b"), ("A", "e", None), ("D", "f", None)]
    csv = tmp_path / "v.csv"
    csv.write_text("Check ID,Check Name,Directory,File,Line,Column,Violation\nAll,,,,,,\nC1,Naming,src,a.py,3,,bad name\nC2,Size,src,b.py,,4,too long\n")
    assert rows(readers.violations_csv(spark, str(csv)).select("check_id", "path", "line", "column")) == [("C1", "src/a.py", 3, None), ("C2", "src/b.py", 0, 4)]
    log = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Error: old", "Error: broken", "File: a.py Line: 7", "Error: gone", "Warning: w", "File: b.py Line: 9", "clean 9 of 12 files"])], "run int, n int, text string")
    assert rows(readers.analysis_log(log)) == [("a.py", 7, "broken")] and rows(readers.accuracy(log)) == [(1, 0.75)]
    assert sinks.between_markers(sinks.between_markers("x", "one"), "two").count("tidewatch:begin") == 1
