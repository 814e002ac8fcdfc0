import ast

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.functions import scalars, source
from tidewatch.operators import arch, dead, facts, graph, modules, structure, summary, text
from tidewatch.plans import settings
from tidewatch.sources import readers


def test_class_facts_leave_out_a_class_s_own_use(spark):
    keys = spark.createDataFrame([("A",), ("B",), ("C",)], "key string")
    refs = spark.createDataFrame([("A", "A.m"), ("A", "B.x"), ("A", "file"), ("A", "file"), ("B", "A"), ("A", "A")], "target string, referrer string")
    members = spark.createDataFrame([("A", "A.m"), ("B", "B.x")], "owner string, member string")
    inherits = spark.createDataFrame([("A", "B"), ("A", "B")], "base string, derived string")
    got = facts.class_facts(keys, refs, members, inherits)
    assert rows(got) == [("A", True, ["B"], 1), ("B", True, [], 1), ("C", False, [], 0)]
    assert facts.class_facts(keys.limit(0), refs, members, inherits).count() == 0


def test_parameters_bindings_and_constructors(spark):
    p = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("f", 3, "c"), ("g", 1, "a")], "key string, position int, name string")
    assert rows(facts.unused_parameter_lists(p, spark.createDataFrame([("f", "b"), ("g", "a")], "key string, name string"))) == [("f", ["a", "c"])]
    b = facts.read_bindings(spark.createDataFrame([("x",), ("y",), ("z",)], "key string"), spark.createDataFrame([("x", "read"), ("y", "write"), ("x", "write")], "key string, kind string"))
    assert rows(b) == [("x", True), ("y", False), ("z", False)]
    calls = spark.createDataFrame([("a", "K", 2), ("a", "K.new", 1), ("a", "f", 1)], "src string, dst string, refs bigint")
    assert rows(facts.to_constructors(calls, spark.createDataFrame([("K", "K.new")], "class string, routine string"))) == [("a", "K.new", 3), ("a", "f", 1)]


@pytest.mark.parametrize("bucket", [1, 7, 256])
def test_spans_equal_brute_force(spark, bucket):
    spans = [("p", f"k{i}", (i * 37) % 50, (i * 37) % 50 + (i * 11) % 23 - 2) for i in range(25)] + [("q", "z", 1, 300), ("q", "y", 1, 300)]
    lines = [("p", n) for n in range(0, 70, 3)] + [("q", 300), ("r", 1)]
    s, ln = spark.createDataFrame(spans, "path string, key string, start int, stop int"), spark.createDataFrame(lines, "path string, line int")
    assert rows(facts.lines_in_spans(ln, s, bucket).select("path", "line", "key")) == sorted(((p, n, k) for p, n in lines for q, k, a, b in spans if p == q and a <= n <= b), key=repr)
    good = [x for x in spans if x[2] <= x[3]]
    want = {(i[1], o[1]) for i in good for o in good if i[0] == o[0] and o[2] <= i[2] and i[3] <= o[3] and ((o[2], o[3]) != (i[2], i[3]) or o[1] < i[1])}
    assert {tuple(r) for r in facts.nested_spans(s, bucket).collect()} == want and ("z", "y") in want
    assert {r.key for r in facts.outermost(s).collect()} == {x[1] for x in spans} - {i for i, _ in want}


def test_vocabulary_is_dense_and_in_first_order(spark):
    data = [(w, i) for i, w in enumerate("b a c a b d e b f g".split())]
    assert rows(facts.vocabulary(spark.createDataFrame(data, "text string, place bigint"))) == sorted(zip("bacdefg", range(7)), key=repr)
    assert facts.vocabulary(spark.createDataFrame([], "text string, place bigint")).count() == 0


def test_summaries(spark):
    e = spark.createDataFrame([("routine", "gen/a.py", "f", None), ("routine", "gen/a.py", "f", None), ("routine", "b.py", "g", "x"), ("file", "gen/a.py", "gen/a.py", None)], "scope string, path string, longname string, parameters string")
    assert rows(summary.entity_counts(e)) == [("file", 1), ("routine", 2)]
    assert summary.counts_line(summary.entity_counts(e)).first().line == "2 routines, 1 files" and summary.counts_line(summary.entity_counts(e.limit(0))).first().line == ""
    assert rows(summary.ignored_counts(e, ["gen", ""])) == [("file", 1), ("routine", 1)]
    long = spark.createDataFrame([("routine", "p", f"f{i}", None, "X", float(i % 5)) for i in range(20)] + [("routine", "p", "n", None, "X", None)], "scope string, path string, longname string, parameters string, metric string, value double")
    assert [(r.longname, r.value) for r in summary.worst(long).orderBy("rank").collect()] == [("f14", 4.0), ("f19", 4.0), ("f4", 4.0)]
    assert [r.longname for r in summary.top_values(long, 2).collect()] == ["f14", "f19"]
    assert rows(summary.population_vectors(long).select("value", "n")) == [(float(v), 4) for v in range(5)] and rows(summary.project_values(summary.population_vectors(long))) == [("X", 4.0)]
    reached = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("a", "d")], "seed string, node string")
    nodes = spark.createDataFrame([("a", 99.0), ("b", 1.0), ("c", None), ("d", 5.0)], "node string, complexity double")
    assert rows(summary.heaviest(reached, nodes, 1)) == [("a", 1, "d", 5.0)]
    stamps = spark.createDataFrame([("k", 1, 5), ("k", 2, 5), ("k", 3, 4)], "k string, id int, t int")
    assert rows(summary.latest(stamps, ["k"], "t", 1).select("id")) == [(2,)]


def test_findings_without_a_limit_table(spark):
    figures = spark.createDataFrame([("after", 0.5), ("before", 0.75), ("x", None)], "side string, accuracy double")
    assert rows(summary.accuracy_findings(figures, 0.75).select("side", "blocking")) == [("after", False)] and summary.accuracy_findings(figures, None).count() == 0
    v = spark.createDataFrame([("C1", "/r/src\\a.py", 3, "m"), ("C2", "/other/b.py", 0, "n")], "check_id string, path string, line int, message string")
    assert rows(summary.checker_findings(v, "warning", "/r/").select("rule", "path", "line", "blocking")) == [("codecheck.C1", "src/a.py", 3, False), ("codecheck.C2", "/other/b.py", None, False)]
    net = spark.createDataFrame([(10.0, 3)], "net_CountStmt double, entities bigint")
    assert [summary.net_growth(net, m, "error").count() for m in (9, 10, None)] == [1, 0, 0] and summary.net_growth(net, 0, "error").first().blocking
    ch = spark.createDataFrame([("R", "n", "o"), ("M", "n", None)], "status string, path string, old_path string")
    assert rows(summary.touched(ch)) == [("n",), ("o",)]
    wide = spark.createDataFrame([("a",), ("b",)], "key string")
    extra = spark.createDataFrame([("a", "P", 1.0), ("z", "Q", 2.0)], "key string, metric string, value double")
    got, missing = summary.with_extra_metrics(wide, extra, ["P", "Q"])
    assert rows(got) == [("a", {"P": 1.0}), ("b", None)] and rows(missing) == [("Q",)]
    assert {r.metric for r in settings.thresholds(spark, settings.load()[0]).where("severity = 'warning'").collect()} == {"RatioCommentToCode", "PercentLackOfCohesion", "Essential", "MaxInheritanceTree", "CountLineComment", "LinesPerStatement"}


def test_source_text(spark):
    code = "import a\nfrom typing import TYPE_CHECKING\n\ndef f(x):\n    import b\n    return b\n\nif TYPE_CHECKING:\n    import c\n\nx = [  # open\n    1,\n    'a b',\n]\ny: int = 2\nz == 3\n"
    ast.parse(code)
    df = spark.createDataFrame([(1, code, 11), (2, code, 15), (3, code, 16), (4, "def (", 1), (5, None, None), (6, "q = (\n" + "1,\n" * 20 + ")", 1)], "id int, text string, line int")
    got = {r.id: r.i for r in df.select("id", source.initialiser_text(F.col("text"), F.col("line")).alias("i")).collect()}
    assert got == {1: "[ 1 , 'a b' , ]", 2: "2", 3: "= 3", 4: None, 5: None, 6: None}
    out = modules.outlines(df.select(F.col("id").cast("string").alias("path"), "text"))
    assert [r.path for r in out.where("NOT parsed").collect()] == ["4"]
    assert rows(modules.deferred_lines(out)) == [(p, n) for p in "123" for n in (5, 6, 9)]
    assert rows(modules.definitions(out).where("path = '1'")) == [("x", "1", 11, "[ 1 , 'a b' , ]"), ("y", "1", 15, "2")]


def test_deferred_imports_close_no_cycle(spark):
    """a and b import each other, but b only inside a function; c and d do so at once; e's is for the type checker."""
    texts = {"a": "import b\n", "b": "@wrap\ndef f():\n    def g():\n        import a\n    return g\n", "c": "from d import x\nclass K:\n    import a\n", "d": "if True:\n    import c, a\nelse:\n    import b\n", "e": "import typing, c\nif typing.TYPE_CHECKING:\n    from e import y\n    import d\nif not typing.TYPE_CHECKING:\n    import b\n", "f": "import ("}
    out = modules.outlines(spark.createDataFrame(list(texts.items()), "path string, text string"))
    edges = modules.import_edges(out, spark.createDataFrame([(m, m) for m in texts], "target string, path string"))
    assert rows(edges) == [("a", "b", 1, 1), ("b", "a", 1, 0), ("c", "a", 1, 1), ("c", "d", 1, 1), ("d", "a", 1, 1), ("d", "b", 1, 1), ("d", "c", 1, 1), ("e", "b", 1, 1), ("e", "c", 1, 1), ("e", "d", 1, 0), ("e", "e", 1, 0)]
    none = edges.limit(0)
    assert rows(graph.new_cycles(structure.import_time_only(edges), none)) == [("c", 2)]
    assert rows(graph.new_cycles(edges, none)) == [("a", 2), ("c", 2)]


def test_architecture_cut_keeps_shallow_leaves(spark):
    members = spark.createDataFrame([("a/b/c", "f1"), ("a/b", "f2"), ("a", "f3"), ("d", "f4"), ("a/e", "f5"), ("d", "f3"), ("a/b/c", "f5"), ("", "f6")], "node string, path string")
    assert rows(arch.cut_members(members, 2)) == [("f1", "a/b"), ("f2", "a/b"), ("f3", "d"), ("f4", "d"), ("f5", "a/b"), ("f5", "a/e"), ("f6", "")]
    assert rows(arch.cut_members(members, 3, "top").where("path IN ('f2', 'f3', 'f5', 'f6')")) == [("f2", "top"), ("f3", "d"), ("f5", "a/b/c"), ("f5", "a/e"), ("f6", "top")]
    assert rows(arch.cut_members(members, 0)) == [(f"f{i}", "") for i in range(1, 7)]
    empty_child = spark.createDataFrame([("d/x",)], "node string")
    assert rows(arch.cut_members(members, 2, "top", empty_child).where("path = 'f4'")) == [("f4", "top")]
    assert rows(arch.nodes_of(arch.cut_members(members, 2)).where("path = 'f5'")) == [("f5", ["a/b", "a/e"])]
    files = spark.createDataFrame([("a/b/x.py",), ("a/q.py",), ("z.py",)], "path string")
    assert rows(arch.deepest_cover(files, members, "top")) == [("a/b/x.py", "a/b"), ("a/q.py", "a"), ("z.py", "top")]


def test_regions_and_their_proposal(spark):
    texts = [("gen/a.py", "# @generated by x"), ("gen/b/c.py", "# DO NOT EDIT"), ("src/a.py", "x = 1"), ("src/tests/t.py", "y"), ("src/tests/u/v.py", ""), ("src/made.py", "# automatically generated"), ("lib/x.js", None)]
    files = spark.createDataFrame(texts, "path string, text string")
    found = arch.uniform_regions(arch.marked_files(files, ["tests"]))
    assert rows(found.select("dir", "role", "files", "pattern")) == [("gen", "generated", 2, "gen/**"), ("src/made.py", "generated", 1, "src/made.py"), ("src/tests", "tests", 2, "src/tests/**")]
    attrs = spark.createDataFrame([("src/.gitattributes", "# c\n[attr]m linguist-vendored\n/tests/** linguist-vendored\n*.js linguist-generated=false\n\"a b.py\" linguist-generated\nmade.py -linguist-vendored linguist-generated=true\n"), (".gitattributes", "lib/ linguist-vendored")], "path string, text string")
    told = arch.declared_regions(attrs)
    assert rows(told.select("role", "pattern")) == [("generated", "src/**/a b.py"), ("generated", "src/**/made.py"), ("vendored", "**/lib"), ("vendored", "src/tests/**")]
    counted = arch.covered(told.withColumn("evidence", F.concat_ws(": ", "source", "detail")), files)
    assert rows(counted.select("pattern", "covered")) == [("**/lib", 1), ("src/**/a b.py", 0), ("src/**/made.py", 1), ("src/tests/**", 2)]
    assert rows(arch.proposal(counted).select("line", "pattern", "evidence")) == [("exclude", "**/lib", ".gitattributes: lib/ linguist-vendored (1 files)"), ("exclude", "src/**/made.py", "src/.gitattributes: made.py linguist-generated=true (1 files)"), ("exclude", "src/tests/**", "src/.gitattributes: /tests/** linguist-vendored (2 files)")]
    assert rows(arch.proposal(found.withColumn("covered", F.col("files"))).select("line", "pattern")) == [("exclude", "gen/**"), ("exclude", "src/made.py"), ("scope", "src/tests/**")]
    line = spark.createDataFrame([("if x1 >= 'a # b': return 3.5  # why",), ("",), (None,)], "t string")
    assert [r.c for r in line.select(source.token_classes(F.col("t"), ["if", "return"]).alias("c")).collect()] == [["if", "ID", ">", "=", "LIT", ":", "return", "LIT"], [], None]


def test_small_columns(spark):
    one = spark.range(1)
    got = one.select(scalars.count_params(F.array(F.lit("a"), F.lit("b"))), scalars.count_params(F.lit(None).cast("array<string>")), scalars.long_name(F.lit("file"), F.lit("p"), F.lit("n")), scalars.long_name(F.lit("class"), F.lit("p"), F.lit("n")))
    assert tuple(got.first()) == (2, 0, "p", "n")
    files = spark.createDataFrame([("/r/a",)], "path string")
    assert scalars.root_checked(files, "/r").first().held and scalars.root_checked(files.limit(0), "/x").count() == 0
    with pytest.raises(Exception, match="no file below"):
        scalars.root_checked(files, "/x").collect()


def test_graph_of_components(spark):
    e = spark.createDataFrame([(a, b, 1) for a, b in ("ab", "ba", "bc", "cd", "dc", "de", "xe", "ee")], "src string, dst string, refs bigint")
    nodes = spark.createDataFrame([(n, float(i)) for i, n in enumerate("abcdex")] + [("lone", None)], "node string, complexity double")
    assert rows(graph.reach_components(nodes, e)) == sorted([("a", "a"), ("a", "c"), ("a", "e"), ("c", "c"), ("c", "e"), ("e", "e"), ("x", "x"), ("x", "e"), ("lone", "lone")], key=repr)
    assert rows(graph.whole_reachable_complexity(nodes, e)) == rows(graph.reachable_complexity(nodes, e, nodes))
    assert rows(graph.bounded(e, spark.createDataFrame([("c",), ("none",)], "node string")).select("src", "dst")) == [("c", "d"), ("d", "c"), ("d", "e"), ("e", "e")]


def test_blocks_equal_a_listing_of_places(spark):
    files = {f"f{i}": [("abcd" * 3)[(i * j) % 7 % 12] if (i + j) % 5 else f"u{i}_{j}" for j in range(24)] for i in range(6)} | {"r": ["z"] * 9}
    df = spark.createDataFrame([(p, "\n".join(x)) for p, x in files.items()], "path string, text string")
    for k in (1, 2, 3):
        places = {}
        for p, x in files.items():
            for i in range(len(x) - k + 1):
                places.setdefault(tuple(x[i : i + k]), []).append((p, i))
        want = []
        for p, x in files.items():
            hit = [i for i in range(len(x) - k + 1) if len(places[tuple(x[i : i + k])]) > 1]
            while hit:
                n = next((j for j in range(1, len(hit)) if hit[j] != hit[0] + j), len(hit))
                run, hit = hit[:n], hit[n:]
                out = {q for i in run for q in places[tuple(x[i : i + k])] if q[0] != p or not run[0] <= q[1] <= run[-1] + k - 1}
                if out:
                    want.append((p, run[0] + 1, run[-1] + k, len(run) + k - 1, len(out)))
        assert rows(text.duplicate_blocks(text.code_lines(df), k)) == sorted(want, key=repr)


def test_rules_of_dead_code_behind_the_gate(spark):
    facts_ = spark.createDataFrame([("k1", "p", "C.run", False, ["a"]), ("k2", "p", "C.go", True, ["b"]), ("k3", "p", "skip", False, ["c"]), ("k4", "p", "D.shared", False, ["d"])], "key string, path string, longname string, overrides boolean, unused_parameters array<string>")
    declared = dead.method_declarations(spark.createDataFrame([("C", "run"), ("C", "shared"), ("D", "shared"), ("D", "shared")], "class string, method string"))
    assert rows(dead.unused_parameters(facts_, declared, ["^skip"])) == [("k1", "a")]
    e = spark.createDataFrame([("routine", "a"), ("routine", "b"), ("class", "b"), ("routine", "c"), ("file", "a")], "scope string, path string")
    edges = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "b"), ("a", "a"), ("x", "c")], "src string, dst string")
    assert rows(dead.over_exports(e, edges, spark.createDataFrame([("c",)], "path string"))) == [("a", "x")]
    one = spark.createDataFrame([("A", "A", ["B"], 0), ("C", "C", ["D"], 1), ("E", "E", ["F", "G"], 0)], "key string, longname string, derived array<string>, referrers int")
    assert rows(dead.single_implementations(one, spark.createDataFrame([("B",), ("C",), ("E",)], "key string"))) == [("A", "A", "B")]


def test_listings_and_globs(spark):
    held, now = (spark.createDataFrame(x, "path string, digest string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert rows(readers.sync_delta(held, now)) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    files = spark.createDataFrame([("src/a.py",), ("src/gen/b.py",), ("doc/c.md",)], "path string")
    assert rows(readers.keep_paths(files, ["src"], ["**/gen"])) == [("src/a.py",)] and readers.keep_paths(files, [], []).count() == 3
    suffixes = spark.createDataFrame([(".py", "Python"), (".md", "Markdown")], "suffix string, language string")
    assert rows(readers.enrolled(files, suffixes, ["python"])) == [("src/a.py",), ("src/gen/b.py",)] and readers.enrolled(files, suffixes, []).count() == 3


def test_outlines_are_built_piece_by_piece(spark):
    import pyarrow as pa

    text = "import a\n" * (source.PIECE // 18)  # half a piece
    texts = [text, None, "def f():\n    import b\n", "(", *[text] * 9, ""]
    pieces = list(source.module_outline.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert len(pieces) > 3 and sum(map(len, pieces)) == len(texts) and max(len(x["imports"]) for p in pieces for x in p.to_pylist()) == source.PIECE // 18
    assert [x["parsed"] for p in pieces for x in p.to_pylist()][:4] == [True, True, True, False]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", source.module_outline("text").alias("o"))
    assert {r[0]: r[1] for r in df.selectExpr("id", "size(o.imports)").collect()} == {i: (t or "").count("import") for i, t in enumerate(texts)}


def test_nested_spans_of_one_file_are_dealt_to_tasks(spark):
    spans = [("p", f"k{i:03d}", i % 20, 20 + i % 31) for i in range(200)]
    got = facts.nested_spans(spark.createDataFrame(spans, "path string, key string, start int, stop int"))
    inside = lambda i, o: o[2] <= i[2] and i[3] <= o[3] and (o[2] < i[2] or i[3] < o[3] or o[1] < i[1])
    assert rows(got.select("inner", "outer")) == sorted(((i[1], o[1]) for i in spans for o in spans if i != o and inside(i, o)), key=repr)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
