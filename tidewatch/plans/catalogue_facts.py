"""More operators as queries, next to their SQL: facts of entities, spans, summaries and rules; registered with the others.

Classes are brands and their members parts; a brand of two digits derives from the brand of its first digit. One part refers to another's
brand where it stands before it in an order. Spans of lines are customers inside their nation's file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scalars, source
from tidewatch.operators import dead, facts, graph, rules, structure, summary
from tidewatch.plans import check, settings
from tidewatch.plans.catalogue import SQL, VIEWS, changes, limits, query, recommended
from tidewatch.sources import project as P
from tidewatch.sources import readers

VIEWS |= {
    "br": "br AS (SELECT DISTINCT p_brand AS key FROM part)",
    "mb": "mb AS (SELECT DISTINCT p_brand AS owner, CAST(p_partkey AS VARCHAR) AS member FROM part)",
    "ih": "ih AS (SELECT a.key AS base, b.key AS derived FROM br a JOIN br b ON length(b.key) = 8 AND a.key = substr(b.key, 1, 7))",
    "rf": "rf AS (SELECT DISTINCT p_brand AS target, CAST(src AS VARCHAR) AS referrer FROM cea JOIN part ON p_partkey = dst)",
    "ow": "ow AS (SELECT key, key AS own FROM br UNION SELECT base, derived FROM ih UNION SELECT owner, member FROM mb UNION SELECT base, member FROM ih JOIN mb ON owner = derived)",
    "rc": "rc AS (SELECT key, count(referrer) AS referrers FROM br LEFT JOIN (SELECT * FROM rf ANTI JOIN ow ON key = target AND own = referrer) ON target = key GROUP BY 1)",
    "sp": "sp AS (SELECT n_name AS path, c_name AS key, c_custkey % 1000 + 1 AS start, c_custkey % 1000 + 1 + CAST(floor(abs(c_acctbal) / 50) AS BIGINT) AS stop FROM customer JOIN nation ON n_nationkey = c_nationkey)",
    "sl": "sl AS (SELECT DISTINCT n_name AS path, s_suppkey % 1000 + 1 AS line FROM supplier JOIN nation ON n_nationkey = s_nationkey)",
    "en": "en AS (SELECT DISTINCT 'routine' AS scope, path, longname, parameters FROM na UNION SELECT DISTINCT 'class', path, parameters, NULL FROM na UNION SELECT DISTINCT 'file', path, path, NULL FROM na)",
}
_CLASS = ("cea", "br", "mb", "ih", "rf", "ow", "rc")
_NA = ("m", "na")


def _classes(spark, sf_dir):
    part = P.read(spark, sf_dir, "part")
    keys = part.select(F.col("p_brand").alias("key")).distinct()
    members = part.select(F.col("p_brand").alias("owner"), F.col("p_partkey").cast("string").alias("member"))
    inherits = keys.select(F.col("key").alias("base")).join(keys.where(F.length("key") == 8).select(F.col("key").alias("derived")), F.col("base") == F.substring("derived", 1, 7))
    edges = P.call_edges(spark, sf_dir)
    refs = edges.join(part, F.col("dst") == F.col("p_partkey")).select(F.col("p_brand").alias("target"), F.col("src").cast("string").alias("referrer"))
    return keys, refs, members, inherits


@query("SELECT key, referrers FROM rc", *_CLASS)
def referrer_count(spark, sf_dir):
    return facts.referrer_counts(*_classes(spark, sf_dir))


@query("SELECT key, key IN (SELECT target FROM rf) AS referenced, coalesce((SELECT string_agg(derived, ',' ORDER BY derived) FROM ih WHERE base = key), '') AS derived, referrers FROM rc", *_CLASS)
def class_facts(spark, sf_dir):
    found = facts.class_facts(*_classes(spark, sf_dir))
    return found.withColumn("derived", F.array_join("derived", ","))


@query("SELECT doc_id, coalesce((SELECT bool_or(quality = 1) FROM labels l WHERE l.doc_id = d.doc_id), false) AS referenced FROM documents d")
def variable_referenced(spark, sf_dir):
    refs = P.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, "read").otherwise("write").alias("kind"))
    return facts.read_bindings(P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), refs).withColumnRenamed("key", "doc_id")


_UNUSED = """SELECT l_orderkey AS key, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS unused FROM lineitem a
    WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_returnflag <> 'N') GROUP BY 1"""


def _unused(spark, sf_dir):
    lines = P.read(spark, sf_dir, "lineitem")
    parameters = lines.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("name"))
    uses = lines.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("name"))
    return facts.unused_parameter_lists(parameters, uses)


@query(_UNUSED)
def unused_parameters_list(spark, sf_dir):
    return _unused(spark, sf_dir).withColumn("unused", F.array_join("unused", ","))


@query(
    f"""SELECT u.key, parameter FROM (SELECT key, unnest(string_split(unused, ',')) AS parameter FROM ({_UNUSED})) u JOIN orders ON o_orderkey = u.key
        WHERE o_orderstatus <> 'P' AND (SELECT count(DISTINCT p_type) FROM part WHERE p_brand = 'Brand#' || (o_custkey % 40)) < 2 AND NOT regexp_matches('C' || o_custkey || '.Brand#' || (o_custkey % 40), '^C1')"""
)
def unused_parameter(spark, sf_dir):
    """Orders of status P override; an order's short name is a brand, which as many classes declare as it has types."""
    orders = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "P").alias("overrides"), F.format_string("C%d.Brand#%d", "o_custkey", F.col("o_custkey") % 40).alias("longname"), F.lit("f").alias("path"))
    declared = dead.method_declarations(P.read(spark, sf_dir, "part").select(F.col("p_type").alias("class"), F.col("p_brand").alias("method")))
    rows = orders.join(_unused(spark, sf_dir).withColumnRenamed("unused", "unused_parameters"), "key")
    return dead.unused_parameters(rows, declared, ["^C1"]).select("key", F.col("parameter").cast("string").alias("parameter"))


_TRUSTED = "SELECT lang FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) FILTER (quality = 1) / nullif(count(quality), 0) >= 0.5"


def _trusted(spark, sf_dir):
    docs = P.read(spark, sf_dir, "documents").join(P.read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("language", F.col("lang"))
    return dead.trust(dead.resolution_counts(docs, F.when(F.col("quality") == 1, "resolved").when(F.col("quality") == 0, "unresolved").otherwise("external")), 0.9, 0.5)


@query("SELECT DISTINCT p_brand || ':' || p_size AS key FROM part WHERE p_brand || ':' || p_size NOT IN (SELECT p_brand || ':' || p_size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50) AND NOT regexp_matches(p_brand || ':' || p_size, '5$')")
def unused_class(spark, sf_dir):
    """A class is a size of a brand; a line of the largest quantity refers to it."""
    part = P.read(spark, sf_dir, "part").withColumn("key", F.concat_ws(":", "p_brand", "p_size"))
    refs = P.read(spark, sf_dir, "lineitem").where("l_quantity = 50").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("key").alias("target"), F.col("l_orderkey").cast("string").alias("referrer"))
    none = spark.createDataFrame([], "owner string, member string")
    rows = facts.class_facts(part.select("key"), refs, none, none.toDF("base", "derived")).withColumn("longname", F.col("key"))
    return dead.unreferenced(rows, ["5$"]).select("key")


@query(f"SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND lang IN ({_TRUSTED}) AND NOT regexp_matches(source, '^src0$')")
def unused_variable(spark, sf_dir):
    docs = P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("language"), F.col("source").alias("longname"))
    refs = P.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, "read").otherwise("write").alias("kind"))
    return dead.unreferenced(facts.read_bindings(docs, refs), ["^src0$"], _trusted(spark, sf_dir)).select(F.col("key").alias("doc_id"))


@query("""SELECT doc_id FROM documents WHERE lang IN (SELECT lang FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) FILTER (quality = 1) / nullif(count(quality), 0) >= 0.5)""")
def gated_findings(spark, sf_dir):
    return dead.gated(P.read(spark, sf_dir, "documents").withColumn("language", F.col("lang")), _trusted(spark, sf_dir)).select("doc_id")


_PAIRS = "SELECT p_partkey AS key, CAST(p_size AS VARCHAR) AS base, p_brand AS brand FROM part"


@query(
    f"""SELECT base AS key, min(key) AS implementation FROM ({_PAIRS}) GROUP BY base, brand HAVING count(*) = 1 AND base || ':' || brand NOT IN (SELECT DISTINCT p_size || ':' || p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity = 50)
        AND bool_or(key % 3 = 0)""".replace("SELECT base AS key", "SELECT base || ':' || brand AS key"),
)
def single_implementation(spark, sf_dir):
    """A size of a brand is a base; its only part derives from it; a line of the largest quantity refers to it; every third part was touched."""
    part = P.read(spark, sf_dir, "part").select(F.concat_ws(":", "p_size", "p_brand").alias("key"), F.col("p_partkey").cast("string").alias("d"))
    back = part.join(P.read(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").cast("string").alias("d")).distinct(), "d", "left_semi").select("key").distinct().withColumn("referrers", F.lit(1))
    rows = part.groupBy("key").agg(F.collect_set("d").alias("derived")).join(back, "key", "left").select("key", F.col("key").alias("longname"), "derived", F.coalesce("referrers", F.lit(0)).alias("referrers"))
    near = part.where("try_cast(d AS BIGINT) % 3 = 0").select(F.col("d").alias("key"))
    return dead.single_implementations(rows, near).select("key", F.col("implementation").cast("bigint").alias("implementation"))


@query("SELECT path, min('seg' || c_mktsegment) AS importer FROM (SELECT *, c_nationkey || '/' || CAST(floor(c_acctbal / 100) AS BIGINT) AS path FROM customer) GROUP BY 1 HAVING count(*) = 1 AND min(c_acctbal) >= 0")
def over_export(spark, sf_dir):
    """A file is a hundred of a balance in a nation; its customers are its routines, their segments use it, a debt binds a variable."""
    customer = P.read(spark, sf_dir, "customer").withColumn("path", F.concat_ws("/", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 100).cast("string")))
    edges = customer.select(F.concat(F.lit("seg"), "c_mktsegment").alias("src"), F.col("path").alias("dst"))
    return dead.over_exports(customer.select("path", F.lit("routine").alias("scope")), edges, customer.where("c_acctbal < 0").select("path"))


@query("SELECT src, coalesce(r, dst) AS dst, CAST(sum(refs) AS BIGINT) AS refs FROM cea LEFT JOIN (SELECT p_partkey AS k, min(p_size) + 1000000 AS r FROM part WHERE p_size < 10 GROUP BY 1) ON k = dst GROUP BY 1, 2", "cea")
def constructor_resolution(spark, sf_dir):
    built = P.read(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("class"), (F.col("p_size") + 1000000).cast("bigint").alias("routine"))
    return facts.to_constructors(P.call_edges(spark, sf_dir), built)


@query("SELECT sl.path, line, key FROM sl JOIN sp ON sp.path = sl.path AND line BETWEEN start AND stop", "sp", "sl")
def range_clip_lines_to_spans(spark, sf_dir):
    return facts.lines_in_spans(_lines(spark, sf_dir), _spans(spark, sf_dir))


def _spans(spark, sf_dir):
    start = F.col("c_custkey") % 1000 + 1
    customer = P.read(spark, sf_dir, "customer").join(F.broadcast(P.read(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return customer.select(F.col("n_name").alias("path"), F.col("c_name").alias("key"), start.alias("start"), (start + F.floor(F.abs("c_acctbal") / 50)).alias("stop"))


def _lines(spark, sf_dir):
    supplier = P.read(spark, sf_dir, "supplier").join(F.broadcast(P.read(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    return supplier.select(F.col("n_name").alias("path"), (F.col("s_suppkey") % 1000 + 1).alias("line")).distinct()


_INSIDE = "i.path = o.path AND o.start <= i.start AND i.stop <= o.stop AND (o.start < i.start OR i.stop < o.stop OR o.key < i.key)"


@query(f'SELECT i.key AS "inner", o.key AS "outer" FROM sp i JOIN sp o ON {_INSIDE}', "sp")
def interval_containment(spark, sf_dir):
    return facts.nested_spans(_spans(spark, sf_dir))


@query(f"SELECT path, key, start, stop FROM sp i WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE {_INSIDE})", "sp")
def outermost_spans(spark, sf_dir):
    return facts.outermost(_spans(spark, sf_dir))


@query("SELECT text, row_number() OVER (ORDER BY place, text) - 1 AS id FROM (SELECT p_name || ' ' || p_type AS text, min(p_partkey) AS place FROM part GROUP BY 1)")
def win_vocab(spark, sf_dir):
    return facts.vocabulary(P.read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_partkey").alias("place")))


# --- summaries --------------------------------------------------------------------------------------------


def _entities(spark, sf_dir):
    after = P.sides(spark, sf_dir)[0]
    none = F.lit(None).cast("string")
    routines = after.select("scope", "path", "longname", "parameters")
    return routines.union(after.select(F.lit("class"), "path", "parameters", none)).union(after.select(F.lit("file"), "path", "path", none)).distinct()


@query("SELECT scope, count(*) AS entities FROM en GROUP BY 1", *_NA, "en")
def entity_counts(spark, sf_dir):
    return summary.entity_counts(_entities(spark, sf_dir))


@query("SELECT concat_ws(', ', count(*) FILTER (scope = 'routine') || ' routines', count(*) FILTER (scope = 'class') || ' classes', count(*) FILTER (scope = 'file') || ' files') AS line FROM en", *_NA, "en")
def counts_line(spark, sf_dir):
    return summary.counts_line(summary.entity_counts(_entities(spark, sf_dir)))


@query("SELECT scope, count(*) AS ignored FROM en WHERE path = 'NATION_4' OR path LIKE 'NATION_1_' GROUP BY 1", *_NA, "en")
def ignored_counts(spark, sf_dir):
    return summary.ignored_counts(_entities(spark, sf_dir), ["/NATION_4", "NATION_1?"])


@query("SELECT scope, metric, value, count(*) AS n FROM na WHERE value IS NOT NULL GROUP BY 1, 2, 3", *_NA)
def population_vectors(spark, sf_dir):
    return summary.population_vectors(P.sides(spark, sf_dir)[0])


@query("SELECT metric, max(value) AS value FROM na GROUP BY 1", *_NA)
def project_value(spark, sf_dir):
    return summary.project_values(summary.population_vectors(P.sides(spark, sf_dir)[0]))


@query("SELECT metric, path, longname, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY scope, metric ORDER BY value DESC, path, longname, parameters) AS rank FROM na) WHERE rank <= 3", *_NA)
def win_offenders(spark, sf_dir):
    return summary.worst(P.sides(spark, sf_dir)[0]).select("metric", "path", "longname", "value", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT metric, path, longname, value FROM na ORDER BY value DESC, metric, path, longname, parameters LIMIT 10", *_NA)
def win_topk_value(spark, sf_dir):
    return summary.top_values(P.sides(spark, sf_dir)[0]).select("metric", "path", "longname", "value")


@query(f"SELECT metric, configured, proposed FROM ({SQL['recommend']}) WHERE verdict = 'raise'")
def deviations(spark, sf_dir):
    return summary.deviations(recommended(spark, sf_dir)[0]).select("metric", "configured", "proposed")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 8")
def win_latest_n(spark, sf_dir):
    return summary.latest(P.read(spark, sf_dir, "events"), ["user_id"], "ts", 8, "event_id").select("user_id", "event_id")


# --- rules ------------------------------------------------------------------------------------------------


@query("SELECT 'analysis.accuracy' AS rule, lang AS side, ok AS value, CAST(0.95 AS DOUBLE) AS \"limit\", 'warning' AS severity, false AS blocking FROM (SELECT lang, count(*) FILTER (quality = 1) / nullif(count(quality), 0) AS ok FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) WHERE ok < 0.95")
def analysis_accuracy(spark, sf_dir):
    figures = P.read(spark, sf_dir, "documents").join(P.read(spark, sf_dir, "labels"), "doc_id", "left").groupBy(F.col("lang").alias("side")).agg(F.try_divide(F.count_if(F.col("quality") == 1), F.count("quality")).alias("accuracy"))
    return summary.accuracy_findings(figures, 0.95)


@query("""SELECT 'codecheck.' || event_type AS rule, 'user/' || user_id AS path, CASE WHEN event_id % 50 > 0 THEN event_id % 50 END AS line, props AS message, 'error' AS severity, true AS blocking FROM events""")
def codecheck(spark, sf_dir):
    rows = P.read(spark, sf_dir, "events").select(F.col("event_type").alias("check_id"), F.format_string("/repo\\user/%d", "user_id").alias("path"), (F.col("event_id") % 50).alias("line"), F.col("props").alias("message"))
    return summary.checker_findings(rows, "error", "/repo")


@query("""SELECT 'structure.net_growth' AS rule, d AS value, CAST(100 AS DOUBLE) AS "limit", 'warning' AS severity, false AS blocking
          FROM (SELECT (SELECT sum(round(value)) FROM nb WHERE metric = 'CountOrders') - (SELECT sum(round(value)) FROM na WHERE metric = 'CountOrders') AS d) WHERE d > 100""", *_NA, "nb")  # fmt: skip
def net_growth(spark, sf_dir):
    late, early = P.sides(spark, sf_dir)  # most orders are early, so the change is read backwards
    net = rules.net_delta(early, late, ["CountOrders"])
    return summary.net_growth(net, 100, statements="net_CountOrders").drop("entities")


@query("SELECT DISTINCT path FROM (SELECT 'user/' || user_id AS path FROM events UNION ALL SELECT 'old/' || (user_id + event_id % 9) FROM events WHERE event_type = 'click')")
def touched(spark, sf_dir):
    """Every path that the events name as changes: clicks are renames."""
    events = P.read(spark, sf_dir, "events")
    old = F.when(F.col("event_type") == "click", F.concat(F.lit("old/"), (F.col("user_id") + F.col("event_id") % 9).cast("string")))
    return summary.touched(events.select(F.when(old.isNotNull(), "R").otherwise("M").alias("status"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), old.alias("old_path")))


@query("SELECT 'analysis.parse_error' AS rule, source AS path, count(*) AS errors, CAST(min(doc_id) AS VARCHAR) AS first FROM documents WHERE text LIKE '%!%' GROUP BY 2")
def parse_error_groups(spark, sf_dir):
    bad = P.read(spark, sf_dir, "documents").where(F.col("text").contains("!")).select(F.col("source").alias("path"), F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("message"))
    side = check.Side(spark.createDataFrame([], "path string"), spark.createDataFrame([], "src string, dst string"), bad)
    return check.parse_errors(side, bad.select("path").distinct()).select(F.lit("analysis.parse_error").alias("rule"), "path", "errors", "first")


@query("SELECT rule, path, longname, CASE WHEN rule = 'routine.CountOrders' THEN 'warning' ELSE severity END AS severity FROM cl", "m", "na", "nb", "lim", "th", "tb", "ra", "cl")
def join_severity_map(spark, sf_dir):
    after, before = P.sides(spark, sf_dir)
    found = rules.attach_before(rules.evaluate_thresholds(after, limits(spark)), before).union(rules.evaluate_ratchet(after, before, limits(spark)).select(*rules.FINDING))
    table = spark.createDataFrame([("routine.CountOrders", "warning")], "rule string, severity string")
    return rules.classify(found, severities=table).select("rule", "path", "longname", "severity")


@query("SELECT path, kind, kind = 'error' AND NOT (kind = 'parse' AND path LIKE 'src1%') AS blocking FROM (SELECT source AS path, CASE WHEN doc_id % 2 = 0 THEN 'parse' ELSE 'error' END AS kind FROM documents)".replace("kind = 'error' AND NOT", "NOT"))
def acknowledge(spark, sf_dir):
    rows = P.read(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.when(F.col("doc_id") % 2 == 0, "parse").otherwise("error").alias("kind"), F.lit(True).alias("blocking"))
    return rules.acknowledge(rows, ["src1*"])


@query("SELECT metric, path, longname, value FROM na WHERE path IN (SELECT path FROM af)", *_NA, "fe", "se", "ea", "eb", "ch", "gone", "af")
def affected_records(spark, sf_dir):
    after, before = P.strong_edges(spark, sf_dir)
    files = structure.affected(changes(spark), after, before)
    return P.sides(spark, sf_dir)[0].join(files, "path", "left_semi").select("metric", "path", "longname", "value")


@query("SELECT src, dst, refs FROM ea WHERE dst NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0)", "fe", "se", "ea")
def namespace_targets(spark, sf_dir):
    sizes = P.read(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.lit("CountLineCode").alias("metric"), (F.col("n_nationkey") % 5).cast("double").alias("value"))
    return structure.without_namespaces(P.strong_edges(spark, sf_dir)[0], sizes)


@query("SELECT src, dst, refs FROM cea WHERE dst % 3 <> 1", "cea")
def import_time_filter(spark, sf_dir):
    timed = P.call_edges(spark, sf_dir).withColumn("import_time", F.when(F.col("dst") % 3 == 0, F.lit(None)).otherwise(F.col("dst") % 3 - 1).cast("int"))
    return structure.import_time_only(timed).select("src", "dst", "refs")


@query("SELECT doc_id FROM documents WHERE (source || '/' || lang) LIKE 'src1%' AND lang <> 'de'")
def path_filter(spark, sf_dir):
    files = P.read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))
    return readers.keep_paths(files.where("path LIKE '%/%'"), ["/src1*"], ["**/de"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')")
def language_enrol(spark, sf_dir):
    files = P.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/b."), "lang").alias("path"))
    suffixes = spark.createDataFrame([(".en", "English"), (".fr", "French"), (".de", "German")], "suffix string, language string")
    return readers.enrolled(files, suffixes, ["english", "FRENCH"]).select("doc_id")


@query("""SELECT coalesce(a.p, b.p) AS path, CASE WHEN b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'deleted' ELSE 'modified' END AS change
          FROM (SELECT CAST(o_custkey AS VARCHAR) AS p, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' GROUP BY 1) a
          FULL JOIN (SELECT CAST(o_custkey AS VARCHAR) AS p, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1) b ON a.p = b.p WHERE a.n IS DISTINCT FROM b.n""")
def sync_delta(spark, sf_dir):
    listed = P.side_of(P.read(spark, sf_dir, "orders")).groupBy("side", F.col("o_custkey").cast("string").alias("path")).agg(F.count("*").cast("string").alias("digest"))
    return readers.sync_delta(listed.where("side = 'before'").drop("side"), listed.where("side = 'after'").drop("side"))


@query("""SELECT a.longname, a.value, b.value AS before FROM na a JOIN nb b USING (path, longname, metric) JOIN na x ON x.path = a.path AND x.longname = a.longname AND x.metric = 'MaxNesting'
          JOIN nb y ON y.path = a.path AND y.longname = a.longname AND y.metric = 'MaxNesting' WHERE metric = 'CountOrders' AND a.value > b.value""", *_NA, "nb")  # fmt: skip
def ratchet_increase(spark, sf_dir):
    """Routines that were measured on both sides and grew; none of the split metrics is asked for, so none is excused."""
    after, before = P.sides(spark, sf_dir)
    found = rules.evaluate_ratchet(after, before, limits(spark).where("metric = 'CountOrders'"))
    return found.select("longname", "value", "before")


@query("SELECT path, longname, metric, value FROM na WHERE metric IN ('CountOpen', 'MaxPrice')", *_NA)
def metric_project(spark, sf_dir):
    maps = P.sides(spark, sf_dir)[0].groupBy("scope", "path", "longname", "parameters").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    return readers.measures(maps, ["CountOpen", "MaxPrice"]).select("path", "longname", "metric", "value")


@query("SELECT lang AS language, 'quality,toxic' AS metrics FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND lang IS NOT NULL GROUP BY 1")
def unavailable_metrics(spark, sf_dir):
    named = P.read(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double")).alias("metrics")).dropDuplicates(["doc_id"])
    rows = P.read(spark, sf_dir, "documents").where("lang IS NOT NULL").join(named, "doc_id", "left").select(F.col("lang").alias("language"), F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"))
    return readers.unavailable(rows, ["quality", "toxic"]).select("language", F.array_join("metrics", ",").alias("metrics"))


@query("SELECT p_brand AS brand, CASE WHEN p_size > 25 THEN 'class.MaxInheritanceTree' ELSE 'routine.MaxNesting' END AS rule, CASE WHEN p_size > 25 THEN 'warning' ELSE 'error' END AS severity, count(*) AS findings FROM part GROUP BY ALL")
def severity_default(spark, sf_dir):
    """Parts as findings of two rules, with the severities that the shipped limits give them."""
    table = settings.thresholds(spark, settings.load()[0]).select(F.concat_ws(".", "scope", "metric").alias("rule"), "severity")
    found = P.read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 25, "class.MaxInheritanceTree").otherwise("routine.MaxNesting").alias("rule"))
    return found.join(table, "rule").groupBy("brand", "rule", "severity").agg(F.count("*").alias("findings"))


# --- functions of columns ---------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE c_name END AS longname FROM customer")
def key_of(spark, sf_dir):
    c = P.read(spark, sf_dir, "customer").withColumn("scope", F.when(F.col("c_custkey") % 2 == 0, "file").otherwise("class"))
    return c.select("c_custkey", scalars.long_name(F.col("scope"), F.col("c_nationkey").cast("string"), F.col("c_name")).alias("longname"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS params FROM orders")
def synthetic_count_params(spark, sf_dir):
    lists = P.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("p"))
    return P.read(spark, sf_dir, "orders").join(lists, "o_orderkey", "left").select("o_orderkey", scalars.count_params(F.col("p")).cast("bigint").alias("params"))


@query("SELECT p_partkey, p_retailprice / nullif(p_size % 5, 0) AS ratio, greatest(0, p_size - 2 * coalesce(nullif(p_size % 30, 7), 0)) AS methods, coalesce(nullif(p_size % 5, 3) < 2, false) AS below FROM part")
def synthetic_metrics(spark, sf_dir):
    """Lines per statement, methods that aren't stubs, and whether an entity is below the floor."""
    five = F.col("p_size") % 5
    floor = F.create_map(F.lit("CountStmt"), F.nullif(five, F.lit(3)))
    return P.read(spark, sf_dir, "part").select("p_partkey", scalars.lines_per_statement(F.col("p_retailprice"), five).alias("ratio"), scalars.non_stub_methods(F.col("p_size"), F.nullif(F.col("p_size") % 30, F.lit(7))).alias("methods"), scalars.below_floor(floor, "CountStmt", 2).alias("below"))


@query("SELECT page_id, substr(url, 7) AS path FROM pages WHERE url LIKE 'http://%'")
def reject_outside(spark, sf_dir):
    return P.read(spark, sf_dir, "pages").where("url LIKE 'http://%'").select("page_id", scalars.inside_root(F.col("url"), "http:/").alias("path"))


@query("SELECT true AS held FROM pages HAVING count(*) > 0")
def root_check(spark, sf_dir):
    return scalars.root_checked(P.read(spark, sf_dir, "pages").select(F.col("url").alias("path")), "http")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, 'License') THEN 'licence' WHEN regexp_matches(text, '[0-9]{3}') THEN 'number' END AS construct FROM documents")
def construct_of(spark, sf_dir):
    return P.read(spark, sf_dir, "documents").select("doc_id", scalars.constructs(F.col("text"), [("licence", "License"), ("number", "[0-9]{3}")]).alias("construct"))


@query("SELECT p_partkey, 'net: ' || CASE WHEN d >= 0 THEN '+' ELSE '' END || d || ' statements, +' || p_size || ' lines over 3 routines' AS line FROM (SELECT p_partkey, p_size, p_size - 25 AS d FROM part)")
def net_line(spark, sf_dir):
    return P.read(spark, sf_dir, "part").select("p_partkey", scalars.signed_line(F.col("p_size") - 25, F.col("p_size"), F.lit(3)).alias("line"))


@query(r"""SELECT page_id, array_to_string(list_transform(list_filter(regexp_extract_all(url, '(#[^\n]*|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|[0-9][0-9A-Za-z_.]*|[A-Za-z_][0-9A-Za-z_]*|[^\s0-9A-Za-z_])', 1), lambda x: x[1] <> '#'),
           lambda x: CASE WHEN x = 'http' THEN x WHEN regexp_matches(x, '^[A-Za-z_]') THEN 'ID' WHEN regexp_matches(x, '^["''0-9]') THEN 'LIT' ELSE x END), ' ') AS shape FROM pages""")
def token_classes(spark, sf_dir):
    return P.read(spark, sf_dir, "pages").select("page_id", F.array_join(source.token_classes(F.col("url"), ["http"]), " ").alias("shape"))


# --- graphs with every node as a subject ------------------------------------------------------------------


@query(", down AS (SELECT DISTINCT src AS node FROM cea WHERE src % 97 = 0 UNION SELECT cea.dst FROM down JOIN cea ON cea.src = down.node) SELECT src, dst, refs FROM cea WHERE src IN (FROM down)", "cea", recursive=True)
def call_closure_bound(spark, sf_dir):
    """Calls out of what the requested files reach; requested are the parts of every 97th key."""
    edges = P.call_edges(spark, sf_dir)
    return graph.bounded(edges, edges.where("src % 97 = 0").select(F.col("src").alias("node")))


@query(
    """, nd AS (SELECT DISTINCT s.side, a.n_name AS src, b.n_name AS dst, refs FROM se s JOIN nation a ON a.n_name = src JOIN nation b ON b.n_name = dst),
       rl AS (SELECT side, x.r_name AS src, y.r_name AS dst, sum(refs) AS refs FROM nd JOIN nation a ON a.n_name = src JOIN nation b ON b.n_name = dst JOIN region x ON x.r_regionkey = a.n_regionkey JOIN region y ON y.r_regionkey = b.n_regionkey WHERE x.r_name <> y.r_name GROUP BY 1, 2, 3),
       rr AS (SELECT side, src AS seed, src AS node FROM rl UNION SELECT rr.side, rr.seed, rl.dst FROM rr JOIN rl ON rl.side = rr.side AND rl.src = rr.node),
       cc AS (SELECT x.side, x.seed AS node, min(x.node) AS component FROM rr x JOIN rr y ON x.side = y.side AND x.seed = y.node AND x.node = y.seed GROUP BY 1, 2 HAVING count(*) > 1)
       SELECT a.component, count(*) AS members FROM cc a LEFT JOIN cc b ON b.side = 'before' AND b.node = a.node WHERE a.side = 'after' GROUP BY 1 HAVING NOT (count(b.component) = count(*) AND count(DISTINCT b.component) = 1)""",
    "fe", "se", recursive=True,
)
def arch_cycle(spark, sf_dir):
    """Cycles of regions that the before side lacks."""
    members = P.arch_members(spark, sf_dir)
    after, before = (structure.roll_up(e, members) for e in P.strong_edges(spark, sf_dir))
    return graph.new_cycles(after, before)


@query("""SELECT seed, rank, node, complexity FROM (SELECT c.src AS seed, p_partkey AS node, CAST(p_size AS DOUBLE) AS complexity, row_number() OVER (PARTITION BY c.src ORDER BY p_size DESC, p_partkey) AS rank
          FROM cea c JOIN part ON p_partkey = c.dst WHERE c.src <> c.dst AND p_partkey % 7 <> 0) WHERE rank <= 3""", "cea")  # fmt: skip
def win_heaviest(spark, sf_dir):
    """The heaviest direct callees of every part."""
    direct = P.call_edges(spark, sf_dir).select(F.col("src").alias("seed"), F.col("dst").alias("node"))
    return summary.heaviest(direct, P.call_nodes(spark, sf_dir)).select("seed", F.col("rank").cast("bigint").alias("rank"), "node", "complexity")


@query("""SELECT DISTINCT 'u' || user_id AS path, CAST(event_id AS INTEGER) AS line, was_props AS message FROM (SELECT *, lag(event_type) OVER w AS was, lag(props) OVER w AS was_props FROM events WHERE event_type IN ('error', 'click', 'signup') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
          WHERE event_type = 'click' AND was = 'error'""")
def win_pair_lines(spark, sf_dir):
    """Events as the lines of a log for each user: errors, the places that clicks name, and signups as warnings."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("Error: "), "props")).when(F.col("event_type") == "click", F.format_string("File: u%d Line: %d", "user_id", "event_id")).when(F.col("event_type") == "signup", F.lit("Warning: new")).otherwise(F.lit("note"))
    return readers.analysis_log(P.read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("n"), text.alias("text")))
