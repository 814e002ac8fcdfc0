"""Every operator as a query over the driver's tables, next to the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalars
from tidewatch.operators import dead, graph, rules, similar, stats, structure, text
from tidewatch.sources import project as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: SQL of the projected tables; a query names those that it uses.
VIEWS = {
    "m": """m AS (SELECT side, 'routine' AS scope, n_name AS path, c_name AS longname, c_mktsegment AS parameters, u.metric, u.value
        FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN 'before' ELSE 'after' END AS side, o_custkey, CAST(count(*) AS DOUBLE) AS a, round(max(o_totalprice), 2) AS b,
                     CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS c, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS d FROM orders GROUP BY 1, 2) s
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey,
        LATERAL (VALUES ('CountOrders', a), ('MaxPrice', b), ('CountOpen', c), ('MaxNesting', d)) u(metric, value))""",
    "na": "na AS (SELECT * EXCLUDE (side) FROM m WHERE side = 'after')",
    "nb": "nb AS (SELECT * EXCLUDE (side) FROM m WHERE side = 'before')",
    "lim": "lim AS (SELECT * FROM (VALUES ('routine', 'CountOrders', 8.0, NULL, 'error', true), ('routine', 'MaxPrice', 400000.0, NULL, 'warning', false), ('routine', 'CountOpen', NULL, 1.0, 'error', true)) t(scope, metric, most, least, severity, ratchet))",
    "th": """th AS (SELECT 'threshold' AS kind, scope || '.' || metric AS rule, metric, path, longname, parameters, value, CASE WHEN value > most THEN CAST(most AS DOUBLE) ELSE CAST(least AS DOUBLE) END AS "limit", severity
        FROM na JOIN lim USING (scope, metric) WHERE value > most OR value < least)""",
    "tb": 'tb AS (SELECT th.*, b.value AS before FROM th LEFT JOIN nb b ON b.path = th.path AND b.longname = th.longname AND b.parameters IS NOT DISTINCT FROM th.parameters AND b.metric = th.metric)',
    "ra": """ra AS (SELECT 'ratchet' AS kind, scope || '.' || metric AS rule, metric, a.path, a.longname, a.parameters, a.value, CASE WHEN most IS NOT NULL AND a.value > b.value THEN CAST(most AS DOUBLE) ELSE CAST(least AS DOUBLE) END AS "limit", severity, b.value AS before
        FROM na a JOIN nb b USING (scope, path, longname, metric) JOIN lim USING (scope, metric)
        WHERE a.parameters IS NOT DISTINCT FROM b.parameters AND ratchet AND ((most IS NOT NULL AND a.value > b.value) OR (least IS NOT NULL AND a.value < b.value)))""",
    "cl": """cl AS (SELECT kind, rule, path, longname, value, before, "limit", sev AS severity, pre AS preexisting, sev = 'error' AND NOT pre AS blocking FROM (
        SELECT *, CASE WHEN kind = 'ratchet' AND (CASE WHEN value > before THEN value <= "limit" ELSE value >= "limit" END) THEN 'warning' ELSE severity END AS sev,
               coalesce(kind = 'threshold' AND (CASE WHEN value >= "limit" THEN before > "limit" AND value <= before ELSE before < "limit" AND value >= before END), false) AS pre
        FROM (SELECT kind, rule, path, longname, value, before, "limit", severity FROM tb UNION ALL SELECT kind, rule, path, longname, value, before, "limit", severity FROM ra)))""",
    "fe": """fe AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN 'before' ELSE 'after' END AS side, n1.n_name AS src, n2.n_name AS dst, count(*) AS refs
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN nation n2 ON n2.n_nationkey = s_nationkey GROUP BY 1, 2, 3)""",
    "se": "se AS (SELECT side, src, dst, refs FROM fe JOIN (SELECT side, quantile_disc(refs, 0.9) AS cut FROM fe GROUP BY side) USING (side) WHERE refs >= cut)",
    "ea": "ea AS (SELECT src, dst, refs FROM se WHERE side = 'after')",
    "eb": "eb AS (SELECT src, dst, refs FROM se WHERE side = 'before')",
    "ne": "ne AS (SELECT src, dst FROM ea EXCEPT SELECT src, dst FROM eb)",
    "am": "am AS (SELECT r_name AS node, n_name AS path, n_nationkey AS ordinal FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "cea": """cea AS (SELECT src, dst, count(*) AS refs FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL GROUP BY 1, 2)""",
    "rea": "rea AS (SELECT DISTINCT src AS seed, src AS node FROM cea UNION SELECT rea.seed, cea.dst FROM rea JOIN cea ON cea.src = rea.node)",
    "sca": "sca AS (SELECT a.seed AS node, min(a.node) AS component FROM rea a JOIN rea b ON a.seed = b.node AND a.node = b.seed GROUP BY 1 HAVING count(*) > 1)",
    "ch": "ch AS (SELECT * FROM (VALUES ('M', 'NATION_3', NULL), ('D', 'NATION_7', NULL), ('R', 'NATION_2', 'NATION_9')) t(status, path, old_path))",
    "gone": "gone AS (SELECT path FROM ch WHERE status = 'D' UNION SELECT old_path FROM ch WHERE status = 'R')",
    "af": """af AS (SELECT path FROM (SELECT path FROM ch WHERE status <> 'D' UNION
        SELECT src FROM ((SELECT src, dst FROM ea WHERE dst NOT IN (FROM gone) EXCEPT SELECT src, dst FROM eb) UNION (SELECT src, dst FROM eb WHERE dst NOT IN (FROM gone) EXCEPT SELECT src, dst FROM ea)) t(src, dst)) WHERE path NOT IN (FROM gone))""",
    "ln": """ln AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS idx, substr(sha256(code), 1, 16) AS hash
        FROM (SELECT CAST(doc_id AS VARCHAR) AS path, i AS line, regexp_replace(parts[i], '\\s+', '', 'g') AS code
              FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))) WHERE code <> '')""".replace("\\\\", "\\"),
    "li": "li AS (SELECT CAST(doc_id AS VARCHAR) AS path, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))",
    "w3": """w3 AS (SELECT path, idx, line, last_line, key FROM (SELECT path, idx, line, max(line) OVER w AS last_line, sha256(array_to_string(list(hash) OVER w, ',')) AS key, len(list(hash) OVER w) AS n FROM ln
        WINDOW w AS (PARTITION BY path ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3)""",
    "rw": "rw AS (SELECT w3.*, places FROM w3 JOIN (SELECT key, count(*) AS places FROM w3 GROUP BY key HAVING count(*) > 1) USING (key))",
}


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Register a query under its function's name, with SQL over the given views."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(VIEWS[v] for v in views)} " if views else ""
            SQL[f.__name__] = head + sql
        return f

    return keep


def limits(spark: SparkSession) -> DataFrame:
    rows = [("routine", "CountOrders", 8.0, None, "error", True), ("routine", "MaxPrice", 400000.0, None, "warning", False), ("routine", "CountOpen", None, 1.0, "error", True)]
    return spark.createDataFrame(rows, "scope string, metric string, most double, least double, severity string, ratchet boolean")


def changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("M", "NATION_3", None), ("D", "NATION_7", None), ("R", "NATION_2", "NATION_9")], "status string, path string, old_path string")


# --- limits, ratchet, classification ----------------------------------------------------------------------

_T = ("m", "na", "lim", "th")
_TB = ("m", "na", "nb", "lim", "th", "tb")
_CL = ("m", "na", "nb", "lim", "th", "tb", "ra", "cl")


@query('SELECT rule, path, longname, parameters, value, "limit", severity FROM th', *_T)
def threshold(spark, sf_dir):
    return rules.evaluate_thresholds(P.sides(spark, sf_dir)[0], limits(spark)).select("rule", "path", "longname", "parameters", "value", "limit", "severity")


@query('SELECT rule, path, longname, value, before, "limit" FROM tb', *_TB)
def join_attach_before(spark, sf_dir):
    after, before = P.sides(spark, sf_dir)
    return rules.attach_before(rules.evaluate_thresholds(after, limits(spark)), before).select("rule", "path", "longname", "value", "before", "limit")


@query('SELECT rule, path, longname, value, before, "limit", severity FROM ra', "m", "na", "nb", "lim", "ra")
def ratchet(spark, sf_dir):
    after, before = P.sides(spark, sf_dir)
    return rules.evaluate_ratchet(after, before, limits(spark)).select("rule", "path", "longname", "value", "before", "limit", "severity")


def _classified(spark, sf_dir):
    after, before = P.sides(spark, sf_dir)
    found = rules.attach_before(rules.evaluate_thresholds(after, limits(spark)), before)
    return rules.classify(found.union(rules.evaluate_ratchet(after, before, limits(spark)).select(*rules.FINDING)))


@query("SELECT * FROM cl", *_CL)
def classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("kind", "rule", "path", "longname", "value", "before", "limit", "severity", "preexisting", "blocking")


@query("SELECT count(*) FILTER (blocking) AS blocking, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (preexisting) AS preexisting, count(DISTINCT path) AS files FROM cl", *_CL)
def run_counts(spark, sf_dir):
    return rules.run_counts(_classified(spark, sf_dir))


@query("SELECT rule, path, longname, before FROM tb WHERE before > \"limit\" AND value <= before AND value > \"limit\" OR before < \"limit\" AND value >= before AND value < \"limit\"", *_TB)
def preexisting(spark, sf_dir):
    return _classified(spark, sf_dir).where("preexisting").select("rule", "path", "longname", "before")


@query("SELECT path, longname, rule, path IN ('NATION_3', 'NATION_4') OR coalesce(before > \"limit\" AND value <= before AND value > \"limit\", false) OR coalesce(before < \"limit\" AND value >= before AND value < \"limit\", false) AS preexisting FROM (SELECT th.*, CASE WHEN th.path NOT IN ('NATION_3', 'NATION_4') THEN tb.before END AS before FROM th JOIN tb USING (path, longname, rule))", *_TB)
def first_measured(spark, sf_dir):
    after, before = P.sides(spark, sf_dir)
    unread = spark.createDataFrame([("NATION_3",), ("NATION_4",)], "path string")
    found = rules.attach_before(rules.evaluate_thresholds(after, limits(spark)), before, unread)
    return rules.classify(found, first_measured=unread).select("path", "longname", "rule", "preexisting")


@query(
    """SELECT a.path, a.longname, a.p AS parameters, b.p AS old_parameters
       FROM (SELECT path, longname, any_value(CASE WHEN CAST(right(longname, 9) AS BIGINT) % 5 = 0 THEN 'NEW' ELSE parameters END) AS p FROM na GROUP BY 1, 2) a
       JOIN (SELECT path, longname, any_value(parameters) AS p FROM nb GROUP BY 1, 2) b USING (path, longname) WHERE a.p <> b.p""",
    "m", "na", "nb",
)
def join_family_pairing(spark, sf_dir):
    after, before = P.sides(spark, sf_dir)
    renamed = after.withColumn("parameters", F.when(F.substring("longname", -9, 9).cast("bigint") % 5 == 0, "NEW").otherwise(F.col("parameters")))
    return rules.pair_signatures(renamed, before).select("path", "longname", "parameters", "old_parameters")


_DELTA = """(SELECT path, longname, metric, coalesce(b.value, 0) AS was, coalesce(a.value, 0) AS now, coalesce(a.value, 0) - coalesce(b.value, 0) AS delta,
    CASE WHEN b.value IS NULL THEN 'added' WHEN a.value IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM na a FULL JOIN nb b USING (scope, path, longname, parameters, metric)) d WHERE change <> 'modified' OR delta <> 0"""


@query(f"SELECT path, longname, metric, was, now, delta, change FROM {_DELTA}", "m", "na", "nb")
def join_full_outer_delta(spark, sf_dir):
    return rules.full_outer_delta(*P.sides(spark, sf_dir)).select("path", "longname", "metric", "was", "now", "delta", "change")


@query(f"SELECT path, longname, metric, delta FROM {_DELTA} ORDER BY abs(delta) DESC, path, longname, metric LIMIT 10", "m", "na", "nb")
def win_topk_delta(spark, sf_dir):
    return rules.top_movements(rules.full_outer_delta(*P.sides(spark, sf_dir))).select("path", "longname", "metric", "delta")


@query("SELECT sum(CASE WHEN metric = 'CountOrders' THEN s * value END) AS \"net_CountOrders\", sum(CASE WHEN metric = 'CountOpen' THEN s * value END) AS \"net_CountOpen\", count(DISTINCT longname) AS entities FROM (SELECT *, 1 AS s FROM na UNION ALL SELECT *, -1 FROM nb)", "m", "na", "nb")
def net_delta(spark, sf_dir):
    return rules.net_delta(*P.sides(spark, sf_dir), ["CountOrders", "CountOpen"])


_SCOPES = [
    {"pattern": "NATION_1*", "rules": [{"scope": "routine", "metric": "CountOrders", "most": 20.0}]},
    {"pattern": "*_?3", "rules": [{"scope": "routine", "metric": "CountOrders", "disabled": True}, {"scope": "routine", "metric": "MaxNesting", "most": 3.0, "severity": "warning"}]},
]


@query(
    """SELECT path, metric, CAST(CASE WHEN metric = 'CountOrders' AND path LIKE 'NATION!_1%' ESCAPE '!' THEN 20 ELSE most END AS DOUBLE) AS most, CAST(least AS DOUBLE) AS least, severity
       FROM (SELECT n_name AS path FROM nation) CROSS JOIN lim WHERE NOT (metric = 'CountOrders' AND path LIKE '%!__3' ESCAPE '!')
       UNION ALL SELECT n_name, 'MaxNesting', 3.0, NULL, 'warning' FROM nation WHERE n_name LIKE '%!__3' ESCAPE '!'""",
    "lim",
)
def join_path_scope(spark, sf_dir):
    paths = P.read(spark, sf_dir, "nation").select(F.col("n_name").alias("path"))
    return rules.overlay_scopes(paths, limits(spark), _SCOPES).select("path", "metric", "most", "least", "severity")


@query("SELECT rule, path, longname, CASE rule WHEN 'routine.CountOrders' THEN 'split the customer' WHEN 'routine.MaxPrice' THEN 'look at prices' ELSE 'see the guide' END AS hint FROM th", *_T)
def hint_lookup(spark, sf_dir):
    table = spark.createDataFrame([("routine.CountOrders", "split the customer"), ("MaxPrice", "look at prices"), ("*", "see the guide")], "key string, hint string")
    return rules.hints(rules.evaluate_thresholds(P.sides(spark, sf_dir)[0], limits(spark)), table).select("rule", "path", "longname", "hint")


@query("SELECT longname, path FROM (SELECT DISTINCT longname, path FROM na) WHERE NOT regexp_matches(longname, '7$|99')", "m", "na")
def ignore_filter(spark, sf_dir):
    return P.sides(spark, sf_dir)[0].select("longname", "path").distinct().where(~scalars.matches_any(F.col("longname"), ["7$", "99"]))


# --- statistics -------------------------------------------------------------------------------------------


@query(
    """SELECT l_returnflag, round(avg(l_quantity), 6) AS avg, median(l_quantity) AS median, quantile_disc(l_quantity, 0.5) AS median_low,
              list_sort(list(l_quantity))[count(*) // 2 + 1] AS median_high, round(stddev_pop(l_quantity), 6) AS stdev, round(var_pop(l_quantity), 6) AS variance,
              (SELECT q FROM (SELECT l_quantity AS q, count(*) AS n FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY 1) ORDER BY n DESC, q LIMIT 1) AS mode
       FROM lineitem o GROUP BY l_returnflag"""
)
def reduce(spark, sf_dir):
    r = stats.reducers(P.read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return r.select("l_returnflag", F.round("avg", 6).alias("avg"), "median", "median_low", "median_high", F.round("stdev", 6).alias("stdev"), F.round("variance", 6).alias("variance"), "mode")


@query(
    """SELECT l_returnflag, round(x - 0.5 + (n / 2 - count(*) FILTER (l_quantity < x)) / count(*) FILTER (l_quantity = x), 6) AS median_grouped
       FROM lineitem JOIN (SELECT l_returnflag, list_sort(list(l_quantity))[count(*) // 2 + 1] AS x, count(*) AS n FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY l_returnflag, x, n"""
)
def agg_median_grouped(spark, sf_dir):
    return stats.reducers(P.read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", F.round("median_grouped", 6).alias("median_grouped"))


@query("SELECT o_orderpriority, count(*) AS n, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.9) AS p90, quantile_disc(o_totalprice, 0.95) AS p95, quantile_disc(o_totalprice, 0.99) AS p99, max(o_totalprice) AS maximum FROM orders GROUP BY 1")
def distribution(spark, sf_dir):
    return stats.distribution(P.read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


@query("SELECT o_orderpriority, CAST(l AS DOUBLE) AS \"limit\", CAST(count(*) FILTER (o_totalprice > l) AS BIGINT) AS outside, round(count(*) FILTER (o_totalprice > l) / count(*), 9) AS share_outside FROM orders, (VALUES (100000), (250000), (400000)) t(l) GROUP BY 1, 2")
def outside_counts(spark, sf_dir):
    keys = P.read(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    table = keys.crossJoin(spark.createDataFrame([(100000.0,), (250000.0,), (400000.0,)], "limit double"))
    return stats.outside_counts(P.read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", table).withColumn("share_outside", F.round("share_outside", 9))


_CONFIGURED = {"CountOrders": 3.0, "MaxPrice": 1000000.0, "CountOpen": 60.0, "MaxNesting": 2.5}
_ADVICE = f"""rs AS (SELECT s * pow(10, e) AS rung, row_number() OVER (ORDER BY e, s) AS pos FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 50, 60, 80]) AS s), (SELECT unnest(range(0, 13)) AS e)),
    cf AS (SELECT * FROM (VALUES {', '.join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in _CONFIGURED.items())}) t(metric, configured)),
    sh AS (SELECT metric, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS maximum FROM na GROUP BY 1),
    ad AS (SELECT sh.*, configured, CASE WHEN fit > configured THEN 'raise' ELSE 'keep' END AS verdict, CASE WHEN fit > configured THEN fit END AS proposed, round(maximum / greatest(p95, 1), 9) AS tail_ratio, maximum / greatest(p95, 1) >= 50 AS tail_dominated
           FROM sh JOIN cf USING (metric) JOIN LATERAL (SELECT min(rung) AS fit FROM rs WHERE rung >= p95 AND rung <= 1e12) ON true)"""


def recommended(spark, sf_dir):
    table = spark.createDataFrame(list(_CONFIGURED.items()), "metric string, configured double")
    return stats.recommend(P.sides(spark, sf_dir)[0], ["metric"], "value", table)


@query(f", {_ADVICE} SELECT * FROM ad", "m", "na")
def recommend(spark, sf_dir):
    return recommended(spark, sf_dir)[0].withColumn("tail_ratio", F.round("tail_ratio", 9))


@query(
    f""", {_ADVICE}, an AS (SELECT metric, n, maximum, configured, proposed, coalesce(proposed, configured) AS anchor FROM ad),
       ce AS (SELECT metric, unnest([configured, anchor]) AS c FROM an),
       pl AS (SELECT metric, c, (SELECT min(pos) FROM rs WHERE rung = c) AS pos FROM ce),
       ls AS (SELECT metric, c AS "limit" FROM pl UNION SELECT metric, rung FROM pl JOIN rs ON CASE WHEN pl.pos IS NULL THEN rs.pos <= 2 ELSE rs.pos BETWEEN pl.pos - 2 AND pl.pos + 2 END)
       SELECT metric, "limit", (SELECT count(*) FROM na WHERE na.metric = ls.metric AND na.value > ls."limit") AS outside, round((SELECT count(*) FROM na WHERE na.metric = ls.metric AND na.value > ls."limit") / n, 9) AS share_outside,
              "limit" = configured AS is_configured, coalesce("limit" = proposed, false) AS is_proposed
       FROM ls JOIN an USING (metric) WHERE "limit" <= greatest(maximum, anchor)""",
    "m", "na",
)
def recommend_candidates(spark, sf_dir):
    """What every limit near the configured one and near the proposal would leave outside."""
    return recommended(spark, sf_dir)[1].withColumn("share_outside", F.round("share_outside", 9))


# the before side of the pairing: some customers stood under another signature, some in another file
VIEWS["ra_"] = "ra_ AS (SELECT DISTINCT 'routine' AS scope, n_name AS path, c_name AS longname, c_mktsegment AS parameters, c_name AS body, c_custkey AS k FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= TIMESTAMP '1998-07-01')"
VIEWS["rb_"] = """rb_ AS (SELECT DISTINCT 'routine' AS scope, CASE WHEN c_custkey % 7 = 0 THEN 'OLD/' || n_name ELSE n_name END AS path, c_name AS longname, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || '2' ELSE c_mktsegment END AS parameters, c_name AS body, c_custkey AS k
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate < TIMESTAMP '1998-07-01')"""
_PAIRS = """, fo AS (SELECT coalesce(a.scope, b.scope) AS scope, a.path, a.longname, a.parameters, b.path AS old_path, b.longname AS old_longname, b.parameters AS old_parameters,
        CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.path <> b.path THEN 'moved' WHEN a.parameters <> b.parameters THEN 'signature' ELSE 'same' END AS stage FROM ra_ a FULL JOIN rb_ b USING (k))"""


def _routines(spark, sf_dir):
    orders, customer, nation = (P.read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = P.side_of(orders).join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("side", F.lit("routine").alias("scope"), F.col("n_name").alias("path"), F.col("c_name").alias("longname"), F.col("c_mktsegment").alias("parameters"), F.col("c_name").alias("body"), "c_custkey").distinct()
    old = rows.where("side = 'before'").withColumn("path", F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("OLD/"), "path")).otherwise(F.col("path"))).withColumn("parameters", F.when(F.col("c_custkey") % 5 == 0, F.concat("parameters", F.lit("2"))).otherwise(F.col("parameters")))
    return rows.where("side = 'after'").drop("side", "c_custkey"), old.drop("side", "c_custkey")


@query(_PAIRS + " SELECT * FROM fo", "ra_", "rb_")
def join_net_pairs(spark, sf_dir):
    """Every customer once, joined to its other side by key, by signature, or by the one body that moved."""
    return rules.net_pairs(*_routines(spark, sf_dir))


@query(_PAIRS + ", dl AS (SELECT sum(CASE WHEN metric = 'CountOrders' THEN s * value END) AS \"net_CountOrders\" FROM (SELECT *, 1 AS s FROM na UNION ALL SELECT *, -1 FROM nb)) SELECT \"net_CountOrders\", (SELECT count(*) FROM fo) AS entities FROM dl", "ra_", "rb_", "m", "na", "nb")
def net_delta_moved(spark, sf_dir):
    """The net movement, where a customer that moved counts once."""
    return rules.net_delta(*P.sides(spark, sf_dir), ["CountOrders"], rules.net_pairs(*_routines(spark, sf_dir)))


@query("SELECT scope, metric, value, min(longname) AS holder FROM na JOIN (SELECT scope, metric, max(value) AS value FROM na GROUP BY 1, 2) USING (scope, metric, value) GROUP BY 1, 2, 3", "m", "na")
def highest(spark, sf_dir):
    return stats.highest(P.sides(spark, sf_dir)[0], "longname")


_CAP = "SELECT scope || '.' || metric AS rule, CASE WHEN most IS NOT NULL THEN max(value) ELSE min(value) END AS value FROM {0} JOIN lim USING (scope, metric) GROUP BY scope, metric, most"


@query(_CAP.format("na"), "m", "na", "lim")
def baseline_capture(spark, sf_dir):
    return stats.baseline_capture(P.sides(spark, sf_dir)[0], limits(spark))


@query(f"SELECT scope || '.' || metric AS rule, CASE WHEN most IS NOT NULL AND value < most THEN value ELSE CAST(most AS DOUBLE) END AS most, CASE WHEN most IS NULL AND value > least THEN value ELSE CAST(least AS DOUBLE) END AS least, CASE WHEN value < most OR (most IS NULL AND value > least) THEN 'baseline' ELSE 'config' END AS source, false AS issue FROM lim LEFT JOIN ({_CAP.format('na')}) c ON c.rule = scope || '.' || metric", "m", "na", "lim")
def baseline_apply(spark, sf_dir):
    table = limits(spark).select(F.concat_ws(".", "scope", "metric").alias("rule"), "most", "least")
    return stats.baseline_apply(table, stats.baseline_capture(P.sides(spark, sf_dir)[0], limits(spark)))


@query(f"SELECT b.rule, least(b.value, a.value) AS value, b.value AS was, a.value < b.value AS tightened FROM ({_CAP.format('nb')}) b JOIN ({_CAP.format('na')}) a USING (rule)", "m", "na", "nb", "lim")
def baseline_tighten(spark, sf_dir):
    after, before = P.sides(spark, sf_dir)
    return stats.baseline_tighten(stats.baseline_capture(before, limits(spark)), stats.baseline_capture(after, limits(spark)))


# --- structure --------------------------------------------------------------------------------------------

_E = ("fe", "se", "ea", "eb")


@query("SELECT src, dst, CAST(sum(refs) AS BIGINT) AS refs FROM fe GROUP BY 1, 2", "fe")
def edge_merge(spark, sf_dir):
    return structure.merge_edges(P.file_edges(spark, sf_dir))


_ROLL = "SELECT a.node AS src, b.node AS dst, CAST(sum(refs) AS BIGINT) AS refs FROM fe JOIN am a ON a.path = src JOIN am b ON b.path = dst WHERE side = 'after' AND a.node <> b.node GROUP BY 1, 2"


def _node_edges(spark, sf_dir):
    return structure.roll_up(P.file_edges(spark, sf_dir).where("side = 'after'"), P.arch_members(spark, sf_dir))


@query(_ROLL, "fe", "am")
def arch_rollup(spark, sf_dir):
    return _node_edges(spark, sf_dir)


@query(f"SELECT r.src, r.dst, refs, CAST(r.most AS BIGINT) AS most FROM (VALUES ('ASIA', 'EUROPE', 10), ('EUROPE', 'ASIA', 1000000000)) r(src, dst, most) JOIN ({_ROLL}) e USING (src, dst) WHERE refs > most", "fe", "am")
def join_coupling_rule(spark, sf_dir):
    return structure.coupling_findings(_node_edges(spark, sf_dir), spark.createDataFrame([("ASIA", "EUROPE", 10), ("EUROPE", "ASIA", 1000000000)], "src string, dst string, most bigint"))


@query("SELECT src, dst, refs, a.node <> b.node AS crosses FROM ea JOIN am a ON a.path = src JOIN am b ON b.path = dst", *_E, "am")
def crosses_arch(spark, sf_dir):
    return structure.crossing(P.strong_edges(spark, sf_dir)[0], P.arch_members(spark, sf_dir)).select("src", "dst", "refs", "crosses")


_FAN = "SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM {0} WHERE src <> dst UNION ALL SELECT dst, 1, 0 FROM {0} WHERE src <> dst) GROUP BY 1"


@query(_FAN.format("ea"), *_E)
def fan(spark, sf_dir):
    return structure.fan(P.strong_edges(spark, sf_dir)[0])


@query(
    f"""SELECT * FROM (SELECT a.node, 'threshold' AS kind, 'structure.fan_in' AS rule, a.fan_in AS value, b.fan_in AS before, 4 AS "limit" FROM ({_FAN.format('ea')}) a LEFT JOIN ({_FAN.format('eb')}) b USING (node) WHERE a.fan_in > 4
        UNION ALL SELECT a.node, 'threshold', 'structure.fan_out', a.fan_out, b.fan_out, 3 FROM ({_FAN.format('ea')}) a LEFT JOIN ({_FAN.format('eb')}) b USING (node) WHERE a.fan_out > 3
        UNION ALL SELECT a.node, 'ratchet', 'structure.fan_out', a.fan_out, b.fan_out, 3 FROM ({_FAN.format('ea')}) a JOIN ({_FAN.format('eb')}) b USING (node) WHERE a.fan_out > b.fan_out)""",
    *_E,
)
def fan_findings(spark, sf_dir):
    return structure.fan_findings(*P.strong_edges(spark, sf_dir), 4, 3)


@query("SELECT src, dst FROM ne", *_E, "ne")
def anti_new_edges(spark, sf_dir):
    return structure.new_edges(*P.strong_edges(spark, sf_dir))


@query("SELECT 'core' AS layer, src, dst, a.node AS src_node, b.node AS dst_node FROM ne JOIN am a ON a.path = src JOIN am b ON b.path = dst WHERE a.node = 'ASIA' AND b.node NOT IN ('ASIA', 'EUROPE')", *_E, "ne", "am")
def join_layer_rule(spark, sf_dir):
    table = spark.createDataFrame([("core", "ASIA", ["EUROPE"])], "layer string, node string, may array<string>")
    return structure.layer_findings(*P.strong_edges(spark, sf_dir), P.arch_members(spark, sf_dir), table)


@query("SELECT src, count(*) AS added FROM ne WHERE src <> dst GROUP BY 1 HAVING count(*) > 1", *_E, "ne")
def new_dependencies(spark, sf_dir):
    files = P.arch_members(spark, sf_dir).select("path")
    return structure.new_dependencies(*P.strong_edges(spark, sf_dir), files, 1)


_A = (*_E, "ch", "gone", "af")


@query("SELECT path FROM af", *_A)
def affected(spark, sf_dir):
    return structure.affected(changes(spark), *P.strong_edges(spark, sf_dir))


@query("SELECT path FROM (SELECT dst AS path FROM ea WHERE src IN (FROM af) UNION SELECT src FROM ea WHERE dst IN (FROM af) UNION SELECT src FROM eb WHERE dst IN (FROM gone)) WHERE path NOT IN (FROM af) AND path NOT IN (FROM gone)", *_A)
def neighbourhood(spark, sf_dir):
    after, before = P.strong_edges(spark, sf_dir)
    return structure.neighbourhood(structure.affected(changes(spark), after, before), changes(spark), after, before)


_RING = "SELECT 'NATION_5' AS path UNION SELECT dst FROM ea WHERE src = 'NATION_5' UNION SELECT src FROM ea WHERE dst = 'NATION_5'"


@query(f"WITH r1 AS ({_RING}) SELECT path FROM r1 UNION SELECT dst FROM ea WHERE src IN (FROM r1) UNION SELECT src FROM ea WHERE dst IN (FROM r1)".replace("WITH r1", ", r1", 1), *_E)
def k_ring(spark, sf_dir):
    return structure.ring(spark.createDataFrame([("NATION_5",)], "path string"), P.strong_edges(spark, sf_dir)[0], 2)


@query(f"SELECT src, dst, refs FROM ea WHERE src IN ({_RING}) AND dst IN ({_RING})", *_E)
def narrow(spark, sf_dir):
    return structure.narrow(P.strong_edges(spark, sf_dir)[0], spark.createDataFrame([("NATION_5",)], "path string"))


@query("SELECT event_type AS name, props AS value, count(DISTINCT user_id) AS files FROM events WHERE props IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT user_id) > 15")
def duplicate_definition(spark, sf_dir):
    return structure.duplicate_definitions(P.definitions(spark, sf_dir), 15)


# --- graphs -----------------------------------------------------------------------------------------------


_LABEL = "lb AS (SELECT node, coalesce(component, node) AS component FROM (SELECT src AS node FROM cea UNION SELECT dst FROM cea UNION SELECT p_partkey FROM part) LEFT JOIN sca USING (node))"


@query(f", {_LABEL} SELECT DISTINCT a.component AS seed, b.component AS node FROM rea JOIN lb a ON a.node = seed JOIN lb b ON b.node = rea.node UNION SELECT component, component FROM lb", "cea", "rea", "sca", recursive=True)
def reach(spark, sf_dir):
    """Which groups of parts that call each other reach which; parts on no cycle are groups of one."""
    return graph.reach_components(P.call_nodes(spark, sf_dir), graph.stored(P.call_edges(spark, sf_dir), "calls"))


@query(
    """, cn AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS complexity FROM part)
       SELECT seed AS node, count(*) AS reached, coalesce(sum(complexity), 0) AS complexity, count(*) - count(complexity) AS unmeasured
       FROM (SELECT seed, node FROM rea WHERE seed IN (SELECT node FROM cn) UNION SELECT node, node FROM cn) LEFT JOIN cn USING (node) GROUP BY 1""",
    "cea", "rea", recursive=True,
)
def reachable_complexity(spark, sf_dir):
    return graph.whole_reachable_complexity(P.call_nodes(spark, sf_dir), graph.stored(P.call_edges(spark, sf_dir), "calls"))


@query("SELECT node, component FROM sca", "cea", "rea", "sca", recursive=True)
def scc(spark, sf_dir):
    return graph.strong_components(P.call_edges(spark, sf_dir))


@query("SELECT component, count(*) AS members, count(p_partkey) AS judged FROM sca LEFT JOIN part ON p_partkey = node GROUP BY 1 HAVING count(p_partkey) > 0", "cea", "rea", "sca", recursive=True)
def call_cycle(spark, sf_dir):
    edges = P.call_edges(spark, sf_dir)
    return graph.call_cycles(edges, P.call_nodes(spark, sf_dir), graph.strong_components(edges))


@query("SELECT src, dst, refs, a.component FROM cea JOIN sca a ON a.node = src JOIN sca b ON b.node = dst WHERE a.component = b.component", "cea", "rea", "sca", recursive=True)
def closing_edges(spark, sf_dir):
    edges = graph.stored(P.call_edges(spark, sf_dir), "calls")
    return graph.closing_edges(edges, graph.strong_components(edges))


_CYCLES = """ra_ AS (SELECT src AS seed, src AS node FROM ea UNION SELECT r.seed, e.dst FROM ra_ r JOIN ea e ON e.src = r.node),
    rb_ AS (SELECT src AS seed, src AS node FROM eb UNION SELECT r.seed, e.dst FROM rb_ r JOIN eb e ON e.src = r.node),
    ca_ AS (SELECT x.seed AS node, min(x.node) AS component FROM ra_ x JOIN ra_ y ON x.seed = y.node AND x.node = y.seed GROUP BY 1 HAVING count(*) > 1),
    cb_ AS (SELECT x.seed AS node, min(x.node) AS component FROM rb_ x JOIN rb_ y ON x.seed = y.node AND x.node = y.seed GROUP BY 1 HAVING count(*) > 1)"""


@query(f", {_CYCLES} SELECT a.component, count(*) AS members FROM ca_ a LEFT JOIN cb_ b USING (node) GROUP BY 1 HAVING NOT (count(b.component) = count(*) AND count(DISTINCT b.component) = 1)", *_E, recursive=True)
def file_cycle(spark, sf_dir):
    return graph.new_cycles(*P.strong_edges(spark, sf_dir))


_IMPACT = """SELECT start, node, CAST(min(d) AS INTEGER) AS depth FROM (SELECT *, 1 AS d FROM i1 UNION ALL SELECT *, 2 FROM i2) GROUP BY 1, 2"""


@query(
    f""", i1 AS (SELECT DISTINCT dst AS start, src AS node FROM cea JOIN part ON p_partkey = dst WHERE src <> dst),
       i2 AS (SELECT DISTINCT start, src AS node FROM i1 JOIN cea ON cea.dst = i1.node WHERE cea.src <> start AND cea.src <> cea.dst) {_IMPACT}""",
    "cea",
)
def impact(spark, sf_dir):
    """Who refers to any part, over at most two steps; every part is a start."""
    return graph.impact(P.call_nodes(spark, sf_dir), P.call_edges(spark, sf_dir), 2)


# --- text -------------------------------------------------------------------------------------------------


@query("SELECT path, line, idx, hash FROM ln", "ln")
def token_index(spark, sf_dir):
    return text.code_lines(P.documents_as_files(spark, sf_dir)).select("path", F.col("line").cast("bigint").alias("line"), F.col("idx").cast("bigint").alias("idx"), "hash")


@query("SELECT path, idx, line, last_line, key, places FROM rw", "ln", "w3", "rw")
def self_join_windows(spark, sf_dir):
    w = text.repeated_windows(text.code_lines(P.documents_as_files(spark, sf_dir)), 3)
    return w.select("path", F.col("idx").cast("bigint").alias("idx"), F.col("line").cast("bigint").alias("line"), F.col("last_line").cast("bigint").alias("last_line"), "key", "places")


@query(
    """, rn AS (SELECT *, idx - row_number() OVER (PARTITION BY path ORDER BY idx) AS island FROM rw),
       bl AS (SELECT path, island, min(line) AS start, max(last_line) AS stop, max(idx) - min(idx) + 3 AS code_lines FROM rn GROUP BY 1, 2)
       SELECT rn.path, start, stop, code_lines, count(DISTINCT (o.path, o.line)) AS elsewhere FROM rn JOIN bl USING (path, island) JOIN rw o ON o.key = rn.key
       WHERE o.path <> rn.path OR o.line < start OR o.line > stop GROUP BY 1, 2, 3, 4""",
    "ln", "w3", "rw",
)
def duplicate_block(spark, sf_dir):
    b = text.duplicate_blocks(text.code_lines(P.documents_as_files(spark, sf_dir)), 3)
    return b.select("path", *[F.col(c).cast("bigint").alias(c) for c in ("start", "stop", "code_lines")], "elsewhere")


def _lines(spark, sf_dir):
    """Every line of the documents as a routine of its own: token, path, start, stop and the shape of its words."""
    lines = P.documents_as_files(spark, sf_dir).select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    tokens = similar.shapes(lines.select(F.struct("path", "at").alias("place"), "line"), "place", "line")
    at = F.col("token.at") + 1
    return tokens.select(F.concat_ws(":", "token.path", at).alias("token"), F.col("token.path").alias("path"), at.alias("start"), at.alias("stop"), "shape")


def _line_classes(spark, sf_dir):
    return similar.shape_classes(_lines(spark, sf_dir))


@query(
    r""", tk AS (SELECT regexp_extract_all(lower(line), '\w+|[^\w \t\n\x0B\f\r]') AS shape, path || ':' || i AS token FROM li),
        cs AS (SELECT row_number() OVER (ORDER BY min(token)) AS id, min(token) AS cls, len(shape) AS n, shape FROM tk WHERE len(shape) >= 6 GROUP BY shape),
        nt AS (SELECT id, n, t || chr(1) || row_number() OVER (PARTITION BY id, t) AS t FROM (SELECT id, n, unnest(shape) AS t FROM cs)),
        rk AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS r FROM nt JOIN (SELECT t, count(*) AS df FROM nt GROUP BY t) USING (t)),
        pf AS (SELECT id, n, t FROM rk WHERE r <= n - ceil(round(n * 0.9 / 1.1, 9)) + 1),
        cd AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pf a JOIN pf b ON a.t = b.t AND a.id < b.id AND 2 * least(a.n, b.n) >= 0.9 * (a.n + b.n)),
        bg AS (SELECT id, list(t) AS ts FROM nt GROUP BY id)
        SELECT x.cls AS a, y.cls AS b, CAST(overlap AS INTEGER) AS overlap FROM (SELECT a, b, len(list_intersect(p.ts, q.ts)) AS overlap FROM cd JOIN bg p ON p.id = a JOIN bg q ON q.id = b) c
        JOIN cs x ON x.id = c.a JOIN cs y ON y.id = c.b WHERE 2 * overlap >= 0.9 * (x.n + y.n)""",
    "li",
)
def self_join_similarity(spark, sf_dir):
    return similar.comparable_classes(_line_classes(spark, sf_dir))


@query()
def pair_score(spark, sf_dir):
    return similar.class_links(_line_classes(spark, sf_dir))


@query()
def similar_routine(spark, sf_dir):
    return similar.similar_families(_lines(spark, sf_dir), None)


# --- dead code and layers ---------------------------------------------------------------------------------


@query(
    """SELECT language, ok >= 0.75 AND ok IS NOT NULL AS trusted, CASE WHEN ok IS NULL OR ok < 0.75 THEN 'resolution of ' || language END AS reason
       FROM (SELECT lang AS language, count(*) FILTER (quality = 1) / nullif(count(quality), 0) AS ok FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)"""
)
def trust_gate(spark, sf_dir):
    docs = P.read(spark, sf_dir, "documents").join(P.read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("language", F.col("lang"))
    bucket = F.when(F.col("quality") == 1, "resolved").when(F.col("quality") == 0, "unresolved").otherwise("external")
    return dead.trust(dead.resolution_counts(docs, bucket), 0.9)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND NOT regexp_matches(source, '^src0$')")
def unused_routine(spark, sf_dir):
    known = P.read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("referenced", F.lit(True))
    facts = P.read(spark, sf_dir, "documents").join(known, "doc_id", "left").select("doc_id", F.col("source").alias("longname"), F.coalesce("referenced", F.lit(False)).alias("referenced"))
    return dead.unreferenced(facts, ["^src0$"]).select("doc_id")


_CF = """, ci AS (SELECT dst AS key, count(DISTINCT src) AS callers FROM cea WHERE src <> dst GROUP BY 1), co AS (SELECT src AS key, count(DISTINCT dst) AS callees, min(dst) AS one FROM cea WHERE src <> dst GROUP BY 1),
    cf AS (SELECT key, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, CASE WHEN callees = 1 THEN one END AS forwards_to FROM ci FULL JOIN co USING (key)) """


@query(_CF + "SELECT * FROM cf", "cea")
def caller_callee_counts(spark, sf_dir):
    return dead.call_facts(P.call_edges(spark, sf_dir))


@query(_CF + "SELECT key, forwards_to FROM cf WHERE callers = 1 AND callees = 1", "cea")
def pass_through(spark, sf_dir):
    facts = dead.call_facts(P.call_edges(spark, sf_dir)).select("*", F.col("key").cast("string").alias("longname"), F.lit(False).alias("overrides"), F.lit(1).alias("statements"))
    return dead.pass_through(facts).select("key", "forwards_to")


@query("SELECT p_brand AS name, count(DISTINCT p_type) AS classes FROM part GROUP BY 1")
def method_declarations(spark, sf_dir):
    return dead.method_declarations(P.read(spark, sf_dir, "part").select(F.col("p_type").alias("class"), F.col("p_brand").alias("method")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal FROM lineitem")
def win_ordinal(spark, sf_dir):
    rows = P.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("line"), F.col("l_suppkey").alias("kind"), F.col("l_extendedprice").alias("name"))
    out = dead.ordinals(rows, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.col("line").alias("l_partkey"), F.col("kind").alias("l_suppkey"), F.col("ordinal").cast("bigint").alias("ordinal"))
