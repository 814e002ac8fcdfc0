"""Queries of the whole check, next to their SQL: every family is written out once more there, and united."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import graph
from tidewatch.plans import check as plan
from tidewatch.plans.catalogue import changes, limits, query
from tidewatch.sources import project as P
from tidewatch.sources import wire
from tidewatch.streaming import state

_BASE = ("m", "na", "nb", "fe", "se", "ea", "eb", "ne", "am", "ch", "gone", "af")
_SQL = """, lm AS (SELECT scope, metric, CASE WHEN metric = 'CountOrders' THEN 7.0 ELSE most END AS most, least, severity, ratchet FROM (VALUES ('routine', 'CountOrders', 8.0, NULL, 'error', true), ('routine', 'MaxPrice', 400000.0, NULL, 'warning', false), ('routine', 'CountOpen', NULL, 1.0, 'error', true)) t(scope, metric, most, least, severity, ratchet)),
    un AS (SELECT 'NATION_' || user_id % 40 AS path, event_id AS line, props AS message, side FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'after' ELSE 'before' END AS side FROM events WHERE event_type = 'error')),
    low AS (SELECT side, path, longname FROM m WHERE metric = 'CountOrders' AND value < 2),
    fl AS (SELECT * FROM m WHERE NOT (metric = 'MaxPrice' AND EXISTS (SELECT 1 FROM low WHERE low.side = m.side AND low.path = m.path AND low.longname = m.longname))),
    fa AS (SELECT * FROM fl WHERE side = 'after' AND path IN (FROM af)),
    fb AS (SELECT * FROM fl WHERE side = 'before' AND path NOT IN (SELECT path FROM un WHERE side = 'before')),
    ov AS (SELECT fa.*, CASE WHEN metric = 'CountOrders' AND path LIKE 'NATION!_1%' ESCAPE '!' THEN 20.0 WHEN metric = 'MaxNesting' THEN 3.0 ELSE most END AS most, least, CASE WHEN metric = 'MaxNesting' THEN 'warning' ELSE severity END AS severity
           FROM fa LEFT JOIN lm USING (scope, metric) WHERE (metric IN ('CountOrders', 'MaxPrice', 'CountOpen') AND NOT (metric = 'CountOrders' AND path LIKE '%!_3' ESCAPE '!')) OR (metric = 'MaxNesting' AND path LIKE '%!_3' ESCAPE '!')),
    tt AS (SELECT 'threshold' AS kind, ov.metric, ov.path, ov.longname, ov.value, b.value AS before, CASE WHEN ov.value > most THEN most ELSE least END AS lim, severity FROM ov LEFT JOIN fb b USING (scope, path, longname, metric) WHERE ov.value > most OR ov.value < least),
    rr AS (SELECT 'ratchet' AS kind, a.metric, a.path, a.longname, a.value, b.value AS before, CASE WHEN most IS NOT NULL AND a.value > b.value THEN most ELSE least END AS lim, severity FROM fa a JOIN fb b USING (scope, path, longname, metric) JOIN lm USING (scope, metric)
           WHERE ratchet AND ((most IS NOT NULL AND a.value > b.value) OR (least IS NOT NULL AND a.value < b.value))),
    ms AS (SELECT *, kind = 'ratchet' AND (CASE WHEN value > before THEN value <= lim ELSE value >= lim END) AS inside,
                  kind = 'threshold' AND (path IN (SELECT path FROM un WHERE side = 'before') OR coalesce(CASE WHEN value >= lim THEN before > lim AND value <= before ELSE before < lim AND value >= before END, false)) AS pre FROM (FROM tt UNION ALL FROM rr)),
    mf AS (SELECT kind, 'routine.' || metric AS rule, path, longname, value, before, lim, CASE WHEN inside THEN 'warning' WHEN metric = 'MaxPrice' THEN 'error' ELSE severity END AS severity, CAST(NULL AS VARCHAR) AS detail, pre FROM ms),
    fn AS (SELECT side, node, count(DISTINCT d) AS o FROM (SELECT side, src AS node, dst AS d FROM se WHERE src <> dst) GROUP BY 1, 2),
    fi AS (SELECT side, node, count(DISTINCT s) AS i FROM (SELECT side, dst AS node, src AS s FROM se WHERE src <> dst) GROUP BY 1, 2),
    nh AS (SELECT path FROM af UNION SELECT path FROM (SELECT dst AS path FROM ea WHERE src IN (FROM af) UNION SELECT src FROM ea WHERE dst IN (FROM af) UNION SELECT src FROM eb WHERE dst IN (FROM gone)) WHERE path NOT IN (FROM gone)),
    ft AS (SELECT n.path AS node, coalesce(a.o, 0) AS o, coalesce(b.o, CASE WHEN bi.i IS NOT NULL THEN 0 END) AS ob FROM nh n LEFT JOIN fn a ON a.node = n.path AND a.side = 'after' LEFT JOIN fi ai ON ai.node = n.path AND ai.side = 'after'
           LEFT JOIN fn b ON b.node = n.path AND b.side = 'before' LEFT JOIN fi bi ON bi.node = n.path AND bi.side = 'before' WHERE a.o IS NOT NULL OR ai.i IS NOT NULL),
    st AS (SELECT 'structural' AS kind, 'structure.fan_out' AS rule, node AS path, node AS longname, o AS value, ob AS before, 3 AS lim, 'error' AS severity, 'threshold' AS detail FROM ft WHERE o > 3
           UNION ALL SELECT 'structural', 'structure.fan_out', node, node, o, ob, 3, 'error', 'ratchet' FROM ft WHERE o > ob
           UNION ALL SELECT 'structural', 'structure.new_dependencies', src, src, count(*), NULL, 1, 'error', NULL FROM ne WHERE src <> dst AND src IN (FROM af) GROUP BY src HAVING count(*) > 1
           UNION ALL SELECT 'structural', 'structure.layer.core', src, src, NULL, NULL, NULL, 'error', a.node || ' -> ' || b.node || ' -> ' || dst FROM ne JOIN am a ON a.path = src JOIN am b ON b.path = dst WHERE a.node = 'ASIA' AND b.node NOT IN ('ASIA', 'EUROPE')
           UNION ALL SELECT 'structural', 'structure.coupling', a.node, a.node, sum(refs), NULL, 10, 'error', b.node FROM ea JOIN am a ON a.path = src JOIN am b ON b.path = dst WHERE a.node = 'ASIA' AND b.node = 'EUROPE' GROUP BY a.node, b.node HAVING sum(refs) > 10
           UNION ALL SELECT 'parse', 'analysis.parse_error', path, path, count(*), NULL, NULL, 'error', arg_min(message, line) FROM un WHERE side = 'after' AND path IN (FROM af) GROUP BY path
           UNION ALL SELECT 'analysis', 'analysis.accuracy', '', '', 0.9, NULL, 0.95, 'warning', 'after'
           UNION ALL SELECT 'codecheck', 'codecheck.purchase', path, path, CASE WHEN line > 0 THEN line END, NULL, NULL, 'error', message FROM (SELECT 'NATION_' || user_id % 40 AS path, event_id % 50 AS line, props AS message FROM events WHERE event_type = 'purchase') WHERE path IN (FROM af)
           UNION ALL SELECT 'population', 'routine.AVGCountOrders', '', '', avg(value), NULL, 5, 'warning', NULL FROM na WHERE metric = 'CountOrders' HAVING avg(value) > 5
           UNION ALL SELECT 'structural', 'structure.net_growth', '', '', d, NULL, -1e9, 'warning', NULL FROM (SELECT coalesce(sum(CASE WHEN metric = 'CountOrders' THEN round(value) * CASE side WHEN 'after' THEN 1 ELSE -1 END END), 0) AS d FROM m WHERE path IN (FROM af)))
    SELECT kind, rule, path, longname, CAST(value AS DOUBLE) AS value, CAST(before AS DOUBLE) AS before, CAST(lim AS DOUBLE) AS "limit", severity, detail, pre AS preexisting, severity = 'error' AND NOT pre AND NOT (kind = 'parse' AND path LIKE 'NATION!_1%' ESCAPE '!') AS blocking,
           CASE WHEN rule = 'routine.CountOrders' THEN 'split the customer' WHEN rule = 'structure.fan_out' THEN 'depend on less' ELSE 'see the guide' END AS hint
    FROM (SELECT kind, rule, path, longname, value, before, lim, severity, detail, pre FROM mf UNION ALL SELECT kind, rule, path, longname, value, before, lim, severity, detail, false FROM st)"""


def _inputs(spark, sf_dir):
    """Both sides of the order tables, with errors of users as files that could not be read, and purchases as another checker's rows."""
    events = P.read(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("NATION_"), (F.col("user_id") % 40).cast("string")))
    bad = events.where("event_type = 'error'").select("path", F.col("event_id").alias("line"), F.col("props").alias("message"), (F.col("event_id") % 2 == 0).alias("late"))
    # stored, since nearly every rule reads them
    measures, edges = ([graph.stored(df, "check-side") for df in pair] for pair in (P.sides(spark, sf_dir), P.strong_edges(spark, sf_dir)))
    members = P.arch_members(spark, sf_dir)
    sides = [plan.Side(measures[i], edges[i], bad.where("late" if i == 0 else "NOT late").drop("late"), members, accuracy=0.9 if i == 0 else None) for i in (0, 1)]
    violations = events.where("event_type = 'purchase'").select(F.col("event_type").alias("check_id"), "path", (F.col("event_id") % 50).alias("line"), F.col("props").alias("message"))
    return sides, violations


@query(_SQL, *_BASE)
def check(spark, sf_dir):
    """A run with a baseline, scopes, a floor, acknowledged paths, set severities and hints, over limits, ratchet, fans, dependencies, layers, couplings, parse errors, accuracy, another checker, populations and growth."""
    (after, before), violations = _inputs(spark, sf_dir)
    scopes = [
        {"pattern": "NATION_1*", "rules": [{"scope": "routine", "metric": "CountOrders", "most": 20.0}]},
        {"pattern": "*_3", "rules": [{"scope": "routine", "metric": "CountOrders", "disabled": True}, {"scope": "routine", "metric": "MaxNesting", "most": 3.0, "severity": "warning"}]},
    ]
    held = plan.Limits(
        limits(spark), scopes, {"MaxPrice": ("CountOrders", 2)}, spark.createDataFrame([("routine.CountOrders", 7.0), ("routine.MaxPrice", 9e9)], "rule string, value double"),
        spark.createDataFrame([("routine", "CountOrders", "AVG", 5.0, None, "warning")], "scope string, metric string, prefix string, most double, least double, severity string"),
        spark.createDataFrame([("routine.MaxPrice", "error")], "rule string, severity string"), spark.createDataFrame([("routine.CountOrders", "split the customer"), ("structure.fan_out", "depend on less"), ("*", "see the guide")], "key string, hint string"),
        ["NATION_1*"], fan_out=3, new_dependencies=1, layers=spark.createDataFrame([("core", "ASIA", ["EUROPE"])], "layer string, node string, may array<string>"), couplings=spark.createDataFrame([("ASIA", "EUROPE", 10)], "src string, dst string, most bigint"),
        net_growth=("CountOrders", -1e9), accuracy=0.95,
    )
    found = plan.check(after, before, changes(spark), held, violations)
    return found.select("kind", "rule", "path", "longname", "value", "before", "limit", "severity", "detail", "preexisting", "blocking", "hint")


# --- commits as a stream ------------------------------------------------------------------------------------------

_COMMITS = """SELECT user_id, epoch_us(date_trunc('day', ts)) // 86400000000 AS commit, CASE WHEN max(event_type) FILTER (event_id = top) <> 'error' THEN CAST(count(*) AS VARCHAR) END AS digest, count(*) FILTER (event_type = 'error') AS errors, max(value) AS value
    FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS top FROM events) GROUP BY 1, 2"""


#: A turn costs a start and a call for each file that changed in it.
TURNS = 2


def _commits(spark, sf_dir):
    """path, commit, digest, errors, value: a user's day is a commit of a file; one that ends in an error removes it."""
    events = P.read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.unix_date(F.to_date("ts")).cast("bigint").alias("commit"), "event_id", "event_type", "value")
    last = F.max_by("event_type", "event_id")
    return events.groupBy("path", "commit").agg(F.when(last != "error", F.count("*").cast("string")).alias("digest"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("value"))


@query(f"""SELECT path, commit, change, errors_before, errors, value_before, value FROM (SELECT 'u' || user_id AS path, commit, errors, value, lag(errors) OVER w AS errors_before, lag(value) OVER w AS value_before,
              CASE WHEN lag(digest) OVER w IS NULL AND digest IS NOT NULL THEN 'added' WHEN digest IS NULL AND lag(digest) OVER w IS NOT NULL THEN 'deleted' WHEN digest <> lag(digest) OVER w THEN 'modified' END AS change
       FROM ({_COMMITS}) WINDOW w AS (PARTITION BY user_id ORDER BY commit)) WHERE change IS NOT NULL""")
def commit_deltas(spark, sf_dir):
    """The deltas of all commits, by a stream of TURNS turns whose state is the last commit of each file."""
    top = graph.shared_top(spark)
    at = f"{top.rstrip('/')}/commits-{uuid.uuid4().hex}"
    changes = graph.stored(_commits(spark, sf_dir), "commits")
    days = changes.agg(F.min("commit").alias("a"), F.max("commit").alias("b")).first()
    if days["a"] is None:
        return state.commit_deltas_of(changes)
    span = -(-(days["b"] + 1 - days["a"]) // TURNS)
    for day in range(days["a"], days["b"] + 1, span):
        changes.where(F.col("commit").between(day, day + span - 1)).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(changes.schema).parquet(f"{at}/in")
        run = state.commit_deltas(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
        run.awaitTermination()  # each turn starts anew from the checkpoint
    return spark.read.schema(state.DELTA).parquet(f"{at}/out")


# --- snapshot documents, read strictly -----------------------------------------------------------------------------


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
    k AS (SELECT o_custkey, o_orderstatus, o_orderpriority, min(pos) AS pos, count(*) AS n FROM o GROUP BY 1, 2, 3 HAVING count(*) > 1)
    SELECT 'c' || o_custkey AS doc, '$.entities[' || pos || '].note' AS at, 'unknown field' AS issue FROM o WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'c' || o_custkey, '$.entities[' || pos || '].ref.line', 'wrong type' FROM o WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'c' || o_custkey, '$.entities[' || first || '].ref.key', 'duplicate key' FROM (SELECT o_custkey, o_orderstatus, o_orderpriority, arg_min(pos, '$.entities[' || pos || ']') AS first FROM o GROUP BY 1, 2, 3 HAVING count(*) > 1)""")
def scan_wire(spark, sf_dir):
    """What is wrong with one document for each customer, whose entities are orders: open ones have a field too many, urgent ones a line that is text, and equal keys stand twice."""
    key = F.to_json(F.struct(F.lit("routine").alias("scope"), F.col("o_orderstatus").alias("path"), F.col("o_orderpriority").alias("longname")))
    line = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit('"7"')).otherwise(F.lit("7"))
    note = F.when(F.col("o_orderstatus") == "P", F.lit(',"note":1')).otherwise(F.lit(""))
    text = F.concat(F.lit('{"ref":{"key":'), key, F.lit(',"line":'), line, F.lit('},"metrics":{"CountStmt":'), F.col("o_totalprice").cast("string"), F.lit("}"), note, F.lit("}"))
    one = P.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", text.alias("e")).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "e"))).alias("es"))
    documents = one.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc"), F.concat(F.lit('{"entities":['), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]}")).alias("text"))
    return wire.issues(documents).select("doc", "at", "issue")
