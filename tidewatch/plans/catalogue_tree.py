"""Queries over trees of paths and over source files, next to their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import arch, modules
from tidewatch.operators.graph import stored
from tidewatch.plans.catalogue import VIEWS, query
from tidewatch.sources import project as P

#: A page's host turned round is its folder: http://blog.x.example.net/en/5 lies in net/example/x/blog/en.
VIEWS["pg"] = """pg AS (SELECT page_id, html, array_to_string(list_reverse(string_split(regexp_extract(u, '^[^/]*'), '.')), '/') || regexp_extract(u, '^[^/]*(.*)$', 1) AS path, query
    FROM (SELECT page_id, html, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS u, contains(url, '?') AS query FROM pages WHERE url IS NOT NULL))"""
VIEWS["mb"] = """mb AS (SELECT DISTINCT path, CASE WHEN query THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) ELSE dir END AS own FROM (SELECT path, query, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM pg))"""
VIEWS["pn"] = """pn AS (SELECT DISTINCT array_to_string(string_split(own, '/')[1:i], '/') AS node FROM (SELECT DISTINCT own, unnest(range(1, len(string_split(own, '/')))) AS i FROM mb))"""
VIEWS["ct"] = """ct AS (SELECT path, node, max(node) OVER (PARTITION BY path) AS any_node FROM (SELECT DISTINCT path, CASE WHEN len(string_split(own, '/')) >= 5 THEN array_to_string(string_split(own, '/')[1:5], '/') WHEN own NOT IN (SELECT node FROM pn) THEN own END AS node FROM mb))"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html, path, query (whether the address has one)."""
    pages = P.read(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", "html", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("u"), F.contains("url", F.lit("?")).alias("query"))
    folders = F.array_join(F.reverse(F.split(F.regexp_extract("u", "^[^/]*", 0), r"\.")), "/")
    return pages.select("page_id", "html", F.concat(folders, F.regexp_extract("u", "^[^/]*(.*)$", 1)).alias("path"), "query")


def page_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, path: a page lies in its folder, one that was asked for with a query in the folder above."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return page_paths(spark, sf_dir).select(F.when(F.col("query"), F.regexp_extract(folder, "^(.*)/[^/]*$", 1)).otherwise(folder).alias("node"), "path")


@query("SELECT path, coalesce(node, 'root') AS node FROM ct WHERE node IS NOT NULL OR any_node IS NULL", "pg", "mb", "pn", "ct")
def scan_architecture(spark, sf_dir):
    """Pages at the nodes five levels deep, or at shallower leaves, or at the root."""
    return arch.cut_members(page_members(spark, sf_dir), 5, "root")


@query("SELECT path, array_to_string(list_sort(list(coalesce(node, 'root'))), ' ') AS nodes FROM ct WHERE node IS NOT NULL OR any_node IS NULL GROUP BY path", "pg", "mb", "pn", "ct")
def join_arch_all(spark, sf_dir):
    return arch.nodes_of(arch.cut_members(page_members(spark, sf_dir), 5, "root")).select("path", F.array_join("nodes", " ").alias("nodes"))


@query("SELECT path, coalesce(arg_max(node, length(node)), 'root') AS node FROM (SELECT DISTINCT path FROM pg) LEFT JOIN (SELECT DISTINCT own AS node FROM mb WHERE own LIKE '%/www%' OR own LIKE '%/blog%') ON path LIKE node || '/%' GROUP BY path", "pg", "mb")
def deepest_cover(spark, sf_dir):
    """The deepest folder of a blog or a www host that a page lies below."""
    nodes = page_members(spark, sf_dir).where("node LIKE '%/www%' OR node LIKE '%/blog%'")
    return arch.deepest_cover(page_paths(spark, sf_dir), nodes, "root")


_ROLE = "CASE regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) WHEN 'fr' THEN 'generated' WHEN 'de' THEN 'vendored' WHEN 'es' THEN 'tests' END"
_REGIONS = f""", fl AS (SELECT path, min(role) AS role FROM (SELECT path, coalesce({_ROLE}, 'none') AS role FROM pg) GROUP BY path),
    tr AS (SELECT path AS dir, path, nullif(role, 'none') AS role FROM fl UNION ALL SELECT CASE WHEN contains(dir, '/') THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) ELSE '' END, path, role FROM tr WHERE dir <> ''),
    un AS (SELECT dir, min(role) AS role, count(*) AS files, min(path) AS first, bool_or(dir = path) AS leaf FROM tr GROUP BY dir HAVING count(role) = count(*) AND min(role) = max(role)),
    rg AS (SELECT dir, role, files, first || ': lang' AS evidence, CASE WHEN leaf THEN dir WHEN dir = '' THEN '**' ELSE dir || '/**' END AS pattern FROM un
           WHERE dir = '' OR (CASE WHEN contains(dir, '/') THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) ELSE '' END) NOT IN (SELECT dir FROM un))"""


def _page_regions(spark, sf_dir):
    lang = F.regexp_extract("html", '<html lang="([a-z]*)"', 1)
    role = F.when(lang == "fr", "generated").when(lang == "de", "vendored").when(lang == "es", "tests")
    files = page_paths(spark, sf_dir).groupBy("path").agg(F.min(F.coalesce(role, F.lit("none"))).alias("role"))
    return arch.uniform_regions(files.select("path", F.nullif("role", F.lit("none")).alias("role"), F.lit("lang").alias("evidence")))


@query(_REGIONS + " SELECT * FROM rg", "pg", recursive=True)
def detect_regions(spark, sf_dir):
    """The largest folders of pages that are in one language only, which stands for a role."""
    return _page_regions(spark, sf_dir)


@query(_REGIONS + """ SELECT CASE WHEN role = 'tests' THEN 'scope' ELSE 'exclude' END AS line, pattern, evidence || ' (' || files || ' files)' AS evidence, CASE role WHEN 'generated' THEN 2 WHEN 'vendored' THEN 3 ELSE 4 END AS rank FROM rg""", "pg", recursive=True)
def propose_config(spark, sf_dir):
    found = stored(_page_regions(spark, sf_dir), "regions")
    return arch.proposal(arch.covered(found, page_paths(spark, sf_dir)))


# --- source files: every supplier is a module that imports the parts it delivers ------------------------------------


def supplier_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: a line item that was returned is imported inside a function, an accepted one for the type checker, others at once; each supplier binds its part count."""
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    what = F.concat(F.lit("import part"), F.col("l_partkey").cast("string"))
    block = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("def f():\n    "), what)).when(F.col("l_returnflag") == "A", F.concat(F.lit("if TYPE_CHECKING:\n    "), what)).otherwise(what)
    lines = P.read(spark, sf_dir, "lineitem").select("l_suppkey", F.struct(*order, block.alias("block")).alias("x")).groupBy("l_suppkey").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.count("*").alias("n"))
    text = F.concat(F.lit("from typing import TYPE_CHECKING\nLINES = ("), F.col("n").cast("string"), F.lit(",  # so many\n)\n"), F.array_join(F.transform("xs", lambda x: x["block"]), "\n"), F.lit("\n"))
    return lines.select(F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("path"), text.alias("text"))


@query("""SELECT 'supplier' || l_suppkey AS src, 'p/' || l_partkey AS dst, count(*) AS refs, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS import_time FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def import_edges(spark, sf_dir):
    """Imports of parts by suppliers, and how many of them run at once."""
    known = P.read(spark, sf_dir, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("target"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"))
    return modules.import_edges(modules.outlines(supplier_modules(spark, sf_dir)), known)


@query("SELECT 'LINES' AS name, 'supplier' || l_suppkey AS path, 2 AS line, '( ' || count(*) || ' , )' AS value FROM lineitem GROUP BY l_suppkey")
def definitions_scan(spark, sf_dir):
    return modules.definitions(modules.outlines(supplier_modules(spark, sf_dir)))


@query("""SELECT path, sum(n) AS lines FROM (SELECT 'supplier' || l_suppkey AS path, count(*) FILTER (l_returnflag IN ('R', 'A')) AS n FROM lineitem GROUP BY l_suppkey) WHERE n > 0 GROUP BY path""")
def deferred_lines(spark, sf_dir):
    return modules.deferred_lines(modules.outlines(supplier_modules(spark, sf_dir))).groupBy("path").agg(F.count("*").alias("lines"))
