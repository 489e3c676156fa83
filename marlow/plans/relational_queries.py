"""Relational and graph queries over the synthetic tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, relational as rel


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.lit("part").alias("type"), F.col("p_size").cast("long").alias("year"), F.lit(0).cast("long").alias("refs"), F.lit(0).cast("long").alias("base_score"))
    customer = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.lit("customer").alias("type"), F.lit(None).cast("long").alias("year"), F.lit(0).cast("long").alias("refs"), F.lit(1).cast("long").alias("base_score"))
    supplier = t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("type"), *[F.lit(10000).cast("long").alias(c) for c in ("year", "refs", "base_score")])
    return rel.titles(part, customer, supplier)


NAMES = """(
  SELECT p_name AS name, p_partkey AS id, 'part' AS type, CAST(p_size AS BIGINT) AS year, CAST(0 AS BIGINT) AS refs, CAST(0 AS BIGINT) AS base_score FROM part
  UNION SELECT c_name, c_custkey, 'customer', NULL, 0, 1 FROM customer
  UNION SELECT s_name, s_suppkey, 'supplier', 10000, 10000, 10000 FROM supplier)"""


def autocomplete_titles(spark: SparkSession, d: str) -> DataFrame:
    return rel.autocomplete(_names(spark, d), "Ar")


def titles_view(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d)


def exact_title(spark: SparkSession, d: str) -> DataFrame:
    return rel.exact_title(_names(spark, d), "Customer#000000007")


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return rel.latest_versions(t(spark, d, "documents"), "source", "doc_id").select("source", "doc_id", "n_chars")


def latest_version_flag(spark: SparkSession, d: str) -> DataFrame:
    return rel.latest_flag(t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


def latest_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return rel.latest_versions(t(spark, d, "part").select("p_brand", "p_size", "p_partkey"), "p_brand", "p_size")


def versions_of(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return rel.versions_of(docs, docs.filter("doc_id = 7").select("doc_id"), "source", "doc_id").orderBy(F.desc_nulls_first("doc_id"))


def siblings_not_updated(spark: SparkSession, d: str) -> DataFrame:
    docs, done = t(spark, d, "documents").select("doc_id", "source"), t(spark, d, "labels").select("doc_id")
    return rel.siblings_not_in(docs, done, "source", "doc_id")


def unfetched(spark: SparkSession, d: str) -> DataFrame:
    return rel.missing(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


def links_without_document(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").join(t(spark, d, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def _ref_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("link"), F.col("o_custkey").alias("source"))
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("link"), F.col("l_partkey").alias("target"))
    return rel.reference_counts(orders, lines, "link", "source", "target")


REFS = "(SELECT o_custkey AS source, l_partkey AS target, count(*) AS n_links FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    return _ref_counts(spark, d)


def refs_scores(spark: SparkSession, d: str) -> DataFrame:
    live = t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("source"))
    refs = rel.in_degrees(_ref_counts(spark, d), live, "source", "target").withColumnRenamed("target", "id")
    items = t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    deep = items.filter("p_size > 25").select("id", F.col("p_size").alias("depth"))
    enacted = items.filter("p_size = 50").select("p_brand")
    return rel.scores(items, refs, deep, enacted, "id", "p_brand", F.col("p_size") < 10)


def in_links(spark: SparkSession, d: str) -> DataFrame:
    live = t(spark, d, "customer").select(F.col("c_custkey").alias("source"), "c_name")
    return rel.in_links(_ref_counts(spark, d), live, "source", "target", 42).select("source", "c_name", "n_links")


def section_in_links(spark: SparkSession, d: str) -> DataFrame:
    links = t(spark, d, "part").select(F.col("p_partkey").alias("link_id"), F.col("p_type").alias("path"))
    return rel.section_in_links(links, [1, 2, 3], "PROMO", "link_id", "path")


def bill_enacted_flag(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").filter("o_totalprice > 200000").select("o_custkey").distinct().withColumn("big", F.lit(True))
    return t(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("big").isNotNull().alias("enacted"))


def amending_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rel.counted(lines, "p_name", "p_partkey")


def document_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per nation: its region, customers and suppliers, and its richest customer."""
    customers = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"), F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("richest"))
    suppliers = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers"))
    nations = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    zero = F.lit(0).cast("long")
    return out.select("n_name", "r_name", F.coalesce("n_customers", zero).alias("n_customers"), F.coalesce("n_suppliers", zero).alias("n_suppliers"), "richest")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("child"), F.expr("nullif(p_partkey div 2, 0)").alias("parent"))


TREE = "(SELECT p_partkey AS child, nullif(p_partkey // 2, 0) AS parent FROM part)"


def hierarchy_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.depths(_tree(spark, d))


def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk_up(_tree(spark, d), t(spark, d, "part").select(F.col("p_partkey").alias("start")))


def child_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.child_counts(_tree(spark, d))


def descendant_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure_counts(_tree(spark, d))


def conversation_chain(spark: SparkSession, d: str) -> DataFrame:
    """For each turn, how many turns of its conversation lead up to it without a gap."""
    turns = t(spark, d, "conversations").select("conv_id", "turn").distinct()
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat_ws("-", "conv_id", "turn").alias("parent"))
    edges = turns.join(before, ["conv_id", "turn"], "left").select(F.concat_ws("-", "conv_id", "turn").alias("child"), "parent")
    return graph.depths(edges).select(F.col("node").alias("start"), F.col("depth").cast("long").alias("n_before"))


def _ring(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("child"), F.expr("cast((n_nationkey * 2) % 25 as bigint)").alias("parent"), F.col("n_regionkey").cast("long").alias("year"))


RING = "(SELECT CAST(n_nationkey AS BIGINT) AS child, CAST((n_nationkey * 2) % 25 AS BIGINT) AS parent FROM nation)"


def cycle_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cyclic_edges(_ring(spark, d))


def acyclic_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.break_cycles(_ring(spark, d), "year").select("child", "parent", "year")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))


def connected(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_links(spark, d), 5)


def link_weights(spark: SparkSession, d: str) -> DataFrame:
    members = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return graph.link_weights(_links(spark, d), members)


def graph_scales(spark: SparkSession, d: str) -> DataFrame:
    counts = _ref_counts(spark, d).groupBy("target").agg(F.sum("n_links").alias("total"))
    return counts.agg(F.min("total").alias("low"), F.max("total").alias("high"))


def topn_per_user(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "events").select("user_id", "event_id", "ts")
    return rel.top_per_group(events, "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


def sessions_over_limit(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 10")


def sequence_validation(spark: SparkSession, d: str) -> DataFrame:
    turns = t(spark, d, "conversations").select("conv_id", "turn").distinct().filter("turn <> 1")
    return rel.sequence_breaks(turns, "conv_id", "turn", "turn").select("conv_id", "turn", "previous")


def definitions_page(spark: SparkSession, d: str) -> DataFrame:
    found = t(spark, d, "part").filter(F.col("p_name").ilike("p%")).select("p_partkey", "p_name")
    return rel.page(found, [F.length("p_name"), F.col("p_partkey")], 25)


def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    return rel.optional_filter(t(spark, d, "orders"), o_orderstatus="F", o_orderpriority=None).select("o_orderkey", "o_totalprice")


def replaced_rows(spark: SparkSession, d: str) -> DataFrame:
    old = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("state"))
    new = t(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id"), F.lit("new").alias("state")).distinct()
    return rel.replace_rows(old, new, "id")


def result_categories(spark: SparkSession, d: str) -> DataFrame:
    parts = t(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("place"), F.col("p_name").alias("name"))
    return rel.grouped_categories(parts, "kind", "place").select("kind", "first_place", F.concat_ws("|", "names").alias("names"))


def definition_html(spark: SparkSession, d: str) -> DataFrame:
    return rel.concat_by_priority(t(spark, d, "nation"), "n_regionkey", "n_nationkey", "n_name")


def json_results(spark: SparkSession, d: str) -> DataFrame:
    named = t(spark, d, "region").select(F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))).alias("json"))
    return named


def suggestion_response(spark: SparkSession, d: str) -> DataFrame:
    found = rel.autocomplete(_names(spark, d), "Supplier#00000000").select("name")
    return found.agg(F.lit("Supplier#00000000").alias("query"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_custkey").subtract(t(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey")).withColumnRenamed("o_custkey", "id")


QUERIES = {f.__name__: f for f in (
    autocomplete_titles, titles_view, exact_title, latest_version, latest_version_flag, latest_with_ties, versions_of, siblings_not_updated, unfetched, links_without_document, reference_counts,
    refs_scores, in_links, section_in_links, bill_enacted_flag, amending_counts, document_summary, hierarchy_depth, ancestors, child_count, descendant_count, conversation_chain, cycle_edges,
    acyclic_edges, connected, link_weights, graph_scales, topn_per_user, sessions_over_limit, sequence_validation, definitions_page, optional_filters, replaced_rows, result_categories,
    definition_html, json_results, suggestion_response, set_difference,
)}

UPS = f"""WITH RECURSIVE e AS {TREE}, w(start, node, depth) AS (
  SELECT child, child, 0 FROM e UNION ALL SELECT w.start, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.node WHERE e.parent IS NOT NULL)"""

ORACLES = {
    "autocomplete_titles": f"SELECT * FROM {NAMES} WHERE name ILIKE '%Ar%' ORDER BY base_score ASC NULLS LAST, strpos(lower(name), 'ar'), length(name), refs DESC NULLS FIRST, year DESC NULLS FIRST, type, id LIMIT 50",
    "titles_view": f"SELECT * FROM {NAMES}",
    "exact_title": f"SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM {NAMES}) WHERE name = 'Customer#000000007' AND n = 1",
    "latest_version": "SELECT source, doc_id, n_chars FROM documents d WHERE doc_id = (SELECT max(doc_id) FROM documents e WHERE e.source = d.source)",
    "latest_version_flag": "SELECT doc_id, source, CASE WHEN doc_id = max(doc_id) OVER (PARTITION BY source) THEN true END AS latest FROM documents",
    "latest_with_ties": "SELECT p_brand, p_size, p_partkey FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r = 1",
    "versions_of": "SELECT doc_id, source, n_chars FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id = 7)",
    "siblings_not_updated": "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "unfetched": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "links_without_document": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "reference_counts": f"SELECT * FROM {REFS}",
    "refs_scores": f"""SELECT p.p_partkey AS id, coalesce(r.refs, 0) AS refs, CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS base_score, (p_size < 10 AND e.done) AS enacted
FROM part p LEFT JOIN (SELECT target, count(n_links) AS refs FROM {REFS} WHERE source IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1) r ON r.target = p.p_partkey
LEFT JOIN (SELECT DISTINCT p_brand, true AS done FROM part WHERE p_size = 50) e ON e.p_brand = p.p_brand""",
    "in_links": f"SELECT source, c_name, n_links FROM {REFS} JOIN customer ON c_custkey = source WHERE target = 42 AND source <> 42",
    "section_in_links": "SELECT DISTINCT p_partkey AS link_id, p_type AS path FROM part WHERE p_partkey IN (1, 2, 3) OR (p_type LIKE 'PROMO%' AND regexp_matches(p_type, '^PROMO(\\(.*)?$'))",
    "bill_enacted_flag": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS enacted FROM customer",
    "amending_counts": "SELECT p_name, p_partkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "document_summary": """SELECT n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers,
(SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1) AS richest FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "hierarchy_depth": f"WITH RECURSIVE e AS {TREE}, w(node, depth) AS (SELECT child, 0 FROM e WHERE parent IS NULL UNION SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node) SELECT node, max(depth) AS depth FROM w GROUP BY 1",
    "ancestors": f"{UPS} SELECT * FROM w",
    "child_count": f"SELECT parent, CAST(count(DISTINCT child) AS INT) AS child_count FROM {TREE} WHERE parent IS NOT NULL GROUP BY 1",
    "descendant_count": f"{UPS} SELECT node AS parent, CAST(count(DISTINCT start) AS INT) AS child_count FROM w WHERE depth > 0 GROUP BY 1",
    "conversation_chain": """WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn FROM conversations), w(conv_id, start, turn, depth) AS (
  SELECT conv_id, turn, turn, 0 FROM e UNION ALL SELECT w.conv_id, w.start, e.turn, w.depth + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.turn = w.turn - 1)
SELECT concat(conv_id, '-', start) AS start, CAST(max(depth) AS BIGINT) AS n_before FROM w GROUP BY conv_id, w.start""",
    "cycle_edges": f"WITH RECURSIVE e AS {RING}, w(a, b) AS (SELECT child, parent FROM e UNION SELECT w.a, e.parent FROM w JOIN e ON e.child = w.b) SELECT child, parent FROM e WHERE EXISTS (SELECT 1 FROM w WHERE w.a = e.parent AND w.b = e.child)",
    "acyclic_edges": """WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS child, CAST((n_nationkey * 2) % 25 AS BIGINT) AS parent, CAST(n_regionkey AS BIGINT) AS year FROM nation),
w(a, b) AS (SELECT child, parent FROM e UNION SELECT w.a, e.parent FROM w JOIN e ON e.child = w.b),
c AS (SELECT e.*, (SELECT min(w.b) FROM w WHERE w.a = e.child AND EXISTS (SELECT 1 FROM w v WHERE v.a = w.b AND v.b = e.child)) AS ring FROM e WHERE EXISTS (SELECT 1 FROM w WHERE w.a = e.parent AND w.b = e.child))
SELECT child, parent, year FROM e WHERE child NOT IN (SELECT child FROM (SELECT child, row_number() OVER (PARTITION BY ring ORDER BY year, child, parent) AS r FROM c) WHERE r = 1)""",
    "connected": "SELECT DISTINCT node FROM (SELECT CAST(5 AS BIGINT) AS node UNION ALL SELECT l_suppkey FROM lineitem WHERE l_partkey = 5 UNION ALL SELECT l_partkey FROM lineitem WHERE l_suppkey = 5)",
    "link_weights": """WITH l AS (SELECT l_partkey AS s, l_suppkey AS g, count(*) AS w FROM lineitem WHERE l_partkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2)
SELECT s_suppkey AS node, (SELECT count(*) FROM l WHERE s = s_suppkey) AS n_targets, CAST((SELECT coalesce(sum(w), 0) FROM l WHERE s = s_suppkey) AS BIGINT) AS weight_out, CAST((SELECT coalesce(sum(w), 0) FROM l WHERE g = s_suppkey) AS BIGINT) AS weight_in FROM supplier""",
    "graph_scales": f"SELECT CAST(min(total) AS BIGINT) AS low, CAST(max(total) AS BIGINT) AS high FROM (SELECT target, sum(n_links) AS total FROM {REFS} GROUP BY 1)",
    "topn_per_user": "SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3",
    "sessions_over_limit": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 10",
    "sequence_validation": "SELECT conv_id, turn, previous FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn <> 1)) WHERE previous IS NOT NULL AND NOT (turn = previous + 1 OR turn = 1)",
    "definitions_page": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'p%' ORDER BY length(p_name), p_partkey LIMIT 25 OFFSET 25",
    "optional_filters": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "replaced_rows": "SELECT c_custkey AS id, 'old' AS state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_totalprice > 300000",
    "result_categories": "SELECT p_brand AS kind, min(p_partkey) AS first_place, string_agg(p_name, '|' ORDER BY p_partkey, p_name) AS names FROM part GROUP BY 1",
    "definition_html": "SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey DESC) AS text FROM nation GROUP BY 1",
    "json_results": """SELECT '{"id":' || r_regionkey || ',"name":"' || r_name || '"}' AS json FROM region""",
    "suggestion_response": "SELECT 'Supplier#00000000' AS query, string_agg(s_name, '|' ORDER BY s_name) AS names FROM supplier WHERE s_name ILIKE '%Supplier#00000000%'",
    "set_difference": "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
}
