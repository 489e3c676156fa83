"""Stored records, derived state and small collection operators, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, index, records
from ..operators import relational as rel
from ..store import new_path
from .relational_queries import t


def inserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two inserts into one table, read back."""
    out = new_path(spark, "inserted")
    own = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    records.insert_rows(own.filter("n_nationkey < 10"), out, ["n_regionkey"])
    records.insert_rows(own.filter("n_nationkey >= 10"), out, ["n_regionkey"])
    return spark.read.schema(own.schema).parquet(out).select("n_nationkey", "n_name", "n_regionkey")


def updated_columns(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    spent = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.nullif(F.max("o_totalprice"), F.lit(0.0)).alias("c_acctbal"))
    return records.update_columns(own, spent, "c_custkey")


def reset_state(spark: SparkSession, d: str) -> DataFrame:
    return records.reset(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["source", "n_chars"])


def refreshed_views(spark: SparkSession, d: str) -> DataFrame:
    """Newest rows, then reference counts, then scores from both, in that order."""
    views = {
        "newest": lambda v: rel.latest_versions(v["part"], "p_brand", "p_size"),
        "counts": lambda v: v["lineitem"].groupBy("l_partkey").agg(F.count(F.lit(1)).alias("refs")),
        "scores": lambda v: v["newest"].join(v["counts"], F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("refs", F.lit(0)).alias("refs")),
    }
    return records.refresh(views, {"part": t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "lineitem": t(spark, d, "lineitem").select("l_partkey")})["scores"]


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


def unprocessed_records(spark: SparkSession, d: str) -> DataFrame:
    return records.record(_documents(spark, d), "source", "doc_id", "quality", "unprocessed").select("source", "doc_id")


def processed_records(spark: SparkSession, d: str) -> DataFrame:
    return records.record(_documents(spark, d), "source", "doc_id", "quality", "processed").select("source", "doc_id", "quality")


def record_states(spark: SparkSession, d: str) -> DataFrame:
    return records.versions_state(_documents(spark, d), "source", "doc_id", "quality").select("doc_id", "is_latest", "waiting")


def limited_union(spark: SparkSession, d: str) -> DataFrame:
    """A title's document from three places, the first of each."""
    part = t(spark, d, "part").filter("p_name like '%widget'").orderBy("p_partkey").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"))
    customer = t(spark, d, "customer").filter("c_acctbal < 0").orderBy("c_custkey").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    supplier = t(spark, d, "supplier").orderBy("s_suppkey").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return records.first_of_each(part, customer, supplier)


def truthy_props(spark: SparkSession, d: str) -> DataFrame:
    """Maps without empty values, the heavy columns dropped."""
    own = t(spark, d, "customer").withColumn("m", F.create_map(F.lit("name"), "c_name", F.lit("odd"), F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.lit("yes")), F.lit("debt"), F.when(F.col("c_acctbal") < 0, F.lit("debt"))))
    return records.pruned(own, ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]).select("c_custkey", F.array_join(F.map_keys(records.truthy(F.col("m"))), ",").alias("keys"))


def key_jobs(spark: SparkSession, d: str) -> DataFrame:
    return records.jobs(t(spark, d, "customer").select("c_custkey"), "c_custkey", 10).select("job", F.array_join("keys", ",").alias("keys"))


def zipped_pairs(spark: SparkSession, d: str) -> DataFrame:
    words, letters = F.split("p_name", " "), F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return t(spark, d, "part").select("p_partkey", F.explode(records.zipped(word=words, letter=letters)).alias("z")).select("p_partkey", "z.word", "z.letter")


def numeric_id_list(spark: SparkSession, d: str) -> DataFrame:
    ids = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ";").alias("ids"))
    return ids.select("l_orderkey", records.numeric_ids(F.col("ids")).alias("ids"))


def years_desc(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, F.year("o_orderdate")).alias("year"))
    ordered = records.by_year(own, "year", "o_orderkey").limit(200)  # the first page of the list
    return ordered


def row_total(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


def way_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every way from each nation along n -> 2n modulo 25, up to where it meets itself."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("child"), F.expr("cast((n_nationkey * 2) % 25 as bigint)").alias("parent"))
    ways = graph.paths(n, n.select(F.col("child").alias("start")))
    return ways.select("start", F.array_join("path", ">").alias("path"), "cyclic")


def user_sort(spark: SparkSession, d: str) -> DataFrame:
    """The dearest parts by a column of the user's choice."""
    return index.sorted_results(t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), "p_retailprice", "desc").limit(25)


QUERIES = {f.__name__: f for f in (
    inserted_rows, updated_columns, reset_state, refreshed_views, unprocessed_records, processed_records, record_states, limited_union, truthy_props, key_jobs, zipped_pairs, numeric_id_list, years_desc, row_total, way_paths, user_sort,
)}

DOCUMENTS = "(SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id))"
ORACLES = {
    "inserted_rows": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "updated_columns": "SELECT c_custkey, c_name, CASE WHEN m IS NOT NULL THEN nullif(m, 0.0) ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "reset_state": "SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS n_chars FROM documents",
    "refreshed_views": "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS refs FROM part p WHERE p_size = (SELECT max(p_size) FROM part q WHERE q.p_brand = p.p_brand)",
    "unprocessed_records": f"SELECT source, max(doc_id) AS doc_id FROM {DOCUMENTS} WHERE quality IS NULL GROUP BY 1",
    "processed_records": f"SELECT source, max(doc_id) AS doc_id, arg_max(quality, doc_id) AS quality FROM {DOCUMENTS} WHERE quality IS NOT NULL GROUP BY 1",
    "record_states": f"SELECT doc_id, doc_id = max(doc_id) OVER (PARTITION BY source) AS is_latest, quality IS NULL AS waiting FROM {DOCUMENTS}",
    "limited_union": "SELECT min(p_partkey) AS id, 'part' AS kind FROM part WHERE p_name LIKE '%widget' UNION SELECT min(c_custkey), 'customer' FROM customer WHERE c_acctbal < 0 UNION SELECT min(s_suppkey), 'supplier' FROM supplier",
    "truthy_props": "SELECT c_custkey, 'name' || (CASE WHEN c_custkey % 2 <> 0 THEN ',odd' ELSE '' END) || (CASE WHEN c_acctbal < 0 THEN ',debt' ELSE '' END) AS keys FROM customer",
    "key_jobs": "SELECT CAST(k // 10 AS BIGINT) AS job, string_agg(c_custkey, ',' ORDER BY c_custkey) AS keys FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) GROUP BY 1",
    "zipped_pairs": "SELECT p_partkey, string_split(p_name, ' ')[i] AS word, ['a', 'b', 'c'][i] AS letter FROM part, range(1, 4) r(i) WHERE i <= greatest(3, len(string_split(p_name, ' ')))",
    "numeric_id_list": "SELECT l_orderkey, string_agg(l_partkey, ';' ORDER BY l_partkey) AS ids FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1",
    "years_desc": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN CAST(year(o_orderdate) AS INT) END AS year FROM orders ORDER BY 2 DESC NULLS FIRST, 1 LIMIT 200",
    "row_total": "SELECT count(*) AS n FROM lineitem",
    "way_paths": """WITH RECURSIVE w(start, path, cyclic) AS (SELECT CAST(n_nationkey AS BIGINT), [CAST(n_nationkey AS BIGINT)], false FROM nation UNION ALL
SELECT start, list_append(path, (path[-1] * 2) % 25), list_contains(path, (path[-1] * 2) % 25) FROM w WHERE NOT cyclic) SELECT start, array_to_string(path, '>') AS path, cyclic FROM w""",
    "user_sort": "SELECT p_partkey AS id, p_retailprice FROM part ORDER BY 2 DESC, 1 LIMIT 25",
}
