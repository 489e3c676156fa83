"""Written tables in joins: none is sent through the driver for the size of its files."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlow.operators import tree
from marlow.store import materialise


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_a_table_that_packs_well_is_not_broadcast(spark):
    rows = materialise(spark.range(200000).select((F.col("id") % 1000).alias("doc_id"), F.lit("x" * 200).alias("said")), "packed")
    small = rows.select("doc_id").distinct()
    assert "BroadcastHashJoin" not in plan(rows.join(rows.select("doc_id", F.length("said").alias("n")), "doc_id"))
    assert "BroadcastHashJoin" not in plan(rows.join(small, "doc_id", "left_semi"))
    assert "BroadcastHashJoin" in plan(rows.join(F.broadcast(small), "doc_id"))


def test_culling_sends_no_nodes_through_the_driver(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("<a><b id='x'><label>1</label></b><crosshead/><b/></a>").alias("xml"))
    nodes = materialise(tree.node_table(docs, "doc_id", "xml"), "nodes")
    culled = tree.cull(nodes, nodes.filter("node_id = 'x'").select("doc_id", F.col("pre").alias("target")))
    assert "Broadcast" not in plan(culled)
    assert culled.count() == 150
