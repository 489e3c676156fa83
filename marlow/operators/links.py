"""Links between documents: texts resolved to nodes, and the link tables kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.citation import canonical_link_udf
from . import annotate, tree
from .relational import replace_rows


def resolve_texts(links: DataFrame, docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """Links with the nodes that their texts name in the target: one row a node, or one with a null where there is none.

    ``links``: target, link_text and further columns. Each (target, text) is read once, and each target
    parsed once, however many links share them.
    """
    asked = links.select("target", "link_text").distinct().withColumn("path", canonical_link_udf("link_text"))
    found = tree.lookup_paths(docs, asked.select(F.col("target").alias("doc_id"), "path").distinct(), id_col, xml_col).select(F.col("doc_id").alias("target"), "path", F.col("target").alias("target_pre"))
    named = asked.join(found, ["target", "path"], "left")
    return links.join(named, ["target", "link_text"], "left")


def document_links(nodes: DataFrame, known: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(source, node_id, target, link_text): links by id, and those by a mention of a title where titles are given.

    ``known``: node_id, doc_id; ``titles``: doc_id, title, the latest ones. A document's mentions of its own title are none.
    """
    by_id = tree.references(nodes, known).select("source", "node_id", "target", "link_text")
    if titles is None:
        return by_id
    texts = nodes.filter((F.col("text") != "") & ~tree.within(tree.UNLINKED | {"link"})).select("doc_id", "pre", "text")
    hits = annotate.occurrences(texts, titles, ["doc_id", "pre"], "text", "title").join(titles.select(F.col("title").alias("term"), F.col("doc_id").alias("target")), "term").filter("doc_id <> target")
    return by_id.unionByName(hits.select(F.col("doc_id").alias("source"), F.lit(None).cast("string").alias("node_id"), "target", F.col("term").alias("link_text")))


def refreshed(stored: DataFrame, nodes: DataFrame, known: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """The stored links with those of the given documents found anew; documents whose links have all gone lose theirs."""
    touched = nodes.select(F.col("doc_id").alias("source")).distinct()
    return stored.join(touched, "source", "left_anti").unionByName(document_links(nodes, known, titles).select(*stored.columns))


def analyse(nodes: DataFrame, instruments: DataFrame, skip_links: bool = False, skip_ids: bool = False, skip_titles: bool = False) -> dict[str, DataFrame]:
    """All link tables of a corpus: ``ids``, ``links`` and, from both, ``amendments``; a skipped phase has no table.

    ``instruments``: doc_id, title, latest ones only.
    """
    out: dict[str, DataFrame] = {}
    if not skip_ids:
        out["ids"] = tree.id_registry(nodes)
    if not skip_links:
        out["links"] = document_links(nodes, out.get("ids", tree.id_registry(nodes)), None if skip_titles else instruments)
    notes = nodes.filter("tag = 'history-note'").select(F.col("doc_id").alias("target"), "node_id", F.col("string_value").alias("note"))
    out["amendments"] = amendments(notes, instruments)
    return out


def amendments(notes: DataFrame, instruments: DataFrame) -> DataFrame:
    """(target, node_id, amendment_date, amending, source): history notes with the amending title and, where it is known, its document."""
    rows = annotate.amendment_rows(notes, "note").select("target", "node_id", "amendment_date", F.nullif("amending", F.lit("")).alias("amending"))
    known = instruments.groupBy(F.col("title").alias("amending")).agg(F.min("doc_id").alias("source"))
    return rows.join(known, "amending", "left").select("target", "node_id", "amendment_date", "amending", "source")


def shortcuts(spark: SparkSession, entries: list[tuple[int, str, str, str, str]]) -> DataFrame:
    """A table of shortcut titles: document_id, title, query, find, type."""
    return spark.createDataFrame(entries, "document_id long, title string, query string, find string, type string")


def replaced_links(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Links by source document: new ones in place of all old ones of those sources."""
    return replace_rows(stored, new, "source")
