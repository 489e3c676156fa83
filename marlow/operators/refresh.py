"""Link tables of a corpus, kept up to date from sets of changed documents.

Some tables say what a document holds on its own: its nodes, its ids, its references, the titles that it
names as parents, its history notes. The others join those of all documents: links by id, the sections
that link texts name, mentions of titles, parents, amendments, and the parents without cycles. A set of
changes tells which rows of the joined tables can differ: those of the changed documents, and those of
others that asked for an id, a title or a section that a changed document had or has. These rows alone
are joined anew; all others are taken over. The result is that of an analysis of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_date
from ..store import materialise
from . import annotate, graph, layout, links, tree


@dataclass
class LinkTables:
    """``docs``: doc_id, title, xml. The other tables are made of it."""

    docs: DataFrame
    titles: DataFrame  # doc_id, title, assent
    nodes: DataFrame
    ids: DataFrame  # doc_id, node_id
    refs: DataFrame  # source, node_id, link_text: known or not
    names: DataFrame  # child, name: titles that a subordinate document names as its parents'
    notes: DataFrame  # target, node_id, amendment_date, amending
    links: DataFrame  # source, node_id, target, link_text
    sections: DataFrame  # the same with path and target_pre
    mentions: DataFrame  # source, target, said
    parents: DataFrame  # child, name, parent
    amendments: DataFrame  # the notes with source
    hierarchy: DataFrame  # child, parent: parents without cycles


def _own(docs: DataFrame) -> dict[str, DataFrame]:
    """What documents hold on their own."""
    assent = F.regexp_extract("xml", r'^\s*(?:<\?[^>]*>\s*)?<[^>]*\bdate\.assent="([^"]*)"', 1)
    titles = docs.select("doc_id", "title", safe_date(assent).alias("assent"))
    nodes = materialise(tree.node_table(docs, "doc_id", "xml"), "state-nodes")
    refs = tree.without(nodes, tree.UNLINKED).filter("href is not null").select(F.col("doc_id").alias("source"), F.col("href").alias("node_id"), F.col("string_value").alias("link_text"))
    whole = nodes.filter("pre = 0").select(F.col("doc_id").alias("id"), F.col("string_value").alias("text"))
    names = layout.parent_names(titles.select(F.col("doc_id").alias("id"), "title"), whole)
    notes = nodes.filter("tag = 'history-note'").select(F.col("doc_id").alias("target"), "node_id", F.col("string_value").alias("note"))
    rows = annotate.amendment_rows(notes, "note").select("target", "node_id", "amendment_date", F.nullif("amending", F.lit("")).alias("amending"))
    return {"docs": docs, "titles": titles, "nodes": nodes, "ids": tree.id_registry(nodes), "refs": refs, "names": names, "notes": rows}


def _linked(refs: DataFrame, ids: DataFrame) -> DataFrame:
    known = ids.groupBy("node_id").agg(F.min("doc_id").alias("target"))
    return refs.join(known, "node_id").select("source", "node_id", "target", "link_text")


def _sections(found: DataFrame, docs: DataFrame) -> DataFrame:
    asked = docs.join(found.select(F.col("target").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return links.resolve_texts(found, asked, "doc_id", "xml").select("source", "node_id", "target", "link_text", "path", "target_pre")


def _texts(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("text") != "") & ~tree.within(tree.UNLINKED | {"link"})).select("doc_id", "pre", "text")


def _mentions(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    hits = annotate.occurrences(_texts(nodes), titles, ["doc_id", "pre"], "text", "title")
    meant = hits.join(titles.select(F.col("title").alias("term"), F.col("doc_id").alias("target")), "term").filter("doc_id <> target")
    return meant.select(F.col("doc_id").alias("source"), "target", F.col("term").alias("said"))


def _parents(names: DataFrame, titles: DataFrame) -> DataFrame:
    return names.join(titles.select(F.col("title").alias("name"), F.col("doc_id").alias("parent")), "name").filter("parent <> child").select("child", "name", "parent").distinct()


def _amendments(notes: DataFrame, titles: DataFrame) -> DataFrame:
    known = titles.groupBy(F.col("title").alias("amending")).agg(F.min("doc_id").alias("source"))
    return notes.join(known, "amending", "left").select("target", "node_id", "amendment_date", "amending", "source")


def _hierarchy(parents: DataFrame, titles: DataFrame) -> DataFrame:
    edges = parents.select("child", "parent").distinct().join(titles.select(F.col("doc_id").alias("child"), "assent"), "child")
    return graph.break_cycles(edges, "assent").select("child", "parent")


def _kept(**tables: DataFrame) -> LinkTables:
    return LinkTables(**{name: materialise(df, f"state-{name}") for name, df in tables.items()})


def analyse(docs: DataFrame) -> LinkTables:
    """All tables of a corpus. ``docs``: doc_id, title, xml, the latest ones only."""
    own = _own(materialise(docs.select("doc_id", "title", "xml").filter("xml is not null"), "state-docs"))
    found = materialise(_linked(own["refs"], own["ids"]), "state-found")
    parents = _parents(own["names"], own["titles"])
    return _kept(**own, links=found, sections=_sections(found, own["docs"]), mentions=_mentions(own["nodes"], own["titles"]), parents=parents, amendments=_amendments(own["notes"], own["titles"]), hierarchy=_hierarchy(parents, own["titles"]))


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.exceptAll(new).unionByName(new.exceptAll(old))


def _among(table: DataFrame, /, **keys: DataFrame) -> DataFrame:
    """``table`` with ``__hit``: whether any of its columns is among the values given for it."""
    out, hit = table, F.lit(False)
    for column, values in keys.items():
        own = values.toDF("__v").distinct().withColumn(f"__{column}", F.lit(True))
        out = out.join(own, F.col(column) == F.col("__v"), "left").drop("__v")
        hit = hit | F.col(f"__{column}").isNotNull()
    return out.withColumn("__hit", hit).drop(*(f"__{c}" for c in keys))


def _renewed(table: DataFrame, of: DataFrame, make: Callable[[DataFrame], DataFrame], /, **keys: DataFrame) -> DataFrame:
    """``table`` with its rows that hold any of the keys made anew from the rows of ``of`` that do."""
    stay = _among(table, **{k: v for k, v in keys.items() if k in table.columns}).filter("not __hit").drop("__hit")
    stale = _among(of, **{k: v for k, v in keys.items() if k in of.columns}).filter("__hit").drop("__hit")
    return stay.unionByName(make(stale).select(*table.columns))


def refresh(state: LinkTables, changes: DataFrame) -> LinkTables:
    """The tables after some documents have changed, come or gone. ``changes``: doc_id, title, xml, null for one that is gone.

    A document is in ``changes`` once.
    """
    changes = materialise(changes.select("doc_id", "title", "xml"), "state-changes")
    touched = changes.select("doc_id")
    fresh = _own(changes.filter("xml is not null"))
    key = {"refs": "source", "names": "child", "notes": "target"}

    def of_touched(name: str) -> DataFrame:
        table = getattr(state, name)
        return table.join(touched.toDF("__t"), F.col(key.get(name, "doc_id")) == F.col("__t"), "left_semi")

    def swapped(name: str) -> DataFrame:
        table = getattr(state, name)
        return table.join(touched.toDF("__t"), F.col(key.get(name, "doc_id")) == F.col("__t"), "left_anti").unionByName(fresh[name].select(*table.columns))

    own = {name: materialise(swapped(name), f"state-{name}") for name in fresh}
    moved_ids = materialise(_differing(of_touched("ids"), fresh["ids"].select("doc_id", "node_id")).select("node_id").distinct(), "state-moved")
    moved_titles = materialise(_differing(of_touched("titles").select("doc_id", "title"), fresh["titles"].select("doc_id", "title")).select("title").distinct(), "state-moved")

    found = materialise(_renewed(state.links, own["refs"], lambda r: _linked(r, own["ids"]), source=touched, node_id=moved_ids), "state-links")
    sections = _renewed(state.sections, found, lambda r: _sections(materialise(r, "state-asked"), own["docs"]), source=touched, node_id=moved_ids, target=touched)

    # texts that hold a title which has come or gone are read again, for it may cover others
    speaking = annotate.occurrences(_texts(own["nodes"]), moved_titles, ["doc_id", "pre"], "text", "title").select("doc_id")
    read = materialise(touched.unionByName(speaking).distinct(), "state-read")
    again = own["nodes"].join(read, "doc_id", "left_semi")
    mentions = state.mentions.join(read.toDF("source"), "source", "left_anti").unionByName(_mentions(again, own["titles"]))

    parents = materialise(_renewed(state.parents, own["names"], lambda r: _parents(r, own["titles"]), child=touched, name=moved_titles), "state-parents")
    amendments = _renewed(state.amendments, own["notes"], lambda r: _amendments(r, own["titles"]), target=touched, amending=moved_titles)
    return _kept(**own, links=found, sections=sections, mentions=mentions, parents=parents, amendments=amendments, hierarchy=_rehung(state, parents, own["titles"], touched))


def _rehung(state: LinkTables, parents: DataFrame, titles: DataFrame, touched: DataFrame) -> DataFrame:
    """The hierarchy, with cycles looked for only where one that has changed can lie.

    An edge has changed if it has come or gone, or if its child has, whose date decides which edge goes.
    A cycle through it lies among the nodes that it leads to and that lead to it.
    """
    old, new = (p.select("child", "parent").distinct() for p in (state.parents, parents))
    both = materialise(old.unionByName(new).distinct(), "state-edges")
    of_touched = both.join(touched.toDF("child"), "child", "left_semi")
    changed = _differing(old, new).unionByName(of_touched).select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    changed = materialise(changed, "state-ends")
    up = graph.reachable(both.select(F.col("child").alias("a"), F.col("parent").alias("b")), changed)
    down = graph.reachable(both.select(F.col("parent").alias("a"), F.col("child").alias("b")), changed)
    near = materialise(up.join(down, "node", "left_semi"), "state-near")
    inner = lambda edges: edges.join(near.toDF("child"), "child", "left_semi").join(near.toDF("parent"), "parent", "left_semi").select("child", "parent")
    untouched = state.hierarchy.join(inner(state.hierarchy), ["child", "parent"], "left_anti").join(new, ["child", "parent"], "left_semi")
    outer = new.join(inner(new), ["child", "parent"], "left_anti").join(old, ["child", "parent"], "left_anti")
    return untouched.unionByName(outer).unionByName(_hierarchy(inner(new), titles)).select("child", "parent")


def same(a: LinkTables, b: LinkTables) -> dict[str, int]:
    """Rows of each table that one state has and the other has not."""
    return {f.name: _differing(getattr(a, f.name), getattr(b, f.name).select(*getattr(a, f.name).columns)).count() for f in fields(LinkTables)}
