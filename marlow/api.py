"""The query API: keyword arguments to a DataFrame, over tables that batch jobs keep up to date.

Tables (DataFrames): ``instruments`` (id, govt_id, version, type, title, year, terminated, repealed,
date_first_valid), ``documents`` (id, document), and, where a query needs them, ``cases`` (id,
full_citation, document, year), ``definitions`` (id, document_id, full_word, html, priority), ``links``
(link_id, source, target, path, repr), ``edges`` (child, parent), ``shortcuts`` (name, id, type, year).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.citation import canonical_link
from .functions.render import fragmented_udf, render_udf
from .operators import graph, relational as rel, text as tx, tree
from .store import materialise

PAGE, PREVIEW, SKELETON = 25, 300, 100_000
INSTRUMENTS = {"act", "regulation", "sop", "bill", "instrument"}


def full_view(rows: DataFrame, xml_col: str, highlight: str = "", limit: int = SKELETON) -> DataFrame:
    """(id, title, skeleton, html, parts) of documents; those above ``limit`` characters, or all where a text is to be marked, by parts."""
    split = F.lit(True) if highlight else F.length(xml_col) > limit
    rows = rows.select("id", "title", xml_col, F.coalesce(split, F.lit(False)).alias("skeleton"))
    marked = (lambda p: tx.highlight(p, [highlight])) if highlight else (lambda p: p)
    own = rows.filter("skeleton").select("id", "title", "skeleton", fragmented_udf()(xml_col).alias("f"))
    numbered = F.transform("f.parts", lambda p, i: F.struct(i.alias("num"), marked(p).alias("html")))
    own = own.select("id", "title", "skeleton", F.col("f.skeleton").alias("html"), numbered.alias("parts"))
    plain = rows.filter("not skeleton").select("id", "title", "skeleton", render_udf()(xml_col).alias("html"), F.array().cast("array<struct<num:int,html:string>>").alias("parts"))
    return own.unionByName(plain)


class QueryError(ValueError):
    """A query that names nothing known."""


class Engine:
    def __init__(self, **tables: DataFrame) -> None:
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(f"no table {name}") from None

    @cached_property
    def latest(self) -> DataFrame:
        return rel.latest_versions(self.instruments, "govt_id", "version")

    @cached_property
    def nodes(self) -> DataFrame:
        """The stored node table where there is one, else all documents parsed once and written."""
        if "node_table" in self.tables:
            return self.tables["node_table"]
        return materialise(tree.node_table(self.documents, "id", "document"), "nodes")

    @cached_property
    def counts(self) -> DataFrame:
        return self.links.groupBy("source", "target").agg(F.count("link_id").alias("n_links"))

    @cached_property
    def scores(self) -> DataFrame:
        refs = rel.in_degrees(self.counts, self.latest.select(F.col("id").alias("source")), "source", "target").withColumnRenamed("target", "id")
        depths = graph.depths(self.edges).withColumnRenamed("node", "id") if "edges" in self.tables else refs.select("id", F.lit(0).alias("depth")).limit(0)
        enacted = self.instruments.filter("type <> 'bill'").select("govt_id")
        return rel.scores(self.latest, refs, depths, enacted, "id", "govt_id", F.col("type") == "bill")

    @cached_property
    def titles(self) -> DataFrame:
        long = lambda c: F.col(c).cast("long").alias(c)
        live = self.latest.filter("terminated is null or terminated = ''").join(self.scores, "id", "left")
        own = [live.select(F.col("title").alias("name"), long("id"), "type", long("year"), long("refs"), long("base_score"))]
        if "cases" in self.tables:
            own.append(self.cases.select(F.col("full_citation").alias("name"), long("id"), F.lit("case").alias("type"), F.lit(None).cast("long").alias("year"), F.lit(0).cast("long").alias("refs"), F.lit(0).cast("long").alias("base_score")))
        if "shortcuts" in self.tables:
            own.append(self.shortcuts.select("name", long("id"), "type", *(F.lit(10000).cast("long").alias(c) for c in ("year", "refs", "base_score"))))
        return rel.titles(*own)

    def query(self, doc_type: str, find: str | None = None, **args: object) -> DataFrame:
        """Dispatch on the document type, and for one instrument on what to find in it."""
        if doc_type == "all":
            return self.search_all(str(args.get("query", "")))
        if doc_type == "instruments":
            return self.search_instruments(**args)
        if doc_type == "cases":
            return self.search_cases(**args)
        if doc_type == "case":
            return self.cases.filter(F.col("id") == args["id"])
        if doc_type not in INSTRUMENTS:
            raise QueryError(f"unknown document type: {doc_type}")
        found: dict[str, Callable[..., DataFrame]] = {"full": self.full, "preview": self.preview, "location": self.location, "govt_location": self.govt_location, "contains": self.contains, "more": self.parts, "section_references": self.section_references, "section_versions": self.versions}
        if (find or "full") not in found:
            raise QueryError(f"unknown find: {find}")
        return found[find or "full"](self.resolve(args.pop("id")), **args)

    def resolve(self, name: object) -> int:
        """A document's number from its number or the id of any node in the latest version."""
        if isinstance(name, int) or str(name).isdigit():
            return int(name)
        hits = self.nodes.filter(F.col("node_id") == name).join(self.latest.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        row = hits.agg(F.min("doc_id").alias("id")).first()
        if row.id is None:
            raise QueryError(f"no document with {name}")
        return row.id

    def _one(self, doc: int) -> DataFrame:
        return self.instruments.filter(F.col("id") == doc).join(self.documents, "id")

    def full(self, doc: int, highlight: str = "") -> DataFrame:
        """(id, title, skeleton, html, parts): the whole document.

        Where it is long, or a text is to be marked, ``html`` is its skeleton and ``parts`` has each part's
        number and html, marked if need be; a client puts them in as they are read. Nothing is left out.
        """
        return full_view(self._one(doc), "document", highlight)

    def preview(self, doc: int) -> DataFrame:
        return self._one(doc).select("id", "title", render_udf(PREVIEW)("document").alias("html"))

    def location(self, doc: int, location: str) -> DataFrame:
        """Nodes of a path, ancestors included; a path that fails is tried once more in canonical form."""
        row = self.documents.filter(F.col("id") == doc).select("id", "document")
        paths = F.array(F.lit(location), F.lit(canonical_link(location)))
        tried = row.select("id", F.posexplode(tree.lookup_udf()("document", paths)).alias("attempt", "at")).filter("size(at) > 0")
        best = tried.groupBy("id").agg(F.min_by("at", "attempt").alias("at"))
        targets = best.select(F.col("id").alias("doc_id"), F.explode("at").alias("target"))
        return tree.cull(self.nodes.filter(F.col("doc_id") == doc), targets)

    def govt_location(self, doc: int, govt_location: str) -> DataFrame:
        own = self.nodes.filter(F.col("doc_id") == doc)
        return tree.cull(own, own.filter(F.col("node_id") == govt_location).select("doc_id", F.col("pre").alias("target")))

    def parts(self, doc: int, parts: list[int] | None = None) -> DataFrame:
        out = tree.parts(self.nodes.filter(F.col("doc_id") == doc))
        return out.filter(F.col("num").isin(parts)) if parts is not None else out

    def contains(self, doc: int, contains: str, mode: str = "phrase") -> DataFrame:
        """Parts of a document that hold the words, by number."""
        own = self.nodes.filter(F.col("doc_id") == doc)
        return tree.parts(own).join(own.select("doc_id", "pre", "string_value"), ["doc_id", "pre"]).filter(tx.contains(F.col("string_value"), contains, mode)).orderBy("num")

    def section_references(self, doc: int, ids: list[int] | None = None, path: str = "") -> DataFrame:
        """Links to a document's sections, those from within it marked."""
        own = self.links.filter(F.col("target") == doc)
        return rel.section_in_links(own, ids or [], path, "link_id", "path").withColumn("internal", F.col("source") == doc).orderBy("repr")

    def versions(self, doc: int) -> DataFrame:
        ids = self.instruments.filter(F.col("id") == doc).select("id")
        return rel.versions_of(self.instruments, ids, "govt_id", "id").orderBy(F.desc_nulls_first("version"))

    def references(self, doc: int) -> DataFrame:
        return rel.in_links(self.counts, self.latest.select(F.col("id").alias("source"), "title"), "source", "target", doc)

    def contents(self, doc: int) -> DataFrame:
        return tree.outline(self.nodes.filter(F.col("doc_id") == doc)).orderBy("pre")

    def autocomplete(self, query: str, limit: int = 50) -> DataFrame:
        return rel.autocomplete(self.titles, query, limit)

    def exact(self, query: str) -> DataFrame:
        return rel.exact_title(self.titles, query)

    def definition(self, ids: list[str]) -> DataFrame:
        """The html of definitions, one string, the most binding first."""
        return rel.concat_by_priority(self.definitions.filter(F.col("id").isin(ids)).withColumn("all", F.lit(1)), "all", "priority", "html").select(F.col("text").alias("html"))

    def definitions_like(self, term: str, offset: int = 0) -> DataFrame:
        own = self.definitions.join(self.latest.select(F.col("id").alias("document_id"), "title"), "document_id").filter(F.col("full_word").ilike(f"{term}%"))
        return rel.page(own, [F.length("full_word"), F.col("id")], offset, PAGE)

    def search_all(self, query: str) -> DataFrame:
        own = self.latest.join(self.documents.select("id", tx.html_text(F.col("document")).alias("body")), "id")
        return tx.ranked(own, "id", {"title": 3.0, "body": 1.0}, query, PAGE)

    def search_instruments(self, title: str | None = None, contains: str | None = None, contains_type: str = "phrase", definition: str | None = None, year: str | None = None, kinds: list[str] | None = None, drop_repealed: bool = False, drop_not_in_force: bool = False, mode: str = "intended", sort: str = "title", offset: int = 0) -> DataFrame:
        """Latest instruments by title, words of their parts, definitions, year and kind, a page at a time."""
        amending = F.col("title").ilike("%amendment%")
        by_kind = {"act_principal": (F.col("type") == "act") & ~amending, "act_amendment": (F.col("type") == "act") & amending, "regulation": F.col("type") == "regulation", "bill": F.col("type").isin("bill", "sop")}
        pending = F.coalesce(F.col("date_first_valid") > F.current_date(), F.lit(False))
        keep = tx.instrument_filter(by_kind, kinds or [], F.lit(True), F.coalesce("repealed", F.lit(False)), pending, drop_repealed, drop_not_in_force, mode)
        out = self.latest.filter(keep)
        if title:
            out = out.filter(tx.parse_query(title, tx.tokens(F.col("title"))))
        if year:
            out = out.filter(tx.year_query(F.col("year"), year))
        if contains:
            hits = tree.parts(self.nodes).join(self.nodes.select("doc_id", "pre", "string_value"), ["doc_id", "pre"]).filter(tx.contains(F.col("string_value"), contains, contains_type))
            out = tx.with_child(out, hits.select(F.col("doc_id").alias("id")), "id")
        if definition:
            out = tx.with_child(out, self.definitions.filter(tx.parse_query(definition, tx.tokens(F.col("full_word")))).select(F.col("document_id").alias("id")), "id")
        return rel.page(out, [F.col(sort).asc_nulls_last(), F.col("id")], offset, PAGE)

    def search_cases(self, full_citation: str | None = None, contains: str | None = None, contains_type: str = "phrase", year: str | None = None, offset: int = 0) -> DataFrame:
        out = self.cases
        if full_citation:
            out = out.filter(tx.parse_query(full_citation, tx.tokens(F.col("full_citation"))))
        if contains:
            out = out.filter(tx.contains(tx.html_text(F.col("document")), contains, contains_type))
        if year:
            out = out.filter(tx.year_query(F.col("year"), year))
        return rel.page(out, [F.col("full_citation"), F.col("id")], offset, PAGE)

    def link(self, title: str) -> DataFrame:
        """What a title leads to: the latest document of that name, with its type."""
        return self.latest.filter(F.col("title") == title).select("id", "type", "title", "year").orderBy(F.desc_nulls_first("year"), "id")

    def summary(self, doc: int) -> DataFrame:
        """A document with its versions, references into it, and what is made under it or it is made under."""
        own = self.instruments.filter(F.col("id") == doc)
        versions = self.instruments.groupBy("govt_id").agg(F.count(F.lit(1)).alias("n_versions"), F.max("version").alias("newest"))
        into = self.counts.filter((F.col("target") == doc) & (F.col("source") != doc)).agg(F.count(F.lit(1)).alias("n_referring"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"))
        out = own.join(versions, "govt_id").crossJoin(into)  # one row on either side
        if "edges" in self.tables:
            below = self.edges.filter(F.col("parent") == doc).agg(F.countDistinct("child").alias("n_below"))
            above = self.edges.filter(F.col("child") == doc).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
            out = out.crossJoin(below).crossJoin(above)
        return out

    def published(self, kind: str | None = None) -> DataFrame:
        """Saved views that are open to all, newest first."""
        return rel.optional_filter(self.views.filter("published"), kind=kind).orderBy(F.desc_nulls_last("saved"), "id")


class PageStore:
    """Pages of results as a client holds them: one list a query, whatever page of it was asked for."""

    def __init__(self, engine: Engine, size: int = PAGE) -> None:
        self.engine, self.size = engine, size
        self.lists: dict[tuple, dict] = {}

    @staticmethod
    def key(query: dict) -> tuple:
        return tuple(sorted((k, str(v)) for k, v in query.items() if k != "offset"))

    def more(self, **query: object) -> dict:
        """The query's list with its next page: ``results`` and whether it is ``finished``; a finished one asks no more."""
        held = self.lists.setdefault(self.key(query), {"results": [], "finished": False})
        if not held["finished"]:
            rows = self.engine.query(**{**query, "offset": len(held["results"])}).collect()  # one page
            held["results"] += rows
            held["finished"] = len(rows) < self.size
        return held
