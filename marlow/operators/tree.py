"""Document trees as node tables.

A document becomes one row per element: ``pre`` (place in document order), ``last`` (place of its last
descendant), parent, depth, tag, id, label, own text and whole text, its pieces set apart by blanks, and
``above``, the places and names of its ancestors from the root to itself; ``href`` is a link's, or that of the pair in it. Ancestors are then an explode,
what lies within an element of some name a test of one row, the nearest of several nodes the least
depth, a range an interval of ``pre``, and pruning a semi join, all of which Catalyst plans; only
parsing and the path grammar are Python, in Arrow batches.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.slices import HELD
from ..store import materialise

#: Element names of the document vocabulary.
ROLES = ["part", "schedule", "head1", "subpart", "prov", "subprov", "form", "label-para"]
UNSEARCHED = {"amend", "end", "def-para"}
UNLINKED = {"history-note", "end", "skeleton", "amend", "schedule.amendments", "insertwords", "amend.in", "empowering-prov"}
KEPT_BESIDE = {"label", "heading", "cover", "text"}

NODE_SCHEMA = "pre int, last int, parent int, depth int, tag string, node_id string, label string, text string, string_value string, href string, above array<struct<pre:int,tag:string>>"


def norm_label(text: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[()]", " ", (text or "").lower())).strip()


class Tree:
    """A document's nodes as columns, in document order; none for a null text or one that is not XML.

    A node's whole text is a run of the document's pieces of text, put together when it is asked for.
    """

    def __init__(self, xml: str | None) -> None:
        self.last: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.node_id: list[str | None] = []
        self.label: list[str | None] = []
        self.text: list[str] = []
        self.href: list[str | None] = []
        self.pieces: list[str] = []
        self.runs: list[list[int]] = []
        try:
            root = ET.fromstring(xml) if xml else None
        except ET.ParseError:
            root = None
        if root is not None:
            self._walk(root)

    def __len__(self) -> int:
        return len(self.tag)

    def _walk(self, root: ET.Element) -> None:
        last, tags, labels, hrefs, runs, pieces, pairs = self.last, self.tag, self.label, self.href, self.runs, self.pieces, set()
        stack: list[tuple] = [(root, -1, 0)]
        while stack:
            element, at, depth = stack.pop()
            if depth < 0:  # the end of node ``at``
                last[at] = len(tags) - 1
                runs[at][1] = len(pieces)
                if at and element.tail and (tail := " ".join(element.tail.split())):
                    pieces.append(tail)
                continue
            parent, at, tag, said = at, len(tags), _tag(element), element.text
            if tag == "label" and parent >= 0 and labels[parent] is None:
                labels[parent] = norm_label("".join(element.itertext()))
            elif tag == "resourcepair" and parent >= 0 and parent not in pairs:
                pairs.add(parent)
                hrefs[parent] = hrefs[parent] or element.get("targetXmlId")
            last.append(at)
            self.parent.append(parent)
            self.depth.append(depth)
            tags.append(tag)
            self.node_id.append(element.get("id"))
            labels.append(None)
            hrefs.append(element.get("href") or None)
            self.text.append(said.strip() if said else "")
            runs.append([len(pieces), 0])
            if said and (said := " ".join(said.split())):
                pieces.append(said)
            stack.append((element, at, -1))
            stack.extend((c, at, depth + 1) for c in reversed(element) if isinstance(c.tag, str))

    def string_value(self, at: int) -> str:
        return " ".join(self.pieces[slice(*self.runs[at])])

    def above(self) -> Iterator[tuple[list[int], list[str]]]:
        """The places and names of each node's ancestors, from the root to itself; the lists change with the next node."""
        way, names = [], []
        for at, (depth, tag) in enumerate(zip(self.depth, self.tag, strict=True)):
            del way[depth:], names[depth:]
            way.append(at)
            names.append(tag)
            yield way, names


def parse(xml: str | None) -> list[dict]:
    """The nodes of a document in order; none for a null text or one that is not XML."""
    own = Tree(xml)
    return [
        {"above": [{"pre": k, "tag": own.tag[k]} for k in way], "pre": at, "last": own.last[at], "parent": own.parent[at], "depth": own.depth[at], "tag": own.tag[at], "node_id": own.node_id[at], "label": own.label[at], "text": own.text[at], "string_value": own.string_value(at), "href": own.href[at]}
        for at, (way, _) in enumerate(own.above())
    ]


def _tag(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


#: Rows, and characters of text, that a worker holds of its result; one node more may pass the second.
ROWS_HELD, CHARACTERS_HELD = 1 << 14, 1 << 23


class _Held:
    """Node rows on their way out, as columns: ``over`` has the rows' ancestors one after the other, ``ends`` where each row's end."""

    def __init__(self) -> None:
        self.columns: dict[str, list] = {k: [] for k in ("id", "pre", "last", "parent", "depth", "tag", "node_id", "label", "text", "string_value", "href")}
        self.over_pre: list[int] = []
        self.over_tag: list[str] = []
        self.ends, self.characters = [0], 0

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        kinds = {"id": pa.int32(), "pre": pa.int32(), "last": pa.int32(), "parent": pa.int32(), "depth": pa.int32()}
        made = {k: pa.array(v, kinds.get(k, pa.string())) for k, v in self.columns.items()}
        made["doc_id"] = ids.take(made.pop("id"))
        over = pa.StructArray.from_arrays([pa.array(self.over_pre, pa.int32()), pa.array(self.over_tag, pa.string())], ["pre", "tag"])
        made["above"] = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), over)
        names = ["doc_id", *(f.split()[0] for f in NODE_SCHEMA.split(", "))]
        return pa.RecordBatch.from_arrays([made[k] for k in names], names)


def _rows(xmls: pa.Array) -> Iterator[_Held]:
    """The nodes of some documents, a bounded number at a time; ``id`` is a document's place among them."""
    held = _Held()
    for k in range(len(xmls)):
        own = Tree(xmls[k].as_py())
        done = 0
        for at, (way, names) in enumerate(own.above()):
            said = own.string_value(at)
            held.columns["string_value"].append(said)
            held.over_pre += way
            held.over_tag += names
            held.ends.append(len(held.over_pre))
            held.characters += len(said) + len(own.text[at])
            if at + 1 < len(own) and len(held.ends) <= ROWS_HELD and held.characters < CHARACTERS_HELD:
                continue
            here, n = slice(done, at + 1), at + 1 - done
            held.columns["id"] += [k] * n
            held.columns["pre"] += range(done, at + 1)
            for name in ("last", "parent", "depth", "tag", "node_id", "label", "text", "href"):
                held.columns[name] += getattr(own, name)[here]
            done = at + 1
            if len(held.ends) > ROWS_HELD or held.characters >= CHARACTERS_HELD:
                yield held
                held = _Held()
    if len(held.ends) > 1:
        yield held


def node_table(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """A row per element, keyed by document. A worker holds one document's tree and a bounded part of the rows, however many documents a batch has."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in _rows(batch.column(1)):
                yield held.batch(batch.column(0))

    return docs.select(F.col(id_col).alias("id"), F.col(xml_col).alias("xml")).mapInArrow(run, f"doc_id {id_type}, {NODE_SCHEMA}")


def each_document(docs: DataFrame, id_col: str, xml_col: str, rows: Callable[[Tree], Iterable[tuple]], schema: str) -> DataFrame:
    """doc_id and the rows that ``rows`` gives of each document, ints and strings. A worker holds no more of them than ``node_table``'s does; nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = {f.split()[0]: pa.int32() if f.split()[1] == "int" else pa.string() for f in schema.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(ids: pa.Array, docs: list[int], held: list[tuple]) -> pa.RecordBatch:
            made = [pa.array(column, k) for column, k in zip(zip(*held, strict=True), kinds.values(), strict=True)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(docs, pa.int32())), *made], ["doc_id", *kinds])

        for batch in batches:
            docs, held, size = [], [], 0
            for k in range(batch.num_rows):
                for row in rows(Tree(batch.column(1)[k].as_py())):
                    docs.append(k)
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, str))
                    if len(held) >= ROWS_HELD or size >= CHARACTERS_HELD:
                        yield given(batch.column(0), docs, held)
                        docs, held, size = [], [], 0
            if held:
                yield given(batch.column(0), docs, held)

    return docs.select(F.col(id_col).alias("id"), F.col(xml_col).alias("xml")).mapInArrow(run, f"doc_id {kind}, {schema}")


def kept(docs: DataFrame, id_col: str, xml_col: str, keep: Callable[[Tree], dict[int, int | None]], columns: list[str]) -> DataFrame:
    """doc_id, the named columns of the node table (not ``above``), and ``mark``, of the nodes that ``keep`` gives of each document, in order, with their marks.

    A document's other nodes never leave the worker.
    """
    kinds = dict(f.split(maxsplit=1) for f in NODE_SCHEMA.split(", "))

    def rows(own: Tree) -> Iterator[tuple]:
        said = {"pre": lambda at: at, "string_value": own.string_value}
        values = [said.get(c) or getattr(own, c).__getitem__ for c in columns]
        return ((*(value(at) for value in values), mark) for at, mark in keep(own).items())

    return each_document(docs, id_col, xml_col, rows, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "mark int"]))


class PathError(ValueError):
    """A path that names no node."""


_UNIT = re.compile(r"(schedules?|sch|subparts?|parts?)\.?\s*(.*)", re.DOTALL)
_LESSER = re.compile(r"(?:sections?|ss?|clauses?|cl|rules?|rr?|hcr|forms?|paragraphs?)\.?(?=[\s\d(]|$)\s*")


def lookup(nodes: list[dict], path: str) -> list[int]:
    """Places of the nodes that a path such as ``sch 3 cl 1(2)`` or ``part 12 s 216(2)(b)`` names."""
    if not nodes:
        raise PathError("empty document")
    found = _in_scope(nodes, 0, path.strip().lower())
    if not found:
        raise PathError(f"path not found: {path}")
    return found


def _in_scope(nodes: list[dict], scope: int, path: str) -> list[int]:
    if m := _UNIT.match(path):
        tag = "schedule" if m[1].startswith("sch") else "subpart" if m[1].startswith("sub") else "part"
        rest = m[2]
        if span := re.fullmatch(r"([\w.]+)\s*([-+])\s*([\w.]+)", rest):
            return _span(nodes, [_first(nodes, scope, tag, span[1]), _first(nodes, scope, tag, span[3])], span[2])
        name = re.match(r"([\w.]+)\s*,?\s*(.*)", rest, re.DOTALL)
        at = _first(nodes, scope, tag, name[1]) if name else None
        if at is None and name and tag == "part":
            at = _first(nodes, scope, "head1", f"part {name[1]}")
        after = name[2] if name else ""
        if at is None:  # a lone schedule has no number; what looked like one belongs to the rest
            at = next((n["pre"] for n in nodes[scope + 1 : nodes[scope]["last"] + 1] if n["tag"] == tag), None)
            after = re.sub(r"^1\s*,?\s*", "", rest)
        if at is None:
            return []
        return _in_scope(nodes, at, after) if after else [at]
    path = _LESSER.sub("", path, count=1)
    if scope == 0:
        scope = next((n["pre"] for n in nodes if n["tag"] == "body"), 0)
    return _descend(nodes, scope, _keys(path))


def _keys(path: str) -> list[str]:
    """The labels of a path from the outermost in, those of a range or a sum in one."""
    keys = [k for k in re.split(r"[^\w.+\- ]+|(?<![+-])\s+(?![+-])", re.sub(r"\)\s*([+-])\s*\(", r"\1", path)) if k and k.strip()]
    return [re.sub(r"\s*([+-])\s*", r"\1", k.strip()) for k in keys]


def _first(nodes: list[dict], scope: int, tag: str, label: str) -> int | None:
    return min((n for n in nodes[scope + 1 : nodes[scope]["last"] + 1] if n["tag"] == tag and n["label"] == label), key=lambda n: (n["depth"], n["pre"]), default={"pre": None})["pre"]


def _span(nodes: list[dict], ends: list[int | None], sign: str) -> list[int]:
    if None in ends:
        return []
    if sign == "+":
        return sorted(set(ends))
    a, b = ends
    hidden = [n for n in nodes if n["tag"] in UNSEARCHED]
    return [n["pre"] for n in nodes[a : b + 1] if n["tag"] == nodes[a]["tag"] and not any(h["pre"] < n["pre"] <= h["last"] for h in hidden)]


def _nearest(nodes: list[dict], scope: int, label: str) -> int | None:
    """The shallowest labelled descendant; where there is none, that of the parent, and so on up."""
    while scope >= 0:
        low, high = scope + 1, nodes[scope]["last"]
        hidden = [n for n in nodes[low : high + 1] if n["tag"] in UNSEARCHED]
        hits = [n for n in nodes[low : high + 1] if n["label"] == label and n["tag"] not in UNSEARCHED | {"part", "subpart"} and not any(h["pre"] < n["pre"] <= h["last"] for h in hidden)]
        if hits:
            return min(hits, key=lambda n: (n["depth"], n["pre"]))["pre"]
        scope = nodes[scope]["parent"]
    return None


def _descend(nodes: list[dict], scope: int, keys: list[str]) -> list[int]:
    found: list[int] = []
    for key in keys:
        pieces = re.split(r"([+-])", key)
        at = _nearest(nodes, scope, pieces[0])
        if at is None:
            return []
        now = [at]
        for sign, label in zip(pieces[1::2], pieces[2::2], strict=False):
            end = _nearest(nodes, nodes[at]["parent"], label)
            if end is None:
                return []
            now = sorted({*now, *_span(nodes, [now[-1] if sign == "-" else end, end], sign)})
        found, scope = now, now[-1]
    return [p for p in found if not any(p < q <= nodes[p]["last"] for q in found)]


class Places:
    """The nodes of one document by label and by name, so that a path is looked up without a walk through the document.

    What ``lookup`` finds by going through all nodes is found here among those of the label or name asked
    for, and remembered by the element it was asked from.
    """

    def __init__(self, last: list[int], tag: list[str], label: list[str | None]) -> None:
        self.last, self.tag = last, tag
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.hidden: list[int] = []  # the innermost element around a node that hides what is in it, or -1
        self.labelled: dict[str, list[int]] = {}
        self.units: dict[tuple[str, str | None], list[int]] = {}
        self.named: dict[str, list[int]] = {}
        self.known: dict[tuple[int, str], int | None] = {}
        way: list[int] = []
        for at, (name, said) in enumerate(zip(tag, label, strict=True)):
            while way and last[way[-1]] < at:
                way.pop()
            over = way[-1] if way else -1
            self.parent.append(over)
            self.depth.append(len(way))
            self.hidden.append(-1 if over < 0 else over if tag[over] in UNSEARCHED else self.hidden[over])
            way.append(at)
            self.named.setdefault(name, []).append(at)
            if said is not None:
                self.units.setdefault((name, said), []).append(at)
                if name not in UNSEARCHED and name not in ("part", "subpart"):
                    self.labelled.setdefault(said, []).append(at)

    def find(self, path: str | None) -> list[int]:
        """As ``lookup``; nothing for a path that names no node."""
        if not self.tag:
            return []
        scope, path = 0, (path or "").strip().lower()
        while m := _UNIT.match(path):
            tag = "schedule" if m[1].startswith("sch") else "subpart" if m[1].startswith("sub") else "part"
            rest = m[2]
            if span := re.fullmatch(r"([\w.]+)\s*([-+])\s*([\w.]+)", rest):
                ends = self._first(scope, (tag, span[1])), self._first(scope, (tag, span[3]))
                return [] if None in ends else sorted(set(ends)) if span[2] == "+" else self._between(*ends)
            name = re.match(r"([\w.]+)\s*,?\s*(.*)", rest, re.DOTALL)
            at = self._first(scope, (tag, name[1])) if name else None
            if at is None and name and tag == "part":
                at = self._first(scope, ("head1", f"part {name[1]}"))
            after = name[2] if name else ""
            if at is None:  # a lone schedule has no number; what looked like one belongs to the rest
                at = next(iter(self._inside(self.named.get(tag, []), scope)), None)
                after = re.sub(r"^1\s*,?\s*", "", rest)
            if at is None:
                return []
            if not after:
                return [at]
            scope, path = at, after
        path = _LESSER.sub("", path, count=1)
        if scope == 0:
            scope = self.named.get("body", [0])[0]
        return self._descend(scope, _keys(path))

    def _inside(self, rows: list[int], scope: int) -> list[int]:
        return rows[bisect_right(rows, scope) : bisect_right(rows, self.last[scope])]

    def _least(self, rows: list[int]) -> int | None:
        return min(rows, key=lambda n: (self.depth[n], n), default=None)

    def _first(self, scope: int, unit: tuple[str, str]) -> int | None:
        return self._least(self._inside(self.units.get(unit, []), scope))

    def _between(self, a: int, b: int) -> list[int]:
        rows = self.named[self.tag[a]]
        return [n for n in rows[bisect_right(rows, a - 1) : bisect_right(rows, b)] if self.hidden[n] < 0]

    def _nearest(self, scope: int, label: str) -> int | None:
        rows, way, at = self.labelled.get(label), [], None
        while rows and at is None and scope >= 0:
            if (scope, label) in self.known:
                at = self.known[scope, label]
                break
            way.append(scope)
            at = self._least([n for n in self._inside(rows, scope) if self.hidden[n] <= scope])
            scope = self.parent[scope]
        for scope in way:
            self.known[scope, label] = at
        return at

    def _descend(self, scope: int, keys: list[str]) -> list[int]:
        found: list[int] = []
        for key in keys:
            pieces = re.split(r"([+-])", key)
            at = self._nearest(scope, pieces[0])
            if at is None:
                return []
            now = [at]
            for sign, label in zip(pieces[1::2], pieces[2::2], strict=False):
                end = self._nearest(self.parent[at], label)
                if end is None:
                    return []
                now = sorted({*now, *([end] if sign == "+" else self._between(now[-1], end))})
            found, scope = now, now[-1]
        return [p for p, q in zip(found, [*found[1:], len(self.tag)], strict=False) if q > self.last[p]]


def lookup_udf() -> Callable:
    """(xml, paths) to the places that each path names, none where it names nothing; a document is parsed once, and a worker holds the results of a few."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def every(x: str | None, ps: list | None) -> list[list[int]]:
            own = Tree(x)
            places = Places(own.last, own.tag, own.label)
            return [places.find(p) for p in ([] if ps is None else ps)]

        for xml, paths in batches:
            for k in range(0, len(xml), HELD):
                yield pd.Series([every(x, ps) for x, ps in zip(xml.iloc[k : k + HELD], paths.iloc[k : k + HELD], strict=True)])

    return F.pandas_udf(run, T.ArrayType(T.ArrayType(T.IntegerType())))


def lookup_paths(docs: DataFrame, asked: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(doc_id, path, target): the nodes that paths name; a path that names none has a null target. ``asked``: doc_id, path."""
    wanted = asked.groupBy("doc_id").agg(F.collect_set("path").alias("paths"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(xml_col).alias("xml")).join(wanted, "doc_id")
    found = rows.select("doc_id", "paths", lookup_udf()("xml", "paths").alias("at"))
    each = found.select("doc_id", F.explode(F.arrays_zip(F.col("paths").alias("path"), F.col("at").alias("at"))).alias("x"))
    return each.select("doc_id", "x.path", F.explode_outer("x.at").alias("target"))


def ancestors(nodes: DataFrame, targets: DataFrame, tags: set[str] | None = None) -> DataFrame:
    """(doc_id, target, and the columns of each ancestor, itself included); ``targets``: doc_id, target.

    Targets that carry ``above`` are not looked up for it. ``tags``: only ancestors of these names, which
    ``above`` tells before any join.
    """
    over = F.col("above") if tags is None else F.filter("above", lambda x: x["tag"].isin(*sorted(tags)))
    up = _placed(nodes, targets).withColumn("pre", F.explode(F.transform(over, lambda x: x["pre"]))).drop("above")
    return up.join(nodes if tags is None else nodes.filter(F.col("tag").isin(*sorted(tags))), ["doc_id", "pre"])


def _placed(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with ``above``."""
    return targets if "above" in targets.columns else nodes.select("doc_id", F.col("pre").alias("target"), "above").join(targets, ["doc_id", "target"])


def within(tags: set[str], own: bool = True) -> Column:
    """Whether a node lies within an element of one of these names, itself counted or not."""
    over = F.col("above.tag") if own else F.slice("above.tag", F.lit(1), F.size("above") - 1)
    return F.arrays_overlap(over, F.array(*map(F.lit, sorted(tags))))


def node_paths(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, target, path): labels of the ancestors, by role, innermost last. ``targets``: doc_id, target and, where at hand, ``above``.

    Paragraph and subprovision labels are bracketed unless they hold a dot; a provision is ``s`` or,
    within a schedule, ``cl``; parts are left out.
    """
    own = _placed(nodes, targets).select("doc_id", "target", "above", within({"schedule"}).cast("int").alias("__in"))
    rows = ancestors(nodes, own, {"schedule", "prov", "subprov", "label-para"})
    label = F.coalesce("label", F.lit(""))
    bracketed = F.when(label == "", "").when(F.contains(label, F.lit(".")), label).otherwise(F.concat(F.lit("("), label, F.lit(")")))
    piece = F.when(F.col("tag") == "schedule", F.concat(F.lit("sch "), label)).when(F.col("tag") == "prov", F.concat(F.when(F.col("__in") == 1, " cl ").otherwise("s "), label)).otherwise(bracketed)
    rows = rows.select("doc_id", "target", "depth", piece.alias("piece"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "piece"))), lambda p: p["piece"]), "")
    return rows.groupBy("doc_id", "target").agg(F.trim(F.regexp_replace(path, r"\s+", " ")).alias("path"))


def cull(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with their subtrees, all ancestors, the ancestors' labels, headings, covers and texts, and the nearest crosshead before each target."""
    up = ancestors(nodes, targets).select("doc_id", "pre").distinct()
    below = nodes.withColumn("target", F.explode("above.pre")).join(targets, ["doc_id", "target"], "left_semi").select("doc_id", "pre")
    beside = nodes.filter(F.col("tag").isin(*KEPT_BESIDE)).join(up.withColumnRenamed("pre", "parent"), ["doc_id", "parent"], "left_semi").select("doc_id", "pre")
    own = nodes.select("doc_id", F.col("pre").alias("target"), "parent").join(targets, ["doc_id", "target"])
    heads = nodes.filter("tag = 'crosshead'").select("doc_id", "parent", "pre")
    heads = own.join(heads, ["doc_id", "parent"]).filter("pre < target").groupBy("doc_id", "target").agg(F.max("pre").alias("pre")).select("doc_id", "pre")
    keep = up.unionByName(below).unionByName(beside).unionByName(heads).distinct()
    return nodes.join(keep, ["doc_id", "pre"], "left_semi").join(targets.select("doc_id", F.col("target").alias("pre"), F.lit(True).alias("current")), ["doc_id", "pre"], "left")


def first_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """The first n + 1 nodes of each document, in document order."""
    return nodes.filter(F.col("pre") <= n)


def outline(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, depth, entry) of the nodes with a role; a missing label counts as 1."""
    return _entries(nodes)


def _entries(nodes: DataFrame, *more: Column) -> DataFrame:
    label = F.coalesce("label", F.lit("1"))
    entry = F.when(F.col("tag") == "schedule", F.concat(F.lit("sch "), label)).when(F.col("tag").isin("part", "subpart", "form"), F.concat_ws(" ", "tag", label)).when(F.col("tag") == "prov", F.concat(F.lit("s "), label)).when(F.col("tag") == "head1", label).otherwise(F.concat(F.lit("("), label, F.lit(")")))
    return nodes.filter(F.col("tag").isin(*ROLES)).select("doc_id", "pre", "depth", entry.alias("entry"), *more)


def without(nodes: DataFrame, tags: set[str]) -> DataFrame:
    """The nodes outside all elements of the given tags."""
    return nodes.filter(~within(tags))


def holding(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose whole text contains ``text``; so do their ancestors."""
    return nodes.filter(F.contains("string_value", F.lit(text)))


def definitions_holding(nodes: DataFrame, text: str) -> DataFrame:
    """Definition paragraphs with a defined term that contains ``text``."""
    term = nodes.filter((F.col("tag") == "def-term") & F.contains(F.lower("string_value"), F.lit(text.lower()))).select("doc_id", F.col("pre").alias("target"), F.col("string_value").alias("term"), "above")
    return ancestors(nodes, term, {"def-para"}).select("doc_id", "pre", "term", "string_value")


def best_definition(nodes: DataFrame, text: str) -> DataFrame:
    """Per document, the definition whose term is nearest to ``text`` by edits."""
    rows = definitions_holding(nodes, text).withColumn("distance", F.levenshtein(F.lower("term"), F.lit(text.lower())))
    return rows.groupBy("doc_id").agg(F.min(F.struct("distance", "pre", "term")).alias("b")).select("doc_id", "b.pre", "b.term", "b.distance")


def parts(nodes: DataFrame) -> DataFrame:
    """(doc_id, num, pre, title): the outermost provisions and schedules outside amendments, numbered in order."""
    outer = nodes.filter(F.col("tag").isin("prov", "schedule") & ~within({"prov", "schedule", "amend"}, own=False))
    heads = nodes.filter("tag = 'heading'").select("doc_id", F.col("parent").alias("pre"), F.col("string_value").alias("title"))
    numbered = outer.withColumn("num", F.row_number().over(W.partitionBy("doc_id").orderBy("pre")) - 1)
    return numbered.join(heads, ["doc_id", "pre"], "left").select("doc_id", "num", "pre", "title")


def fragments(nodes: DataFrame) -> DataFrame:
    """(doc_id, num, pre, title, text, ids, locations): the parts with what is in them, ids and paths as ``;`` lists."""
    own = parts(nodes).select("doc_id", F.col("pre").alias("__part"), "num", "title")
    # a node's part is the first element of its way down that can be one, unless an amendment comes before
    part = F.get(F.filter("above", lambda x: x["tag"].isin("prov", "schedule", "amend")), F.lit(0))
    inside = nodes.withColumn("__part", F.when(part["tag"] != "amend", part["pre"])).filter("node_id is not null or pre = __part")
    inside = inside.select("doc_id", "pre", "node_id", "above", "__part", F.when(F.col("pre") == F.col("__part"), F.col("string_value")).alias("string_value")).filter("__part is not null")
    placed = node_paths(nodes, inside.filter("node_id is not null").select("doc_id", F.col("pre").alias("target"), "above")).select("doc_id", F.col("target").alias("pre"), "path")
    inside = inside.drop("above").join(own, ["doc_id", "__part"])
    inside = inside.join(placed, ["doc_id", "pre"], "left")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("node_id").isNotNull(), F.struct("pre", F.coalesce(c, F.lit("")).alias("x"))))), lambda s: s["x"]), ";")
    grouped = inside.groupBy("doc_id", "num", F.col("__part").alias("pre"), "title")
    return grouped.agg(F.max(F.when(F.col("pre") == F.col("__part"), F.col("string_value"))).alias("text"), listed(F.col("node_id")).alias("ids"), listed(F.col("path")).alias("locations"))


def skeleton(nodes: DataFrame) -> DataFrame:
    """The nodes of each document with its parts emptied: the parts' own rows stay, with their number, and all outside them."""
    own = parts(nodes).select("doc_id", "pre", "num")
    inner = nodes.filter(~within({"prov", "schedule"}, own=False) | within({"amend"}, own=False))
    return inner.join(own, ["doc_id", "pre"], "left")


def outer_parts(own: Tree) -> list[int]:
    """The places of a document's parts, as ``parts`` has them, in order."""
    out, until = [], -1
    for at, tag in enumerate(own.tag):
        if at > until and tag in ("prov", "schedule", "amend"):
            until = own.last[at]
            if tag != "amend":
                out.append(at)
    return out


def skeletons(docs: DataFrame, id_col: str, xml_col: str, columns: list[str]) -> DataFrame:
    """``skeleton`` of documents, without a node table between: doc_id, the named columns and ``num``."""

    def keep(own: Tree) -> dict[int, int | None]:
        numbers = {at: k for k, at in enumerate(outer_parts(own))}
        out, part, amend = {}, -1, -1  # the ends of the outermost part, and of the outermost amendment, around a node
        for at, tag in enumerate(own.tag):
            if at > part or at <= amend:
                out[at] = numbers.get(at)
            if at > part and tag in ("prov", "schedule"):
                part = own.last[at]
            if at > amend and tag == "amend":
                amend = own.last[at]
        return out

    return kept(docs, id_col, xml_col, keep, columns).withColumnRenamed("mark", "num")


def culled(docs: DataFrame, id_col: str, xml_col: str, wanted: Callable[[Tree], list[int]], columns: list[str]) -> DataFrame:
    """``cull`` of documents by the places that ``wanted`` gives of each, without a node table between: doc_id, the named columns and ``current``."""

    def keep(own: Tree) -> dict[int, int | None]:
        targets = sorted(set(wanted(own)))
        up, below, heads, until = set(), set(), set(), -1
        over = {own.parent[t] for t in targets}
        shelves: dict[int, list[int]] = {}
        for at, tag in enumerate(own.tag):
            if tag == "crosshead" and own.parent[at] in over:
                shelves.setdefault(own.parent[at], []).append(at)
        for t in targets:
            if t > until:
                until = own.last[t]
                below.update(range(t, until + 1))
            before = shelves.get(own.parent[t], [])
            heads.update(before[(n := bisect_right(before, t - 1)) - 1 : n] if before else [])
            at = t
            while at >= 0 and at not in up:
                up.add(at)
                at = own.parent[at]
        beside = {at for at, tag in enumerate(own.tag) if tag in KEPT_BESIDE and own.parent[at] in up}
        targets = set(targets)
        return {at: 1 if at in targets else None for at in sorted(up | below | beside | heads)}

    return kept(docs, id_col, xml_col, keep, columns).withColumn("current", F.col("mark") == 1).drop("mark")


def document_fragments(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """``fragments`` of documents, without a node table between: (doc_id, num, pre, title, text, ids, locations)."""

    def rows(own: Tree) -> Iterator[tuple]:
        known: dict[int, str] = {}
        for num, part in enumerate(outer_parts(own)):
            inside = range(part, own.last[part] + 1)
            titles = dict.fromkeys(own.string_value(at) for at in inside if own.tag[at] == "heading" and own.parent[at] == part)
            named = [at for at in inside if own.node_id[at] is not None]
            ids, locations = ";".join(own.node_id[at] for at in named), ";".join(_path(own, at, known) for at in named)
            for title in titles or [None]:
                yield num, part, title, own.string_value(part), ids, locations

    return each_document(docs, id_col, xml_col, rows, "num int, pre int, title string, text string, ids string, locations string")


def _path(own: Tree, at: int, known: dict[int, str]) -> str:
    """A node's path, as ``node_paths`` has it; ``known`` are those of the elements that have been asked for."""
    way = []
    while at >= 0:
        if own.tag[at] in ("schedule", "prov", "subprov", "label-para"):
            if not way and at in known:
                return known[at]
            way.append(at)
        at = own.parent[at]
    inside = any(own.tag[k] == "schedule" for k in way)
    pieces = []
    for k in reversed(way):
        label = own.label[k] or ""
        pieces.append(f"sch {label}" if own.tag[k] == "schedule" else f"{' cl ' if inside else 's '}{label}" if own.tag[k] == "prov" else label if not label or "." in label else f"({label})")
    said = re.sub(r"\s+", " ", "".join(pieces), flags=re.ASCII).strip(" ")
    if way:
        known[way[0]] = said
    return said


def nested_outline(nodes: DataFrame, depth: int = 12) -> DataFrame:
    """(doc_id, outline): the outline as nested JSON, each entry a label and its children.

    Entries join their parents from the deepest level up, ``depth`` levels of them; deeper ones raise.
    """
    roles = F.filter("above", lambda x: x["tag"].isin(*ROLES))
    flat = _entries(nodes, roles.alias("roles"))
    flat = flat.select("doc_id", "pre", "entry", F.size("roles").alias("level"), F.get("roles", F.size("roles") - 2)["pre"].alias("over"))
    flat = flat.withColumn("level", F.when(F.col("level") > depth, F.raise_error(F.lit("an outline is deeper than its bound"))).otherwise(F.col("level")))
    flat = materialise(flat, "outline")  # each level reads it

    def said(children: Column) -> Column:
        return F.concat(F.lit('{"label":'), F.to_json(F.array("entry")).substr(F.lit(2), F.length(F.to_json(F.array("entry"))) - 2), F.lit(',"children":['), F.coalesce(children, F.lit("")), F.lit("]}"))

    below = None
    for level in range(depth, 0, -1):
        own = flat.filter(F.col("level") == level)
        if below is not None:
            own = own.join(below, ["doc_id", "pre"], "left")
        own = own.select("doc_id", "over", "pre", said(F.col("children") if below is not None else F.lit("")).alias("json"))
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "json"))), lambda x: x["json"]), ",")
        below = own.groupBy("doc_id", F.col("over").alias("pre")).agg(ordered.alias("children"))
    return below.select("doc_id", F.concat(F.lit("["), "children", F.lit("]")).alias("outline"))


def citations(nodes: DataFrame, targets: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, target, citation, url, path): how a node is cited, where it is found, and its path. ``titles``: doc_id, title."""
    placed = node_paths(nodes, targets).join(nodes.select("doc_id", F.col("pre").alias("target"), "node_id"), ["doc_id", "target"]).join(titles, "doc_id")
    query = F.concat(F.lit("query?"), F.concat_ws("&", F.concat(F.lit("doc_type=instrument&find=location&id="), "doc_id"), F.concat(F.lit("location="), F.url_encode("path"))))
    return placed.select("doc_id", "target", F.concat_ws(" ", "title", "path").alias("citation"), query.alias("url"), "path")


def root_dates(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(doc_id, assent, reprint): dates of the root's attributes in words, null where they are none."""
    from ..functions.scalars import long_date, safe_date

    attr = lambda n: F.nullif(F.regexp_extract(F.regexp_extract(xml_col, r"(?s)^\s*(?:<\?.*?\?>\s*)?(<[^!?][^>]*>)", 1), rf'{n}="([^"]*)"', 1), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), long_date(safe_date(attr(r"date\.assent"))).alias("assent"), long_date(safe_date(attr(r"date\.as\.at"))).alias("reprint"))


def id_registry(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id), once each."""
    return nodes.filter("node_id is not null").select("doc_id", "node_id").distinct()


def references(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Links whose target is a known id: source document, id, target document, text."""
    return referred(without(nodes, UNLINKED).filter("href is not null"), known)


def referred(links: DataFrame, known: DataFrame) -> DataFrame:
    """``references`` of nodes that are links: doc_id, href, string_value. ``known``: doc_id, node_id, also more than once."""
    found = links.select(F.col("doc_id").alias("source"), F.col("href").alias("node_id"), F.col("string_value").alias("link_text"))
    lookup_rows = known.groupBy("node_id").agg(F.min("doc_id").alias("target"))
    return found.join(lookup_rows, "node_id")


def link_nodes(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """doc_id, href, string_value of the links that ``references`` takes, without a node table between."""

    def keep(own: Tree) -> dict[int, None]:
        out, until = {}, -1
        for at, tag in enumerate(own.tag):
            if at > until and tag in UNLINKED:
                until = own.last[at]
            if at > until and own.href[at] is not None:
                out[at] = None
        return out

    return kept(docs, id_col, xml_col, keep, ["href", "string_value"]).drop("mark")
