"""An HTML view of documents: structure with locations, tables, equations, schedules, bills, forms, definitions, judgments and contents.

It keeps what a document says and where; it is not the layout of any publisher. An element's rule is
found by its name; one without a rule becomes a ``div`` of its own class.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from html import escape

import pandas as pd
from pyspark.sql import types as T

from .slices import sliced

#: Elements by the HTML element that shows them; all others are a ``div``.
SHOWN = {
    "span": "label citation emphasis title leg-title amending-leg intref extref catalex-def quote.in variable leg-id".split(), "h4": ["heading"], "h5": ["crosshead", "head2"], "h3": ["head1"], "dfn": ["def-term"], "section": ["part", "subpart", "schedule", "prov"],
    "tbody": ["tbody"], "thead": ["thead"], "tr": ["row"], "p": ["text"], "blockquote": ["amend", "quote"], "ul": ["list"], "li": ["item"], "sup": ["superscript", "footnote-ref"], "sub": ["subscript"], "strong": ["bold"], "em": ["italic", "emphasis"],
    "ins": ["insert", "insertwords", "added"], "del": ["strike", "deleted", "repealed"], "header": ["cover", "intituling"], "footer": ["end", "signature.block"], "figcaption": ["figure.title"], "address": ["solicitor", "counsel"],
}
_HTML = {tag: html for html, tags in SHOWN.items() for tag in tags}
#: How an element's label reads in a location.
ROLES = {"part": "part {}", "subpart": "subpart {}", "schedule": "sch {}", "prov": "s {}", "subprov": "({})", "label-para": "({})", "form": "form {}"}
#: The fields of a judgment's head and how they are titled.
CASE_FIELDS = {"court": "Court", "registry": "Registry", "neutral-citation": "Citation", "full-citation": "Case", "hearing": "Hearing", "judgment": "Judgment", "bench": "Before", "plea": "Plea", "court-file": "File"}
#: MathML names of the parts of an equation.
MATH = {"equation": "math", "fraction": "mfrac", "numerator": "mrow", "denominator": "mrow", "squareroot": "msqrt", "eq.superscript": "msup", "eq.subscript": "msub", "brackets": "mrow", "operator": "mo", "number": "mn", "eq.variable": "mi", "line": "mrow"}


def name_of(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


class Renderer:
    """One document's rendering; ``cut`` bounds the elements that are shown."""

    def __init__(self, cut: int | None = None, changes: bool = True) -> None:
        self.left, self.changes = -1 if cut is None else cut, changes

    def inner(self, e: ET.Element, path: str) -> str:
        return escape(e.text or "") + "".join(self.element(c, path) + escape(c.tail or "") for c in e if isinstance(c.tag, str))

    def location(self, e: ET.Element, path: str) -> str:
        """The path of an element: its role and label after those of the elements around it."""
        tag = name_of(e)
        label = next(("".join(c.itertext()).strip() for c in e if isinstance(c.tag, str) and name_of(c) == "label"), "")
        if tag not in ROLES or not label:
            return path
        said = ROLES[tag].format(label) if "." not in label or tag not in ("subprov", "label-para") else label
        if tag == "prov" and "sch " in path:
            said = f"cl {label}"
        return path + said if said.startswith("(") else f"{path} {said}".strip()

    def element(self, e: ET.Element, path: str = "") -> str:
        if self.left == 0:
            return ""
        self.left -= 1
        tag = name_of(e)
        rule: Callable[[ET.Element, str], str] | None = getattr(self, "_" + tag.replace("-", "_").replace(".", "_"), None)
        if rule is not None:
            return rule(e, path)
        if tag in CASE_FIELDS:
            return f'<div class="{tag}"{self.extra(e)}><span class="field">{CASE_FIELDS[tag]}</span> {self.inner(e, path)}</div>'
        if tag in MATH:
            return f"<{MATH[tag]}{self.extra(e)}>{self.inner(e, path)}</{MATH[tag]}>"
        if e.get("href"):
            return f'<a class="{tag}" href="#{escape(e.get("href"))}"{self.extra(e)}>{self.inner(e, path)}</a>'
        here = self.location(e, path)
        shown = _HTML.get(tag, "div")
        if shown in ("ins", "del") and not self.changes:
            return "" if shown == "del" else self.inner(e, here)
        where = f' data-location="{escape(here)}"' if here != path else ""
        return f'<{shown} class="{tag}"{self.extra(e)}{where}>{self.inner(e, here)}</{shown}>'

    @staticmethod
    def extra(e: ET.Element) -> str:
        return f' id="{escape(e.get("id"))}"' if e.get("id") else ""

    def _tgroup(self, e: ET.Element, path: str) -> str:
        """Columns by their share of the widths, entries with their spans."""
        columns = [c for c in e if isinstance(c.tag, str) and name_of(c) == "colspec"]
        widths = [float("".join(x for x in (c.get("colwidth") or "1") if x.isdigit() or x == ".") or 1) for c in columns]
        total = sum(widths) or 1
        self.places = {c.get("colname") or str(k): k for k, c in enumerate(columns)}
        shares = "".join(f'<col style="width: {round(100 * w / total)}%">' for w in widths)
        rows = "".join(self.element(c, path) for c in e if isinstance(c.tag, str) and name_of(c) != "colspec")
        return f"<colgroup>{shares}</colgroup>{rows}" if shares else rows

    def _table(self, e: ET.Element, path: str) -> str:
        return f"<table{self.extra(e)}>{self.inner(e, path)}</table>"

    def _entry(self, e: ET.Element, path: str) -> str:
        places = getattr(self, "places", {})
        span = places.get(e.get("nameend"), 0) - places.get(e.get("namest"), 0) + 1 if e.get("namest") in places and e.get("nameend") in places else 1
        down = int(e.get("morerows") or 0) + 1
        said = (f' colspan="{span}"' if span > 1 else "") + (f' rowspan="{down}"' if down > 1 else "") + (f' align="{escape(e.get("align"))}"' if e.get("align") else "")
        return f"<td{self.extra(e)}{said}>{self.inner(e, path)}</td>"

    def _graphic(self, e: ET.Element, path: str) -> str:
        return f'<img alt="{escape(e.get("alt") or "")}" src="{escape(e.get("file") or e.get("src") or "")}"{self.extra(e)}>'

    def _def_para(self, e: ET.Element, path: str) -> str:
        """A definition, told by its term and the ids that it has."""
        term = next((" ".join("".join(x.itertext()).split()) for x in e.iter() if isinstance(x.tag, str) and name_of(x) == "def-term"), "")
        return f'<div class="def-para"{self.extra(e)} data-term="{escape(term)}">{self.inner(e, path)}</div>'

    def _footnote(self, e: ET.Element, path: str) -> str:
        return f'<aside class="footnote" data-key="{escape(e.get("key") or e.get("id") or "")}"><sup>{escape(e.get("key") or "")}</sup>{self.inner(e, path)}</aside>'

    def _paragraph(self, e: ET.Element, path: str) -> str:
        """A judgment's numbered paragraph, with the anchor of its number."""
        number = next(("".join(c.itertext()).strip(" []") for c in e if isinstance(c.tag, str) and name_of(c) == "label"), "")
        return f'<div class="paragraph" id="para-{escape(number)}">{self.inner(e, path)}</div>' if number else f'<div class="paragraph">{self.inner(e, path)}</div>'


class Fragmented(Renderer):
    """A document's skeleton, and its parts one by one: the outermost provisions and schedules outside amendments."""

    def __init__(self, changes: bool = True) -> None:
        super().__init__(None, changes)
        self.parts: list[str] = []
        self.whole = False

    def element(self, e: ET.Element, path: str = "") -> str:
        if self.whole or name_of(e) not in ("prov", "schedule", "amend"):
            return super().element(e, path)
        self.whole = True
        said = super().element(e, path)
        self.whole = False
        if name_of(e) == "amend":
            return said
        self.parts.append(said)
        here = self.location(e, path)
        return f'<div class="part" data-part="{len(self.parts) - 1}" data-location="{escape(here)}"></div>'


def fragmented(xml: str | None, changes: bool = True) -> tuple[str, list[str]] | None:
    """HTML of a document with its parts emptied, and that of each part, in order: put back in their places they are the document's HTML."""
    root = _root(xml)
    if root is None:
        return None
    own = Fragmented(changes)
    return own.element(root), own.parts


def _root(xml: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return None


def render(xml: str | None, cut: int | None = None, changes: bool = True) -> str | None:
    """HTML of a document, or of its first ``cut`` elements; null for what is not XML.

    Without ``changes`` a draft reads as if its insertions and deletions were made.
    """
    root = _root(xml)
    return None if root is None else Renderer(cut, changes).element(root)


def contents(xml: str | None) -> str | None:
    """The table of contents as nested lists: parts, schedules, subparts, heads and provisions, but for those with ``toc="no"``."""
    root = _root(xml)
    if root is None:
        return None
    own = Renderer()

    def entries(e: ET.Element, path: str) -> str:
        out = []
        for c in (c for c in e if isinstance(c.tag, str)):
            here = own.location(c, path)
            if name_of(c) in ("part", "schedule", "subpart", "head1", "prov") and c.get("toc") != "no":
                said = {name_of(x): " ".join("".join(x.itertext()).split()) for x in reversed(c) if isinstance(x.tag, str) and name_of(x) in ("label", "heading")}
                below = entries(c, here)
                out.append(f'<li data-location="{escape(here)}">{escape(" ".join(filter(None, [said.get("label"), said.get("heading")])))}{f"<ul>{below}</ul>" if below else ""}</li>')
            else:
                out.append(entries(c, here))
        return "".join(out)

    return f"<ul>{entries(root, '')}</ul>"


def render_udf(cut: int | None = None, changes: bool = True) -> Callable:
    return sliced(lambda s: s.map(lambda x: render(x, cut, changes), na_action="ignore"), T.StringType())


def fragmented_udf(changes: bool = True) -> Callable:
    """struct(skeleton, parts); null for what is not XML."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [fragmented(x, changes) or (None, None) for x in s]
        return pd.DataFrame(rows, columns=["skeleton", "parts"])

    return sliced(run, "skeleton string, parts array<string>", frame=True)


contents_udf = sliced(lambda s: s.map(contents, na_action="ignore"), T.StringType())
