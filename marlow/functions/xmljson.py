"""XML as JSON and back: ``@name`` attributes, ``#text`` and ``#tail``, repeated children as lists."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_value(e: ET.Element, attributes: bool = True) -> dict | str | None:
    out: dict = {f"@{k}": v for k, v in e.attrib.items()} if attributes else {}
    for child in e:
        name, value = child.tag.rpartition("}")[2], to_value(child, attributes)
        if child.tail and child.tail.strip():
            value = (value if isinstance(value, dict) else {"#text": value} if value is not None else {}) | {"#tail": child.tail.strip()}
        if name in out:
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
        else:
            out[name] = value
    text = (e.text or "").strip()
    if not out:
        return text or None
    return out | ({"#text": text} if text else {})


def xml_to_json(xml: str | None, attributes: bool = True) -> str | None:
    """Null for null and for what is not XML."""
    try:
        root = ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return None
    return None if root is None else json.dumps({root.tag.rpartition("}")[2]: to_value(root, attributes)}, ensure_ascii=False)


def _build(name: str, value: object) -> ET.Element:
    e = ET.Element(name)
    for k, v in value.items() if isinstance(value, dict) else ():
        if k.startswith("@"):
            e.set(k[1:], str(v))
        elif k == "#text":
            e.text = str(v)
        elif k == "#tail":
            e.tail = str(v)
        else:
            e.extend(_build(k, x) for x in (v if isinstance(v, list) else [v]))
    if not isinstance(value, dict) and value is not None:
        e.text = str(value)
    return e


def json_to_xml(text: str | None) -> str | None:
    """The element that a JSON object with one key stands for."""
    if text is None:
        return None
    value = json.loads(text)
    if not isinstance(value, dict) or len(value) != 1:
        raise ValueError("one root is needed")
    ((name, inner),) = value.items()
    return ET.tostring(_build(name, inner), encoding="unicode")


@F.pandas_udf(T.StringType())
def xml_to_json_udf(s: pd.Series) -> pd.Series:
    return s.map(xml_to_json, na_action="ignore")


def tree_value(e: ET.Element, end: str | None = None) -> dict:
    """An element as tag, attributes, texts and children; the children of one with the attribute ``end`` are left out."""
    out: dict = {"tag": e.tag.rpartition("}")[2]} | {f"@{k}": v for k, v in e.attrib.items()}
    for name, text in (("#text", e.text), ("#tail", e.tail)):
        if text and text.strip():
            out[name] = text.strip()
    children = [] if end is not None and e.get(end) is not None else [tree_value(c, end) for c in e if isinstance(c.tag, str)]
    return out | ({"children": children} if children else {})


def tree_json_udf(end: str | None = None):
    """XML to the JSON of ``tree_value``; null for null and for what is not XML."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x: str) -> str | None:
            try:
                return json.dumps(tree_value(ET.fromstring(x), end), ensure_ascii=False)
            except ET.ParseError:
                return None

        return s.map(one, na_action="ignore")

    return run


def same_tree(a: ET.Element, b: ET.Element, attributes: bool = True) -> bool:
    """Equal names, texts and ordered children, and attributes if asked for; ``*`` stands for any text."""
    def same(x: str | None, y: str | None) -> bool:
        x, y = (x or "").strip(), (y or "").strip()
        return x == y or "*" in (x, y)

    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.tag != y.tag or not same(x.text, y.text) or not same(x.tail, y.tail) or len(x) != len(y):
            return False
        if attributes and (set(x.attrib) != set(y.attrib) or not all(same(v, y.get(k)) for k, v in x.attrib.items())):
            return False
        todo.extend(zip(x, y, strict=True))
    return True


def same_xml_udf(attributes: bool = True):
    """Whether two XML texts are the same tree; null where one is null or not XML."""

    @F.pandas_udf(T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> bool | None:
            try:
                return None if x is None or y is None else same_tree(ET.fromstring(x), ET.fromstring(y), attributes)
            except ET.ParseError:
                return None

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run
