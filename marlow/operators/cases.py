"""Judgments: fields, parties and checks over a table of lines (doc, line_no, text)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Anchors of a judgment's fields.
FIELDS = {
    "neutral_citation": r"\[(?:19|20)\d{2}\]\s+[A-Z]{2,6}\s+\d+",
    "hearing": r"(?i)^\s*(?:hearing|heard)\s*:?\s*(.+)$",
    "judgment": r"(?i)^\s*judgment\s*:?\s*(.+)$",
    "bench": r"(?i)^\s*(?:bench|before|coram)\s*:?\s*(.+)$",
    "counsel": r"(?i)^\s*(?:counsel|appearances?)\s*:?\s*(.+)$",
    "plea": r"(?i)^\s*plea\s*:?\s*(.+)$",
    "court_file": r"\b[A-Z]{2,4}[ -]?\d{4}-\d{3}-\d+\b",
}


def find_fields(lines: DataFrame, key: str, place: str, text: str, fields: dict[str, str] = FIELDS) -> DataFrame:
    """One row per document: the first line that holds each field, and what it says."""
    def hit(pattern: str) -> Column:
        groups = 1 if pattern.count("(") > pattern.count("(?") + pattern.count(r"\(") else 0
        return F.nullif(F.trim(F.regexp_extract(text, pattern, groups)), F.lit(""))

    each = lines.select(key, place, *(hit(p).alias(n) for n, p in fields.items()))
    return each.groupBy(key).agg(*(F.min_by(n, F.when(F.col(n).isNotNull(), F.col(place))).alias(n) for n in fields))


def walk(lines: DataFrame, key: str, place: str, start: Column, going: Column) -> DataFrame:
    """Lines after each start for as long as ``going`` holds: gaps and islands, no loop."""
    w = W.partitionBy(key).orderBy(place)
    marked = lines.withColumn("run", F.sum(F.when(start, 1).otherwise(0)).over(w)).filter("run > 0").withColumn("__start", start)
    ok = F.min(F.when(F.col("__start") | going, 1).otherwise(0)).over(W.partitionBy(key, "run").orderBy(place))
    return marked.withColumn("__ok", ok).filter("__ok = 1").drop("__ok", "__start")


#: Headings of the parts of an intituling, and words that qualify a party.
ROLES = {"BETWEEN": "plaintiffs", "AND": "defendants", "AND BETWEEN": "plaintiffs", "THIRD PARTY": "thirdparties", "INTERVENERS?": "thirdparties"}
DESCRIPTOR = r"(?i)^\s*(?:first |second |third |fourth )?(plaintiffs?|defendants?|appellants?|respondents?|applicants?|intervener|third part(?:y|ies))\s*$"
QUALIFIER = r"(?i)^\s*(UNDER|IN THE MATTER(?: OF)?|IN RE|EX PARTE)\b\s*(.*)$"


def _closes(text: str) -> Column:
    """Whether a line is the first after the parties: a field, a heading of the body, a qualifier or a numbered line."""
    field = F.lit(False)
    for pattern in FIELDS.values():
        field = field | F.col(text).rlike(pattern)
    return field | F.col(text).rlike(QUALIFIER) | F.col(text).rlike(r"^\s*(?:\[\d+\]|\d+\.|_{3,}|-{3,})")


def party_lines(lines: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """(key, place, role, name, descriptor): the lines under a party heading up to the next field or heading.

    A line that only says what the party is, such as *First defendant*, is the descriptor of the line before.
    """
    head = F.upper(F.trim(text))
    role = reduce(lambda out, kv: out.when(head.rlike(f"^(?:{kv[0]})$"), kv[1]), ROLES.items(), F.when(_closes(text), "none"))
    w = W.partitionBy(key).orderBy(place)
    named = lines.withColumn("__head", role).withColumn("role", F.last("__head", ignorenulls=True).over(w)).filter(F.col("__head").isNull() & (F.col("role") != "none") & (F.trim(text) != ""))
    named = named.withColumn("__says", F.nullif(F.regexp_extract(text, DESCRIPTOR, 1), F.lit("")))
    named = named.withColumn("descriptor", F.lead("__says").over(W.partitionBy(key, "role").orderBy(place)))
    return named.filter("__says is null").select(key, place, "role", F.trim(text).alias("name"), F.lower("descriptor").alias("descriptor"))


def parties(lines: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """(key, plaintiffs, defendants, thirdparties): what stands under BETWEEN and AND, or on both sides of ``v``."""
    named = party_lines(lines, key, place, text)
    ordered = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct(place, "name")))), lambda s: s["name"]), "; ")
    under = named.groupBy(key).agg(*(F.nullif(ordered(r), F.lit("")).alias(r) for r in ("plaintiffs", "defendants", "thirdparties")))
    versus = lines.select(key, place, F.regexp_extract(text, r"^(.*?)\s+v\.?\s+(.*)$", 1).alias("m"), F.regexp_extract(text, r"^(.*?)\s+v\.?\s+(.*)$", 2).alias("n")).filter("m <> ''")
    versus = versus.groupBy(key).agg(F.min_by(F.trim("m"), place).alias("a"), F.min_by(F.trim("n"), place).alias("b"))
    out = lines.select(key).distinct().join(under, key, "left").join(versus, key, "left")
    return out.select(key, F.coalesce("plaintiffs", "a").alias("plaintiffs"), F.coalesce("defendants", "b").alias("defendants"), "thirdparties")


def matters(lines: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """(key, place, qualifier, value): lines under *UNDER*, *IN THE MATTER OF* and the like, with those that go on to the next."""
    w = W.partitionBy(key).orderBy(place)
    head = F.nullif(F.upper(F.regexp_extract(text, QUALIFIER, 1)), F.lit(""))
    stop = F.upper(F.trim(text)).rlike("^(?:" + "|".join(ROLES) + ")$") | F.trim(text).rlike(r"^$")
    for pattern in FIELDS.values():
        stop = stop | F.col(text).rlike(pattern)
    marked = lines.withColumn("__head", head).withColumn("matter", F.sum(F.when(head.isNotNull() | stop, 1).otherwise(0)).over(w))
    own = marked.withColumn("qualifier", F.first("__head").over(W.partitionBy(key, "matter").orderBy(place))).filter("qualifier is not null")
    said = F.when(F.col("__head").isNotNull(), F.regexp_extract(text, QUALIFIER, 2)).otherwise(F.trim(text))
    value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, said.alias("v")))), lambda s: s["v"]), " ")
    return own.groupBy(key, "matter").agg(F.min(place).alias(place), F.first("qualifier").alias("qualifier"), F.trim(value).alias("value")).drop("matter")


def matters_and_parties(lines: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """(key, set, place, kind, label, value, court_file): the matters and parties of an intituling, by set.

    Matters and parties may follow one another several times; a matter after parties opens the next set,
    so each reading takes up where the other has stopped. A set has the court file on the line before
    its first matter; where a judgment has no parties, its first set has the first court file of all. What
    stands from the first numbered paragraph on is no intituling.
    """
    order = W.partitionBy(key).orderBy(place)
    begun = F.max(F.when(F.col(text).rlike(r"^\s*\[\d+\]"), 1).otherwise(0)).over(order)
    head = lines.select(key, place, text, begun.alias("__begun")).filter("__begun = 0").drop("__begun")
    found = matters(head, key, place, text).select(key, place, F.lit("matter").alias("kind"), F.col("qualifier").alias("label"), "value")
    named = party_lines(head, key, place, text).select(key, place, F.lit("party").alias("kind"), F.col("role").alias("label"), F.col("name").alias("value"))
    each = found.unionByName(named).withColumn("__opens", F.when((F.col("kind") == "matter") & (F.lag("kind").over(order) == "party"), 1).otherwise(0))
    each = each.withColumn("set", F.sum("__opens").over(order) + 1).drop("__opens")
    pattern = FIELDS["court_file"]
    files = head.withColumn("__next", F.lead(place).over(order)).withColumn("file", F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))).filter("file is not null")
    firsts = each.filter("kind = 'matter'").groupBy(key, "set").agg(F.min(place).alias("__next"))
    before = firsts.join(files.select(key, "__next", "file"), [key, "__next"]).select(key, "set", "file")
    lone = files.groupBy(key).agg(F.min_by("file", place).alias("__lone")).join(named.select(key).distinct(), key, "left_anti")
    out = each.join(before, [key, "set"], "left").join(lone, key, "left")
    return out.select(key, "set", place, "kind", "label", "value", F.coalesce("file", F.when(F.col("set") == 1, F.col("__lone"))).alias("court_file"))


def body_kinds(lines: DataFrame, text: str) -> DataFrame:
    """Each line with its kind (paragraph, title, list, text) and its label."""
    number = F.regexp_extract(text, r"^\s*\[(\d+)\]", 1)
    item = F.regexp_extract(text, r"^\s*(?:\(([a-z]|[ivxl]+|\d+)\)|([•*-])\s)", 1)
    bullet = F.regexp_extract(text, r"^\s*([•*-])\s", 1)
    kind = F.when(number != "", "paragraph").when((item != "") | (bullet != ""), "list").when((F.upper(text) == F.col(text)) & F.col(text).rlike("[A-Z]"), "title").otherwise("text")
    return lines.withColumn("kind", kind).withColumn("label", F.nullif(F.concat(number, item, bullet), F.lit("")))


def validate(fields: DataFrame, parties_table: DataFrame, key: str, least_citation: int = 20) -> DataFrame:
    """A row per fault: no parties, no or too short a citation, no waistband."""
    rows = fields.join(parties_table, key, "left")
    faults = F.array_compact(F.array(
        F.when(F.col("plaintiffs").isNull() | F.col("defendants").isNull(), F.lit("parties")),
        F.when(F.coalesce(F.length("full_citation"), F.lit(0)) < least_citation, F.lit("citation")),
        F.when(F.col("waistband").isNull(), F.lit("waistband")),
    ))
    return rows.select(key, F.explode(faults).alias("fault"))


def paragraph_anchors(lines: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """(key, number, place): the ``[n]`` that continue the count, each the first after the one before.

    Whether a line counts hangs on all that counted before it, which no window function says; one pass
    over a document's numbered lines does.
    """
    found = lines.withColumn("number", F.regexp_extract(text, r"^\s*\[(\d+)\]", 1).try_cast("int")).filter("number is not null").select(key, "number", F.col(place).cast("long").alias("place"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, good, due = rows.sort_values("place"), [], 1
        for n in rows["number"]:
            good.append(n == due)
            due += n == due
        return rows[good]

    return found.groupBy(key).applyInPandas(run, found.schema)


#: The parts of a judgment's head and body: a line that opens each, a line that ends it, and whether it takes more than its first line.
RULES = [
    ("court", r"(?i)^\s*in the (?:high court|court of appeal|supreme court|district court)\b", None, False),
    ("registry", r"(?i)\bregistry\s*$", None, False),
    ("court_file", FIELDS["court_file"], None, False),
    ("neutral_citation", FIELDS["neutral_citation"], None, False),
    ("matter", QUALIFIER, r"^\s*$", True),
    ("parties", r"(?i)^\s*between\s*$", r"(?i)^\s*(?:hearing|heard|judgment|counsel|appearances?)\b", True),
    ("hearing", FIELDS["hearing"], None, False),
    ("counsel", FIELDS["counsel"], r"^\s*$|^\s*[Jj]udgment\b|^[A-Z][A-Z ]+$", True),
    ("judgment", FIELDS["judgment"], None, False),
    ("bench", FIELDS["bench"], None, False),
    ("solicitor", r"(?i)^\s*solicitors?\s*:?", r"^\s*(?:\[\d+\]|$)", True),
    ("body", r"^\s*\[1\]", None, True),
]


def match(lines: DataFrame, key: str, place: str, text: str, rules: list[tuple[str, str, str | None, bool]] = RULES) -> DataFrame:
    """(key, place, rule, text): each line with the rule it belongs to, null where none holds.

    A line that opens a rule ends the one before; a rule of one line ends after it; one of several goes
    on until a line ends it or opens another. The last rule of the table, once open, takes the rest.
    """
    import re

    ready = [(name, re.compile(_python(start)), re.compile(_python(stop)) if stop else None, more) for name, start, stop, more in rules]
    final = rules[-1][0]
    own = lines.select(key, F.col(place).cast("long").alias("place"), F.col(text).alias("text"))
    schema = T.StructType([*own.schema.fields, T.StructField("rule", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now = object(), None
        for batch in batches:
            out = []
            for k, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != of and (k == k or of == of):  # NaN is one key
                    of, now = k, None
                said = line or ""
                opened = next((r for r in ready if r[1].search(said)), None) if now is None or now[0] != final else None
                if opened is not None:
                    now = opened
                elif now is not None and (not now[3] or (now[2] is not None and now[2].search(said))):
                    now = None
                out.append(None if now is None else now[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], schema.names)

    # the documents of a partition one after the other: a worker reads lines as they come
    dealt = own.repartition(F.col(key)).sortWithinPartitions(key, F.asc_nulls_last("place"))
    return dealt.mapInArrow(run, schema).select(key, "place", "rule", "text")


def _python(pattern: str) -> str:
    """A pattern whose ``(?i)`` may come late, for Python: the flag holds for the whole of it."""
    return ("(?i)" if "(?i)" in pattern else "") + pattern.replace("(?i)", "")


def assembled(matched: DataFrame, key: str, rules: list[tuple[str, str, str | None, bool]] = RULES) -> DataFrame:
    """One row per document, a column per rule in the table's order: the text of its lines, one under the other."""
    lines = F.array_sort(F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("place", F.coalesce("text", F.lit("")).alias("t")))))
    each = matched.repartition(F.col(key)).groupBy(key, "rule").agg(F.nullif(F.array_join(F.transform(lines, lambda x: x["t"]), "\n"), F.lit("")).alias("__said"))
    told = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("rule", "__said")))).alias("__told"))
    return told.select(key, *(F.col("__told")[name].alias(name) for name, *_ in rules))


def body_flags(lines: DataFrame, text: str, left: str, usual: str, font: str, bold: str) -> DataFrame:
    """Lines with what their place and face say: quotations are indented and smaller, titles bold or in capitals, and the rest runs on."""
    title = F.col(bold) | ((F.upper(text) == F.col(text)) & F.col(text).rlike("[A-Z]{2}"))
    quote = (F.col(left) > F.col(usual) + 18) & (F.col(font) < 12)
    item = F.col(text).rlike(r"^\s*(?:\([a-z]{1,4}\)|[•*-]\s)")
    return lines.withColumns({"is_quote": quote & ~item, "is_item": item, "is_title": title & ~quote & ~item, "runs_on": ~F.col(text).rlike(r"[.:;?!]\s*$") & ~title})


def clean_markup_udf(inline: tuple[str, ...] = ("b", "i", "em", "strong", "span", "style")):
    """XML without empty inline elements, and with neighbours of one style as one; null for null and for what is not XML."""
    import xml.etree.ElementTree as ET

    def tidy(e: ET.Element) -> None:
        kept: list[ET.Element] = []
        for c in list(e):
            tidy(c)
            before = kept[-1] if kept else None
            if c.tag in inline and not len(c) and not (c.text or "").strip():
                gap = (c.text or "") + (c.tail or "")
                if before is not None:
                    before.tail = (before.tail or "") + gap
                else:
                    e.text = (e.text or "") + gap
                e.remove(c)
            elif before is not None and c.tag in inline and c.tag == before.tag and c.attrib == before.attrib and not (before.tail or "").strip():
                said = (before.tail or "") + (c.text or "")
                if len(before):
                    before[-1].tail = (before[-1].tail or "") + said
                else:
                    before.text = (before.text or "") + said
                before.extend(list(c))
                before.tail = c.tail
                e.remove(c)
            else:
                kept.append(c)

    def one(x: str) -> str | None:
        try:
            root = ET.fromstring(x)
        except ET.ParseError:
            return None
        tidy(root)
        return ET.tostring(root, encoding="unicode")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run
