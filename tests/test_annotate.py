"""Dictionary hits of any length, annotation within scopes, and what is derived from definitions; and small text operators."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from marlow.functions import xmljson
from marlow.operators import annotate, index, links, records, text, tree

XML = """<act id="A"><body id="B"><part id="P"><label>1</label><prov id="S"><label>1</label><prov.body><subprov id="U"><label>1</label><para><text>In this Part,</text>
<def-para id="D1"><para><text><def-term id="T1">port dues</def-term> means tolls</text></para></def-para><def-para id="D2"><para><text><def-term id="T2">ship</def-term> includes boats</text></para></def-para></para></subprov></prov.body></prov>
<prov id="S2"><label>2</label><prov.body><subprov id="U2"><label>1</label><para><text>The Ships pay port dues; a Ship's dues</text></para></subprov></prov.body></prov></part>
<prov id="S3"><label>3</label><prov.body><subprov id="U3"><label>1</label><para><text>No port dues for a ship here</text></para></subprov></prov.body></prov></body></act>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return tree.node_table(spark.createDataFrame([(1, XML), (2, None), (3, "<a")], "doc_id long, xml string"), "doc_id", "xml")


def test_terms_of_any_length(spark, monkeypatch):
    terms = spark.createDataFrame([("the",), ("the Act of the long and very old title of 1908",), ("old title",), ("of",), (None,), ("",)], "term string")
    texts = spark.createDataFrame([(1, "see the Act of the long and very old title of 1908, the old title of it"), (2, None), (3, ""), (4, "The")], "id long, t string")
    want = [(1, 1, "the Act of the long and very old title of 1908"), (1, 12, "the"), (1, 13, "old title"), (1, 15, "of")]
    for bound in (annotate.FIRST_WORDS, 0):  # broadcast, and salted
        monkeypatch.setattr(annotate, "FIRST_WORDS", bound)
        got = annotate.occurrences(texts, terms, ["id"], "t", "term")
        assert sorted((r.id, r.start, r.term) for r in got.collect()) == want
    folded = annotate.occurrences(texts, terms, ["id"], "t", "term", ignore_case=True).filter("id = 4").collect()
    assert [(r.term, r.said) for r in folded] == [("the", "The")]


def test_annotation_within_scope(nodes):
    got = annotate.annotate(nodes, annotate.extract(nodes)).orderBy("pre", "start").collect()
    assert [(r.said, r.ids) for r in got] == [("Ships", "T2"), ("port dues", "T1"), ("Ship's", "T2")]  # nothing outside the part


NAMED = """<act id="A"><body id="B"><part id="P"><label>1</label><prov id="S1"><label>1</label><prov.body><subprov id="U1"><label>1</label><para><text>{}</text>
<def-para><para><text><def-term id="T">ship</def-term> means a boat, see <link href="S3">section 3</link></text></para></def-para></para></subprov></prov.body></prov>
<prov id="S2"><label>2</label><prov.body><subprov id="U2"><label>1</label><para><text id="X2">a ship</text></para></subprov></prov.body></prov><prov id="S3"><label>3</label><prov.body><subprov id="U3"><label>1</label><para><text id="X3">a ship</text></para></subprov></prov.body></prov></part>
<prov id="S4"><label>4</label><prov.body><subprov id="U4"><label>1</label><para><text id="X4">a ship</text></para></subprov></prov.body></prov><prov id="S5"><label>5</label><prov.body><subprov id="U5"><label>1</label><para><text id="X5">a ship</text></para></subprov></prov.body></prov></body></act>"""


OPENINGS = [
    ('For the purposes of <link href="S2">section 2</link> and <link href="S4">section 4</link>,', "X2 X4"),
    ('In <link href="S2">sections 2 and 4</link>,', "X2 X4"),
    ('By <link href="S2">sections 2 and 4</link>,', "X2 X3 X4 X5"),  # no phrase that names sections
    ('For the purposes of <link href="S2">sections 2 and 4</link>,', "X2 X4"),
    ('For the purposes of <link href="S2">sections 2 to 4</link>,', "X2 X3 X4"),
    ('For the purposes of <citation><intref>section 5<resourcepair targetXmlId="S5"/></intref></citation> and this Part, in this Part,', "X2 X3 X5"),
    ('For the purposes of <link href="S3">section 3</link>, in this Part,', "X2 X3"),  # one within the other
    ('For the purposes of <link href="Z9">section 2</link>,', ""),  # in another document
    ("For the purposes of all sections,", "X2 X3 X4 X5"),
    ("In this section, for the purposes of ships,", ""),
    ("In this schedule,", "X2 X3 X4 X5"),  # there is none around it
    ("", "X2 X3 X4 X5"),
]


def test_scopes_by_sections_named(spark):
    docs = [(i, NAMED.format(opening)) for i, (opening, _) in enumerate(OPENINGS)]
    own = tree.node_table(spark.createDataFrame(docs, "doc_id long, xml string"), "doc_id", "xml").cache()
    found = annotate.extract(own).cache()
    for row in found.collect():
        assert all(a.hi < b.lo for a, b in zip(row.spans, row.spans[1:], strict=False))
    hits = annotate.annotate(own, found).join(own, ["doc_id", "pre"]).filter("node_id is not null").collect()
    got = {i: " ".join(sorted(r.node_id for r in hits if r.doc_id == i)) for i in range(len(docs))}
    assert got == {i: where for i, (_, where) in enumerate(OPENINGS)}


def test_terms_come_down_through_acts_in_between(spark):
    act = lambda i, opening, term, text: (i, f'<act id="A{i}"><body><para><text>{opening}</text><def-para><para><text><def-term id="T{i}">{term}</def-term> includes boats</text></para></def-para></para><text id="X{i}">{text}</text></body></act>')
    rows = [act(1, "In this Act,", "ship", "a ship"), act(2, "In this Act,", "dues", "a ship"), act(3, "In this Act,", "ship", "a ship and dues"), act(4, "In this Act,", "tolls", "a ship, dues and tolls"), (5, None)]
    own = tree.node_table(spark.createDataFrame(rows, "doc_id long, xml string"), "doc_id", "xml").cache()
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 1)], "child long, parent long")
    held = annotate.passed_down(annotate.extract(own), edges, own)
    hits = annotate.annotate(own, held).join(own.filter("node_id is not null"), ["doc_id", "pre"])
    assert sorted((r.doc_id, r.said, r.ids) for r in hits.collect()) == [(1, "ship", "T1"), (2, "ship", "T1"), (3, "dues", "T2"), (3, "ship", "T3;T1"), (4, "dues", "T2"), (4, "ship", "T1"), (4, "tolls", "T4")]
    day = datetime.date
    dated = annotate.extract(own).withColumn("maxdate", F.when(F.col("doc_id") == 1, F.lit(day(2000, 1, 1))))
    dates = spark.createDataFrame([(2, day(1990, 1, 1)), (3, day(2010, 1, 1)), (4, None)], "doc_id long, assent date")
    got = annotate.passed_down(dated, edges, own, dates).filter("id = 'T1'")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]


def test_exclusive_and_priority(nodes):
    base = annotate.extract(nodes).filter("id = 'T2'")
    twice = base.unionByName(base.withColumns({"id": F.lit("X"), "priority": F.lit(100), "exclusive": F.lit(True)}))
    got = annotate.annotate(nodes, twice).collect()
    assert {(r.ids, r.other_ids) for r in got} == {("X", "T2")}


def test_combined_and_expired(spark):
    rows = spark.createDataFrame([("ship", "b", 0, "<2>"), ("ship", "a", 50, "<1>"), ("boat", "c", 0, "<3>")], "word string, id string, priority int, html string")
    got = {r.word: (r.ids, r.priority, r.html) for r in annotate.combined(rows, ["word"]).collect()}
    assert got == {"ship": ("a;b", 50, "<1><2>"), "boat": ("c", 0, "<3>")}
    day = datetime.date
    defs = spark.createDataFrame([(1, "x", day(2000, 1, 1)), (2, "y", day(2000, 1, 1)), (3, "z", None)], "doc_id long, id string, maxdate date")
    dates = spark.createDataFrame([(1, day(1990, 1, 1)), (2, day(2010, 1, 1))], "doc_id long, assent date")
    assert {r.id: r.maxdate for r in annotate.expired(defs, dates, "doc_id").collect()} == {"x": day(2000, 1, 1), "y": None, "z": None}


def test_links_by_title(spark, nodes):
    titles = spark.createDataFrame([(7, "port dues for"), (1, "a ship here")], "doc_id long, title string")
    got = links.document_links(nodes, tree.id_registry(nodes), titles).collect()
    assert [(r.source, r.target, r.link_text) for r in got] == [(1, 7, "port dues for")]  # not its own title


def test_culling_keeps_the_crosshead(spark):
    xml = "<act id='A'><body><crosshead id='c1'>one</crosshead><prov id='S1'/><crosshead id='c2'>two</crosshead><prov id='S2'/><prov id='S3'><label>3</label></prov></body></act>"
    own = tree.node_table(spark.createDataFrame([(1, xml)], "doc_id long, xml string"), "doc_id", "xml")
    kept = tree.cull(own, own.filter("node_id = 'S3'").select("doc_id", F.col("pre").alias("target")))
    assert {r.node_id for r in kept.filter("node_id is not null").collect()} == {"A", "c2", "S3"}


def test_same_trees():
    import xml.etree.ElementTree as ET

    same = lambda a, b, **k: xmljson.same_tree(ET.fromstring(a), ET.fromstring(b), **k)
    assert same("<a x='1'> <b/>t</a>", "<a x='1'><b/> t </a>")
    assert not same("<a x='1'/>", "<a x='2'/>")
    assert same("<a x='1'/>", "<a x='2'/>", attributes=False)
    assert same("<a>*</a>", "<a>text</a>")
    assert not same("<a><b/></a>", "<a><c/></a>")
    assert not same("<a><b/></a>", "<a/>")


def test_tree_value_stops_at_the_end_mark():
    import xml.etree.ElementTree as ET

    assert xmljson.tree_value(ET.fromstring("<a i='1'>t<b end='x'><c/></b>u</a>"), "end") == {"tag": "a", "@i": "1", "#text": "t", "children": [{"tag": "b", "@end": "x", "#tail": "u"}]}


def test_entities(spark):
    rows = spark.createDataFrame([("a &amp;lt; &lt;c&gt; &#160;x&#8217;s &#x1F600; &bogus; & &#99999999; &#0; &eacute;",), (None,)], "t string")
    assert [r.x for r in rows.select(text.entities(F.col("t")).alias("x")).collect()] == ["a &lt; <c>  x’s \U0001f600 &bogus; & &#99999999; &#0; é", None]


def test_sorting_by_an_unknown_column_raises(spark):
    with pytest.raises(ValueError, match="no column"):
        index.sorted_results(spark.range(1), "nothing")


def test_updates_write_nulls_too(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(1, None), (3, "c")], "id int, v string")
    assert sorted(tuple(r) for r in records.update_columns(old, new, "id").collect()) == [(1, None, "x"), (2, "b", "y")]
