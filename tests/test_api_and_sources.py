from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marlow.api import Engine, QueryError
from marlow.functions import render, xmljson
from marlow.sources import documents

ACT = """<act id="A1" year="1993"><cover><title>Sample Act</title></cover><body id="B1">
<part id="P1"><label>1</label><heading>First part</heading>
<prov id="S1"><label>1</label><heading>Interpretation</heading><prov.body><subprov id="S1-1"><label>1</label><para><text>In this Act, unless the context otherwise requires,</text>
<def-para id="D1"><para><text><def-term id="T1">vessel</def-term> means a ship</text></para></def-para><def-para id="D2"><para><text><def-term id="T2">harbour dues</def-term> includes tolls</text></para></def-para></para></subprov></prov.body></prov>
<prov id="S2"><label>2</label><heading>Levels</heading><prov.body><subprov id="S2-1"><label>1</label><para><text>A person</text><label-para id="L1"><label>a</label><para><text>first</text><label-para id="L2"><label>i</label><para><text>deep</text></para></label-para></para></label-para>
<label-para id="L3"><label>b</label><para><text>second</text></para></label-para><label-para id="L4"><label>ba</label><para><text>between</text></para></label-para><label-para id="L5"><label>c</label><para><text>third <link href="S1">section 1</link></text></para></label-para></para></subprov></prov.body></prov></part>
<part id="P2"><label>2</label><heading>Second part</heading><prov id="S3"><label>3</label><heading>More</heading><prov.body><subprov id="S3-1"><label>1</label><para><text>text</text></para></subprov></prov.body></prov></part></body>
<schedule id="C1"><label>1</label><heading>Forms</heading><prov id="S4"><label>1</label><heading>Form</heading><prov.body><subprov id="S4-1"><label>1</label><para><text>see <link href="S2">section 2</link></text></para></subprov></prov.body></prov></schedule></act>"""


@pytest.fixture(scope="module")
def engine(spark):
    instruments = spark.createDataFrame(
        [(1, "A1", 1, "act", "Sample Act", 1993, None, False, None), (2, "A1", 2, "act", "Sample Act", 1993, "", False, None), (3, "B2", 1, "act", "Harbour Amendment Act", 2001, "repealed", True, None), (4, "B4", 1, "bill", "Vessels Bill", 2010, None, False, None)],
        "id int, govt_id string, version int, type string, title string, year int, terminated string, repealed boolean, date_first_valid date",
    )
    docs = spark.createDataFrame([(1, ACT), (2, ACT), (3, "<act id='B2'><body><prov id='X'><label>1</label><para><text>tolls are due</text></para></prov></body></act>"), (4, "not xml")], "id int, document string")
    links = spark.createDataFrame([(1, 3, 2, "s 2(1)", "s 1"), (2, 3, 2, "s 2", "s 2"), (3, 2, 2, "s 1", "s 3")], "link_id int, source int, target int, path string, repr string")
    definitions = spark.createDataFrame([("d1", 2, "vessel", "<p>v</p>", 50), ("d2", 2, "vessels of war", "<p>w</p>", 100)], "id string, document_id int, full_word string, html string, priority int")
    cases = spark.createDataFrame([(9, "A v B [2014] NZHC 1", "<p>The vessel sank</p>", 2014)], "id int, full_citation string, document string, year int")
    return Engine(instruments=instruments, documents=docs, links=links, definitions=definitions, cases=cases)


def test_dispatch(engine):
    assert [r.id for r in engine.query("instruments", title="act").collect()] == [3, 2]
    assert [r.id for r in engine.query("instruments", kinds=["act_principal"], year="1990-1999").collect()] == [2]
    assert [r.id for r in engine.query("instruments", title="act", drop_repealed=True).collect()] == [2]
    assert [r.id for r in engine.query("instruments", title="act", drop_repealed=True, mode="reference").collect()] == [3, 2]
    assert [r.id for r in engine.query("instruments", contains="tolls are").collect()] == [3]
    assert [r.id for r in engine.query("instruments", definition="vessel").collect()] == [2]
    assert [r.id for r in engine.query("cases", contains="vessel sank").collect()] == [9]
    assert engine.query("act", "location", id=2, location="s 2(1)(b)").filter("current").first().node_id == "L3"
    assert engine.query("act", "location", id=2, location="section 2(1)(b) of the Sample Act 1993").filter("current").first().node_id == "L3"
    assert engine.query("act", "govt_location", id="A1", govt_location="S3").filter("current").first().node_id == "S3"
    assert [r.num for r in engine.query("act", "contains", id=2, contains="a person").collect()] == [1]
    assert [(r.link_id, r.internal) for r in engine.query("act", "section_references", id=2, path="s 2").collect()] == [(1, False), (2, False)]
    assert [r.id for r in engine.query("act", "section_versions", id=2).collect()] == [2, 1]
    assert engine.query("act", id=2).first().html.startswith('<div class="act" id="A1">')
    assert [r.source for r in engine.references(2).collect()] == [3]
    assert [r["name"] for r in engine.autocomplete("act").collect()] == ["Sample Act"]
    assert engine.exact("A v B [2014] NZHC 1").first().id == 9
    assert engine.definition(["d1", "d2"]).first().html == "<p>w</p><p>v</p>"
    assert [r.id for r in engine.definitions_like("vessel").collect()] == ["d1", "d2"]
    assert sorted(r.id for r in engine.query("all", query="tolls").collect()) == [2, 3]
    for bad in ({"doc_type": "song"}, {"doc_type": "act", "find": "nothing", "id": 2}, {"doc_type": "act", "id": "nowhere"}):
        with pytest.raises(QueryError):
            engine.query(**bad)


def test_xml_files_and_instruments(spark, tmp_path):
    for folder, name, xml in (("1.0", "b.xml", "<act id='second'/>"), ("1.0", "a.xml", "<act id='A' year='1993' date.assent='1993-09-28' date.as.at='nulldate' act.no='5' act.type='public' terminated='repealed'><cover><title>An\nAct</title></cover></act>"), ("2.0", "c.xml", "<broken")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(xml)
    files = documents.xml_files(spark, str(tmp_path))
    assert files.count() == 2
    row = documents.instruments(files).collect()
    assert [(r.govt_id, r.version, r.year, r.number, r.subtype, str(r.date_assent), r.date_as_at, r.repealed, r.title) for r in row] == [("A", 1, 1993, "5", "public", "1993-09-28", None, True, "An Act")]


def test_feed_jsonp_and_binary(spark, tmp_path):
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>T</title><updated>2014-01-02T03:04:05Z</updated><link href='/act/public/1.xml'/></entry><entry><link href='/news/1'/></entry></feed>"
    rows = documents.feed_entries(spark.createDataFrame([(feed,), (None,), ("<",)], "xml string"), "xml").collect()
    assert [(r.path, r.title) for r in rows] == [("act/public/1.xml", "T")]
    wrapped = spark.createDataFrame([('cb({"response": {"docs": [{"DocumentName": "x.pdf", "court": "HC"}]}});',)], "t string")
    assert [tuple(r) for r in documents.jsonp(wrapped, "t", "struct<DocumentName:string,court:string>").collect()] == [("x.pdf", "HC", "x")]
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.bin").write_bytes(b"\x89PNG1234")
    assert sorted((r.path[-5:], r.kind) for r in documents.binary_files(spark, str(tmp_path)).collect()) == [("a.bin", "pdf"), ("b.bin", "png")]


def test_xml_json_round_trip(spark):
    xml = '<a x="1"><b>one</b><b>two<i>in</i>tail</b><c /></a>'
    got = json.loads(xmljson.xml_to_json(xml))
    assert got == {"a": {"@x": "1", "b": ["one", {"i": {"#text": "in", "#tail": "tail"}, "#text": "two"}], "c": None}}
    assert xmljson.json_to_xml(json.dumps(got)) == xml
    assert xmljson.xml_to_json("<broken") is None
    assert spark.createDataFrame([(xml,), (None,)], "x string").select(F.count_if(xmljson.xml_to_json_udf("x").isNotNull())).first()[0] == 1


def test_render_escapes_and_cuts():
    assert render.render("<p>a &lt; b<link href='x'>y</link></p>") == '<div class="p">a &lt; b<a class="link" href="#x">y</a></div>'
    assert render.render("<p><q/><r/></p>", 2) == '<div class="p"><div class="q"></div></div>'
    assert render.render(None) is None


def test_page_store_and_summary(spark, engine):
    from marlow.api import Engine, PageStore

    store = PageStore(engine, size=2)
    first = store.more(doc_type="instruments", title="act")
    assert [r.id for r in first["results"]] == [3, 2]
    assert not first["finished"]
    assert store.more(doc_type="instruments", title="act")["finished"]
    assert len(store.lists) == 1
    assert [r.id for r in engine.link("Sample Act").collect()] == [2]
    row = engine.summary(2).first()
    assert (row.n_versions, row.newest, row.n_referring, row.n_links) == (2, 2, 1, 2)
    edges = spark.createDataFrame([(2, None), (3, 2), (4, 2), (3, 1)], "child int, parent int")
    views = spark.createDataFrame([(1, "graph", True, 5), (2, "graph", True, 9), (3, "page", True, 7), (4, "graph", False, 8)], "id int, kind string, published boolean, saved int")
    more = Engine(**engine.tables, edges=edges, views=views)
    assert more.summary(2).first().n_below == 2
    assert more.summary(3).first().parents == [1, 2]
    assert [r.id for r in more.published("graph").collect()] == [2, 1]


def test_pages(spark):
    from marlow.sources import pages

    html = "<table><tr><th>Case</th><th>Date</th></tr><tr><td><a href=\"/c/1\">A &amp; B</a></td><td>2014</td></tr><tr><td>short</td></tr></table><dl><dt>Court</dt><dd>HC</dd><dt>Court</dt><dd>CA</dd></dl><a href=\"/p/2\">Next</a>"
    rows = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    got = pages.records(rows, "id", "html", ["name", "date"]).orderBy("row").collect()
    assert [(r["name"], r.date, r.href) for r in got] == [("Case", "Date", None), ("A & B", "2014", "/c/1")]
    out = rows.select("id", pages.details(F.col("html")).alias("d"), pages.next_page(F.col("html")).alias("n")).orderBy("id").collect()
    assert (out[0].d, out[0].n) == ({"Court": "CA"}, "/p/2")
    assert (out[2].d, out[2].n) == ({}, None)
