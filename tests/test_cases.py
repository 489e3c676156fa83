"""Judgment lines: parties, matters and anchors."""

from __future__ import annotations

from marlow.operators import cases

LINES = ["[2014] NZHC 123", "UNDER the Sample Act 1993", "IN THE MATTER OF an appeal", "against a decision", "BETWEEN", "Ann Example", "First plaintiff", "AND", "The Borough of Elsewhere", "Defendant", "Hearing: 3 March 2014", "Counsel: B Advocate", "THE FACTS", "[1] It began.", "(a) first", "[3] Not yet.", "[2] It went on.", "[3] It ended.", "[2] Again."]


def lines(spark):
    return spark.createDataFrame([(1, k, s) for k, s in enumerate(LINES)] + [(2, 0, "Roe v Wade"), (3, 0, None)], "doc_id long, line_no long, text string")


def test_parties_end_at_the_next_field(spark):
    got = {r.doc_id: (r.plaintiffs, r.defendants) for r in cases.parties(lines(spark), "doc_id", "line_no", "text").collect()}
    assert got == {1: ("Ann Example", "The Borough of Elsewhere"), 2: ("Roe", "Wade"), 3: (None, None)}
    named = cases.party_lines(lines(spark), "doc_id", "line_no", "text").orderBy("line_no").collect()
    assert [(r.role, r.name, r.descriptor) for r in named] == [("plaintiffs", "Ann Example", "plaintiff"), ("defendants", "The Borough of Elsewhere", "defendant")]


def test_matters(spark):
    got = cases.matters(lines(spark), "doc_id", "line_no", "text").orderBy("line_no").collect()
    assert [(r.qualifier, r.value) for r in got] == [("UNDER", "the Sample Act 1993"), ("IN THE MATTER OF", "an appeal against a decision")]


def test_anchors(spark):
    got = cases.paragraph_anchors(lines(spark), "doc_id", "line_no", "text").orderBy("place").collect()
    assert [(r.number, r.place) for r in got] == [(1, 13), (2, 16), (3, 17)]


def test_rules_and_assembly(spark):
    matched = cases.match(lines(spark), "doc_id", "line_no", "text")
    got = {r.doc_id: r for r in cases.assembled(matched, "doc_id").collect()}
    assert got[1].neutral_citation == "[2014] NZHC 123"
    assert got[1].matter == "UNDER the Sample Act 1993\nIN THE MATTER OF an appeal\nagainst a decision"
    assert got[1].parties == "BETWEEN\nAnn Example\nFirst plaintiff\nAND\nThe Borough of Elsewhere\nDefendant"
    assert got[1].hearing == "Hearing: 3 March 2014"
    assert got[1].body.startswith("[1] It began.")
    assert got[3].body is None
    assert matched.count() == lines(spark).count()


def test_markup_is_tidied(spark):
    rows = spark.createDataFrame([("<p>a<b>x</b><b>y</b> <i> </i>c<b k='1'>z</b></p>",), (None,), ("<p",)], "x string")
    assert [r.y for r in rows.select(cases.clean_markup_udf()("x").alias("y")).collect()] == ['<p>a<b>xy</b>  c<b k="1">z</b></p>', None, None]


def test_body_flags(spark):
    rows = spark.createDataFrame([("A quoted line", 120.0, 72.0, 10.0, False), ("FACTS", 72.0, 72.0, 12.0, False), ("(a) one;", 90.0, 72.0, 12.0, False), ("runs on to", 72.0, 72.0, 12.0, False)], "t string, l double, u double, f double, b boolean")
    got = [(r.is_quote, r.is_title, r.is_item, r.runs_on) for r in cases.body_flags(rows, "t", "l", "u", "f", "b").collect()]
    assert got == [(True, False, False, True), (False, True, False, False), (False, False, True, False), (False, False, False, True)]


def test_matters_and_parties_take_turns(spark):
    said = ["UNDER the Ships Act", "IN THE MATTER OF dues", "BETWEEN", "A", "AND", "B", "UNDER the Ports Act", "BETWEEN", "C", "CIV-2014-404-9", "UNDER the Tolls Act", None, "[1] Text", "UNDER nothing", "BETWEEN", "D"]
    rows = [(1, i, x) for i, x in enumerate(said)] + [(2, 0, "BETWEEN"), (2, 1, "E"), (3, 0, None), (4, 0, "CIV-2014-404-1"), (4, 1, "x"), (4, 2, "UNDER the Ships Act")]
    lines = spark.createDataFrame(rows, "doc long, n int, t string")
    got = sorted((r.doc, r.set, r.place, r.kind, r.value, r.court_file) for r in cases.matters_and_parties(lines, "doc", "n", "t").withColumnRenamed("n", "place").collect())
    assert got == [
        (1, 1, 0, "matter", "the Ships Act", None), (1, 1, 1, "matter", "dues", None), (1, 1, 3, "party", "A", None), (1, 1, 5, "party", "B", None), (1, 2, 6, "matter", "the Ports Act", None), (1, 2, 8, "party", "C", None),
        (1, 3, 10, "matter", "the Tolls Act", "CIV-2014-404-9"), (2, 1, 1, "party", "E", None), (4, 1, 2, "matter", "the Ships Act", "CIV-2014-404-1"),
    ]
    assert cases.matters_and_parties(lines.limit(0), "doc", "n", "t").count() == 0


def test_rules_read_documents_one_after_the_other(spark):
    """No call of Python a document: two documents that follow one another in a partition, a null key, and lines out of order."""
    said = [(2, "[1] Second."), (1, "Hearing: 3 May"), (3, None)]
    rows = [(d, n, x) for d in (1, 2, None) for n, x in said] + [(4, 1, "loose")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no long, text string")
    got = cases.match(lines, "doc_id", "line_no", "text")
    assert "InPandas" not in got._jdf.queryExecution().sparkPlan().toString()
    want = {(d, n): r for d in (1, 2, None) for n, r in ((1, "hearing"), (2, "body"), (3, "body"))} | {(4, 1): None}
    assert {(r.doc_id, r.place): r.rule for r in got.collect()} == want
    told = {r.doc_id: (r.hearing, r.body) for r in cases.assembled(got, "doc_id").collect()}
    assert told == dict.fromkeys((1, 2, None), ("Hearing: 3 May", "[1] Second.\n")) | {4: (None, None)}
