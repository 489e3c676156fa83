"""Steps over node tables: what they join, explode and hold."""

from __future__ import annotations

import pandas as pd
import pytest

from marlow.functions.slices import HELD
from marlow.operators import annotate, tree

ACT = (
    '<act><body><prov id="S1"><label>1</label><prov.body><subprov id="U1"><label>1</label><para><text>In this Act,</text><def-para id="D"><para><text><def-term id="T">red ship</def-term> means a boat</text></para></def-para>'
    '<label-para id="L1"><label>a</label><para><text>x</text></para></label-para></para></subprov></prov.body></prov>'
    '<amend><prov id="S9"><label>9</label></prov></amend><schedule id="C"><label>2</label><heading>h</heading><prov id="S2"><label>3</label><amend><prov id="S8"><label>8</label></prov></amend></prov></schedule></body></act>'
)


@pytest.fixture(scope="module")
def nodes(spark):
    from marlow.store import materialise

    return materialise(tree.node_table(spark.createDataFrame([(7, ACT)], "doc_id long, xml string"), "doc_id", "xml"), "nodes")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_join_the_node_table_once(nodes):
    """targets that carry their ancestors are not looked up for them, and only named ones are joined."""
    wanted = nodes.filter("node_id is not null").selectExpr("doc_id", "pre as target", "node_id", "above")
    found = tree.node_paths(nodes, wanted.drop("node_id"))
    assert plan(found).count("Join Inner") == 1 and "Window" not in plan(found)
    got = {r.node_id: r.path for r in found.join(wanted, ["doc_id", "target"]).collect()}
    assert got == {"S1": "s 1", "U1": "s 1(1)", "D": "s 1(1)", "T": "s 1(1)", "L1": "s 1(1)(a)", "S9": "s 9", "C": "sch 2", "S2": "sch 2 cl 3", "S8": "sch 2 cl 3 cl 8"}


def test_fragments_take_a_node_once(nodes):
    """a node is in one part, which its ancestors tell, so nodes are not taken once for each ancestor."""
    found = tree.fragments(nodes)
    assert plan(found).count("Generate explode") == 1  # of the paths' ancestors
    got = {r.num: (r.title, r.text, r.ids, r.locations) for r in found.collect()}
    assert got == {0: (None, "1 1 In this Act, red ship means a boat a x", "S1;U1;D;T;L1", "s 1;s 1(1);s 1(1);s 1(1);s 1(1)(a)"), 1: ("h", "2 h 3 8", "C;S2;S8", "sch 2;sch 2 cl 3;sch 2 cl 3 cl 8")}


def test_levels_of_an_outline_read_what_is_written_of_it(nodes):
    """the levels read a table of entries, not the node table once each."""
    found = tree.nested_outline(nodes)
    assert "above#" not in plan(found) and "string_value#" not in plan(found)
    assert found.collect()[0].outline.startswith('[{"label":"s 1","children":[{"label":"(1)","children":[{"label":"(a)","children":[]}]}]}')


def test_lookups_are_given_out_a_few_at_a_time():
    """a worker holds the places of a few documents."""
    n = 2 * HELD + 5
    given = list(tree.lookup_udf().func(iter([(pd.Series([ACT, None] * n)[:n], pd.Series([["s 1(1)(a)", "s 77"]] * n))])))
    assert [len(x) for x in given] == [HELD, HELD, 5]
    assert list(pd.concat(given))[:2] == [[[13], []], [[], []]]


def test_definitions_of_the_whole_document_look_for_no_places(nodes):
    """F21 (F2, F9, F19): where no phrase names a place the node table is read for the documents' ends alone."""
    found = annotate.extract(nodes)
    assert "Generate" not in plan(found) and plan(found).count("Join") == 2
    r = found.collect()[0]
    assert (r.id, r.term, r.exclusive, r.priority, [tuple(s) for s in r.spans]) == ("T", "red ship", True, 50, [(0, nodes.count() - 1)])
