"""Queries whose answers lie within one document: what they join, and that they find what node tables give."""

from __future__ import annotations

import random
import time

from marlow.operators import paths, tree
from marlow.plans import acts, registry

from .test_paths import PATHS, document

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_those_of_the_walk():
    """what is found by label is what a walk through all nodes finds."""
    rnd = random.Random(5)
    for _ in range(25):
        xml = document(rnd)
        nodes, own = tree.parse(xml), tree.Tree(xml)
        places = tree.Places(own.last, own.tag, own.label)
        assert places.parent == own.parent and places.depth == own.depth
        for p in [*PATHS, *PATHS]:  # the second time from what was remembered
            try:
                want = tree.lookup(nodes, p)
            except tree.PathError:
                want = []
            assert places.find(p) == want, (p, xml)


def test_paths_of_a_long_document_are_looked_up_in_a_moment():
    """each path was looked for among all nodes."""
    n = 6000
    own = tree.Tree("<act><body>" + "".join(f'<prov><label>{k}</label><subprov><label>1</label></subprov></prov>' for k in range(n)) + "</body></act>")
    began = time.process_time()
    places = tree.Places(own.last, own.tag, own.label)
    assert all(own.label[places.find(f"s {k}(1)")[0]] == "1" for k in range(n))
    assert time.process_time() - began < 10


def test_lookups_in_a_document_join_nothing(spark):
    """only the acts are made by a join, and the node table is not made at all."""
    for name in ("path_lookup", "found_paths"):
        assert plan(registry.QUERIES[name](spark, SF)).count("Join") == 1, name
    docs = spark.createDataFrame([(7, '<act><body><prov id="P"><label>1</label></prov></body></act>'), (8, "<bad")], "doc_id long, xml string")
    got = paths.lookups(docs, "doc_id", "xml", lambda own: ["s 1", "s 2", "s 1"]).collect()
    assert sorted((r.doc_id, r.path, r.target, r.node_id) for r in got if r.target is not None) == [(7, "s 1", 2, "P")]
    assert sorted((r.doc_id, r.path) for r in got if r.target is None) == [(7, "s 2"), (8, "s 1"), (8, "s 2")]


def test_acts_are_dealt_by_their_orders(spark, monkeypatch):
    """partitions were as many as the orders' compressed bytes asked for, and the text made of them many times larger."""
    monkeypatch.setattr(acts, "ORDERS", 100)
    assert acts.acts(spark, SF).rdd.getNumPartitions() == 15


def test_linked_sections_meet_the_index_once(spark):
    """a document's nodes come to its links as one row, not one by one."""
    found = plan(registry.QUERIES["linked_sections"](spark, SF))
    assert found.count("Join") == 2 and "above#" not in found


def test_indexes_of_documents_are_those_of_their_nodes(spark):
    """an index made of the documents is that of their node table."""
    rnd = random.Random(3)
    docs = spark.createDataFrame([(k, document(rnd)) for k in range(12)], "doc_id long, xml string")
    of_nodes, of_docs = (sorted(tuple(map(str, r)) for r in df.select("doc_id", "last", "tag", "label", "node_id").collect()) for df in (paths.index(tree.node_table(docs, "doc_id", "xml")), paths.indexed(docs, "doc_id", "xml")))
    assert of_nodes == of_docs and len(of_docs) == 12


def mixed(rnd):
    """A random document with ids, headings and crossheads put in."""
    out = ""
    for piece in document(rnd).split("<label>"):
        out += piece + rnd.choice(["", "", f'<heading id="h{rnd.random()}">h{rnd.randrange(9)}</heading>', "<crosshead>c</crosshead>"]) + "<label>" if rnd.random() < 0.9 else piece + "<label>"
    return out.removesuffix("<label>")


def both(spark, of_nodes, of_docs, n=30):
    rnd = random.Random(11)
    docs = spark.createDataFrame([*((k, mixed(rnd)) for k in range(n)), (n, "<bad"), (n + 1, None)], "doc_id long, xml string")
    nodes = tree.node_table(docs, "doc_id", "xml").cache()
    a, b = of_nodes(nodes), of_docs(docs)
    assert "Join" not in plan(b)
    got, want = (sorted((tuple(r) for r in df.collect()), key=str) for df in (b, a.select(*b.columns)))
    assert got == want and len(got) > n


def test_skeletons_of_documents_are_those_of_their_nodes(spark):
    """the node table was made in full, and what is left of it counted."""
    both(spark, tree.skeleton, lambda docs: tree.skeletons(docs, "doc_id", "xml", ["pre", "tag", "node_id", "string_value"]))
    assert plan(registry.QUERIES["document_skeleton"](spark, SF)).count("Join") == 1


def test_fragments_of_documents_are_those_of_their_nodes(spark):
    """as F7."""
    both(spark, tree.fragments, lambda docs: tree.document_fragments(docs, "doc_id", "xml"))
    assert plan(registry.QUERIES["document_fragments"](spark, SF)).count("Join") == 1


def test_documents_are_culled_as_their_nodes_are(spark):
    """every node was written, and taken once for each element around it, and shuffled."""
    targets = lambda own: [at for at, label in enumerate(own.label) if label in ("2", "b")]
    of_nodes = lambda nodes: tree.cull(nodes, nodes.filter("label in ('2', 'b')").selectExpr("doc_id", "pre as target"))
    both(spark, of_nodes, lambda docs: tree.culled(docs, "doc_id", "xml", targets, ["pre", "tag", "last"]))
    assert plan(registry.QUERIES["culled_tree"](spark, SF)).count("Join") == 1


def test_links_of_openings_meet_an_index_of_their_documents(spark, monkeypatch):
    """steps of the paths in openings were taken one by one, each by joins with the node table."""
    written = []
    monkeypatch.setattr(paths, "materialise", lambda df, name: written.append(name) or df)
    docs = spark.createDataFrame([(1, '<act><body><prov id="P1"><label>1</label></prov><prov id="P2"><label>2</label></prov></body></act>')], "doc_id long, xml string")
    links = spark.createDataFrame([(1, "P1", "sections 1 and 2"), (1, "P1", None), (None, "P1", "section 2"), (1, None, "section 2")], "target long, node_id string, link_text string")
    got = {(r.target, r.node_id, r.link_text, r.target_pre) for r in paths.resolve(links, tree.node_table(docs, "doc_id", "xml")).collect()}
    assert got == {(1, "P1", "sections 1 and 2", 2), (1, "P1", "sections 1 and 2", 4), (1, "P1", None, 2), (None, "P1", "section 2", None), (1, None, "section 2", 4)}
    assert written == ["path-index", "link-texts"]
