"""Paths looked up by joins against the walk of a single document, on random documents and paths."""

from __future__ import annotations

import random

import pytest

from marlow.operators import paths, tree


def document(rnd):
    def paras(depth):
        if depth > 2 or rnd.random() < 0.3:
            return f"<text>t{rnd.randrange(9)}</text>"
        tag, body = rnd.choice([("subprov", "para"), ("label-para", "para")])
        return "".join(f"<{tag}><label>{label}</label><{body}>{paras(depth + 1)}</{body}></{tag}>" for label in rnd.sample(["(1)", "(2)", "(3)", "(a)", "(b)", "(c)", "(i)"], rnd.randint(1, 4)))

    def provs(n):
        out = ""
        for k in rnd.sample(range(1, 12), n):
            said = f'<prov id="p{rnd.random()}"><label>{k}{rnd.choice(["", "", "A"])}</label><prov.body>{paras(0)}</prov.body></prov>'
            out += f"<{w}>{said}</{w}>" if (w := rnd.choice(["", "", "", "amend", "head1"])) else said
        return out

    parts = "".join(f"<part><label>{k}</label>{provs(2)}<subpart><label>{rnd.randint(1, 3)}</label>{provs(2)}</subpart></part>" for k in rnd.sample([1, 2, 3], rnd.randint(0, 3)))
    heads = "".join(f"<head1><label>Part {k}</label>{provs(2)}</head1>" for k in (4, 5) if rnd.random() < 0.5)
    schedules = "".join(f"<schedule>{f'<label>{k}</label>' if rnd.random() < 0.7 else ''}{provs(3)}<part><label>1</label>{provs(1)}</part></schedule>" for k in range(1, rnd.randint(1, 4)))
    return f"<act><body>{provs(4)}{parts}{heads}</body>{schedules}</act>"


PATHS = [
    "s 1", "s 2(1)", "section 3(1)(a)", "s 4(a)-(c)", "s 4(a)+(c)", "s 1-5", "ss 2+7+3", "s 3+5-8", "s 1(1)-(3)(a)", "s 7a(1)", "part 1", "part 2 s 3", "part 1 subpart 2 s 4(1)", "subpart 1", "part 1-3", "parts 1+2", "part 4", "part 5 s 2", "sch 1", "schedule 2 cl 3", "sch 2 cl 1(2)(b)",
    "sch 1 part 1 cl 2", "schedule 1-2", "sch", "sch cl 4", "s 99", "", "s", "(a)", "(1)(a)", "cl 2(1) ", "S 5(2)(B)", "part 9 s 1", "s 6(i)", "1(2)", "s 2 (1) (a)", "sch 1 part 1", "s 8(1)(a)-(b)+(c)", "s 10-2",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_find_equals_the_walk(spark, seed):
    rnd = random.Random(seed)
    docs = [(k, document(rnd)) for k in range(25)]
    nodes = tree.node_table(spark.createDataFrame([*docs, (99, "<bad")], "doc_id long, xml string"), "doc_id", "xml").cache()
    asked = spark.createDataFrame([(k, p) for k, _ in docs for p in PATHS] + [(99, "s 1"), (None, "s 1"), (1, None), (1, "s 1")], "doc_id long, path string")
    got: dict[tuple, list] = {}
    for r in paths.find(nodes, asked).collect():
        got.setdefault((r.doc_id, r.path), []).append(r.target)
    named = 0
    for k, xml in docs:
        own = tree.parse(xml)
        for p in PATHS:
            try:
                want = sorted(set(tree.lookup(own, p)))
            except tree.PathError:
                want = [None]
            named += want != [None]
            assert sorted(got[k, p], key=str) == sorted(want, key=str), (k, p, xml)
    assert named > 300
    assert got[99, "s 1"] == got[None, "s 1"] == got[1, None] == [None]


def test_links_fall_back_to_their_id(spark):
    nodes = tree.node_table(spark.createDataFrame([(1, '<act><body><prov id="P1"><label>1</label></prov><prov id="P2"><label>2</label></prov></body></act>')], "doc_id long, xml string"), "doc_id", "xml")
    links = spark.createDataFrame([(1, "P1", "section 2", "a"), (1, "P2", "the meaning", "b"), (1, "P2", "section 77", "c"), (1, "gone", "section 77", "d"), (2, "P1", "section 1", "e")], "target long, node_id string, link_text string, row string")
    got = {r.row: r.target_pre for r in paths.resolve(links, nodes).collect()}
    places = {r.node_id: r.pre for r in nodes.filter("node_id is not null").collect()}
    assert got == {"a": places["P2"], "b": places["P2"], "c": places["P2"], "d": None, "e": None}
