"""Link tables refreshed by random sets of changes equal those of a full analysis."""

from __future__ import annotations

import random

from marlow.operators import graph, refresh


def act(rnd, c, n):
    """A random act of number c among n: links, a parent, a note, mentions of titles, one inside another."""
    title = lambda k: f"C {k} Amendment Act 2000" if k % 3 else f"C {k} Amendment Act 2000 Rules"
    some = lambda: rnd.randrange(n)
    own = title(c) if rnd.random() < 0.8 else title(some())
    links = "".join(f'<para><text>see <link href="P{some()}">section {rnd.randint(1, 3)}</link></text></para>' for _ in range(rnd.randrange(3)))
    sections = "".join(f'<prov id="{f"P{c}" if k == 1 else f"P{c}x{k}"}"><label>{k}</label><prov.body><para><text>{rnd.choice(["amends", "says"])} the {title(some())}.</text></para>{links}</prov.body></prov>' for k in range(1, rnd.randint(2, 4)))
    note = f'<notes><history-note id="H{c}">Section 1: repealed, on 1 July 2014, by section 6 of the {title(some())}.</history-note></notes>'
    return c, own, f'<act id="A{c}" date.assent="{1990 + rnd.randrange(3)}-01-01"><cover><title>{own}</title></cover><body>{sections}</body>{note}</act>'


def test_refresh_equals_a_full_analysis(spark):
    rnd, n, schema = random.Random(5), 24, "doc_id long, title string, xml string"
    docs = {c: act(rnd, c, n) for c in range(n - 4)}
    state = refresh.analyse(spark.createDataFrame(list(docs.values()), schema))
    assert not state.hierarchy.isEmpty() and not state.sections.isEmpty() and not state.amendments.isEmpty()
    for size in (1, 9):
        changes = {c: act(rnd, c, n) if rnd.random() < 0.75 else (c, None, None) for c in rnd.sample(range(n), size)}
        docs = {c: x for c, x in (docs | changes).items() if x[2] is not None}
        state = refresh.refresh(state, spark.createDataFrame(list(changes.values()), schema))
        assert refresh.same(state, refresh.analyse(spark.createDataFrame(list(docs.values()), schema))) == dict.fromkeys(vars(state), 0)


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "a long, b long")
    assert sorted(r.node for r in graph.reachable(edges, spark.createDataFrame([(2,)], "node long")).collect()) == [1, 2, 3, 4]
    assert graph.reachable(edges, spark.createDataFrame([], "node long")).collect() == []
