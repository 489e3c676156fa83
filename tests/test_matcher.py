"""The character automaton against regular expressions on prefixes, and the rules against a direct interpreter."""

from __future__ import annotations

import random
import re

import pytest

from marlow.operators import matcher
from marlow.operators.matcher import LINE_TESTS, RULES, Automaton, Not, Or, Rule

PIECES = ["[1] ", "[12] ", " [3]", "______", "_______  ", "REASONS", "REASONS OF THE COURT ", "Introduction", "Introd", "Contents", "Table of Contents", "INDEX ", "Outline", "12", "7 ", "Para No", "x", " ", "é", "", "This page has been deliberately left blank"]


def ends(pattern, said):
    """Where the pattern ends in a text, each hit beginning after the one before."""
    plain = re.compile("(?:" + "".join((r"[\d%]" if c == "%" else re.escape(c)) + ("*" if star else "") for c, star in Automaton._items(pattern)) + r")\Z")
    out, start = [], 0
    for e in range(1, len(said) + 1):
        if plain.search(said[start:e]):
            out.append(e - 1)
            start = e
    return out


def direct(lines, patterns):
    """(line, place in it, rule) by whole texts: a line feed, then every line with its own."""
    said = "\n" + "".join(x + "\n" for x in lines)
    where = [(i, k) for i, x in enumerate(lines) for k in range(len(x) + 1)]
    return sorted((*where[e - 1], r) for r, p in enumerate(patterns) for e in ends(p, said) if e)


def judged(lines, flags, rules, first):
    tags, out = set(first), []
    for i, at, r in direct(lines, [x.pattern for x in rules]):
        def holds(t, i=i):
            if isinstance(t, Or):
                return any(holds(x) for x in t.tests)
            if isinstance(t, Not):
                return not holds(t.test)
            return matcher.OPEN_TESTS[t] in tags if t in matcher.OPEN_TESTS else bool(flags[i][t])

        counts = all(holds(t) for t in rules[r].tests)
        if counts:
            tags = tags - set(rules[r].close) | set(rules[r].open)
        out.append((i, at, r, counts, tuple(t for t in matcher.TAGS if t in tags)))
    return out


OWN = [*RULES, Rule("x\nx", ("quote",), ("blank",), (Not("is_quote"),)), Rule("\n\n*é", ("blank",), ("quote",), (Or(("is_bold", Not("is_table"))),)), Rule("%*a", (), ("quote",))]


@pytest.fixture(scope="module", params=[RULES, OWN])
def judgments(spark, request):
    rnd, docs = random.Random(len(request.param)), {}
    for d in range(40):
        lines = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(4))) for _ in range(rnd.randrange(1, 30))]
        docs[d] = lines, [{t: rnd.choice([True, True, False, None]) for t in LINE_TESTS} for _ in lines]
    rows = [(d, i, x, *(f[t] for t in LINE_TESTS)) for d, (lines, flags) in docs.items() for i, (x, f) in enumerate(zip(lines, flags, strict=True))]
    schema = "doc_id long, line_no long, text string, " + ", ".join(f"{t} boolean" for t in LINE_TESTS)
    return request.param, docs, spark.createDataFrame(rows, schema).repartition(5).cache()


def test_states_after_a_line_feed():
    assert len(Automaton([r.pattern for r in RULES]).starts) == 2  # a feed may have ended a hit, or not
    assert len(Automaton([r.pattern for r in OWN]).starts) > 2
    with pytest.raises(ValueError):
        Automaton(["a*"])


@pytest.mark.parametrize("stretch", [matcher.STRETCH, 3])
def test_rules_equal_a_direct_interpreter(judgments, monkeypatch, stretch):
    monkeypatch.setattr(matcher, "STRETCH", stretch)
    rules, docs, table = judgments
    got = sorted((r.doc_id, r.place, r.at, r.rule, r.counts, tuple(r.tags)) for r in matcher.apply_rules(table, "doc_id", "line_no", "text", rules).collect())
    want = sorted((d, *x) for d, (lines, flags) in docs.items() for x in judged(lines, flags, rules, ("intituling",)))
    assert got == want
    assert {r for *_, r, _, _ in got} == set(range(len(rules))) - {r for r in range(len(rules)) if not any(w[3] == r for w in want)}
    assert sum(w[4] for w in want) > 50


def test_tagged_lines(judgments):
    rules, docs, table = judgments
    got = {(r.doc_id, r.line_no): tuple(r.tags) for r in matcher.tagged_lines(table, "doc_id", "line_no", "text", rules).collect()}
    for d, (lines, flags) in docs.items():
        now, said = ("intituling",), {i: tags for i, _, _, _, tags in judged(lines, flags, rules, ("intituling",))}
        for i in range(len(lines)):
            now = said.get(i, now)
            assert got[d, i] == now


def test_rules_take_a_lines_faces_along(spark):
    """Hits carry what their lines are like: lines are read once, and not joined with themselves."""
    rules = [matcher.Rule("a", ("body",), (), ("is_bold",))]
    lines = spark.createDataFrame([(1, 1, "xa", True), (1, 2, "a", None), (1, None, "a", True), (2, 1, "b", True)], "d long, n long, t string, is_bold boolean")
    got = matcher.apply_rules(lines, "d", "n", "t", rules)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.d, r.place, r.at, r.counts) for r in got.collect()) == [(1, 1, 1, True), (1, 2, 0, False)]
