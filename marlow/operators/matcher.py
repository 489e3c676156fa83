"""Character patterns over the lines of documents, and the tags that their rules open and close.

A pattern is a string of characters: ``%`` is any digit, and a character with ``*`` after it may come any
number of times, or never. All patterns of a rule table become one automaton, which searches for each of
them everywhere and begins anew after each hit. It is stepped over a document's characters, a line feed
before the first line and after each, and its state goes on from line to line.

Few states can be met after a line feed, most often one. A line's hits and its last state are found for
each of them, all lines of an Arrow batch in step; where there are several, the states at the lines'
starts follow from composing these small maps, ``STRETCH`` lines at a time, then stretch by stretch.

A hit counts if its rule's tests hold: of the line (its place and face, columns of the table), or of the
tags then open, ``Not`` or ``Or`` of such. It closes and opens tags. That is one fold over a document's
hits, which are few beside its characters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRETCH = 1024


@dataclass(frozen=True)
class Not:
    test: str


@dataclass(frozen=True)
class Or:
    tests: tuple


@dataclass(frozen=True)
class Rule:
    pattern: str
    open: tuple[str, ...] = ()
    close: tuple[str, ...] = ()
    tests: tuple = field(default=())


#: Tags that can be open, and tests of them; other tests are columns of the lines.
TAGS = ["intituling", "body", "paragraph", "table", "row", "entry", "indent", "quote", "blank", "footer"]
OPEN_TESTS = {f"is_{tag}": tag for tag in TAGS}

#: The patterns of judgments, what they open and close, and when.
_HEAD = ("paragraph", "intituling")
_LIST = ("paragraph", "intituling", "indent")
RULES = [
    Rule("\n *[%%*] ", ("body", "paragraph"), ("intituling", "table"), ("is_left_aligned", Or(("is_intituling", "is_table")))),
    Rule("_______* *\n", ("paragraph",), ("paragraph",), ("is_left_aligned", "is_body")),
    Rule("\nREASONS *\n", ("body", "paragraph"), ("intituling",), ("is_bold", "is_intituling")),
    Rule("REASONS OF THE COURT *\n", ("body", "paragraph"), ("intituling",), ("is_bold", "is_intituling")),
    Rule("Introduction", ("body", "paragraph"), ("intituling",), ("is_bold", "is_intituling")),
    Rule("This page has been deliberately left blank *\n", ("body",), ("intituling", "table", "blank")),
    Rule("Para No", ("body", "table"), _HEAD, ("is_bold", "is_right_aligned")),
    Rule("Table of Contents", ("body", "table"), _LIST, ("is_bold",)),
    Rule("Contents", ("body", "table"), _LIST, ("is_bold", "is_center_aligned")),
    Rule("INDEX *\n", ("body", "table"), _LIST, ("is_bold", "is_center_aligned")),
    Rule("JUDGMENT PARTS *\n", ("body", "table"), _LIST, ("is_bold", "is_center_aligned")),
    Rule("Outline *\n", ("body", "table"), _LIST, ("is_bold", "is_center_aligned")),
    Rule("[", ("table", "row", "entry"), _LIST, ("is_right_aligned", "is_body", Not("is_table"), Not("is_quote"), Not("is_left_indented"))),
    Rule("[1] *\n", ("body", "table", "row", "entry"), _LIST, ("is_body", Not("is_table"), Not("is_quote"), "is_full_width")),
    Rule("%%* *\n", ("body", "table", "row", "entry"), _LIST, ("is_body", Not("is_table"), Not("is_footer"), "has_adjacent_chunks", "is_right_aligned")),
]
LINE_TESTS = ["is_left_aligned", "is_right_aligned", "is_center_aligned", "is_left_indented", "is_full_width", "is_bold", "has_adjacent_chunks"]


class Automaton:
    """All patterns at once. ``step[state, class of a character]``; a step may hit some patterns."""

    def __init__(self, patterns: list[str]) -> None:
        items = [self._items(p) for p in patterns]
        self.own = sorted({c for p in items for c, _ in p if c != "%"} | {"\n", "%"})
        digit, other = len(self.own), len(self.own) + 1
        symbols = [*self.own, "digit", None]
        takes = lambda c, k: c == symbols[k] or (c == "%" and (k == digit or (k < digit and symbols[k].isdigit())))

        def closed(places: set[int], p: list[tuple[str, bool]]) -> frozenset[int]:
            out = set(places)
            for i in range(len(p)):
                if i in out and p[i][1]:
                    out.add(i + 1)
            return frozenset(out)

        first = tuple(closed({0}, p) for p in items)
        if any(len(p) in s for p, s in zip(items, first, strict=True)):
            raise ValueError("a pattern must hold a character")
        known, queue, self.hits, steps = {first: 0}, [first], {}, []
        for state in queue:
            row = []
            for k in range(other + 1):
                then, hit = [], []
                for r, (places, p) in enumerate(zip(state, items, strict=True)):
                    moved = closed({i if p[i][1] else i + 1 for i in places if i < len(p) and takes(p[i][0], k)}, p) | first[r]
                    if len(p) in moved:
                        hit.append(r)
                        moved = first[r]
                    then.append(moved)
                then = tuple(then)
                if then not in known:
                    known[then] = len(queue)
                    queue.append(then)
                if hit:
                    self.hits[len(steps), k] = hit
                row.append(known[then])
            steps.append(row)
        self.step = np.array(steps, np.int32)
        self.hit = np.zeros(self.step.shape, bool)
        for at in self.hits:
            self.hit[at] = True
        feed = self.own.index("\n")
        self.feed = feed
        # the states that a line can begin in
        self.starts = [int(self.step[0, feed])]
        self.starts += sorted({int(x) for x in self.step[:, feed]} - {self.starts[0]})
        self.code = np.full(0x110000, other, np.uint8)
        self.code[[c for c in range(0x110000) if chr(c).isdigit()]] = digit
        for k, c in enumerate(self.own):
            self.code[ord(c)] = k

    @staticmethod
    def _items(pattern: str) -> list[tuple[str, bool]]:
        out, i = [], 0
        while i < len(pattern):
            star = pattern[i + 1 : i + 2] == "*"
            out.append((pattern[i], star))
            i += 2 if star else 1
        return out

    def run(self, lines: list[str]) -> list[list[list[int]]]:
        """For each line and each state that it can begin in: [number of the state after it, rule, place, rule, place ...]."""
        texts = [line + "\n" for line in lines]
        size = np.array([len(x) for x in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        ends = np.cumsum(size)
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin, size = (ends - size)[order], size[order]
        number = {s: k for k, s in enumerate(self.starts)}
        out: list[list[list[int]]] = [[] for _ in lines]
        for start in self.starts:
            state = np.full(len(lines), start, np.int32)
            found: dict[int, list[int]] = {}
            for t in range(int(size.max(initial=0))):
                n = int(np.searchsorted(-size, -t, "left"))
                symbol = codes[begin[:n] + t]
                before = state[:n]
                for i in np.flatnonzero(self.hit[before, symbol]).tolist():
                    for r in self.hits[int(before[i]), int(symbol[i])]:
                        found.setdefault(i, []).extend((r, t))
                state[:n] = self.step[before, symbol]
            for i, at in enumerate(order.tolist()):
                out[at].append([number[int(state[i])], *found.get(i, [])])
        return out


def hits(lines: DataFrame, key: str, place: str, text: str, patterns: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, place, at, rule, and ``carried`` columns of the line): where a pattern ends, by the line's place, the character's in it (its length for the line feed) and the pattern's number.

    A null text is an empty line; a line without a key belongs to no document and has no hits.
    """
    automaton = Automaton(patterns)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(automaton.run([x or "" for x in s]))

    rows = lines.filter(F.col(key).isNotNull()).select(key, F.col(place).cast("long").alias("place"), *carried, run(F.coalesce(text, F.lit(""))).alias("runs"))
    entry = F.lit(0)
    if len(automaton.starts) > 1:
        rows = _entered(rows, key)
        entry = F.col("entry")
    said = F.get("runs", entry)
    found = F.transform(F.sequence(F.lit(1), F.size("said") - 2, F.lit(2)), lambda i: F.struct(F.get("said", i).alias("rule"), F.get("said", i + 1).alias("at")))
    return rows.select(key, "place", *carried, said.alias("said")).filter(F.size("said") > 2).select(key, "place", *carried, F.explode(found).alias("x")).select(key, "place", "x.at", "x.rule", *carried)


def _entered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``entry``, the number of the state that each line begins in."""
    numbered = rows.withColumn("line", F.row_number().over(W.partitionBy(key).orderBy("place")) - 1).withColumn("exits", F.transform("runs", lambda r: r[0]))
    numbered = numbered.withColumn("stretch", F.floor(F.col("line") / STRETCH))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "exits"))), lambda x: x["exits"])
    stretches = numbered.groupBy(key, "stretch").agg(listed.alias("maps"))
    through = lambda maps, entry: F.aggregate(maps, entry, lambda s, m: F.get(m, s))
    every = F.transform(F.get("maps", F.lit(0)), lambda _, k: through(F.col("maps"), k))
    whole = stretches.select(key, "stretch", every.alias("map"))
    along = lambda maps: F.aggregate(maps, F.array(F.lit(0)), lambda out, m: F.array_append(out, F.get(m, F.element_at(out, -1))))
    heads = whole.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "map"))), lambda x: x["map"]).alias("maps"))
    heads = heads.select(key, F.posexplode(along(F.col("maps"))).alias("stretch", "head"))
    entries = stretches.join(heads, [key, "stretch"]).select(key, "stretch", F.aggregate("maps", F.array("head"), lambda out, m: F.array_append(out, F.get(m, F.element_at(out, -1)))).alias("entries"))
    return numbered.join(entries, [key, "stretch"]).withColumn("entry", F.get("entries", (F.col("line") % STRETCH).cast("int"))).drop("entries", "exits", "line", "stretch")


def _clauses(rule: Rule, bit: Callable[[str], int]) -> Column:
    """What must hold for a hit, given its line: for each test a pair of tag sets, of which one tag is open, or one is not.

    A test of the line that holds is left out; one that fails has no tag that could satisfy it.
    """
    out = []
    for test in rule.tests:
        shown, opened, shut = [], 0, 0
        for t in test.tests if isinstance(test, Or) else (test,):
            name, want = (t.test, False) if isinstance(t, Not) else (t, True)
            if name in OPEN_TESTS:
                opened, shut = (opened | bit(OPEN_TESTS[name]), shut) if want else (opened, shut | bit(OPEN_TESTS[name]))
            else:
                shown.append(F.coalesce(F.col(name), F.lit(False)) == want)
        holds = reduce(lambda a, b: a | b, shown, F.lit(False))
        out.append(F.when(~holds, F.struct(F.lit(opened).alias("opened"), F.lit(shut).alias("shut"))))
    if not out:
        return F.array().cast("array<struct<opened:int,shut:int>>")
    return F.filter(F.array(*out), lambda c: c.isNotNull())


def apply_rules(lines: DataFrame, key: str, place: str, text: str, rules: list[Rule] = RULES, first: tuple[str, ...] = ("intituling",)) -> DataFrame:
    """(key, place, at, rule, counts, tags): every hit, whether its tests held, and the tags open after it.

    ``lines`` has a boolean column for each test of the line that a rule names (null is false); ``first``
    are the tags open at the start. Hits at one character go in the order of the table.
    """
    bit = lambda tag: 1 << TAGS.index(tag)
    mask = lambda tags: sum(bit(t) for t in set(tags))
    named = sorted({t.test if isinstance(t, Not) else t for r in rules for x in r.tests for t in (x.tests if isinstance(x, Or) else (x,))} - set(OPEN_TESTS))
    found = hits(lines, key, place, text, [r.pattern for r in rules], tuple(named)).filter("place is not null")
    per_rule = lambda values: F.get(F.array(*values), F.col("rule"))
    told = found.select(
        key, "place", "at", "rule", per_rule([_clauses(r, bit) for r in rules]).alias("clauses"), per_rule([F.lit(mask(r.open)) for r in rules]).alias("opens"), per_rule([F.lit(mask(r.close)) for r in rules]).alias("closes")
    )
    start = F.struct(F.lit(mask(first)).alias("tags"), F.array().cast("array<struct<place:bigint,at:int,rule:int,counts:boolean,tags:int>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        counts = F.forall(h["clauses"], lambda c: (acc["tags"].bitwiseAND(c["opened"]) != 0) | (F.bitwise_not(acc["tags"]).bitwiseAND(c["shut"]) != 0))
        tags = F.when(counts, acc["tags"].bitwiseAND(F.bitwise_not(h["closes"])).bitwiseOR(h["opens"])).otherwise(acc["tags"])
        return F.struct(tags.alias("tags"), F.array_append(acc["out"], F.struct(h["place"].alias("place"), h["at"].alias("at"), h["rule"].alias("rule"), counts.alias("counts"), tags.alias("tags"))).alias("out"))

    folded = told.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "at", "rule", "clauses", "opens", "closes"))).alias("hs"))
    each = folded.select(key, F.explode(F.aggregate("hs", start, step)["out"]).alias("x")).select(key, "x.*")
    names = F.filter(F.array(*(F.when(F.col("tags").bitwiseAND(F.lit(bit(t))) != 0, F.lit(t)) for t in TAGS)), lambda t: t.isNotNull())
    return each.withColumn("tags", names)


def tagged_lines(lines: DataFrame, key: str, place: str, text: str, rules: list[Rule] = RULES, first: tuple[str, ...] = ("intituling",)) -> DataFrame:
    """``lines`` with ``tags``, those open at the end of each line."""
    last = apply_rules(lines, key, place, text, rules, first).groupBy(key, "place").agg(F.max_by("tags", F.struct("at", "rule")).alias("__tags"))
    last = last.select(F.col(key).alias("__key"), F.col("place").alias("__place"), "__tags")
    rows = lines.join(last, (F.col(key) == F.col("__key")) & (F.col(place) == F.col("__place")), "left").drop("__key", "__place")
    open_now = F.coalesce(F.last("__tags", ignorenulls=True).over(W.partitionBy(key).orderBy(place)), F.array(*map(F.lit, first)))
    return rows.withColumn("tags", open_now).drop("__tags")
