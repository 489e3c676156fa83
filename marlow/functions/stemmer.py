"""The English suffix stemmer of M. F. Porter (1980), as expressions over arrays of words, and as SQL.

Both are made of one table of steps. A step looks for the first suffix of its list that a word ends in,
and puts another in its place if the rest of the word is as wanted. ``y`` is a vowel after a consonant;
where it is none it is written ``Y`` until the end. The measure m of a stem, how often a vowel is
followed by a consonant, is only asked for being above 0, above 1, or 1, which regular expressions say.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
M0 = f"{VOWEL}{OTHER}"
M1 = f"{VOWEL}{OTHER}+{VOWEL}+{OTHER}"
ANY_VOWEL = VOWEL
#: A consonant, a vowel, and a consonant other than w, x and y, at the end.
SHORT = f"{OTHER}{VOWEL}[^aeiouywxY]$"

#: Suffixes, what takes their place, and what the stem before them must match (all of the patterns).
STEP_1A = [("sses", "ss", []), ("ies", "i", []), ("ss", "ss", []), ("s", "", [])]
STEP_1C = [("y", "i", [ANY_VOWEL]), ("Y", "i", [ANY_VOWEL])]
STEP_2 = [
    (a, b, [M0])
    for a, b in [
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
        ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
    ]
]
STEP_3 = [(a, b, [M0]) for a, b in [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]]
STEP_4 = [(a, "", [M1, "[st]$"] if a == "ion" else [M1]) for a in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()]


class _Spark:
    """How the steps are said in column expressions."""

    lit = staticmethod(F.lit)

    @staticmethod
    def ends(w: Column, suffix: str) -> Column:
        return F.endswith(w, F.lit(suffix))

    @staticmethod
    def cut(w: Column, n: int) -> Column:
        return F.substring(w, F.lit(1), F.length(w) - n)

    @staticmethod
    def match(w: Column, pattern: str) -> Column:
        return w.rlike(pattern)

    @staticmethod
    def join(w: Column, more: str) -> Column:
        return F.concat(w, F.lit(more)) if more else w

    @staticmethod
    def both(conditions: list[Column]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & c
        return out

    @staticmethod
    def neither(c: Column) -> Column:
        return ~c

    @staticmethod
    def case(cases: list[tuple[Column, Column]], other: Column) -> Column:
        out = F
        for c, v in cases:
            out = out.when(c, v)
        return out.otherwise(other)


class _Sql:
    """How the steps are said in SQL."""

    ends = staticmethod(lambda w, suffix: f"ends_with({w}, '{suffix}')")
    cut = staticmethod(lambda w, n: f"left({w}, length({w}) - {n})")
    match = staticmethod(lambda w, pattern: f"regexp_matches({w}, '{pattern}')")
    join = staticmethod(lambda w, more: f"({w} || '{more}')" if more else w)
    both = staticmethod(lambda conditions: "(" + " AND ".join(conditions or ["true"]) + ")")
    neither = staticmethod(lambda c: f"(NOT {c})")
    case = staticmethod(lambda cases, other: "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {other} END)")


def _step(say, w, table):  # noqa: ANN001, ANN202
    """The first suffix of the table counts, longer ones before those that they end in."""
    cases = []
    for suffix, put, wanted in sorted(table, key=lambda x: -len(x[0])):
        stem = say.cut(w, len(suffix))
        changed = say.join(stem, put)
        cases.append((say.ends(w, suffix), say.case([(say.both([say.match(stem, p) for p in wanted]), changed)], w) if wanted else changed))
    return say.case(cases, w)


def _mended(say, w):  # noqa: ANN001, ANN202
    """What is left of a word without -ed or -ing, made a word again."""
    double = say.both([say.match(w, "(?:" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxY") + ")$")])
    one = say.both([say.match(w, f"^{OTHER}*{VOWEL}+{OTHER}+$"), say.match(w, SHORT)])
    return say.case([(say.match(w, "(?:at|bl|iz)$"), say.join(w, "e")), (double, say.cut(w, 1)), (one, say.join(w, "e"))], w)


def _step_1b(say, w):  # noqa: ANN001, ANN202
    e, ed, ing = say.cut(w, 3), say.cut(w, 2), say.cut(w, 3)
    return say.case([
        (say.ends(w, "eed"), say.case([(say.match(e, M0), say.cut(w, 1))], w)),
        (say.ends(w, "ed"), say.case([(say.match(ed, ANY_VOWEL), _mended(say, ed))], w)),
        (say.ends(w, "ing"), say.case([(say.match(ing, ANY_VOWEL), _mended(say, ing))], w)),
    ], w)


def _step_5(say, w):  # noqa: ANN001, ANN202
    stem = say.cut(w, 1)
    one = say.both([say.match(stem, M0), say.neither(say.match(stem, SHORT))])
    return say.case([(say.ends(w, "e"), say.case([(say.match(stem, M1), stem), (one, stem)], w))], w)


def _step_5b(say, w):  # noqa: ANN001, ANN202
    return say.case([(say.both([say.ends(w, "ll"), say.match(say.cut(w, 1), M1)]), say.cut(w, 1))], w)


_STEPS = [lambda say, w: _step(say, w, STEP_1A), _step_1b, *(lambda say, w, t=t: _step(say, w, t) for t in (STEP_1C, STEP_2, STEP_3, STEP_4)), _step_5, _step_5b]


def _long_only(step: Callable, w: Column) -> Column:
    return F.when(F.length(w) > 2, step(_Spark, w)).otherwise(w)


def stems(words: Column) -> Column:
    """The stems of an array of words in small letters; words of one or two letters stay.

    Each step is a transform of its own, so that its word is computed once.
    """
    out = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiou])y", "$1Y"))
    for step in _STEPS:
        out = F.transform(out, partial(_long_only, step))
    return F.zip_with(words, out, lambda w, s: F.when(F.length(w) > 2, F.lower(s)).otherwise(w))


def beginnings(stem: str) -> list[str]:
    """How any word with this stem begins: as the stem does, but for what a step puts in a suffix's place.

    Of all that steps put, only ``e`` and ``i`` at the end, and ``le`` or ``l`` after a ``b`` (for
    *-biliti*), need not stand in the word.
    """
    out = {stem}
    if stem[-1:] in ("e", "i"):
        out.add(stem[:-1])
    if stem.endswith("ble"):
        out.add(stem[:-2])
    if stem.endswith("bl"):
        out.add(stem[:-1])
    return sorted(out)


def stems_sql(table: str, word: str = "term", stem: str = "stem") -> str:
    """A query that adds a column of stems to a table with a column of words in small letters."""
    out = f"SELECT *, regexp_replace(regexp_replace({word}, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS {stem} FROM {table}"
    for step in _STEPS:
        out = f"SELECT * REPLACE (CASE WHEN length({stem}) > 2 THEN {step(_Sql, stem)} ELSE {stem} END AS {stem}) FROM ({out})"
    return f"SELECT * REPLACE (CASE WHEN length({word}) > 2 THEN lower({stem}) ELSE {word} END AS {stem}) FROM ({out})"
