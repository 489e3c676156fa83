"""Words and stems of the published algorithm, and a plain stemmer against both forms on made-up words."""

from __future__ import annotations

import random
import re

import duckdb
from pyspark.sql import functions as F

from marlow.functions.stemmer import STEP_1A, STEP_2, STEP_3, STEP_4, stems, stems_sql

#: Words and their stems.
STEMS = """caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size,
hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, valency valenc, hesitancy hesit,
digitizer digit, conformably conform, radically radic, differently differ, vilely vile, analogously analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis,
hopefulness hope, callousness callous, formality formal, sensitivity sensit, sensibility sensibl, triplicate triplic, formative form, formalize formal, electricity electr, electrical electr, hopeful hope,
goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust,
dependent depend, adoption adopt, communism commun, activate activ, angularity angular, homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controlling control, roll roll,
say sai, by by, generalizations gener, oscillators oscil, toying toi, yes ye, syzygy syzygi, is is""".replace("\n", " ")
PAIRS = [tuple(x.split()) for x in STEMS.split(",")]


def plain(w):
    """The algorithm over marks of vowels and consonants."""
    if len(w) <= 2:
        return w

    def kinds(s):
        out = ""
        for i, c in enumerate(s):
            out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
        return out

    def m(s):
        return len(re.findall("v+c+", kinds(s)))

    def short(s):
        return kinds(s).endswith("cvc") and s[-1] not in "wxy"

    def replaced(w, table, least):
        for a, b in sorted(((a, b) for a, b, _ in table), key=lambda x: -len(x[0])):
            if w.endswith(a):
                stem = w[: -len(a)]
                fits = m(stem) > least if least is not None else True
                return stem + b if fits and (a != "ion" or stem.endswith(("s", "t"))) else w
        return w

    w = replaced(w, STEP_1A, None)
    if len(w) > 2:
        if w.endswith("eed"):
            w = w[:-1] if m(w[:-3]) else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end):
                    stem = w[: -len(end)]
                    if "v" in kinds(stem):
                        w = stem
                        if w.endswith(("at", "bl", "iz")):
                            w += "e"
                        elif w[-2:-1] == w[-1:] and kinds(w)[-2:] == "cc" and w[-1] not in "lsz" and w[-1].isascii() and w[-1].isalpha():
                            w = w[:-1]
                        elif m(w) == 1 and short(w):
                            w += "e"
                    break
    if len(w) > 2 and w.endswith("y") and "v" in kinds(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((STEP_2, 0), (STEP_3, 0), (STEP_4, 1)):
        w = replaced(w, table, least) if len(w) > 2 else w
    if len(w) > 2 and w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    if len(w) > 2 and w.endswith("ll") and m(w[:-1]) > 1:
        w = w[:-1]
    return w


def both(spark, words):
    got = [r.s for r in spark.createDataFrame([(words,)], "ws array<string>").select(F.explode(stems(F.col("ws"))).alias("s")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE w AS SELECT unnest(?) AS term, unnest(range(?)) AS i", [words, len(words)])
    sql = [s for (s,) in con.execute(f"SELECT stem FROM ({stems_sql('w')}) ORDER BY i").fetchall()]
    return got, sql


def test_published_stems(spark):
    got, sql = both(spark, [w for w, _ in PAIRS])
    assert got == sql == [s for _, s in PAIRS]
    assert [plain(w) for w, _ in PAIRS] == [s for _, s in PAIRS]


def test_made_up_words(spark):
    rnd = random.Random(2)
    ends = [a for t in (STEP_1A, STEP_2, STEP_3, STEP_4) for a, _, _ in t] + ["ed", "ing", "eed", "y", "ly", "e", "ll", "zz", "é"]
    words = ["".join(rnd.choice("abcdeilnorstuyyéw1") for _ in range(rnd.randint(0, 5))) + "".join(rnd.choice(ends) for _ in range(rnd.randint(0, 3))) for _ in range(4000)]
    words = [w for w in words if not re.search("yy", w)]
    got, sql = both(spark, words)
    assert got == sql
    assert got == [plain(w) for w in words]


def test_words_begin_as_their_stems_say(spark):
    from itertools import product

    from marlow.functions.stemmer import STEP_1A, STEP_2, STEP_3, STEP_4, beginnings

    heads = ["", "b", "er", "ap", "hop", "rel", "conf", "sky", "ay", "posit", "troub", "oscill"]
    ends = ["", "s", "ed", "ing", "eed", "y", "ies", "ly", "e", "ll", "bility", "ency", "ancy", "abilities", "izing", "ating", "bling", "fulness"] + [a for a, *_ in STEP_1A + STEP_2 + STEP_3 + STEP_4]
    words = sorted({h + a + b for h, a, b in product(heads, ends, ends)})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.get(stems(F.array("w")), F.lit(0)).alias("s")).collect()
    assert len(rows) > 20000 and [r for r in rows if not any(r.w.startswith(b) for b in beginnings(r.s))] == []


def test_a_word_is_stemmed_once(spark):
    from marlow.operators import text as tx

    docs = spark.createDataFrame([(1, "Running the runs, run"), (2, "runs"), (3, None), (None, "running")], "id long, text string")
    own = tx.stemmed_words(docs, "id", "text")
    assert sorted((r.id or 0, r.term, r.n, r.stem) for r in own.collect()) == [(0, "running", 1, "run"), (1, "run", 1, "run"), (1, "running", 1, "run"), (1, "runs", 1, "run"), (2, "runs", 1, "run")]
