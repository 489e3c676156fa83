"""Decontamination against full dynamic programming, language-model probabilities and gain, licence wordings not in the templates."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlow.llm import decontaminate, licenses, lm_scoring
from marlow.llm.textnum import utf8

LETTERS = "abcdefghij klm no"


def least_edits(item, text):
    """The least edits between the item and any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    for c in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j, d in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
        row = new
    return int(row.min())


def plain(s):
    return " ".join(s.lower().split())


def test_decontaminate_finds_all_within_the_budget():
    rnd = random.Random(8)
    make = lambda n: "".join(rnd.choice(LETTERS) for _ in range(n))
    items = [plain(make(rnd.randint(40, 120))) for _ in range(12)]
    own = decontaminate.Items(list(range(len(items))), items)
    texts = []
    for _ in range(90):
        k = rnd.randrange(len(items))
        s = list(items[k])
        for _ in range(rnd.randint(0, len(s) // 8)):  # up to and beyond the budget
            at = rnd.randrange(len(s))
            s[at : at + 1] = rnd.choice([[], [rnd.choice("xyz")], [s[at], rnd.choice("xyz")]])
        texts.append(plain(make(rnd.randint(0, 40)) + "".join(s) + make(rnd.randint(0, 40))))
    found = {(r, i): e for r, i, e in own.find(*utf8(pa.array(texts)))}
    within = 0
    for r, text in enumerate(texts):
        for i, item in enumerate(items):
            edits = least_edits(item, text)
            if edits <= own.edits[i]:
                within += 1
                assert found.get((r, i)) == edits, (text, item)
            else:
                assert (r, i) not in found
    assert within >= 40


def test_decontaminate_slices_its_postings(monkeypatch):
    """Items that share a sentence, and a text that repeats it: the same hits however few postings are looked at together."""
    shared = "every item of this benchmark opens with one and the same long sentence"
    own = decontaminate.Items(list(range(30)), [f"{shared} and ends on number {k}{k}{k}" for k in range(30)])
    column = utf8(pa.array([" ".join([shared] * 20), f"{shared} and ends on number 777", None]))
    want = own.find(*column)
    monkeypatch.setattr(decontaminate, "POSTINGS", 64)
    assert own.find(*column) == want
    assert (1, 7, 0) in want


def test_decontaminate_finds_the_last_of_many_items():
    """300,000 short items in a block, and a text of more characters than 2**20."""
    rnd = random.Random(1)
    items = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(300_000)]
    own = decontaminate.Items(list(range(len(items))), items, least=10)
    texts = [f"zz {items[5]} q", f"{items[290_000]} yy", f"x {items[299_999]}", "nothing", items[262_143], items[262_144], "1 " * 700_000 + items[299_998]]
    assert own.find(*utf8(pa.array(texts))) == [(0, 5, 0), (1, 290_000, 0), (2, 299_999, 0), (4, 262_143, 0), (5, 262_144, 0), (6, 299_998, 0)]


def test_licences_of_many_notices_in_one_text(spark):
    """Notices and other lines by turns, 12,000 lines in all, and one line of 500 notices."""
    text = "\n".join("SPDX-License-Identifier: MIT" if k % 2 else f"line {k} of code" for k in range(12_000))
    row = " ".join(["SPDX-License-Identifier: MIT"] * 500)
    got = licenses.scan_documents(spark.createDataFrame([(1, text), (2, row)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].families == ["mit"] and got[0].n_notices == 6000
    assert got[1].families == ["mit"]


@pytest.fixture(scope="module")
def chained(spark):
    """Texts in which every word says the next but one time in ten."""
    rnd, rows = random.Random(6), []
    for i in range(1500):
        at, ws = rnd.randrange(40), []
        for _ in range(60):
            at = (at + 1) % 40 if rnd.random() < 0.9 else rnd.randrange(40)
            ws.append(f"w{at}")
        rows.append((i, " ".join(ws)))
    return spark.createDataFrame([*rows, (None, None)], "id long, text string").repartition(4).cache()


def test_lm_probabilities_sum_to_one(spark, chained, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 24)  # some words are beyond the table
    model = lm_scoring.train(chained.filter(~lm_scoring.scored_only(F.col("id"))))
    rng = np.random.default_rng(1)
    odds = model.odds(model.weights, rng.integers(0, lm_scoring.BUCKETS, (3, 50)))
    assert odds.sum(1) == pytest.approx(np.ones(50), abs=1e-5)
    for kind in set(model.kind.tolist()):
        assert (10 ** model.inside[model.kind == kind]).sum() <= 1 + 1e-9
    inside = [(10 ** model.inside[model.kind == k]).sum() for k in set(model.kind.tolist()) - {0, lm_scoring.CLASSES - 1}]
    assert inside == pytest.approx(np.ones(len(inside)))
    head = set(model.key.view(np.int64).tolist())
    rest = [r.n for r in model.counts.collect() if r.key not in head]
    assert sum(n + 0.5 for n in rest) + 0.5 == pytest.approx(10**model.rest_scale)


def test_lm_score_gains_on_held_out_texts(chained):
    held = lm_scoring.score_all(chained.select(F.col("id").alias("doc_id"), "text")).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.2 * held[2]  # a fifth of a decade a token better than counts alone


def test_licences_of_other_wordings(spark):
    """Notices in other words keep their family or are unknown, never another family; sentences that only mention the words are none."""
    said = {
        "This file may be used under the terms of the Apache License, Version 2.0.": {"apache", "unknown"},
        "The code is free software; you can redistribute it under the GNU General Public License, version 2 or later.": {"gpl", "unknown"},
        "The authors license this dataset under Creative Commons Attribution 4.0 International.": {"cc", "unknown"},
        "All files here are licensed under the terms of the MIT license unless noted otherwise.": {"mit", "unknown"},
        "Copies may be made under the Harbour Board's own licence terms, which come with the work.": {"unknown"},
    }
    plain_lines = ["He renewed his driving licence on a rainy day in May.", "The publisher of the novel held no copyright in the songs.", "They had permission to cross the field.", "A warranty is worth little when the shop has closed."]
    rows = spark.createDataFrame(list(enumerate([*said, *plain_lines])), "doc_id long, text string")
    got = {r.doc_id: set(r.families) for r in licenses.scan_documents(rows).collect()}
    for i, (line, allowed) in enumerate(said.items()):
        assert got[i] <= allowed, (line, got[i])
    assert sum(bool(got[i]) for i in range(len(said))) >= 4
    assert sum(bool(got[len(said) + i]) for i in range(len(plain_lines))) <= 1
