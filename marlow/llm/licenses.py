"""License scans: a trained paragraph classifier, in DataFrame operations only.

Notices are found however they are wrapped. The word pairs of a text, line breaks and comment marks as
spaces, meet those of the templates in a join; where enough pairs of a template lie close together, the
lines they are on, joined, are one candidate. Of the other lines, those with a cue word of licensing are
candidates, and so are the runs of lines that go on without a sentence's end where they hold one; a run
that is a notice counts once, in place of its lines. A candidate is turned into its distinct words and
word pairs, and a softmax regression over them, the families plus *unknown* (a notice of no known
family) plus *none* (no notice at all), gives a family and a probability. The regression is trained here, by gradient steps that are joins and aggregates, on the templates below,
each with whole sentences and with words left out; a temperature, chosen on the variants that the
training did not see, calibrates the probabilities. A predicted family is confirmed where the candidate
also holds enough of the word pairs of one of its templates, or is a template of one word and nothing
else; otherwise it is reported as unknown. Where no class reaches the probability ``sure``, or *none*
does, the candidate is no notice. Names that are words of other meanings too, such as MIT, are told
apart by the words beside them, for *none* has templates of capitalised prose.

The feature weights are a table of a bounded size, the n-grams of the templates, so joining it never
moves the candidates. Words of texts without a cue are never shuffled.

Edge cases: a null or empty text has no notice; equal notices of one document count separately; every
row is told apart by its place, so repeated rows have the same notices each and null identifiers are
like any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .expressions import let, sums_before
from .store import ROW, materialise, rows

#: Opening phrases and notices of the licence families, and lines that only look like one.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License 2.0",
        "Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License",
        "BSD-3-Clause",
        "BSD",
    ],
    "cc": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "To the extent possible under law, the author has waived all copyright under CC0, the Creative Commons public domain dedication.",
        "CC BY 4.0",
        "CC0 1.0 Universal",
        "CC0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU GPL v3 or later",
        "GNU GPL",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "MIT License",
        "MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "All rights reserved.",
        "This material is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
    ],
    "unknown": [
        "Licensed under the terms of the community license agreement.",
        "Distributed under a custom license, see the accompanying file for its conditions.",
        "Use of this work is subject to the license terms of its authors.",
        "This text may be shared under the house license of its publisher.",
    ],
    "none": [
        "The driver renewed the license of the old car last week.",
        "She asked the school for permission to leave early.",
        "The warranty of the washing machine had run out.",
        "He wrote about copyright in the modern age and what readers think of it.",
        "A fishing license costs little in the northern counties.",
        "They granted the visitors permission to take pictures.",
        "DIE KINDER GEHEN MIT DEM HUND IN DEN WALD.",
        "ER KAM MIT DER BAHN UND MIT SEINEM BRUDER AUS DER STADT.",
        "MIT DIESEM ZUG FÄHRT SIE NICHT NACH HAUSE.",
        "SIE SPRICHT MIT IHM ÜBER DAS BUCH, DAS ER LIEST.",
        "WIR WAREN MIT EINEM FREUND IM GARTEN.",
        "DAS HAUS MIT DEN FENSTERN IST FÜR ALLE ZU GROSS.",
    ],
}
GENERAL = r"(?i:licen[cs]|copyright|warrant|permission|permitted|redistribut|all\W+rights\W+reserved|creative\W+commons|public\W+domain|free\W+software|mozilla|apache|proprietary)"
CUES = GENERAL + r"|\b(?:CC0|CC[ -]BY|GNU|MIT|BSD)\b"
VARIANTS, STEPS, RATE = 12, 8, 6.0
TEMPERATURES = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def _grams(words: Column) -> Column:
    """Distinct words and word pairs, without final stops."""
    plain = F.transform(words, lambda w: F.regexp_replace(w, r"\.+$", ""))
    return let(plain, lambda own: F.array_distinct(F.concat(own, _pairs(own))))


def _pairs(words: Column) -> Column:
    """Every two neighbours, a blank between; ``words`` is walked once."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _samples(spark: SparkSession) -> DataFrame:
    """Templates and their variants: sample, family, grams, unseen."""
    rows = [f"('{f}', {i}, '{t.replace(chr(39), chr(39) * 2)}')" for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    base = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(family, number, text)")
    base = base.select("family", "number", _words(F.col("text")).alias("words")).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS))))
    thinned = F.filter("words", lambda w, i: (F.col("variant") == 0) | (F.pmod(F.xxhash64("family", "number", "variant", i), F.lit(100)) >= 15))
    out = base.select(F.concat_ws("-", "family", "number", "variant").alias("sample"), "family", (F.col("variant") % 4 == 3).alias("unseen"), _grams(thinned).alias("grams"))
    return out.filter(F.size("grams") > 0)


def _scores(features: DataFrame, weights: DataFrame, key: list[str]) -> DataFrame:
    """Linear scores of every class for each key, scaled by the root of the number of features known."""
    joined = features.join(F.broadcast(weights), "gram")
    return joined.groupBy(*key, "class").agg((F.sum("w") / F.sqrt(F.first("n"))).alias("z"))


def _softmax(scores: DataFrame, key: list[str], temperature: float = 1.0) -> DataFrame:
    """One row for each key: an array of (p, class), the likeliest first."""
    each = scores.groupBy(*key).agg(F.collect_list(F.struct((F.col("z") / temperature).alias("z"), "class")).alias("zs"))
    top = F.array_max(F.transform("zs", lambda s: s["z"]))
    odds = F.transform("zs", lambda s: F.struct(F.exp(s["z"] - F.col("top")).alias("p"), s["class"].alias("class")))
    each = each.withColumn("top", top).withColumn("odds", odds)
    total = F.aggregate("odds", F.lit(0.0), lambda a, s: a + s["p"])
    ps = F.transform("odds", lambda s: F.struct((s["p"] / F.col("total")).alias("p"), s["class"].alias("class")))
    return each.withColumn("total", total).select(*key, F.sort_array(ps, asc=False).alias("ps"))


def _features(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*key, F.size("grams").alias("n"), F.explode("grams").alias("gram"))


def train(spark: SparkSession) -> tuple[DataFrame, float]:
    """(weights: gram, class, w; temperature).

    The tables are those of the templates, so each step runs in one partition without an exchange. The
    first weights are smoothed log counts of the n-grams by class; gradient steps of the softmax
    regression go on from there.
    """
    samples = materialise(_samples(spark).coalesce(1), "licence-samples").coalesce(1)
    features = materialise(_features(samples.filter("not unseen"), ["sample", "family"]), "licence-features").coalesce(1)
    share = features.groupBy("family").agg(F.countDistinct("sample").alias("of_family"))
    features = materialise(features.join(F.broadcast(share), "family"), "licence-features").coalesce(1)
    classes = F.array(*map(F.lit, TEMPLATES))
    counted = features.groupBy("gram", F.col("family").alias("class")).agg((F.count(F.lit(1)) / F.first("of_family")).alias("rate"))
    grid = features.select("gram").distinct().select("gram", F.explode(classes).alias("class"))
    first = F.log(F.coalesce("rate", F.lit(0.0)) + 0.05)
    weights = grid.join(F.broadcast(counted), ["gram", "class"], "left").select("gram", "class", first.alias("w"))
    weights = materialise(weights, "licence-weights").coalesce(1)
    for _ in range(STEPS):
        p = _softmax(_scores(features, weights, ["sample"]), ["sample"]).select("sample", F.explode("ps").alias("s")).select("sample", "s.class", "s.p")
        slope = features.join(F.broadcast(p), "sample")
        miss = (F.col("family") == F.col("class")).cast("double") - F.col("p")
        slope = slope.groupBy("gram", "class").agg(F.sum(miss / F.sqrt("n") / F.col("of_family")).alias("g"))
        weights = materialise(weights.join(F.broadcast(slope), ["gram", "class"], "left").select("gram", "class", (F.col("w") * 0.999 + RATE * F.coalesce("g", F.lit(0.0))).alias("w")), "licence-weights").coalesce(1)
    scored = materialise(_scores(_features(samples.filter("unseen"), ["sample", "family"]), weights, ["sample", "family"]), "licence-scores").coalesce(1)
    union = None
    for t in TEMPERATURES:
        own = F.filter("ps", lambda s: s["class"] == F.col("family"))
        loss = _softmax(scored, ["sample", "family"], t).select(F.lit(t).alias("t"), (-F.log(F.greatest(F.element_at(own, 1)["p"], F.lit(1e-9)))).alias("l"))
        union = loss if union is None else union.unionByName(loss)
    best = union.groupBy("t").agg(F.avg("l").alias("l")).orderBy("l", "t").first()
    return weights, float(best["t"]) if best else 1.0


def _known(spark: SparkSession, families: set[str]) -> DataFrame:
    """(family, number, pairs): the word pairs of the templates of some families."""
    rows = [f"('{f}', {i}, '{t.replace(chr(39), chr(39) * 2)}')" for f, ts in TEMPLATES.items() if f in families for i, t in enumerate(ts)]
    known = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(family, number, text)")
    return known.select("family", "number", F.filter(_grams(_words(F.col("text"))), lambda g: g.contains(" ")).alias("pairs"))


#: Spans of words: pairs matched, negative length, first pair and last pair.
SPANS = "array<struct<n:int,less:int,start:int,stop:int>>"


def _best(spans: str) -> Column:
    """Of spans that overlap those with most pairs, then the shortest, in order of place."""
    def step(acc: Column, x: Column) -> Column:
        met = F.exists(acc, lambda y: (y["start"] <= x["stop"]) & (x["start"] <= y["stop"]))
        return F.when(met, acc).otherwise(F.concat(acc, F.array(x)))

    taken = F.aggregate(F.sort_array(spans, asc=False), F.expr(f"cast(array() as {SPANS})"), step)
    return F.array_sort(taken, lambda x, y: x["start"] - y["start"])


def _spans(texts: DataFrame, alike: float) -> DataFrame:
    """(row, spans): where a text holds enough of a template's pairs within twice its length, by place of words."""
    known = _known(texts.sparkSession, set(TEMPLATES) - {"none"}).select("family", "number", F.size("pairs").alias("size"), F.explode("pairs").alias("gram"))
    pairs = texts.filter(F.size("words") > 1).select("row", F.posexplode(let(F.transform("words", lambda w: w["word"]), _pairs)).alias("at", "gram"))
    hits = pairs.join(F.broadcast(known), "gram").withColumn("scaled", (F.col("at") * 1000 / (2 * F.col("size") + 8)).cast("long"))
    near = Window.partitionBy("row", "family", "number").orderBy("scaled").rangeBetween(0, 1000)
    hits = hits.select("row", "family", "number", "size", "at", F.array_sort(F.collect_list(F.struct("at", "gram")).over(near)).alias("near"))
    hits = hits.withColumn("grams", F.transform("near", lambda x: x["gram"]))
    firsts = F.filter("near", lambda x, i: F.array_position("grams", x["gram"]) == i + 1)
    hits = hits.select("row", "family", "number", "size", F.col("at").alias("start"), firsts.alias("firsts")).filter(F.size("firsts") >= alike * F.col("size"))
    stop = F.element_at("firsts", -1)["at"]
    each = F.struct(F.size("firsts").alias("n"), (F.col("start") - stop).alias("less"), "start", stop.alias("stop"))
    best = hits.groupBy("row", "family", "number").agg(F.collect_list(each).alias("spans")).select("row", F.explode(_best("spans")).alias("span"))
    return best.groupBy("row").agg(F.collect_list("span").alias("spans")).select("row", _best("spans").alias("spans"))


def _candidates(docs: DataFrame, alike: float) -> DataFrame:
    """(ROW, doc_id, row, paragraph, part, run, whole, grams): spans of templates, runs of lines and lines.

    ``run`` is null for spans of templates, ``whole`` says that a run is meant and not a line of it.
    """
    cued = docs.filter(F.col("text").rlike(CUES))
    clean = lambda line: F.regexp_replace(line, r"^\s*(?i:rem|dnl|--+)(?=\s)", "")
    lines = F.transform(F.split("text", "\n"), lambda s: F.struct(F.transform(_words(clean(s)), lambda w: F.regexp_replace(w, r"\.+$", "")).alias("ws"), s.rlike(CUES).alias("cue"), s.rlike(r"[.:!?][^\p{L}\p{N}]*$").alias("ends")))
    cued = materialise(cued.select(F.monotonically_increasing_id().alias("row"), *ROW, "doc_id", lines.alias("lines")), "licence-lines")
    texts = cued.select("row", *ROW, "doc_id", "lines", F.flatten(F.transform("lines", lambda s, i: F.transform(s["ws"], lambda w: F.struct(i.alias("line"), w.alias("word"))))).alias("words"))
    texts = texts.join(_spans(texts, alike), "row", "left").withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")))
    at = lambda i: F.get("words", i)["line"]
    ranges = F.transform("spans", lambda s, k: F.struct(at(s["start"]).alias("first"), at(s["stop"] + 1).alias("last"), F.coalesce(F.get("spans", k - 1)["stop"] + 1, F.lit(-1)).alias("after"), F.coalesce(F.get("spans", k + 1)["start"], F.size("words")).alias("before")))
    texts = materialise(texts.withColumn("ranges", ranges), "licence-texts")
    key = [*ROW, "doc_id", "row"]

    # a range's words are neighbours: from its first line or the range before, to its last line or the range after
    starts = sums_before(F.concat(F.transform("lines", lambda s: F.size(s["ws"])), F.array(F.lit(0))))
    slices = let(starts, lambda at: F.transform("ranges", lambda r: F.struct(r["first"].alias("paragraph"), F.greatest(F.get(at, r["first"]), r["after"] + 1).alias("from"), F.least(F.get(at, r["last"] + 1), r["before"]).alias("to"))))
    found = texts.select(*key, "words", slices.alias("slices"))
    own = F.transform("slices", lambda r: F.struct(r["paragraph"].alias("paragraph"), F.transform(F.slice("words", r["from"] + 1, F.greatest(r["to"] - r["from"], F.lit(0))), lambda w: w["word"]).alias("ws")))
    found = found.select(*key, F.posexplode(own).alias("part", "r"))
    found = found.select(*key, "r.paragraph", "part", F.lit(None).cast("long").alias("run"), F.lit(False).alias("whole"), "r.ws")

    covered = texts.select("row", F.explode("ranges").alias("r")).select("row", F.explode(F.sequence("r.first", "r.last")).alias("paragraph")).distinct()
    rest = texts.select(*key, F.posexplode("lines").alias("paragraph", "line")).join(covered.withColumn("held", F.lit(True)), ["row", "paragraph"], "left")
    rest = rest.select(*key, "paragraph", "line.*", (F.col("held").isNotNull() | (F.size("line.ws") == 0)).alias("apart"))
    ordered = Window.partitionBy("row").orderBy("paragraph")
    rest = rest.withColumn("fresh", F.coalesce(F.lag("apart").over(ordered) | F.lag("ends").over(ordered) | F.col("apart"), F.lit(True)))
    rest = rest.withColumn("run", F.sum(F.col("fresh").cast("long")).over(ordered)).filter("not apart")
    runs = rest.groupBy(*key, "run").agg(F.array_sort(F.collect_list(F.struct("paragraph", "ws", "cue"))).alias("lines"))
    runs = runs.withColumn("ws", F.flatten(F.transform("lines", lambda s: s["ws"])))
    runs = materialise(runs.filter(F.concat_ws(" ", "ws").rlike(GENERAL) | F.exists("lines", lambda s: s["cue"])), "licence-runs")
    single = runs.select(*key, "run", F.explode(F.filter("lines", lambda s: s["cue"])).alias("s")).select(*key, "s.paragraph", F.lit(0).alias("part"), "run", F.lit(False).alias("whole"), "s.ws")
    runs = runs.filter(F.size("lines") > 1).select(*key, F.col("lines")[0]["paragraph"].alias("paragraph"), F.lit(0).alias("part"), "run", F.lit(True).alias("whole"), "ws")
    out = found.unionByName(single).unionByName(runs)
    return out.select(*key, "paragraph", "part", "run", "whole", _grams(F.col("ws")).alias("grams"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.5, alike: float = 0.6) -> DataFrame:
    """A row for each licence notice: doc_id, paragraph (its first line), family, probability, confirmed."""
    docs = rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return _scan(docs, sure, alike).drop(*ROW)


def _scan(docs: DataFrame, sure: float = 0.5, alike: float = 0.6) -> DataFrame:
    """``docs``: ROW, doc_id, text; the notices keep ROW."""
    weights, temperature = train(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    lines = materialise(_candidates(docs, alike).withColumn("place", F.monotonically_increasing_id()), "licence-candidates")
    top = _softmax(_scores(_features(lines, ["place"]), weights, ["place"]), ["place"], temperature).select("place", F.element_at("ps", 1).alias("s"))

    known = _known(spark, set(TEMPLATES) - {"none", "unknown"}).groupBy("family").agg(F.collect_list("pairs").alias("templates"))
    judged = lines.join(top, "place").select("*", F.col("s.class").alias("family"), F.col("s.p").alias("probability")).filter(F.col("probability") >= sure).filter("family <> 'none'")
    judged = judged.join(F.broadcast(known), "family", "left")
    share = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.greatest(F.size(t), F.lit(1))))
    alone = F.array(*[F.lit(f"{f}:{t.lower()}") for f, ts in TEMPLATES.items() for t in ts if " " not in t])
    named = (F.size("grams") == 1) & F.array_contains(alone, F.concat_ws(":", "family", F.get("grams", F.lit(0))))
    judged = judged.withColumn("confirmed", F.coalesce(share >= alike, F.lit(False)) | named)
    judged = judged.withColumn("run_counts", F.coalesce(F.max("whole").over(Window.partitionBy("row", "run")) & F.col("run").isNotNull(), F.lit(False))).filter("whole or not run_counts")
    confirmed = F.col("confirmed")
    return judged.select(*ROW, "doc_id", "paragraph", F.when(confirmed, F.col("family")).otherwise("unknown").alias("family"), F.col("probability"), confirmed)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, families (sorted), n_notices, n_unknown."""
    docs = rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    found = _scan(docs).groupBy(*ROW).agg(F.array_sort(F.collect_set("family")).alias("families"), F.count(F.lit(1)).alias("n_notices"), F.count_if(~F.col("confirmed")).alias("n_unknown"))
    out = docs.select(*ROW, "doc_id").join(found, ROW, "left")
    return out.select("doc_id", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"))
