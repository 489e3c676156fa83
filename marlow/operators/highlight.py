"""Hits of a search marked in the texts, by an index of words with their places and offsets.

Words are looked up in the index as they are, by their stems, or by how they begin, and phrases by
consecutive places; what is found are spans of characters, so a stem marks the word that stands in the
text. Spans that overlap are marked as one. Offsets count code points. Identifiers are unique; null
texts have no words.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stemmer import beginnings
from .text import MARK, STOP_WORDS, stem

WORD = r"[\p{L}\p{N}_]+"


def offsets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, start, stop, term, stem): the words of every text; stop words have no stem."""
    words = F.regexp_extract_all(text_col, F.lit(f"({WORD})"), F.lit(1))
    own = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("ws"), F.split(text_col, WORD).alias("gaps"))
    each = own.select("id", F.posexplode(F.arrays_zip("ws", F.slice("gaps", F.lit(1), F.size("ws")).alias("gap"))).alias("place", "x"))
    size = F.length("x.ws")
    stop = F.sum(F.length("x.gap") + size).over(W.partitionBy("id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    own = each.select("id", "place", (stop - size).alias("start"), stop.alias("stop"), F.lower("x.ws").alias("term"))
    return own.withColumn("stem", F.when(~F.col("term").isin(STOP_WORDS), stem(F.col("term"))))


def clauses(query: str) -> list[list[tuple[str, str]]]:
    """What a query asks for: ``"two words"`` next to one another, ``begin*``, and other words by their stems; each a list of (kind, word)."""
    out = []
    for phrase, start, word in re.findall(r'"([^"]*)"|([\w]+)\*|([\w]+)', query.lower()):
        if phrase:
            out.append([("term", w) for w in re.findall(r"\w+", phrase)])
        elif start:
            out.append([("start", start)])
        elif word and word not in STOP_WORDS:
            out.append([("stem", word)])
    return [c for c in out if c]


def spans(index: DataFrame, query: str) -> DataFrame:
    """(id, start, stop): the characters that a query's clauses hit, those that overlap as one."""
    asked = clauses(query)
    if not asked:
        return index.select("id", "start", "stop").limit(0)
    wanted = sorted({w for c in asked for kind, w in c if kind == "stem"})
    found = index.sparkSession.range(1).select(*(stem(F.lit(w)).alias(w) for w in wanted)).first() if wanted else {}

    def test(kind: str, word: str) -> Column:
        if kind == "stem":  # stemming is dear, so words that begin otherwise are not stemmed
            return reduce(lambda a, b: a | b, [F.col("term").startswith(b) for b in beginnings(found[word])]) & (F.col("stem") == found[word])
        return F.col("term").startswith(word) if kind == "start" else F.col("term") == word

    tests = [(c, k, len(clause), test(*part)) for c, clause in enumerate(asked) for k, part in enumerate(clause)]
    met = index.filter(reduce(lambda a, b: a | b, [hit for *_, hit in tests]))
    each = F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(c).alias("c"), F.lit(k).alias("k"), F.lit(n).alias("n"))) for c, k, n, hit in tests)))
    rows = met.select("id", "place", "start", "stop", F.inline(each))
    whole = rows.groupBy("id", "c", "n", (F.col("place") - F.col("k")).alias("base")).agg(F.count(F.lit(1)).alias("hits"), F.min("start").alias("start"), F.max("stop").alias("stop")).filter("hits = n")
    order = W.partitionBy("id").orderBy("start", "stop")
    seen = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = whole.select("id", "start", "stop", F.when(F.col("start") < seen, 0).otherwise(1).alias("opens"))
    return apart.withColumn("group", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("id", "group").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("group")


@F.pandas_udf(T.StringType())
def _marked(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    """Each text with its spans, which are in order and apart, between the marks."""
    def one(text: str | None, a: list[int] | None, b: list[int] | None) -> str | None:
        if text is None or a is None:
            return text
        out, at = [], 0
        for start, stop in zip(a, b, strict=True):
            out += [text[at:start], MARK[0], text[start:stop], MARK[1]]
            at = stop
        return "".join([*out, text[at:]])

    return pd.Series([one(*row) for row in zip(texts, starts, stops, strict=True)], dtype=object)


def _listed(found: DataFrame, *keys: str) -> DataFrame:
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("at"))


def marked(docs: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """(id, marks, marked): every text whole, its hits marked; texts without a hit as they are."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(_listed(found, "id"), "id", "left")
    return rows.select("id", F.coalesce(F.size("at"), F.lit(0)).alias("marks"), _marked("text", "at.start", "at.stop").alias("marked"))


def fragments(docs: DataFrame, id_col: str, text_col: str, found: DataFrame, number: int = 5, size: int = 100) -> DataFrame:
    """(id, tile, fragment): the ``number`` stretches of ``size`` characters with most hits, in their order, and the first one of a text without any.

    A stretch begins with its first whole word and goes on to the end of the last hit that begins in it;
    of stretches with as many hits the earlier goes first.
    """
    tiles = _listed(found.withColumn("tile", F.expr(f"start div {size}")), "id", "tile").withColumn("hits", F.size("at"))
    best = tiles.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("hits"), "tile"))).filter(F.col("rank") <= number)
    kept = best.groupBy("id").agg(F.collect_list(F.struct("tile", "at")).alias("tiles"))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(kept, "id", "left")
    low = lambda x: (x["tile"] * size).cast("int")
    piece = lambda x: F.struct(
        x["tile"].alias("tile"), x["at"].alias("at"), F.substring("text", low(x) + 1, F.greatest(F.lit(size), F.array_max(x["at"]["stop"]).cast("int") - low(x))).alias("said"),
        F.when(x["tile"] > 0, F.substring("text", low(x), F.lit(1)).rlike(WORD)).otherwise(F.lit(False)).alias("within"),
    )
    alone = F.array(F.struct(F.lit(0).cast("bigint").alias("tile"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("at"), F.substring("text", 1, size).alias("said"), F.lit(False).alias("within")))
    each = rows.select("id", F.inline(F.coalesce(F.transform("tiles", piece), alone)))
    each = each.withColumn("cut", F.when(F.col("within"), F.length(F.regexp_extract("said", f"^{WORD}", 0))).otherwise(0))
    begin = F.col("tile") * size + F.col("cut")
    each = each.select("id", "tile", F.expr("substring(said, cut + 1)").alias("said"), F.transform("at.start", lambda a: a - begin).alias("a"), F.transform("at.stop", lambda b: b - begin).alias("b"))
    return each.select("id", "tile", _marked("said", "a", "b").alias("fragment"))
