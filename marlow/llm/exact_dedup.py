"""Exact dedup: tree-merge of sorted digest runs, in DataFrame operations only.

Every document gets the SHA-256 of its normalised text. A document's run is a hash of its
row's place, so a run holds about ``run_rows`` documents whatever the corpus looks like. Each run is
aggregated to one row per digest; then runs meet in rounds, ``fan_in`` neighbours at a time, and each
round keeps, per digest, the best row so far and how many rows it stands for. A round's group holds
at most ``fan_in`` rows, so a text that fills a third of the corpus costs no task more than a rare
one. The winner is handed down the same tree, again with at most ``fan_in`` children to a parent, and
reaches the documents run by run.

A digest is only ever merged with one that also has the same second hash and the same normalised
length, at every level, so the smallest identifiers are verified ones.

Edge cases: a null text counts as empty; empty texts are equal to one another; rows that repeat the
same identifier and text are counted as often as they occur, and one of them stays; a null identifier
is a row like any other and, sorting last, stays only where no other does; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import ROW, materialise, rows

WHITESPACE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
KEY = ["digest", "proof", "n_norm"]


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITESPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = 4096, fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return _dedup(docs, run_rows, fan_in).drop(*ROW)


def _dedup(docs: DataFrame, run_rows: int = 4096, fan_in: int = 16) -> DataFrame:
    """``docs``: ROW, doc_id, text; the answer keeps ROW."""
    text = F.col("text")
    leaf = docs.select(*ROW, "doc_id", F.coalesce(F.length(text), F.lit(0)).alias("n_chars"), normalised(text).alias("norm"))
    leaf = leaf.select(*ROW, "doc_id", "n_chars", F.sha2("norm", 256).alias("digest"), F.xxhash64("norm").alias("proof"), F.length("norm").alias("n_norm"))
    leaf = materialise(leaf, "digests")
    runs, n = 1, leaf.count()
    while runs * run_rows < n:
        runs *= fan_in
    leaf = leaf.withColumn("run", F.pmod(F.xxhash64(*ROW), F.lit(runs)))

    def best(first: Column) -> Column:
        return F.min(first).alias("best")

    mine = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), *ROW)
    levels = [materialise(leaf.groupBy("run", *KEY).agg(best(mine), F.count(F.lit(1)).alias("rows")), "run-0")]
    while runs > 1:
        runs //= fan_in
        up = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("long"))
        levels.append(materialise(up.groupBy("run", *KEY).agg(best(F.col("best")), F.sum("rows").alias("rows")), f"run-{len(levels)}"))
    answer = levels.pop()
    while levels:
        below = levels.pop().select("run", *KEY, F.floor(F.col("run") / fan_in).cast("long").alias("up"))
        above = answer.withColumnRenamed("run", "up")
        answer = below.join(above, ["up", *KEY]).drop("up")
    out = leaf.join(answer, ["run", *KEY])
    mine = F.lit(True)
    for c in ROW:
        mine = mine & (F.col(c) == F.col(f"best.{c}"))
    return out.select(*ROW, "doc_id", F.col("best.id").alias("keep_id"), F.col("rows").cast("long").alias("group_size"), mine.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each text, with all their columns."""
    docs = rows(docs)
    kept = _dedup(docs.select(*ROW, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).filter("kept").select(*ROW)
    return docs.join(kept, ROW, "left_semi").drop(*ROW)
