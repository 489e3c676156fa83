"""The search index: analysed fields as token tables, bulk loads, single-document refresh, and sorted results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: How each field is analysed: exact, plain words, stems, or beginnings of words for suggestions.
MAPPINGS = {
    "title": ["exact", "simple", "english", "ngram"], "document": ["simple", "english"], "skeleton": ["simple", "english"], "html": ["simple", "english"],
    "full_word": ["exact", "simple", "english", "ngram"], "full_citation": ["exact", "simple", "english", "ngram"],
}


def analysed(text: Column, analyzer: str) -> Column:
    """The terms of a text, in order."""
    if analyzer == "exact":
        return F.array(tx.folded_keyword(text))
    if analyzer == "simple":
        return tx.tokens(text)
    if analyzer == "english":
        return tx.terms(text)
    if analyzer == "ngram":
        return F.array_distinct(F.flatten(F.transform(tx.tokens(text), lambda w: tx.edge_grams(w))))
    raise ValueError(f"unknown analyzer: {analyzer}")


def build(docs: DataFrame, id_col: str, mappings: dict[str, list[str]] = MAPPINGS) -> DataFrame:
    """(field, analyzer, term, id, tf, length, places): the inverted index of all mapped fields that the table has."""
    fields = [(f, a) for f, analyzers in mappings.items() if f in docs.columns for a in analyzers]
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(a).alias("analyzer"), analysed(F.coalesce(F.col(f), F.lit("")), a).alias("ts")) for f, a in fields))
    # the documents are dealt before they are taken to pieces: a task groups the words of its own documents, and words are not shuffled
    dealt = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    rows = dealt.select(F.col(id_col).alias("id"), F.explode(each).alias("x")).select("id", "x.field", "x.analyzer", F.size("x.ts").alias("length"), F.posexplode("x.ts").alias("place", "term"))
    return rows.groupBy("field", "analyzer", "term", "id", "length").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("place")).alias("places"))


def load(index: DataFrame, table: str) -> None:
    """Write an index, its folders named by field and analyzer, so that a search reads only what it asks for."""
    index.write.mode("overwrite").partitionBy("field", "analyzer").parquet(table)


def replaced(index: DataFrame, docs: DataFrame, id_col: str, mappings: dict[str, list[str]] = MAPPINGS, siblings: DataFrame | None = None) -> DataFrame:
    """The index with the given documents, and those that share a group with them, analysed anew."""
    fresh = docs if siblings is None else docs.unionByName(siblings.join(docs.select(id_col), id_col, "left_anti"))
    return deleted(index, fresh.select(F.col(id_col).alias("id"))).unionByName(build(fresh, id_col, mappings))


def deleted(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id").distinct(), "id", "left_anti")


def search(index: DataFrame, field: str, words: list[str], analyzer: str = "simple") -> DataFrame:
    """(id, score): documents that hold all words in a field; each word weighs tf / length."""
    own = index.filter((F.col("field") == field) & (F.col("analyzer") == analyzer) & F.col("term").isin(*words))
    hits = own.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("tf") / F.col("length")).alias("score"))
    return hits.filter(F.col("n") == len(set(words))).select("id", "score")


def covers(index: DataFrame, field: str, words: list[str], analyzer: str = "english", limit: int = 100) -> DataFrame:
    """(id, score): documents that hold all words, by cover density: each shortest stretch with all of them counts 1 / length.

    A stretch starts at a place of some word and ends where the last of the others has come; it counts
    where none that starts later ends there.
    """
    wanted = sorted(set(words))
    own = index.filter((F.col("field") == field) & (F.col("analyzer") == analyzer) & F.col("term").isin(*wanted))
    each = own.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("places").alias("all")).filter(F.col("n") == len(wanted))
    starts = F.array_sort(F.flatten("all"))
    ends = each.select("id", "all", F.explode(starts).alias("start")).select("id", "start", F.transform("all", lambda ps: F.array_min(F.filter(ps, lambda p: p >= F.col("start")))).alias("nexts"))
    whole = ends.filter(~F.exists("nexts", lambda p: p.isNull())).select("id", "start", F.array_max("nexts").alias("end"))
    tight = whole.groupBy("id", "end").agg(F.max("start").alias("start"))
    return tight.groupBy("id").agg(F.sum(1.0 / (F.col("end") - F.col("start") + 1)).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def projection(instruments: DataFrame, scores: DataFrame, group: str = "govt_id", version: str = "version") -> DataFrame:
    """What an index row of an instrument carries: scores, principal, latest and whether its bill was enacted."""
    from .relational import latest_flag

    flagged = latest_flag(instruments, group, version).withColumn("latest", F.coalesce("latest", F.lit(False)))
    return flagged.withColumn("principal", ~F.col("title").ilike("%amendment%")).join(scores, "id", "left")


def sorted_results(results: DataFrame, sort_col: str | None = None, sort_dir: str = "desc", tie: str = "id") -> DataFrame:
    """Results by score, or by a column of the user's choice that the results have."""
    if sort_col is not None and sort_col not in results.columns:
        raise ValueError(f"no column to sort by: {sort_col}")
    c = sort_col or "score"
    return results.orderBy(F.asc_nulls_last(c) if sort_dir == "asc" else F.desc_nulls_last(c), tie)

