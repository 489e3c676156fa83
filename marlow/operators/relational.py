"""Relational operators over versioned, cross-referenced documents.

Each takes DataFrames and column names and returns a DataFrame; nothing is collected. Ordering of nulls
follows the rule "ascending last, descending first" throughout.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_versions(df: DataFrame, group: str, version: str) -> DataFrame:
    """Rows whose version is the greatest of their group; ties are kept. One shuffle on the group."""
    top = F.max(version).over(W.partitionBy(group))
    return df.withColumn("__top", top).filter(F.col(version) == F.col("__top")).drop("__top")


def latest_flag(df: DataFrame, group: str, version: str, flag: str = "latest") -> DataFrame:
    """``flag`` is true on the latest rows and null on all others."""
    return df.withColumn(flag, F.when(F.col(version) == F.max(version).over(W.partitionBy(group)), True))


def versions_of(df: DataFrame, ids: DataFrame, group: str, id_col: str) -> DataFrame:
    """All rows that share a group with one of the given ids."""
    groups = df.join(ids, id_col, "left_semi").select(group).distinct()
    return df.join(groups, group, "left_semi")


def siblings_not_in(df: DataFrame, ids: DataFrame, group: str, id_col: str) -> DataFrame:
    """Rows that share a group with the given ids and are not among them."""
    return versions_of(df, ids, group, id_col).join(ids, id_col, "left_anti")


def missing(wanted: DataFrame, have: DataFrame, on: str) -> DataFrame:
    """Wanted rows that are not there yet."""
    return wanted.join(have, on, "left_anti")


def reference_counts(sources: DataFrame, targets: DataFrame, link: str, source: str, target: str) -> DataFrame:
    """Links per (source, target): both sides meet on the link, then one aggregate."""
    return sources.join(targets, link).groupBy(source, target).agg(F.count(link).alias("n_links"))


def in_degrees(counts: DataFrame, live: DataFrame, source: str, target: str) -> DataFrame:
    """How many live sources refer to each target."""
    return counts.join(live, source, "left_semi").groupBy(target).agg(F.count("n_links").alias("refs"))


def scores(items: DataFrame, refs: DataFrame, depths: DataFrame, enacted: DataFrame, id_col: str, group: str, is_draft: Column) -> DataFrame:
    """Each item with its references, its depth and whether its draft was enacted.

    The flag keeps three values: where an item is a draft and nothing enacted matches, it is null.
    """
    done = enacted.select(F.col(group)).distinct().withColumn("__done", F.lit(True))
    out = items.join(refs, id_col, "left").join(depths, id_col, "left").join(done, group, "left")
    return out.select(id_col, F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("depth", F.lit(0)).alias("base_score"), (is_draft & F.col("__done")).alias("enacted"))


def titles(*parts: DataFrame) -> DataFrame:
    """The distinct union of name tables with equal columns."""
    return reduce(DataFrame.unionByName, parts).distinct()


def autocomplete(names: DataFrame, query: str, limit: int = 50, wildcards: bool = False) -> DataFrame:
    """Names that contain the query, whatever the case, best first: depth, place, length, references, year.

    With ``wildcards``, ``%`` and ``_`` in the query stand for any text and any character, as the literal
    LIKE has it. The last key, the identifier, makes the cut stable.
    """
    low = F.lower("name")
    hit = F.col("name").ilike(f"%{query}%") if wildcards else F.contains(low, F.lit(query.lower()))
    order = [F.asc_nulls_last("base_score"), F.locate(query.lower(), low).asc(), F.char_length("name").asc(), F.desc_nulls_first("refs"), F.desc_nulls_first("year"), F.col("type").asc(), F.col("id").asc()]
    return names.filter(hit).orderBy(*order).limit(limit)


def exact_title(names: DataFrame, query: str) -> DataFrame:
    """The one row of that very name; nothing where there are several."""
    found = names.filter(F.col("name") == query)
    return found.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("name"))).filter("__n = 1").drop("__n")


def in_links(counts: DataFrame, live: DataFrame, source: str, target: str, target_id: int) -> DataFrame:
    """Who refers to a target, itself left out, most links first."""
    own = counts.filter((F.col(target) == target_id) & (F.col(source) != target_id))
    return own.join(live, source).orderBy(F.desc("n_links"), source)


def section_in_links(links: DataFrame, ids: list, path: str, id_col: str, path_col: str) -> DataFrame:
    """Links whose target is one of the ids, or whose path is the given one or lies below it.

    The literal prefix reaches the scan; the pattern confirms that the path goes on with a bracket.
    """
    below = F.col(path_col).startswith(path) & F.col(path_col).rlike(re.escape(path) + r"(\(.*)?$")
    return links.filter(F.col(id_col).isin(ids) | below).distinct()


def counted(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key, most first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys)


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def page(df: DataFrame, order: list[Column], offset: int, size: int = 25) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset(offset).limit(size)


def optional_filter(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality on each parameter that is not None."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def sequence_breaks(df: DataFrame, group: str, place: str, number: str) -> DataFrame:
    """Rows whose number is neither the one before plus one nor a new start at 1."""
    before = F.lag(number).over(W.partitionBy(group).orderBy(place))
    ok = (F.col(number) == F.col("previous") + 1) | (F.col(number) == 1)
    return df.withColumn("previous", before).filter(~ok & F.col("previous").isNotNull())


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete by key, then insert: old rows of keys that new has go."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def random_sample(df: DataFrame, share: float, limit: int, seed: int = 0) -> DataFrame:
    """A sample of about ``share`` of the rows, ``limit`` at most; the cut is the operator."""
    return df.sample(share, seed).limit(limit)


def grouped_categories(results: DataFrame, kind: str, place: str) -> DataFrame:
    """Results by kind, kinds in the order in which they first came."""
    rows = F.array_sort(F.collect_list(F.struct(place, "name")))
    return results.groupBy(kind).agg(F.min(place).alias("first_place"), F.transform(rows, lambda r: r["name"]).alias("names")).orderBy("first_place")


def concat_by_priority(df: DataFrame, group: str, priority: str, text: str) -> DataFrame:
    """Texts of a group in one string, the highest priority first, ties by text."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(priority)).alias("p"), F.col(text).alias("t"))))
    return df.groupBy(group).agg(F.concat_ws("", F.transform(rows, lambda r: r["t"])).alias("text"))
