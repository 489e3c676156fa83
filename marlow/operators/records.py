"""Stored records and derived state: inserts, updates, resets, refreshes, and which record is to be worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import materialise


def insert_rows(df: DataFrame, table: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a Parquet table; Spark commits a job's rows together."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(table)


def update_columns(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with the columns of ``new`` written over where it has their key, with nulls too."""
    changed = [c for c in new.columns if c != key]
    own = new.select(key, F.struct(*changed).alias("__new"))
    out = old.join(own, key, "left")
    return out.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns])


def reset(df: DataFrame, derived: list[str]) -> DataFrame:
    """Rows with their derived columns null."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in derived})


def refresh(views: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Derived tables in order, each written once and then there for those after it."""
    out = dict(tables)
    for name, recipe in views.items():
        out[name] = materialise(recipe(out), f"view-{name}")
    return {name: out[name] for name in views}


def versions_state(rows: DataFrame, group: str, version: str, processed: str) -> DataFrame:
    """Rows with two flags: the latest of their group, and whether they wait: latest or not, but not processed."""
    top = F.max(version).over(W.partitionBy(group))
    return rows.withColumn("is_latest", F.coalesce(F.col(version) == top, F.lit(False))).withColumn("waiting", F.col(processed).isNull())


def record(rows: DataFrame, group: str, version: str, processed: str, want: str = "latest") -> DataFrame:
    """One record a group: ``latest``, the latest ``processed``, or the latest ``unprocessed``."""
    own = {"latest": rows, "processed": rows.filter(F.col(processed).isNotNull()), "unprocessed": rows.filter(F.col(processed).isNull())}[want]
    return own.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last(version)))).filter("__n = 1").drop("__n")


def first_of_each(*parts: DataFrame, limit: int = 1) -> DataFrame:
    """The distinct union of limited selections; the limits are the operator. Parts are ordered by their caller."""
    out = parts[0].limit(limit)
    for p in parts[1:]:
        out = out.unionByName(p.limit(limit))
    return out.distinct()


def pruned(df: DataFrame, heavy: list[str]) -> DataFrame:
    return df.drop(*heavy)


def truthy(values: Column) -> Column:
    """A map of strings without its null and empty values."""
    return F.map_filter(values, lambda _, v: v.isNotNull() & (v != ""))


def jobs(df: DataFrame, key: str, size: int) -> DataFrame:
    """(job, keys): keys in order in lists of ``size``, the last one shorter.

    The place of a key in the whole order comes from the sizes of range partitions, of which there is one
    row each, so no task orders all keys.
    """
    ranged = materialise(df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "jobs")
    firsts = ranged.groupBy("__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = firsts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.join(F.broadcast(before), "__part").withColumn("__place", F.col("__before") + F.col("__at") - F.col("__first"))
    numbered = placed.groupBy(F.floor(F.col("__place") / size).cast("long").alias("job")).agg(F.array_sort(F.collect_list(F.struct("__place", key))).alias("ks"))
    return numbered.select("job", F.transform("ks", lambda x: x[key]).alias("keys"))


def zipped(**arrays: Column) -> Column:
    """Arrays side by side as an array of structs; the shorter ones are filled up with nulls."""
    return F.arrays_zip(*(c.alias(n) for n, c in arrays.items()))


def numeric_ids(ids: Column, separator: str = ";") -> Column:
    """A list of numbers in a string, in order of number."""
    return F.array_join(F.transform(F.array_sort(F.transform(F.split(ids, separator), lambda x: x.try_cast("bigint"))), lambda x: x.cast("string")), separator)


def by_year(df: DataFrame, year: str, *then: str) -> DataFrame:
    """Newest year first, rows without one before them."""
    return df.orderBy(F.desc_nulls_first(year), *then)
