"""Incremental refresh: what a feed has that is new or newer, upserts, and a Structured Streaming sink for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import delete


def stale(feed: DataFrame, stored: DataFrame, key: str, updated: str) -> DataFrame:
    """Feed rows that are not stored, or stored from an earlier time."""
    old = stored.select(key, F.col(updated).alias("__stored"))
    return feed.join(old, key, "left").filter(F.col("__stored").isNull() | (F.col("__stored") < F.col(updated))).drop("__stored")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old rows of other keys; columns by name."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def newest_per_key(batch: DataFrame, key: str, updated: str) -> DataFrame:
    """One row a key: the latest of the batch."""
    columns = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*columns), updated).alias("r")).select(key, "r.*")


#: Buckets of a refreshed table, by a hash of the key; a batch rewrites those that it touches.
BUCKETS = 64


def refresh(stream: DataFrame, table: str, key: str, updated: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = BUCKETS):
    """Follow a stream of documents into a Parquet table, keyed and only ever newer, once through what is there.

    Rows lie in buckets of their key. Each micro-batch writes the next version of the buckets that it
    touches (``table/v=<batch>/b=<bucket>``); the batch number makes a repeated batch overwrite its own
    version, so the sink is idempotent. Versions that two later ones have replaced are deleted. The
    number of buckets stays with the table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        fresh = derive(newest_per_key(batch, key, updated))
        touched = [r.b for r in fresh.select(bucket.alias("b")).distinct().collect()]  # a bounded number
        before = current(spark, table, number, touched)
        if before is not None:
            fresh = upsert(before, stale(fresh, before, key, updated), key)
        fresh.withColumn("b", bucket).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{table}/v={number}")
        _drop_old(spark, table, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark, table: str, before: int | None = None) -> dict[int, list[int]]:
    """The whole versions of every bucket, newest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for v in fs.listStatus(path) if fs.exists(path) else []:
        name = v.getPath().getName()
        if not name.startswith("v=") or (before is not None and int(name[2:]) >= before):
            continue
        inner = {b.getPath().getName() for b in fs.listStatus(v.getPath())}
        for b in inner if "_SUCCESS" in inner else ():
            if b.startswith("b="):
                out.setdefault(int(b[2:]), []).append(int(name[2:]))
    return {b: sorted(vs, reverse=True) for b, vs in out.items()}


def _drop_old(spark, table: str, number: int) -> None:
    for b, vs in _versions(spark, table).items():
        for v in vs[2:]:
            if v < number:
                delete(spark, f"{table}/v={v}/b={b}")


def current(spark, table: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest version of a table that ``refresh`` writes, or the newest below a batch number, or some buckets of it."""
    found = {b: vs[0] for b, vs in _versions(spark, table, before).items() if buckets is None or b in buckets}
    if not found:
        return None
    return spark.read.parquet(*(f"{table}/v={v}/b={b}" for b, v in sorted(found.items())))
