"""Tables that cut lineage, in the folder that driver and executors share.

The folder is the cluster's ``spark.checkpoint.dir``. Where that is unset, a session on a local master
makes a temporary one; a session on a cluster is told to set it, for a folder per machine would lose rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one on a local master."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="marlow-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/marlow/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``written``, and joined by sorting.

    A plan takes a table's size from its files, which here are far smaller than the rows in memory, and
    would send large tables whole through the driver. A table that is small for certain is
    broadcast by ``F.broadcast`` at its join.
    """
    return written(df, name).hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def purge(spark: SparkSession) -> None:
    """Delete every table this session wrote; call once results that read them are stored."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a materialised DataFrame that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)
