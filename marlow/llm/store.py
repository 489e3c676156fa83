"""Written tables of the operators, and a name of its own for every row of a table."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..store import discard, new_path, purge, shared_dir

__all__ = ["ROW", "discard", "materialise", "new_path", "purge", "rows", "shared_dir"]

#: The columns that name a row: of a Parquet table its file and place, else the places of a copy.
#: Their names are made anew by each process, so no table has columns of these names.
ROW = [f"__row_{what}_{uuid.uuid4().hex}" for what in ("file", "at")]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back; the shuffle files of what has been written are let go."""
    out = store.written(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _scan_only(df: DataFrame) -> bool:
    """Whether the rows are those of one file scan, some left out perhaps, none repeated."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


def rows(df: DataFrame) -> DataFrame:
    """``df`` with the columns of ``ROW`` before its own, which tell rows apart whatever they hold.

    Rows of a Parquet scan have the name of their place. Other plans may come out in another order
    when they are computed again, so they are written once, with a number for each row.
    """
    if _scan_only(df):
        try:
            return df.select(F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]), "*")
        except AnalysisException:
            pass  # a scan of files without row numbers
    numbered = df.select(F.lit(0).cast("long").alias(ROW[0]), F.monotonically_increasing_id().alias(ROW[1]), "*")
    return materialise(numbered, "rows")
