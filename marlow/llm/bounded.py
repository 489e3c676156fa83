"""The most frequent rows of a count table, as many as a fixed bound has room for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent(counts: DataFrame, bound: int, n_col: str = "n") -> DataFrame:
    """All rows whose count is above a level chosen so that at most ``bound`` rows are.

    Levels are eighths of a power of two, so the histogram that reaches the driver has a few hundred
    rows whatever the table holds.
    """
    level = F.floor(F.log2(n_col) * 8).cast("int")
    room, least = bound, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):
        room -= r["rows"]
        if room < 0:
            break
        least = r["level"]
    return counts.filter(level >= least) if least is not None else counts.limit(0)
