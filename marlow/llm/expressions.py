"""Column expressions that are computed once and used many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row.

    The optimiser copies a projected column into every place that names it, into the lambdas of array
    functions too, where it would be computed again for every element. A lambda's own argument stays.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(sizes: Column) -> Column:
    """For each element of an array of ints, the sum of those before it.

    Blocks of about the root of the length are summed first, so n elements take n * sqrt(n) steps.
    """
    def sum_of(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def within(own: Column) -> Column:
        n, width, sizes = F.size(own["sizes"]), own["width"], own["sizes"]
        blocks = F.transform(F.sequence(F.lit(0), F.floor(n / width).cast("int")), lambda b: sum_of(F.slice(sizes, b * width + 1, width)))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda out, x: F.array_append(out, F.element_at(out, -1) + x))
        return let(F.struct(sizes.alias("sizes"), width.alias("width"), starts.alias("starts")), lambda s: F.transform(s["sizes"], lambda x, i: F.get(s["starts"], F.floor(i / s["width"]).cast("int")) + sum_of(F.slice(s["sizes"], F.floor(i / s["width"]).cast("int") * s["width"] + 1, i % s["width"]))))

    return let(sizes, lambda z: let(F.struct(z.alias("sizes"), F.ceil(F.sqrt(F.size(z) + 1)).cast("int").alias("width")), within))
