"""Vector code compression: each vector becomes one codebook index for each of its equal parts.

Components are scaled and floored to integers, so every distance, sum and mean is exact and the codes
do not depend on how rows are dealt out. A round broadcasts the codebooks (``parts`` x ``entries`` x
part length integers, whatever the table holds); each Arrow batch takes its distances by norm expansion
with integer matrix products and keeps the first nearest entry; a task sends one sum for each component
of each entry, which a grouped shuffle adds up. Vectors themselves are never shuffled.

Edge cases: a vector that is null, or has a null or non-finite component or one of 2**50 or more in size
(no long holds it scaled), is dropped. The vector length is that of the smallest identifier whose length
is a positive multiple of ``parts``; vectors of other lengths can't be cut alike and are dropped. Null
identifiers come last and are coded like all others; rows that repeat an identifier are coded one by one,
ordered by their components where the codebooks start from them. Fewer vectors than entries make
smaller codebooks; an empty table gives an empty result; further columns are ignored. Components beyond
``2**29`` after scaling are computed with integers of any size, and errors beyond a long are its largest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Components of a batch that are looked at together.
SLICE = 1 << 20
LARGEST = (1 << 63) - 1


def kept_vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """Identifier, label and vector of the rows that can be coded, whatever else the table holds."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(1 << 50))))
    own = table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    return own.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0)).filter(sound)


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The floored, scaled components of a column of lists of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dims)


class Codebooks:
    """``entries[part, entry, position]``, integers."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(object)
        # squares of a part, their doubled products and their sum stay below 2**63
        self.safe = int(np.sqrt((1 << 60) // max(1, entries.shape[2])))
        self.small = bool(entries.size) and max(abs(int(entries.max())), abs(int(entries.min()))) <= self.safe

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def slices(self, column: pa.Array, scale: int) -> Iterator[np.ndarray]:
        step = max(1, SLICE // self.dims)
        for at in range(0, len(column), step):
            rows = integers(column.slice(at, step), self.dims, scale)
            small = self.small and int(np.abs(rows).max()) <= self.safe
            yield rows if small else rows.astype(object)

    def nearest(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: its components, the first nearest entry, the squared distance to it."""
        parts, _, d = self.entries.shape
        for p in range(parts):
            own, book = rows[:, p * d : (p + 1) * d], self.entries[p].astype(rows.dtype)
            far = (own * own).sum(1)[:, None] - 2 * (own @ book.T) + (book * book).sum(1)
            first = np.argmin(far, axis=1)
            yield own, first, far[np.arange(len(far)), first]

    def sums(self, batches: Iterator[pa.RecordBatch], scale: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the parts nearest to each entry, and how many those are."""
        parts, k, _ = self.entries.shape
        total, count = np.zeros(self.entries.shape, object), np.zeros((parts, k), np.int64)
        for batch in batches:
            for rows in self.slices(batch.column("vector"), scale):
                for p, (own, first, _) in enumerate(self.nearest(rows)):
                    total[p] += ((first[:, None] == np.arange(k)).astype(rows.dtype).T @ own).astype(object)
                    count[p] += np.bincount(first, minlength=k)
        return total, count

    def moved(self, total: dict[tuple[int, int, int], tuple[int, int]]) -> Codebooks:
        """Entries at the floored means of their parts; unused ones stay."""
        out = self.entries.copy()
        for at, (s, n) in total.items():
            out[at] = s // n
        return Codebooks(out)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel())).encode()).hexdigest()


def first_codebooks(kept: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    if (least := kept.orderBy(*order).first()) is None:
        return None
    dims = len(least["vector"])
    rows = kept.filter(F.size("vector") == dims).orderBy(*order).limit(entries).select("vector").collect()
    start = integers(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), dims, scale)
    return Codebooks(start.reshape(len(rows), parts, dims // parts).transpose(1, 0, 2))


def train(kept: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of the kept vectors after ``rounds``; None where there are no vectors."""
    books = first_codebooks(kept, parts, entries, scale)
    if books is None:
        return None
    vectors = kept.filter(F.size("vector") == books.dims).select("vector")
    for _ in range(rounds):
        books = _round(vectors, books, scale)
    return books


def _round(vectors: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = shared.value.sums(batches, scale)
        p, e, j = (x.ravel() for x in np.indices(total.shape))
        used = count[p, e] > 0
        if used.any():
            p, e, j = p[used], e[used], j[used]
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(j, pa.int32()), pa.array([int(x) for x in total[p, e, j]], pa.decimal128(38, 0)), pa.array(count[p, e], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "position", "total", "n"])

    sums = vectors.mapInArrow(add_up, "part int, entry int, position int, total decimal(38,0), n long")
    merged = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.moved({(r["part"], r["entry"], r["position"]): (int(r["total"]), r["n"]) for r in merged.collect()})
    shared.unpersist()
    return out


def encode(kept: DataFrame, books: Codebooks, scale: int = 4096) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits a part) and ``error`` (squared distances, summed) of every kept vector of the codebooks' length."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    fields = kept.schema
    schema = StructType([fields["vec_id"], fields["label"], StructField("code", StringType()), StructField("error", LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        digits = np.array([f"{e:02x}" for e in range(own.entries.shape[1])])
        for batch in batches:
            at = 0
            for rows in own.slices(batch.column("vector"), scale):
                code, error = np.zeros(len(rows), "U1"), np.zeros(len(rows), rows.dtype)
                for _, first, far in own.nearest(rows):
                    code, error = np.char.add(code, digits[first]), error + far
                part = batch.slice(at, len(rows))
                at += len(rows)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(code.tolist(), pa.string()), pa.array([min(int(x), LARGEST) for x in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.filter(F.size("vector") == books.dims).mapInArrow(assign, schema)


def decode(codes: DataFrame, books: Codebooks, scale: int = 4096) -> DataFrame:
    """``codes`` with ``vector``: the codebook entries that each code names, scaled back."""
    parts, _, d = books.entries.shape
    table = F.array(*(F.array(*(F.array(*(F.lit(int(x) / scale) for x in entry)) for entry in book)) for book in books.entries))
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(F.get(F.get(table, F.lit(p)), index(p)) for p in range(parts))))


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Codes and errors of all vectors, the error of all that share a label (nulls share one), and the codebooks' digest."""
    kept = kept_vectors(table, id_col, vector_col, label_col, parts)
    books = train(kept, parts, entries, rounds, scale)
    if books is None:
        none = kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.withColumn("codebooks_sha256", F.lit("")).limit(0)
    codes = encode(kept, books, scale)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
