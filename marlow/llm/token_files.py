"""Token-id output in binary blocks, and reading it back.

A token file is a Parquet container, which Spark commits whole or not at all, of records in ascending
identifier order. A record holds the identifiers and lengths of consecutive documents and their ids in
blocks of the range coder, each reset and checksummed on its own. Documents are dealt by ranges of
their identifier, encoded in order, and packed as they stream by, so no task holds more than a record.
Each record says how many ids its range has before it; the totals of the ranges, one number a
partition, are summed on the driver, and that gives every document's place in the whole stream.

Edge cases: a null or empty text is its end id alone; identifiers that repeat come one after another;
a null identifier comes first; a document longer than a record is a record of many blocks; an empty
table gives an empty file; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .range_coder import decode_block, encode_block
from .textnum import chunks

RECORD_IDS = 1 << 20
_RECORD = "part int, before long, n_ids long, doc_ids array<{0}>, lengths array<long>, blocks array<binary>"


def _pack(path: str, table, end_id: int, id_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, part, before = bpe.vocabulary(path), table.value, TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []
        room = RECORD_IDS

        def flush() -> pa.RecordBatch:
            nonlocal held, names, sizes, room, before
            ids = np.concatenate(held)
            blocks = [encode_block(ids[k : k + RECORD_IDS]) for k in range(0, len(ids), RECORD_IDS)]
            columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))]
            held, names, sizes, room, before = [], [], [], RECORD_IDS, before + len(ids)
            return pa.RecordBatch.from_arrays(columns, ["part", "before", "n_ids", "doc_ids", "lengths", "blocks"])

        for batch in batches:
            for first, end, raw, at in chunks(batch.column(1), 1 << 20):
                ids, rows = bpe.encode_chunk(own, known, raw, at)
                closed = np.insert(ids, rows[1:], end_id)
                rows = rows + np.arange(len(rows))
                labels = batch.column(0).slice(first, end - first).to_pylist()
                for i, label in enumerate(labels):
                    held.append(closed[rows[i] : rows[i + 1]])
                    names.append(label)
                    sizes.append(int(rows[i + 1] - rows[i]))
                    room -= sizes[-1]
                    if room <= 0:
                        yield flush()
        if held:
            yield flush()

    return run


def _unpack(with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.concatenate([decode_block(b) for b in batch.column(3)[r].as_py()])
                sizes = np.asarray(batch.column(2)[r].values).astype(np.int64)
                rows = np.append(0, np.cumsum(sizes))
                blob = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(blob[4 * a : 4 * b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
                columns = [batch.column(1)[r].values, pa.array(rows[:-1] + batch.column(0)[r].as_py()), pa.array(sizes), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text with the tokenizer file ``path``, close it with ``end_id`` and write the ids to ``out``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(bpe.word_table(docs, path))
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(_pack(path, table, end_id, to_arrow_type(id_type)), _RECORD.format(id_type.simpleString())).write.option("compression", "uncompressed").parquet(out)


def read_tokens(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    records = spark.read.parquet(out)
    id_type = records.schema["doc_ids"].dataType.elementType.simpleString()
    sums = records.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    ends, bases = 0, []
    for r in sorted(sums, key=lambda r: r["part"]):
        bases.append((r["part"], ends))
        ends += r["n"]
    base = spark.createDataFrame(bases, "part int, base long")  # a row for each partition of the writer
    found = records.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "lengths", "blocks")
    return found.mapInArrow(_unpack(with_ids), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
