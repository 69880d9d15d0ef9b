"""Token ids as Parquet list columns, in id order, with cheap selective reads.

Documents are range-partitioned by id, so files follow each other in id order
and each file's row groups and pages hold narrow ranges of ids. Page indexes let
a reader skip the pages of other ids; the metadata columns (id, count, place)
lie apart from the token column and are read without it. Small integers such as
token ids get dictionaries, the growing columns delta encoding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilltrend.llm.common import texts
from skilltrend.llm.tokens import worker_encoder
from skilltrend.plans.checkpoints import broadcast_if_small

#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Ids that a worker hands over at once.
HANDED = 2 << 20

SCHEMA = "doc_id long, chunk int, start_in_chunk long, n_tokens long, ids array<int>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("chunk", pa.int32()), ("start_in_chunk", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    drops_space: bool = True,
    row_group: int = ROW_GROUP,
    page: int = PAGE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write each text's ids and one ``end_id`` below ``path``, in ascending id order.

    Null ids come first, equal ids in the order of their texts. ``chunk`` is the
    rank of the file, ``start_in_chunk`` the number of ids before the text in it.
    Null and empty texts have the end id alone; an empty table makes empty files.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(tokenizer, drops_space), np.array([end_id], "<u4").tobytes()
        chunk, start = TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        parts: list[bytes] = []
        held = 0

        def batch() -> pa.RecordBatch:
            nonlocal start
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(
                pa.array(np.r_[0, ends], pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
            )
            columns = [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(sizes), chunk), pa.int32())]
            columns += [pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), ids]
            start += int(ends[-1])
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

        for incoming in batches:
            for doc_id, text in zip(*(column.to_pylist() for column in incoming.columns)):
                doc_ids.append(doc_id)
                parts.append(encoder.encode(text) + end)
                held += len(parts[-1]) // 4
                if held >= HANDED:
                    yield batch()
                    doc_ids, parts, held = [], [], 0
        if doc_ids:
            yield batch()

    ordered = texts(docs, id_column, text_column).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#start_in_chunk", "false")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids in all rows before; unread columns stay unread.

    The base of each chunk comes from the counts alone: one row per file.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    chunks = stored.groupBy("chunk").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.select("chunk", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # One row per file: where those are few, no row of ids is moved for them.
    return stored.join(broadcast_if_small(bases), "chunk").withColumn("start", F.col("base") + F.col("start_in_chunk")).drop("base")


def with_checksums(stored: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of the ids that were read."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            counts = np.diff(bounds).astype(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(counts), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    rows = stored.select("doc_id", "start", "ids")
    return rows.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")
