"""Token ids as Parquet files for training readers.

One row is one document: ``part`` (the file's number), ``doc_id``, ``start_in_part``, ``n_tokens``
and ``ids``, a list column. Rows are in ascending doc_id order within a file and from file to file.
Ids are dictionary-encoded (two bytes or less each, bit-packed), the ascending columns are
delta-encoded; the sizes of row groups and pages are set, and Parquet's page indexes let a reader
take the pages of some documents, or the small columns alone, without touching other ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotledger.llm.arrays import slices
from slotledger.llm.tokens import crc32, load

SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"


@dataclass(frozen=True)
class TokenFileParams:
    end_id: int = 1
    row_group_bytes: int = 64 << 20
    page_bytes: int = 1 << 20
    page_rows: int = 2_000
    compression: str = "zstd"


def encoded(documents: DataFrame, model_path: str, params: TokenFileParams = TokenFileParams()) -> DataFrame:
    """The rows of the files, parted by ranges of doc_id and sorted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(model_path)
        part_id, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = encoder.encode(part.column("text"), params.end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(part.num_rows, part_id, np.int32)), part.column("doc_id"),
                        pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32))),
                    ],
                    ["part", "doc_id", "start_in_part", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows that repeat a doc_id have an order too, in which many of them can be dealt to several files
    order = ["doc_id", F.xxhash64("text"), "text"]
    return docs.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(work, SCHEMA)


def write_tokens(
    documents: DataFrame, model_path: str, path: str, params: TokenFileParams = TokenFileParams()
) -> None:
    """Encode every whole text and write the files at ``path``.

    A null or empty text has the end id alone. A null doc_id comes first; rows that repeat a doc_id
    follow each other in an order of their texts. Other columns are not read. An empty table gives a file
    without rows.
    """
    writer = encoded(documents, model_path, params).write
    for key, value in {
        "compression": params.compression,
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.block.size": params.row_group_bytes,
        "parquet.page.size": params.page_bytes,
        "parquet.page.row.count.limit": params.page_rows,
    }.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of the files, or those of doc_ids from ``first`` to ``last``; unread columns cost nothing."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows


def checksums(rows: DataFrame) -> DataFrame:
    """``(part, doc_id, start_in_part, n_tokens, ids_crc32)`` from the ids in the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)
            sums = [crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), batch.column("start_in_part"),
                 pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(work, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before: one row a file is summed up, never one a document."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return sums.join(before, "part").withColumn("start", F.col("before") + F.col("start_in_part"))
