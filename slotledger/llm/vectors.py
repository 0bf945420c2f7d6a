"""Blocks of vectors: usable rows, packed matrices, and the grid of block pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.llm.arrays import by_group


def finite(vector: Column | str) -> Column:
    """True for a vector that is not null or empty and whose components are all finite numbers."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def count_up(n: int) -> Column:
    """The array of 0 .. n - 1."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def packed(rows: DataFrame, blocks: Column, dtype: str) -> DataFrame:
    """``(dim, block, rows, ids, data, weights)``: the vectors of a block and length as one matrix.

    ``rows(id, vector, weight)``; ``blocks`` is the number of blocks, into which ids are hashed.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "place"):
            vectors = table["vector"].combine_chunks()
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            yield pa.RecordBatch.from_arrays(
                [
                    table["dim"][:1].combine_chunks(), table["block"][:1].combine_chunks(),
                    pa.array([table.num_rows], pa.int64()),
                    pa.array([table["id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                    pa.array([flat.tobytes()], pa.binary()),
                    pa.array([table["weight"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                ],
                ["dim", "block", "rows", "ids", "data", "weights"],
            )

    placed = rows.select(
        "id", "vector", "weight", F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), blocks).alias("block")
    ).withColumn("place", F.xxhash64("dim", "block"))
    return (
        placed.repartition("place").sortWithinPartitions("place", "id")
        .mapInArrow(build, "dim int, block long, rows long, ids binary, data binary, weights binary")
    )


def matrix(row: dict, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids``, the matrix and ``weights`` of one packed row."""
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["data"], dtype).reshape(len(ids), -1), np.frombuffer(row["weights"], np.int64)
