"""Exact top-k search by inner product, with bounds from segment means and deviations.

A vector is cut into segments; of each, its mean and the length of its deviation from the mean are
kept. For two vectors the sum over segments of ``size * mean * mean + deviation * deviation`` is an
upper bound of the inner product (Cauchy-Schwarz on the deviations), which is the same as a lower
bound of the squared distance, ``|q|^2 + |c|^2 - 2 * bound``. Bounds are taken with few segments
first; only pairs that can still reach the query's k-th best score see the finer ones, and only
survivors of the finest have their score computed.

Queries and candidates are packed in blocks. A task takes one block of queries and a group of
candidate blocks, one after the other, so that the k-th best score rises as it goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.arrays import by_group
from slotledger.llm.vectors import count_up, matrix, packed


@dataclass(frozen=True)
class TopKParams:
    """``group``: candidate blocks in one task."""

    k: int = 20
    segments: tuple[int, ...] = (1, 4, 16)
    query_block: int = 1024
    block: int = 4096
    group: int = 16


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """The scaled means and deviations of each row's segments; their products bound inner products."""
    out = []
    for part in np.array_split(x.astype(np.float64), min(segments, x.shape[1]), axis=1):
        mean = part.mean(axis=1)
        out.append(mean * np.sqrt(part.shape[1]))
        out.append(np.sqrt(np.square(part - mean[:, None]).sum(axis=1)))
    return np.stack(out, axis=1)


class Best:
    """The k best scores so far of each query of a block."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query = np.concatenate((self.query, query))
        ids = np.concatenate((self.id, ids))
        score = np.concatenate((self.score, score))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        counts = np.bincount(query, minlength=len(self.least))
        rank = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = rank < self.k
        self.query, self.id, self.score = query[keep], ids[order][keep], score[order][keep]
        last = rank[keep] == self.k - 1
        self.least[self.query[last]] = self.score[last]


def scores(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the named pairs."""
    out = np.empty(len(rows), np.int64)
    for begin in range(0, len(rows), 100_000):
        part = slice(begin, begin + 100_000)
        out[part] = np.einsum("ij,ij->i", q[rows[part]], c[cols[part]])
    return out


def search_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, levels: tuple[int, ...], best: Best) -> None:
    """Add to ``best`` what a block of candidates has for a block of queries."""
    slack = 1e-6 + 1e-9 * float(np.abs(q).max(initial=1)) * float(np.abs(c).max(initial=1)) * q.shape[1]
    for begin in range(0, len(q), 256):
        rows = np.arange(begin, min(begin + 256, len(q)))
        alive = c_ids[None, :] != q_ids[rows][:, None]
        i, j = None, None
        for count in levels:
            if not np.isfinite(best.least[rows]).any():
                break
            left, right = features(q[rows], count), features(c, count)
            if i is None:
                alive &= left @ right.T + slack >= best.least[rows][:, None]
                if alive.mean() < 0.25:
                    i, j = np.nonzero(alive)
            else:
                keep = np.einsum("ij,ij->i", left[i], right[j]) + slack >= best.least[rows][i]
                i, j = i[keep], j[keep]
        if i is None:
            i, j = np.nonzero(alive)
        found = scores(q, c, rows[i], j)
        keep = found >= best.least[rows][i]
        best.add(rows[i][keep], c_ids[j][keep], found[keep])


def top_k(queries: DataFrame, candidates: DataFrame, params: TopKParams = TopKParams()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries(id, vector)`` its k best candidates.

    ``vector`` is a list of whole numbers without nulls. A candidate with the query's own id is not
    returned; vectors of different lengths are not compared. Ties go to the smaller id; a query
    with fewer candidates returns them all, one without any has no row. Rows with a null id or
    vector take no part; rows that repeat an id are one vector each. An empty table on either side
    gives an empty result.
    """
    spark, k = queries.sparkSession, params.k

    def usable(rows: DataFrame) -> DataFrame:
        whole = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<long>").alias("vector"))
        return whole.where("id is not null and vector is not null").withColumn("weight", F.lit(1).cast("long"))

    queries, candidates = usable(queries), usable(candidates)
    n_query = max(1, -(-queries.count() // params.query_block))
    n_block = max(1, -(-candidates.count() // params.block))
    groups = -(-n_block // params.group)
    left = packed(queries, F.lit(n_query), "<i8").select(
        "*", F.lit(0).alias("side"), F.col("block").alias("q"), F.explode(count_up(groups)).alias("g")
    )
    right = packed(candidates, F.lit(n_block), "<i8").select(
        "*", F.lit(1).alias("side"), F.explode(count_up(n_query)).alias("q"),
        F.pmod("block", F.lit(groups)).cast("long").alias("g"),
    )
    tiles = left.union(right).withColumn("tile", F.xxhash64("dim", "q", "g"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "tile"):
            sides = table["side"].to_numpy()
            if sides[0] or not sides[-1]:
                continue
            q_ids, q, _ = matrix(table.slice(0, 1).to_pylist()[0], "<i8")
            best = Best(len(q_ids), k)
            for at in np.flatnonzero(sides):
                c_ids, c, _ = matrix(table.slice(int(at), 1).to_pylist()[0], "<i8")
                search_block(q, q_ids, c, c_ids, params.segments, best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[best.query]), pa.array(best.id), pa.array(best.score)], ["query_id", "vec_id", "score"]
            )

    part = tiles.repartition("tile").sortWithinPartitions("tile", "side", "block").mapInArrow(
        work, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
