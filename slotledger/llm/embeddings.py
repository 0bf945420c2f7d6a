"""Near-duplicate vectors by cosine, from quantised tile products with error bounds.

Equal vectors are one class from the start. Classes are packed in blocks, and every pair of blocks
is a tile. In a tile each unit vector u is ``scale * q + e`` with q in int8; e is known, so

    |u.v - scale_u scale_v q_u.q_v|  <=  |e_u| |v'| + |e_v| |u'| + |e_u| |e_v|,   x' = scale * q,

with the norms taken of the vectors at hand. Up to 1,040 components the products q_u.q_v are whole
numbers below 2**24 and exact in single precision; beyond, their rounding is bounded too. Only pairs that the bound leaves possible are computed again in double
precision from the vectors themselves. Blocks have a centre and an angular radius; tiles whose caps
are too far apart for any link are skipped.

A tile returns, for each class, how many vectors it links, and a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.llm.arrays import by_group
from slotledger.llm.components import connected_components
from slotledger.llm.shared import written
from slotledger.llm.vectors import count_up, finite, matrix, packed

STRIP = 256


@dataclass(frozen=True)
class CosineParams:
    threshold: float = 0.95
    block: int = 4096


class Quantised:
    """Unit vectors in int8 (held as single-precision whole numbers), with the error of each."""

    def __init__(self, data: np.ndarray):
        self.norm = np.sqrt(np.square(data).sum(axis=1))
        unit = data / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        q = np.rint(unit / self.scale[:, None])
        near = q * self.scale[:, None]
        self.near = np.sqrt(np.square(near).sum(axis=1))
        self.error = np.sqrt(np.square(unit - near).sum(axis=1))
        self.q = q.astype(np.float32)
        self.data = data
        mean = unit.mean(axis=0)
        size = np.sqrt(np.square(mean).sum())
        self.centre = mean / size if size else unit[0]
        self.radius = float(np.arccos(np.clip(unit @ self.centre, -1, 1)).max())


def possible(a: Quantised, rows: slice, b: Quantised, threshold: float) -> np.ndarray:
    """The pairs of ``rows`` of a with all of b whose cosine may reach the threshold."""
    product = a.q[rows] @ b.q.T
    product *= a.scale[rows, None].astype(np.float32)
    product *= b.scale[None, :].astype(np.float32)
    # 1e-5 covers the rounding of these products, and of their sums where these outgrow single
    # precision; the quantisation error is bounded for each vector
    dim = a.q.shape[1]
    slack = 1e-5 + (dim * 2.0**-23 if dim * 127 * 127 >= 1 << 24 else 0.0)
    bound = np.outer(a.error[rows], b.near + b.error) + np.outer(a.near[rows], b.error) + slack
    return product + bound.astype(np.float32) >= threshold


def tile_links(a: Quantised, b: Quantised, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose cosine in double precision reaches the threshold, a strip of a at a time."""
    gap = np.arccos(np.clip(a.centre @ b.centre, -1, 1)) - a.radius - b.radius
    if gap > np.arccos(threshold) + 1e-9:
        return
    for begin in range(0, len(a.data), STRIP):
        rows = slice(begin, min(begin + STRIP, len(a.data)))
        i, j = np.nonzero(possible(a, rows, b, threshold))
        if not len(i):
            continue
        i += begin
        cosine = np.empty(len(i))
        for at in range(0, len(i), 100_000):
            part = slice(at, at + 100_000)
            cosine[part] = np.einsum("ij,ij->i", a.data[i[part]], b.data[j[part]]) / (a.norm[i[part]] * b.norm[j[part]])
        keep = cosine >= threshold
        yield i[keep], j[keep]


class Forest:
    """Union of rows, keeping the edges that joined two trees."""

    def __init__(self, count: int):
        self.parent = np.arange(count)
        self.edges: list[tuple[int, int]] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while (up != self.parent[up]).any():
            up = self.parent[up]
        self.parent[x] = up
        return up

    def join(self, row: int, others: np.ndarray) -> None:
        """Join a row with all it links to."""
        roots, first = np.unique(self.roots(np.append(others, row)), return_index=True)
        if len(roots) > 1:
            own = int(self.roots(np.array([row]))[0])
            self.edges += [(row, int(others[k])) for r, k in zip(roots, first, strict=True) if r != own]
            self.parent[roots] = roots[0]


def near_vectors(vectors: DataFrame, params: CosineParams = CosineParams()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, embedding)``.

    ``n_links``: the other vectors whose cosine with this one reaches the threshold. Vectors that
    are null, empty, zero or hold a null or a component that is not finite link with nothing, as do
    vectors of different lengths. However large or small finite components are, their cosines count. Rows that repeat a vec_id are vectors of their own with one id. A
    null vec_id has a null component and is kept; its vector links with nothing. Other columns are
    not read. An empty table gives an empty result.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    largest = F.array_max(F.transform("embedding", F.abs))
    sound = F.col("vec_id").isNotNull() & finite("embedding") & (largest > 0)
    # a cosine has no scale: vectors whose squares leave the range of doubles are brought near 1 by powers of two
    power = F.floor(F.log2(largest))
    scale = F.when(power.between(-400, 400), F.lit(0)).otherwise(-power)
    half = F.floor(scale / 2)
    scaled = F.transform("embedding", lambda x: x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), scale - half) + F.lit(0.0))
    rows = rows.withColumn("vector", F.when(sound, scaled))
    classes = written(
        rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")),
        "vector-classes",
    )
    blocks = max(1, -(-classes.count() // params.block))
    sides = packed(classes, F.lit(blocks), "<f8").withColumn("other", F.explode(count_up(blocks)))
    tiles = sides.withColumn("tile", F.xxhash64("dim", F.least("block", "other"), F.greatest("block", "other")))
    tiles = tiles.withColumn("alone", F.col("block") == F.col("other"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "tile"):
            parts = table.to_pylist()
            if len(parts) == 1 and not parts[0]["alone"]:
                continue
            ids, data, weight = matrix(parts[0], "<f8")
            a = b = Quantised(data)
            begin = 0
            if len(parts) > 1:
                more_ids, more, more_weight = matrix(parts[1], "<f8")
                b, begin = Quantised(more), len(ids)
                ids, weight = np.concatenate((ids, more_ids)), np.concatenate((weight, more_weight))
            links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
            for i, j in tile_links(a, b, params.threshold):
                if b is a:
                    i, j = i[i != j], j[i != j]
                if not len(i):
                    continue
                j = j + begin
                np.add.at(links, i, weight[j])
                if b is not a:
                    np.add.at(links, j, weight[i])
                starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                for s, e in zip(starts, [*starts[1:], len(i)], strict=True):
                    forest.join(int(i[s]), j[s:e])
            linked = np.flatnonzero(links)
            left = [ids[p] for p, _ in forest.edges]
            right = [ids[q] for _, q in forest.edges]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*ids[linked].tolist(), *left], pa.int64()),
                    pa.array([None] * len(linked) + right, pa.int64()),
                    pa.array([*links[linked].tolist(), *[0] * len(left)], pa.int64()),
                ],
                ["a", "b", "n"],
            )

    found = written(
        tiles.repartition("tile").sortWithinPartitions("tile", "block").mapInArrow(work, "a long, b long, n long"),
        "vector-links",
    )
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("b is not null").select("a", "b"), "vector-components")
    classes = classes.join(counts, "id", "left").join(components, "id", "left").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    result = rows.join(classes, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
