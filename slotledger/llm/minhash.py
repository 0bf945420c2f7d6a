"""Near duplicates by b-bit MinHash over word shingles.

1. Each whole text becomes its set of shingle hashes, ``bands * rows`` minima, a key for each band,
   and the low ``bits`` of all minima packed into 64-bit words. Equal sets are one class from here.
2. Classes that share a band key are candidates. In each bucket every class is compared with the
   smallest one first; that costs one comparison a member, however large the bucket is.
3. Candidates need a similarity, estimated from the packed bits and corrected for chance
   collisions, of at least the threshold less ``slack`` standard errors. They are links only if
   their full sets say so.
4. Buckets that still hold more than one component are compared in tiles of bounded size, all
   members against those outside the bucket's largest component: by bits first, then, for the
   members of pairs that this leaves, by full sets. A pair is treated in the first band that it
   shares only, and a tile returns a spanning forest.

A pair at the threshold shares no band with probability (1 - t ** rows) ** bands, 3e-6 here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.llm.arrays import blobs, by_group, longs, mix, ragged, slices
from slotledger.llm.components import connected_components
from slotledger.llm.shared import written
from slotledger.llm.shingles import MinHasher, band_keys, packed_bits, shingle_sets

_U = np.uint64


@dataclass(frozen=True)
class MinHashParams:
    """``percent``: links need 100 * intersection >= percent * union. ``tile``: rows of a tile's side."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    bits: int = 4
    slack: float = 4.0
    tile: int = 1024

    @property
    def words(self) -> int:
        return -(-self.bands * self.rows * self.bits // 64)

    @property
    def most_unequal(self) -> int:
        """The most minima that may differ in their low bits."""
        count, chance = self.bands * self.rows, 2.0 ** -self.bits
        equal = chance + (1 - chance) * self.percent / 100
        return int(count * (1 - equal) + self.slack * sqrt(count * equal * (1 - equal)))


def _signatures(params: MinHashParams):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(params.bands * params.rows)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, low, high, bits, keys = [], [], [], [], []
                for found in shingle_sets(part.column("text"), params.shingle):
                    sizes.append(len(found))
                    low.append(int(found.sum(dtype=_U)))
                    high.append(int(mix(found).sum(dtype=_U)))
                    if len(found):
                        minima = hasher.minima(found)
                        packed = packed_bits(minima, params.bits)
                        bits.append(np.frombuffer(packed.ljust(8 * params.words, b"\0"), np.int64))
                        keys.append(band_keys(minima, params.bands, params.rows).view(np.int64))
                    else:
                        bits.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(sizes, pa.int64()),
                        pa.array(np.array(low, _U).view(np.int64)), pa.array(np.array(high, _U).view(np.int64)),
                        pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "low", "high", "bits", "keys"],
                )

    return build


def _sets(shingle: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [x.tobytes() for x in shingle_sets(part.column("text"), shingle)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.binary())], ["id", "shingles"])

    return build


def unequal_minima(left: str, right: str, bits: int):
    """How many minima differ in their low bits, by bit counts over the packed words."""
    ones = sum(1 << k for k in range(0, 64, bits))
    ones -= (1 << 64) if ones >= 1 << 63 else 0

    def differ(a, b):
        x = a.bitwiseXOR(b)
        for k in range(1, bits):
            x = x.bitwiseOR(F.shiftrightunsigned(a.bitwiseXOR(b), k))
        return F.bit_count(x.bitwiseAND(F.lit(ones)))

    return F.aggregate(F.zip_with(left, right, differ), F.lit(0), lambda s, x: s + x)


def _linked(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, at = blobs(batch.column("sa"), _U)
            right, bt = blobs(batch.column("sb"), _U)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                x, y = left[at[k] : at[k + 1]], right[bt[k] : bt[k + 1]]
                common = _common(x, y)
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return check


def _common(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum()) if len(x) else 0


class Tile:
    """The classes of one tile of a bucket, and the pairs in it that their bits leave possible."""

    def __init__(self, table: pa.Table, params: MinHashParams):
        self.params = params
        self.ones = _U(sum(1 << k for k in range(0, 64, params.bits)))
        self.ids, self.labels = table["id"].to_numpy(), table["label"].to_numpy()
        self.sizes = table["n"].to_numpy()
        self.stragglers = np.flatnonzero(table["straggler"].to_numpy(zero_copy_only=False))
        self.bits, self.keys = longs(table["bits"], params.words), longs(table["keys"], params.bands)
        own = _U(table["key"][0].as_py() & (1 << 64) - 1)
        self.band = int(np.flatnonzero((self.keys == own).all(axis=0))[0])

    def partners(self, i: int) -> np.ndarray:
        """Rows of other components that may link with row i and share no earlier band with it."""
        sizes, percent = self.sizes, self.params.percent
        apart = self.labels != self.labels[i]
        apart &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        rest = np.flatnonzero(apart)
        rest = rest[~(self.keys[rest, : self.band] == self.keys[i, : self.band]).any(axis=1)]
        x = self.bits[rest] ^ self.bits[i]
        y = x.copy()
        for k in range(1, self.params.bits):
            y |= x >> _U(k)
        return rest[np.bitwise_count(y & self.ones).sum(axis=1, dtype=np.int64) <= self.params.most_unequal]

    def open_rows(self) -> np.ndarray:
        """The rows that are in any possible pair."""
        found = np.zeros(len(self.ids), bool)
        for i in self.stragglers:
            rest = self.partners(i)
            found[rest] = True
            found[i] |= len(rest) > 0
        return found

    def forest(self, flat: np.ndarray, at: np.ndarray) -> tuple[list[int], list[int]]:
        """Links between components by full sets, as a spanning forest of the components."""
        parent = {int(x): int(x) for x in self.labels}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        left, right = [], []
        for i in self.stragglers:
            mine = root(int(self.labels[i]))
            rest = np.array([j for j in self.partners(i) if root(int(self.labels[j])) != mine], np.int64)
            if not len(rest):
                continue
            own, sizes = flat[at[i] : at[i + 1]], self.sizes[rest]
            values = flat[ragged(at[rest], sizes)]
            where = np.searchsorted(own, values)
            where[where == len(own)] = 0
            common = np.add.reduceat((own[where] == values).astype(np.int64), np.cumsum(sizes) - sizes)
            for j in rest[100 * common >= self.params.percent * (sizes + self.sizes[i] - common)]:
                p, q = root(int(self.labels[i])), root(int(self.labels[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    left.append(int(self.ids[i]))
                    right.append(int(self.ids[j]))
        return left, right


TILE = "tile long, key long, id long, label long, straggler boolean, n long, bits array<long>, keys array<long>"


def _open_rows(params: MinHashParams):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "tile"):
            found = Tile(table, params).open_rows()
            if found.any():
                yield from table.filter(pa.array(found)).combine_chunks().to_batches()

    return work


def _forests(params: MinHashParams):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "tile"):
            left, right = Tile(table, params).forest(*blobs(table["shingles"], _U))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return work


def near_duplicates(documents: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``documents(doc_id, text)``.

    ``component_id`` is the smallest doc_id that links reach. Texts that are null, empty or without
    words have no shingles and link with nothing; a text with fewer words than a shingle is one
    shingle. Rows that repeat a doc_id are one document, each returned. A null doc_id links with
    nothing, has a null component and is kept. Other columns are not read. An empty table gives an
    empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(
        docs.mapInArrow(
            _signatures(params),
            "doc_id long, n_shingles long, low long, high long, bits array<long>, keys array<long>",
        ), "minhash-signatures",
    )
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(
        usable.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")),
        "minhash-classes",
    )
    first = classes.select("id")
    signs = usable.select(F.col("doc_id").alias("id"), "n_shingles", "bits", "keys").join(first, "id", "left_semi")
    signs = written(signs, "minhash-firsts")

    rows = signs.select("id", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last")
    members = written(rows.join(buckets.select("key", "center"), "key"), "minhash-members")

    near = signs.select("id", "bits", F.col("n_shingles").alias("n"))
    stars = members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    stars = (
        stars.join(near.toDF("b", "bits_b", "nb"), "b").join(near.toDF("a", "bits_a", "na"), "a")
        .where(f"100 * least(na, nb) >= {params.percent} * greatest(na, nb)")
        .where(unequal_minima("bits_a", "bits_b", params.bits) <= params.most_unequal).select("a", "b")
    )
    stars = written(stars, "minhash-stars")

    def sets(ids: DataFrame) -> DataFrame:
        """The full sets of the named classes, from their texts again: cheaper than storing all."""
        texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids.distinct(), "id", "left_semi")
        return texts.mapInArrow(_sets(params.shingle), "id long, shingles binary")

    full = written(sets(stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id")))), "minhash-sets")
    starred = (
        stars.join(full.toDF("b", "sb"), "b").join(full.toDF("a", "sa"), "a")
        .mapInArrow(_linked(params.percent), "a long, b long")
    )
    starred = written(starred, "minhash-starred")
    labels = connected_components(starred, "minhash-labels")

    labelled = members.join(labels.withColumnRenamed("component", "label"), "id", "left").select(
        "key", "id", F.coalesce("label", "id").alias("label")
    )
    labelled = written(labelled, "minhash-labelled")
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    counts = counts.groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"),
        F.sum("n").alias("n"), F.count("*").alias("n_labels"),
    ).where("n_labels > 1")
    side = params.tile
    open_rows = labelled.join(counts, "key").select(
        "key", "id", "label", (F.col("label") != F.col("main")).alias("straggler"),
        F.ceil(F.col("n_main") / side).alias("m"), F.ceil((F.col("n") - F.col("n_main")) / side).alias("s"),
    ).withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("straggler"), F.col("s")).otherwise(F.col("m"))))
    # tile (i, j): block i of the stragglers against block j of all, the stragglers' blocks first
    as_left = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") + F.col("s") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j")))
    place = F.when(F.col("straggler"), F.col("part")).otherwise(F.col("s") + F.col("part"))
    as_right = F.transform(F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda i: F.struct(i.alias("i"), place.alias("j")))
    tiles = open_rows.withColumn("at", F.explode(F.when(F.col("straggler"), F.array_distinct(F.concat(as_left, as_right))).otherwise(as_right)))
    tiles = tiles.select(F.xxhash64("key", "at.i", "at.j").alias("tile"), "key", "id", "label", "straggler")
    tiles = tiles.join(signs.select("id", F.col("n_shingles").alias("n"), "bits", "keys"), "id")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", "id").select(*[c.split()[0] for c in TILE.split(", ")])
    # most rows are in no possible pair; only the others need their sets
    tiles = written(tiles.mapInArrow(_open_rows(params), TILE), "minhash-tiles")
    full = sets(tiles.select("id"))
    across = (
        tiles.join(full, "id").repartition("tile").sortWithinPartitions("tile", "id")
        .mapInArrow(_forests(params), "a long, b long")
    )
    across = written(across, "minhash-across")

    joined = connected_components(starred.union(across), "minhash-components")
    grouped = (
        classes.join(joined, "id", "left")
        .select("low", "high", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    )
    result = signed.select("doc_id", "n_shingles", "low", "high").join(grouped, ["low", "high", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
