"""A prefix trie of conversations, from padded matrices of turn ids.

A turn's id is a fingerprint of its role and text. Equal conversations become one sequence first, so
copies cost one row. Sequences are dealt to shards by range. A shard pads its sequences to matrices of
turn ids (in blocks of columns, so a long conversation does not widen the others), puts them in order
with ``lexsort``, and marks the cells that differ from the row above; marks accumulated along a row by
OR are the starts of nodes, and ``reduceat`` over a column adds up every node of that depth.

The nodes of a shard's edges go on in its neighbours. Each shard is told the sequence before its first
and the one after its last, so that every sequence knows where it leaves its predecessor, and all
figures of a node are sums or minima over its sequences, whichever shards they are in: edge nodes are
added up by the fingerprint of their path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.arrays import blobs, by_group
from slotledger.llm.shared import written

WORDS = r"[^\x20\x09-\x0D]+"
#: The width of a turn's fingerprint in bytes.
WIDTH = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieParams:
    columns: int = 64  # turns of a matrix block
    cells: int = 1_000_000  # most cells of a matrix, unless it has more rows
    piece: int = 50_000  # ids of one piece of a list of ends


def _fingerprint(*parts: Column) -> Column:
    """MD5 in hexadecimal of the parts with their lengths, so that no two lists of parts are one text."""
    return F.md5(F.concat_ws(":", *[F.length(p) for p in parts], *parts).cast("binary"))


def sequences(turns: DataFrame) -> DataFrame:
    """``(conv_id, fps, words)``: fingerprints and word counts of the turns of each conversation, in order.

    ``turns(conv_id, turn, role, text)``. Turns are in the order of turn, role and text, a null turn
    first; a null role or text is empty; repeated turns stay. Rows without a conv_id are left out.
    A conversation is one row of 16 bytes and a count for each turn; its texts are not gathered.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.select(
        "conv_id", F.row_number().over(order).alias("at"), _fingerprint(F.col("role"), F.col("text")).alias("fp"),
        F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"),
    )
    listed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "fp", "words"))).alias("t"))
    return listed.select("conv_id", F.col("t.fp").alias("fps"), F.col("t.words").alias("words"))


def with_heads(sequences: DataFrame, heads: Column, most: int, base: Column) -> DataFrame:
    """Each conversation with its first ``heads`` turns taken from conversation ``base``.

    ``heads`` is at most ``most``. Where the base has fewer turns all of them are taken, and none where
    it is absent; the conversation's own turns follow from after its first ``heads``.
    """
    first = sequences.select(
        F.col("conv_id").alias("_base"), F.slice("fps", 1, most).alias("_fps"), F.slice("words", 1, most).alias("_words")
    )
    own = sequences.withColumns({"_base": base, "_heads": heads.cast("int")})
    joined = own.join(first, "_base", "left")

    def rebuilt(name: str) -> Column:
        none = F.array().cast("array<string>" if name == "fps" else "array<long>")
        head = F.slice(F.coalesce(f"_{name}", none), F.lit(1), F.col("_heads"))
        rest = F.slice(name, F.col("_heads") + 1, F.greatest(F.size(name), F.lit(1)))
        return F.concat(head, rest).alias(name)

    return joined.select("conv_id", rebuilt("fps"), rebuilt("words"))


def ends_digests(members: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """``(key, ends)``: SHA-256 of the decimal ids of each key, ascending, joined by commas.

    ``members(key binary, conv_id)``. Ids are put in order by ranges, so that a key of very many ids is
    sorted by many tasks, and joined to pieces there. A digest is sequential by its nature: the pieces
    of a key go through one task, which holds one piece at a time.
    """
    most = params.piece

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), dtype=object)
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(ids):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts = np.unique(np.concatenate([[0], cuts, np.arange(0, len(ids), most)]))
            stops = np.append(starts[1:], len(ids))
            texts = [",".join(map(str, ids[b:e].tolist())) for b, e in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[starts].tolist(), pa.binary()), pa.array(ids[starts]), pa.array(texts, pa.string())],
                ["key", "first", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            keys, found = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == held:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    keys.append(held)
                    found.append(state.hexdigest())
                held, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])

    pieces = (
        members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
        .mapInArrow(join, "key binary, first long, ids string")
    )
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends string")


def _sharded(distinct: DataFrame) -> DataFrame:
    """The distinct sequences with their shard, a range, and the sequences next to the shard's edges.

    ``before`` is set on the rows of a shard's first sequence and ``after`` on those of its last.
    """
    dealt = distinct.repartitionByRange("seq").withColumn("shard", F.spark_partition_id())
    dealt = written(dealt, "trie-sequences")
    edges = dealt.groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    along = Window.orderBy("shard")  # one row for each shard
    edges = edges.withColumns({"before": F.lag("last").over(along), "after": F.lead("first").over(along)})
    return dealt.join(edges, "shard").select(
        "shard", "seq", "words", "conv_id", "n", "ends",
        F.when(F.col("seq") == F.col("first"), F.col("before")).alias("before"),
        F.when(F.col("seq") == F.col("last"), F.col("after")).alias("after"),
    )


class _Rows:
    """The sequences of a shard: flat turn ids with offsets, and their lexicographic order."""

    def __init__(self, fingerprints: np.ndarray, offsets: np.ndarray, params: TrieParams):
        # equal fingerprints get equal ids from 1 on, in the order of their bytes; 0 pads
        high, low = fingerprints[:, 0], fingerprints[:, 1]
        order = np.lexsort((low, high))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        self.ids = np.empty(len(order), np.int64)
        self.ids[order] = np.cumsum(new)
        self.offsets, self.sizes, self.params = offsets, np.diff(offsets), params
        self.order = self._sorted()

    def matrix(self, rows: np.ndarray, first: int) -> np.ndarray:
        """The ids of the turns from ``first`` on of ``rows``, one block of columns, padded with 0."""
        most = int(np.clip(self.params.cells // max(len(rows), 1), 1, self.params.columns))
        wide = int(np.clip((self.sizes[rows] - first).max(initial=0), 1, most))
        held = first + np.arange(wide) < self.sizes[rows][:, None]
        out = np.zeros((len(rows), wide), np.int64)
        out[held] = self.ids[(self.offsets[rows][:, None] + first + np.arange(wide))[held]]
        return out

    def _sorted(self) -> np.ndarray:
        order, rank, first = np.arange(len(self.sizes)), np.zeros(len(self.sizes), np.int64), 0
        while not first or first <= self.sizes.max():
            # rows that end at this block take part, as they come before those that go on
            places = np.flatnonzero(self.sizes[order] >= first)
            rows = order[places]
            block = self.matrix(rows, first)
            found = np.lexsort((*block.T[::-1], rank[rows]))
            block, rows = block[found], rows[found]
            order[places] = rows
            new = np.zeros(len(rows), np.int64)
            new[1:] = (block[1:] != block[:-1]).any(axis=1) | (rank[rows[1:]] != rank[rows[:-1]])
            rank[rows] = np.cumsum(new)
            first += block.shape[1]
        return order

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first, rows, changed)`` of each block of columns: the places in the order of the rows that
        reach it, and the cells that begin a node or, where a row has ended, padding.

        A row that goes on follows the one above it that goes on; what lies between has ended before.
        """
        first, rows = 0, np.flatnonzero(self.sizes[self.order] > 0)
        carried = np.zeros(len(rows), bool)
        while len(rows):
            block = self.matrix(self.order[rows], first)
            changed = np.ones(block.shape, bool)
            changed[1:] = block[1:] != block[:-1]
            changed[:, 0] |= carried
            changed = np.logical_or.accumulate(changed, axis=1)
            yield first, rows, changed
            kept = np.flatnonzero(self.sizes[self.order[rows]] > first + block.shape[1])
            # a mark on any row since the one above that goes on
            marks = np.cumsum(changed[:, -1])[kept]
            carried = np.ones(len(kept), bool)
            carried[1:] = marks[1:] != marks[:-1]
            first, rows = first + block.shape[1], rows[kept]

    def begins(self) -> np.ndarray:
        """The depth, from 1, at which each row of the order leaves the row above it."""
        out = np.ones(len(self.order), np.int64)
        for first, rows, changed in self.blocks():
            marked = changed.any(axis=1)
            depth = first + 1 + np.where(marked, changed.argmax(axis=1), changed.shape[1])
            on = (out[rows] == first + 1) & (depth > first + 1)
            out[rows[on]] = depth[on]
        return out


def _nodes(table: pa.Table, params: TrieParams) -> Iterator[pa.RecordBatch]:
    """Figures of the nodes of one shard: of edge nodes the shard's share, with the fingerprint of the path."""
    before, after = (table[c].combine_chunks().drop_null()[:1].cast(pa.large_binary()) for c in ("before", "after"))
    seqs = pa.concat_arrays([before, table["seq"].combine_chunks().cast(pa.large_binary()), after])
    flat, bounds = blobs(seqs, ">u8")
    turns = flat.reshape(-1, 2)
    rows = _Rows(turns.astype(np.uint64), bounds // (WIDTH // 8), params)
    n, own = len(rows.order), slice(len(before), len(rows.order) - len(after))

    def spread(values: np.ndarray, other: int) -> np.ndarray:
        """Values of the shard's rows in the order; its neighbours' rows have ``other``."""
        out = np.full(n, other, np.int64)
        out[own] = values
        return out[rows.order]

    sizes, base, begins = rows.sizes[rows.order], rows.offsets[:-1][rows.order], rows.begins()
    real = spread(np.ones(table.num_rows, np.int64), 0)
    copies, conv = spread(table["n"].to_numpy(), 0), spread(table["conv_id"].to_numpy(), _MOST)
    # a row is a leaf unless the next one, which may be the neighbour's, goes on from it
    leaf = real.copy()
    leaf[:-1] &= begins[1:] != sizes[:-1] + 1
    upto = np.zeros(len(turns) + 1, np.int64)
    counts, _ = blobs(table["words"], ">u4")
    upto[1 + rows.offsets[own.start] : 1 + rows.offsets[own.stop]] = np.cumsum(counts, dtype=np.int64)
    upto[1 + rows.offsets[own.stop] :] = upto[rows.offsets[own.stop]]

    def left(row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the turns of ``row`` from ``depth`` on."""
        return upto[base[row] + sizes[row]] - upto[base[row] + np.minimum(depth - 1, sizes[row])]

    def figures(row: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
        """What a row adds to its node of a depth: copies, children and leaves that it begins, words saved.

        Words are saved on each copy of each turn, but for the nodes that the row begins once.
        """
        saved = copies[row] * left(row, np.maximum(depth, 1)) - real[row] * left(row, np.maximum(depth, begins[row]))
        child = real[row] * ((sizes[row] > depth) & (begins[row] <= depth + 1))
        return [copies[row], child, leaf[row], saved]

    edges = ([0] if len(before) else []) + ([n - 1] if len(after) else [])
    paths: list[bytes] = []
    offsets = []
    for e in edges:
        offsets.append(len(paths))
        paths.append(hashlib.md5(b"").digest())
        for turn in turns[base[e] : base[e] + sizes[e]]:
            paths.append(hashlib.md5(paths[-1] + turn.tobytes()).digest())
    path = pa.array(paths, pa.binary())
    shas = table["ends"].combine_chunks()

    def picked(values: pa.Array, at: np.ndarray) -> pa.Array:
        return values.take(pa.array(at, pa.int64(), mask=at < 0))

    def record(least, sums, row, depth, parent, edge, above) -> pa.RecordBatch:
        # a node's first row is the one that ends there, if any does
        ended = np.where((sizes[row] == depth) & (real[row] > 0), rows.order[row] - own.start, -1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(row), table["shard"][0].as_py(), np.int32)),
                *(pa.array(v.astype(np.int64)) for v in (least, depth, *sums)), picked(shas, ended),
                pa.array(parent, pa.int64(), mask=depth == 0), picked(path, edge), picked(path, above),
            ],
            [f.split()[0] for f in NODE.split(", ")],
        )

    everything, none = np.arange(n), np.array([-1])
    depth0 = np.zeros(1, np.int64)
    root_edge = 0 if edges else -1
    yield record(
        np.array([conv.min()]), [v.sum(keepdims=True) for v in figures(everything, np.zeros(n, np.int64))],
        np.flatnonzero(real)[:1], depth0, depth0, np.array([root_edge]), none,
    )
    upper, upper_edge = np.full(n, conv.min()), np.full(n, root_edge)
    for first, on, changed in rows.blocks():
        m, wide = changed.shape
        cells = np.flatnonzero(changed.T.ravel())  # column after column
        length = np.diff(np.append(cells, m * wide))
        row, depth = np.tile(on, wide), np.repeat(first + 1 + np.arange(wide), m)
        alive = sizes[row] >= depth
        sums = [np.add.reduceat(np.where(alive, v, 0), cells) for v in figures(row, depth)]
        least = np.minimum.reduceat(np.where(alive, conv[row], _MOST), cells)
        edge = np.full(len(cells), -1)
        for e, offset in zip(edges, offsets, strict=True):
            deep = np.arange(first + 1, min(first + wide, int(sizes[e])) + 1)
            at = (deep - first - 1) * m + np.searchsorted(on, e)
            edge[np.searchsorted(cells, at, side="right") - 1] = offset + deep
        by_cell, edge_by_cell = (np.repeat(v, length).reshape(wide, m) for v in (least, edge))
        parent = np.concatenate([upper[on][None], by_cell[:-1]]).ravel()[cells]
        above = np.concatenate([upper_edge[on][None], edge_by_cell[:-1]]).ravel()[cells]
        held = alive[cells] & (sums[0] > 0)
        if held.any():
            yield record(least[held], [s[held] for s in sums], row[cells][held], depth[cells][held], parent[held], edge[held], above[held])
        upper[on], upper_edge[on] = by_cell[-1], edge_by_cell[-1]


_MOST = np.iinfo(np.int64).max
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
NODE = (
    "shard int, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, parent_conv_id long, node binary, above binary"
)


def prefix_trie(sequences: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """One row for each distinct prefix of ``sequences(conv_id, fps, words)``, the empty one included.

    Returns ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of the subtree, and ``ends_sha256`` of
    the members that end at the node. Equal conversations are members of the same nodes; a conversation
    without turns is a member of the root alone. An empty table has no nodes. ``fps`` are 128-bit
    fingerprints in hexadecimal; of a turn as of :func:`sequences`, equal ones are taken for equal turns.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, "shard"):
            yield from _nodes(table, params)

    seq = F.unhex(F.array_join("fps", ""))
    words = F.unhex(F.array_join(F.transform("words", lambda w: F.lpad(F.hex(w), 8, "0")), ""))
    rows = sequences.select("conv_id", seq.alias("seq"), words.alias("words")).withColumn("key", F.unhex(F.md5("seq")))
    rows = written(rows, "trie-conversations")
    copies = rows.groupBy("key", "seq", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    distinct = copies.join(ends_digests(rows.select("key", "conv_id"), params), "key")
    parts = _sharded(distinct).repartition("shard").sortWithinPartitions("shard").mapInArrow(work, NODE)
    parts = written(parts, "trie-nodes")

    edge = parts.where("node is not null").groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS], F.max("ends").alias("ends"), F.max("above").alias("above")
    )
    edge = written(edge, "trie-edges")
    known = edge.select(F.col("node").alias("above"), F.col("conv_id").alias("_parent"))
    # by shard, as most nodes of depth 1 have the same parent
    near = parts.where("node is not null").select("shard", F.col("node").alias("above")).distinct().join(known, "above")
    inner = parts.where("node is null")
    shown = ["conv_id", "depth", "parent_conv_id", *SUMS, F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    below = inner.where("above is not null").drop("parent_conv_id").join(near, ["shard", "above"])
    whole = edge.join(known, "above", "left")
    return (
        inner.where("above is null").select(*shown)
        .unionByName(below.withColumnRenamed("_parent", "parent_conv_id").select(*shown))
        .unionByName(whole.withColumnRenamed("_parent", "parent_conv_id").select(*shown))
    )
