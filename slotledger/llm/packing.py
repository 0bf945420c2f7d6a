"""Packing documents into training sequences, each seed's window filled with its lexical neighbours.

Documents are put in the order of the rarest terms that they hold, rare by a weighted random order of
all terms (how many of all documents of the table hold them), and dealt to shards of bounded size along it: documents that share rare terms, copies and
passages among them, are in one shard more often than by chance, how often is in the README. A shard
is an inverted BM25 index over the token ids of its documents, weighted by the statistics of all
documents of the table. Packing takes the unused documents in turn as seeds; the index returns the
seed's unused neighbours by score, and those that fit fill the window, best first. When none fits
whole, the best one is cut, and its rest seeds the next window, so that a window never has padding.
What is left at a shard's end is cut into powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.llm.arrays import blobs, mix, slices
from slotledger.llm.shared import written
from slotledger.llm.tokens import MOST_WORDS, WordEncoder, crc32, load

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, shard long"
)


#: Bytes of ids that a task packs, where there are more than the session's tasks would take.
TASK_BYTES = 128 << 20


@dataclass(frozen=True)
class PackParams:
    """``shard_bytes``: text in a shard; a task's last one may have less.

    ``placing_terms``: first terms by which a document is placed. ``cached_words``: words whose ids a
    worker keeps.
    """

    window: int = 4096
    end_id: int = 2
    shard_bytes: int = 3_000_000
    placing_terms: int = 3
    k1: float = 1.2
    b: float = 0.75
    cached_words: int = MOST_WORDS


@dataclass
class Corpus:
    """Numbers of documents and tokens, and for each term how many documents have it."""

    count: int
    tokens: int
    df: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, offsets: np.ndarray, terms: int) -> Corpus:
        owner = np.repeat(np.arange(len(offsets) - 1, dtype=_whole(len(offsets) * terms)), np.diff(offsets))
        pair = np.unique(owner * terms + ids)
        return Corpus(len(offsets) - 1, len(ids), np.bincount(pair % terms, minlength=terms))


def _whole(most: int) -> type:
    """Whole numbers below ``most`` in as few bytes as hold them: they are sorted twice as fast."""
    return np.int32 if most < 1 << 31 else np.int64


class Bm25:
    """Postings of one shard: for each term the documents with it and their weights in ``corpus``."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, params: PackParams, corpus: Corpus):
        count = len(offsets) - 1
        lengths = np.diff(offsets)
        kind = _whole(count * (int(ids.max(initial=0)) + 1))
        owner = np.repeat(np.arange(count, dtype=kind), lengths)
        pair, tf = np.unique(ids.astype(kind) * kind(count) + owner, return_counts=True)
        terms, self.docs = np.divmod(pair, count)
        self.terms, self.heads, df = np.unique(terms, return_index=True, return_counts=True)
        self.ends = self.heads + df
        spread = corpus.df[self.terms]
        idf = np.log1p((corpus.count - spread + 0.5) / (spread + 0.5))
        norm = params.k1 * (1 - params.b + params.b * lengths / max(1.0, corpus.tokens / max(1, corpus.count)))
        self.weights = np.repeat(idf, df) * tf * (params.k1 + 1) / (tf + norm[self.docs])
        order = np.argsort(self.docs, kind="stable")
        self.query = np.repeat(np.arange(len(df)), df)[order]
        self.query_ends = np.cumsum(np.bincount(self.docs, minlength=count))
        self.count = count

    def scores(self, doc: int) -> np.ndarray:
        """The score of every document for all terms of ``doc``."""
        terms = self.query[self.query_ends[doc - 1] if doc else 0 : self.query_ends[doc]]
        spans = [slice(self.heads[t], self.ends[t]) for t in terms]
        if not spans:
            return np.zeros(self.count)
        return np.bincount(
            np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.count
        )

    def neighbours(self, doc: int, unused: np.ndarray) -> list[int]:
        """The unused documents that share a term with ``doc``, best first."""
        scores = self.scores(doc)
        found = np.flatnonzero(unused & (scores > 0))
        return found[np.argsort(-scores[found], kind="stable")].tolist()


def pack_shard(
    ids: np.ndarray, offsets: np.ndarray, params: PackParams, corpus: Corpus | None = None
) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` for each piece of a shard's documents.

    Without a ``corpus`` the shard is all there is.
    """
    index = Bm25(ids, offsets, params, corpus or Corpus.of(ids, offsets, int(ids.max(initial=0)) + 1))
    lengths = np.diff(offsets)
    unused, sizes = lengths > 0, lengths.tolist()
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, used = 0, 0

    def put(doc: int, start: int) -> int:
        """Put what fits of a document from ``start``; returns where its rest starts."""
        nonlocal used
        take = min(sizes[doc] - start, params.window - used)
        pieces.append((doc, start, take, sequence, used))
        used += take
        return start + take

    turn, rest = 0, None
    while True:
        if rest is None:
            while turn < index.count and not unused[turn]:
                turn += 1
            if turn == index.count:
                break
            rest = turn, 0
            unused[turn] = False
        doc, start = rest
        start, rest = put(doc, start), None
        if start < sizes[doc]:  # the window is full, and this document goes on in the next
            rest, sequence, used = (doc, start), sequence + 1, 0
            continue
        best = -1
        for other in index.neighbours(doc, unused) if used < params.window else []:
            if sizes[other] <= params.window - used:
                unused[other] = False
                put(other, 0)
                if used == params.window:
                    break
            elif best < 0:
                best = other
        if used < params.window and best >= 0:
            unused[best] = False
            rest, sequence, used = (best, put(best, 0)), sequence + 1, 0
        elif used == params.window:
            sequence, used = sequence + 1, 0
    return _without_padding(pieces, sequence, used)


def _without_padding(pieces: list, sequence: int, used: int) -> list:
    """Cut the last, unfilled sequence into sequences whose lengths are powers of two."""
    if not used:
        return pieces
    kept, last = [p for p in pieces if p[3] != sequence], [p for p in pieces if p[3] == sequence]
    sizes = [1 << k for k in reversed(range(used.bit_length())) if used >> k & 1]
    room, filled = sizes.pop(0), 0
    for doc, start, length, _, _ in last:
        while length:
            if filled == room:
                sequence, room, filled = sequence + 1, sizes.pop(0), 0
            take = min(length, room - filled)
            kept.append((doc, start, take, sequence, filled))
            start, length, filled = start + take, length - take, filled + take
    return kept


def statistics(encoded: DataFrame, dtype: str, terms: int) -> Corpus:
    """The numbers of all rows of ``encoded(ids)``: at most ``terms`` + 2 of them, whatever the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                found = Corpus.of(*blobs(part.column("ids"), dtype), terms)
                total += np.append(found.df, (found.count, found.tokens))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    total = np.zeros(terms + 2, np.int64)
    for r in encoded.select("ids").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r.at] = r.n
    return Corpus(int(total[terms]), int(total[terms + 1]), total[:terms])


def placing_order(corpus: Corpus) -> np.ndarray:
    """The place of each term in a random order that puts terms first by how rare they are in all documents.

    The first terms of two documents in this order agree about as often as they share what they
    hold, terms weighted by rarity.
    """
    terms = len(corpus.df)
    idf = np.log1p((corpus.count - corpus.df + 0.5) / (corpus.df + 0.5))
    drawn = (mix(np.arange(1, terms + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) + 1
    order = np.argsort(-np.log(drawn / 2.0**53 / (1 + 2.0**-50)) / np.maximum(idf, 1e-9), kind="stable")
    place = np.empty(terms, np.int32)
    place[order] = np.arange(terms)
    return place


def _first_places(place: np.ndarray, ids: np.ndarray, offsets: np.ndarray, most: int) -> list[np.ndarray]:
    """The first ``most`` places among the terms of each document; past the last one where it has fewer."""
    places, counts, out = place[ids], np.diff(offsets), []
    for _ in range(most):
        least = np.minimum.reduceat(places, offsets[:-1]) if len(counts) else places
        out.append(least)
        places = np.where(places == np.repeat(least, counts), np.int32(len(place)), places)
    return out


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Consecutive rows as tables whose ``size`` reaches ``most``; what is left at the end is less."""
    held: list[pa.RecordBatch] = []
    filled = 0
    for batch in batches:
        ends = np.cumsum(batch.column("size").to_numpy(zero_copy_only=False))
        begin, done = 0, 0
        while begin < batch.num_rows:
            end = min(batch.num_rows, int(np.searchsorted(ends, done + most - filled)) + 1)
            held.append(batch.slice(begin, end - begin))
            filled += int(ends[end - 1]) - done
            begin, done = end, int(ends[end - 1])
            if filled >= most:
                yield pa.Table.from_batches(held)
                held, filled = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack(documents: DataFrame, model_path: str, params: PackParams = PackParams()) -> DataFrame:
    """One row for each piece of each row of ``documents(doc_id, text)``; see ``PIECES``.

    A null or empty text is the end id alone. Rows that repeat a doc_id, and rows whose doc_id is
    null, are packed each for itself; many equal rows are dealt to several shards. Other columns are
    not read. An empty table gives no pieces.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoder = load(model_path, params.cached_words)
    terms = max(encoder.vocabulary, params.end_id + 1)
    dtype = "<u2" if terms <= 1 << 16 else "<u4"
    keys = [f"key_{k}" for k in range(params.placing_terms)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(model_path, params.cached_words)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = encoder.encode(part.column("text"), params.end_id)
                ids = ids.astype(dtype)
                packed = [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                size = pc.add(pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64()), 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary()), size], ["doc_id", "ids", "size"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                first = _first_places(place.value, *blobs(part.column("ids"), dtype), params.placing_terms)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, pa.int32()) for v in first)], [*part.schema.names, *keys])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(_cut(batches, params.shard_bytes)):
            shard = (TaskContext.get().partitionId() << 16) + number
            ids, offsets = blobs(table["ids"], dtype)
            doc_ids, lengths = table["doc_id"].to_pylist(), np.diff(offsets)
            rows = [
                (doc_ids[d], start, n, crc32(ids[offsets[d] + start : offsets[d] + start + n]), int(lengths[d]),
                 (shard << 24) + seq, at, shard)
                for d, start, n, seq, at in pack_shard(ids, offsets, params, corpus)
            ]
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    schema = "doc_id long, ids binary, size long"
    encoded = written(docs.mapInArrow(encode, schema), "packing-ids")
    corpus = statistics(encoded, dtype, terms)
    # one number for each term of the model
    place = docs.sparkSession.sparkContext.broadcast(placing_order(corpus))
    placed = encoded.mapInArrow(put, ", ".join([schema, *(f"{k} int" for k in keys)]))
    # the place in the table just written parts rows that are equal in all else
    order = [*keys, "_hash", "_row"]
    dealt = placed.withColumns({"_hash": F.xxhash64("doc_id"), "_row": F.monotonically_increasing_id()})
    # as many tasks as the session sets, or more where each would read more than is good for one
    spark = docs.sparkSession
    needed = -(-corpus.tokens * np.dtype(dtype).itemsize // TASK_BYTES)
    tasks = [needed] if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    dealt = dealt.repartitionByRange(*tasks, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids", "size").mapInArrow(build, PIECES)
