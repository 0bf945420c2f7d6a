"""Ranked lexical search by scanning the documents with an Aho-Corasick automaton of the items' terms.

No index of the documents is made. Every byte that is no part of a term becomes one space, and each
term is a pattern with a space on either side, so that a match is a whole term. One scan counts the
terms of all items in each document; the counts give document frequencies, and then the scores. A term
leads to the items that hold it, so that a document meets only items that it shares a term with.

Items come in blocks of bounded text; of one block the terms and the lists of items are broadcast, and
the documents are scanned once for each block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotledger.llm.arrays import blobs, ragged, slices, text_buffer
from slotledger.llm.shared import written

#: 0-9, a-z, A-Z in lower case and every byte from 0x80 on are of terms; the rest become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BINS = 8_000_000
COUNTS = "doc_id long, n long, terms binary, counts binary"
FOUND = "item_id long, doc_id long, score long"


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    block_bytes: int = 4_000_000  # text of the items of one block; a longer item is a block of its own
    piece_bytes: int = 2_000_000  # text that a task scans at once
    cells: int = 4_000_000  # scores that a task holds at once


@dataclass(frozen=True)
class Block:
    """Items with their distinct terms: of term t, ``items[first[t]:first[t + 1]]`` hold it ``repeats`` times."""

    ids: np.ndarray
    terms: list[bytes]
    first: np.ndarray
    items: np.ndarray
    repeats: np.ndarray


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _block(held: dict[int, Counter]) -> Block:
    ids, terms = sorted(held), sorted(set().union(*held.values()))
    at = {t: k for k, t in enumerate(terms)}
    triples = np.array([(at[t], i, c) for i, item in enumerate(ids) for t, c in held[item].items()], np.int64).reshape(-1, 3)
    triples = triples[np.argsort(triples[:, 0], kind="stable")]
    first = np.searchsorted(triples[:, 0], np.arange(len(terms) + 1))
    return Block(np.array(ids, np.int64), terms, first, triples[:, 1], triples[:, 2])


def blocks(items: DataFrame, params: SearchParams = SearchParams()) -> Iterator[Block]:
    """The items in blocks, in the order of their ids; rows of one item_id are one item."""
    held: dict[int, Counter] = {}
    size = 0
    rows = items.where("item_id is not null and text is not null")
    rows = rows.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.orderBy("item_id").toLocalIterator():
        if size + len(row.text) > params.block_bytes and held and row.item_id not in held:
            yield _block(held)
            held, size = {}, 0
        held.setdefault(row.item_id, Counter()).update(terms_of(row.text))
        size += len(row.text)
    if held:
        yield _block(held)


def _pieces(text: bytes, offsets: np.ndarray, most: int) -> Iterator[tuple[int, bytes]]:
    """``(row, text)``: whole documents, or parts of at least ``most`` bytes that end between terms."""
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while end - begin > most:
            cut = text.find(b" ", begin + most, end)
            if cut < 0:
                break
            yield row, text[begin:cut]
            begin = cut
        yield row, text[begin:end]


def _grouped(pieces: Iterator[tuple[int, bytes]], most: int) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """Pieces joined by spaces to texts of about ``most`` bytes: the rows, the text, where each piece starts."""
    rows, parts, size = [], [], 0
    for row, part in pieces:
        rows.append(row)
        parts.append(part)
        size += len(part) + 1
        if size >= most:
            yield np.array(rows), b" " + b" ".join(parts) + b" ", np.cumsum([1, *[len(p) + 1 for p in parts[:-1]]])
            rows, parts, size = [], [], 0
    if rows:
        yield np.array(rows), b" " + b" ".join(parts) + b" ", np.cumsum([1, *[len(p) + 1 for p in parts[:-1]]])


def count_terms(documents: DataFrame, terms, params: SearchParams = SearchParams()) -> DataFrame:
    """``(doc_id, n, terms, counts)`` of each row: how many terms, and which of ``terms`` how often.

    ``terms`` is a broadcast list of bytes; ``terms`` and ``counts`` are packed unsigned 32-bit numbers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, wide = ahocorasick.Automaton(), len(terms.value)
        # a byte is a character here: no character of a term in UTF-8 is cut, as a space is never part of one
        for k, term in enumerate(terms.value):
            automaton.add_word(" " + term.decode("latin-1") + " ", k)
        automaton.make_automaton()
        for batch in batches:
            for part in slices(batch, "text", params.piece_bytes):
                data, offsets = text_buffer(part.column("text"))
                length, keys, counts = np.zeros(part.num_rows, np.int64), [], []
                for rows, text, starts in _grouped(_pieces(data.tobytes().translate(_TABLE), offsets, params.piece_bytes), params.piece_bytes):
                    inside = np.frombuffer(text, np.uint8) != 32
                    begun = np.searchsorted(np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.append(starts, len(text)))
                    np.add.at(length, rows, np.diff(begun))
                    hits = np.fromiter(chain.from_iterable(automaton.iter(text.decode("latin-1"))), np.int64)
                    # a match ends at the space after the term
                    where = np.searchsorted(starts, hits[::2] - 1, side="right") - 1
                    first = int(rows[0])
                    key = (rows[where] - first) * wide + hits[1::2]
                    if (rows[-1] - first + 1) * wide <= _BINS:
                        counted = np.bincount(key, minlength=1)
                        key = np.flatnonzero(counted)
                        counted = counted[key]
                    else:
                        key, counted = np.unique(key, return_counts=True)
                    keys.append(key + first * wide)
                    counts.append(counted)
                key, counted = (np.concatenate([*v, np.zeros(0, np.int64)]) for v in (keys, counts))
                if len(keys) > 1:  # the pieces of one document
                    key, at = np.unique(key, return_inverse=True)
                    counted = np.bincount(at, counted, len(key))
                ends = 4 * np.searchsorted(key, wide * np.arange(part.num_rows + 1))
                packed = [
                    pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(v.astype("<u4"))])
                    for v in (key % wide, counted)
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(length), *packed], [c.split()[0] for c in COUNTS.split(", ")])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, COUNTS)


def document_frequencies(counted: DataFrame, wide: int) -> np.ndarray:
    """In how many rows of :func:`count_terms` each of the ``wide`` terms of a block is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide, np.int64)
        for batch in batches:
            total += np.bincount(blobs(batch.column("terms"), "<u4")[0], minlength=wide)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["term", "df"])

    out = np.zeros(wide, np.int64)
    # one row for each term of a block
    for row in counted.select("terms").mapInArrow(work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


class _Best:
    """The highest scores of each item so far; equal scores by doc_id, a null one last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.held = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, doc_id is null, doc_id

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        new = [item, scores[row, item], null[row], ids[row]]
        item, score, null, ids = (np.concatenate(p) for p in zip(self.held, new, strict=True))
        order = np.lexsort((ids, null, -score, item))
        rank = np.arange(len(item)) - np.searchsorted(item[order], item[order])
        last = order[rank == self.k - 1]
        self.least[item[last]] = score[last]
        order = order[rank < self.k]
        self.held = [v[order] for v in (item, score, null, ids)]


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _contributions(tf: np.ndarray, weight: np.ndarray, long: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score; ``long`` is the document's length term m."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * long))


def best_of_block(counted: DataFrame, block, weight: np.ndarray, documents: int, tokens: int, params: SearchParams) -> DataFrame:
    """``(item_id, doc_id, score)``: of each task the highest scores of each item of a broadcast block."""
    low = 1 << 24  # sums of both halves are exact as doubles

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        items, holders = len(own.ids), np.diff(own.first)
        best = _Best(items, params.k)
        for batch in batches:
            ids = batch.column("doc_id")
            null = np.asarray(ids.is_null()).astype(np.int64)
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            # whole numbers of any size: the product outgrows 64 bits in a large corpus of long documents
            long = np.array([25 + 75 * n * documents // max(tokens, 1) for n in batch.column("n").to_pylist()], np.int64)
            (term, bounds), (tf, _) = blobs(batch.column("terms"), "<u4"), blobs(batch.column("counts"), "<u4")
            per = max(1, params.cells // items)
            pairs = np.concatenate([[0], np.cumsum(holders[term])])[bounds]
            begin = 0
            while begin < len(ids):
                end = int(np.searchsorted(pairs, pairs[begin] + params.cells, side="right")) - 1
                end = min(max(end, begin + 1), begin + per, len(ids))
                entry = slice(bounds[begin], bounds[end])
                t, row = term[entry].astype(np.int64), np.repeat(np.arange(end - begin), np.diff(bounds[begin : end + 1]))
                value = _contributions(tf[entry].astype(np.int64), weight[t], long[begin + row])
                to = ragged(own.first[t], holders[t])
                value = np.repeat(value, holders[t]) * own.repeats[to]
                cell = np.repeat(row * items, holders[t]) + own.items[to]
                size = (end - begin) * items
                scores = np.bincount(cell, value // low, size).astype(np.int64) * low + np.bincount(cell, value % low, size).astype(np.int64)
                best.add(scores.reshape(-1, items), null[begin:end], ids[begin:end])
                begin = end
        item, score, null, found = best.held
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.ids[item]), pa.array(found, pa.int64(), mask=null > 0), pa.array(score)], [c.split()[0] for c in FOUND.split(", ")]
        )

    return counted.mapInArrow(work, FOUND)


def search(documents: DataFrame, items: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best rows of ``documents(doc_id, text)`` for each item.

    ``items(item_id, text)``. Terms are the runs of 0-9, A-Z, a-z and non-ASCII characters, A-Z in lower
    case. A null or empty text has none. Every row of ``documents`` is a document: rows that repeat a
    doc_id are ranked each for itself, and a null doc_id comes last among equal scores. Rows of one
    item_id are one item, with the terms of all of them; a null item_id is no item. Scores are above 0,
    so an item without terms, or an empty table, gives no rows. Other columns are not read.
    """
    spark: SparkSession = documents.sparkSession
    results = []
    for block in blocks(items, params):
        if not block.terms:
            continue
        counted = written(count_terms(documents, spark.sparkContext.broadcast(block.terms), params), "lexical-counts")
        sums = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
        weight = term_weights(document_frequencies(counted, len(block.terms)), sums["documents"])
        results.append(best_of_block(counted, spark.sparkContext.broadcast(block), weight, sums["documents"], sums["tokens"], params))
    found = reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k)
    return ranked.select("item_id", "rank", "doc_id", "score")
