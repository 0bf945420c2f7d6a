"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut into units that no merge can cross: each run of ``▁`` with what follows it, and each
character that is in no longer piece. Units repeat, so a worker keeps the ids of the units it has
seen (a bounded cache) and merges only new ones, all of them at once: their symbols lie in one flat
array, each round finds the best pair of every unit by a segmented minimum, merges the leftmost
such pair of every unit at the same time, and compacts, until no unit has a pair. Units of more
than ``LONG_UNIT`` symbols, where a round for each merge would be quadratic, take a heap instead.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.llm.arrays import ragged, slices

LONG_UNIT = 512
MOST_UNITS = 300_000
SPACE = "▁"
_NONE = np.int64(1 << 40)


class PairTable:
    """Pairs of symbol ids with the id and the rank of what they merge to, in open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.array([(a << 32) | b for a, b in pairs] or [-1], np.int64)
        values = np.array(list(pairs.values()) or [(0, 0)], np.int64)
        self.merged, self.rank = values[:, 0], values[:, 1]
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at, rest = self._hash(self.keys), np.arange(len(self.keys))
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            left = self.slots[at] != rest
            rest, at = rest[left], (at[left] + 1) & (len(self.slots) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return mixed.astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entry of each pair, or -1."""
        keys = (left << 32) | right
        at, found = self._hash(keys), np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == keys[rest])
            found[rest[hit]] = slot[hit]
            on = (slot >= 0) & ~hit
            rest, at = rest[on], (at[on] + 1) & (len(self.slots) - 1)
        return found


class PieceModel:
    """A SentencePiece BPE model with identity normalisation, and a cache of encoded units."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kind = proto.ModelProto.SentencePiece
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError(f"{path}: only BPE models with identity normalisation are supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.size = len(model.pieces)
        ids, self.bytes_at, texts, special = {}, np.full(256, -1, np.int64), [], np.zeros(self.size, np.int8)
        scores = {}
        for k, piece in enumerate(model.pieces):
            if piece.type == kind.NORMAL:
                ids[piece.piece] = k
                scores[k] = piece.score
                texts.append(piece.piece.replace(SPACE, " ").encode())
            elif piece.type == kind.BYTE:
                self.bytes_at[int(piece.piece[3:5], 16)] = k
                texts.append(bytes([int(piece.piece[3:5], 16)]))
                special[k] = 3
            elif piece.type in (kind.CONTROL, kind.UNKNOWN):
                special[k] = 1 if piece.type == kind.CONTROL else 2
                texts.append(b"" if special[k] == 1 else " ⁇ ".encode())
            else:
                raise ValueError(f"{path}: piece {piece.piece!r} has a type that is not supported")
            if piece.type == kind.UNKNOWN:
                self.unknown = k
        self.special = special
        self.spaced = np.array([p.piece.startswith(SPACE) and p.type == kind.NORMAL for p in model.pieces])
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(texts), np.uint8)

        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.char = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        together: set[str] = set()
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for text, k in ids.items():
            if len(text) == 1:
                self.char[ord(text)] = k
        crossing = False
        for text, k in ids.items():
            if len(text) > 1:
                together.update(text)
                crossing |= re.search(f"[^{SPACE}]{SPACE}", text) is not None
            for cut in range(1, len(text)):
                left, right = self._symbol(ids, text[:cut]), self._symbol(ids, text[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = k, rank[scores[k]]
        self.pairs = PairTable(pairs)
        self.heap_pairs = pairs
        alone = re.escape("".join(c for c in map(chr, range(1, 128)) if c not in together))
        self.unit = re.compile(
            "(?s).+" if crossing else f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|[{alone}]"
        )
        self._forget()

    def _symbol(self, ids: dict[str, int], text: str) -> int | None:
        if len(text) == 1:
            return int(self.char[ord(text)])
        return ids.get(text)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.unit_starts = np.zeros(0, np.int64)
        self.unit_sizes = np.zeros(0, np.int64)
        self.unit_ids = np.zeros(0, np.int32)

    # -- merging ------------------------------------------------------------------------------

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all units one after the other, and how many each has."""
        lengths = np.array([len(u) for u in units], np.int64)
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, owner = self.char[code], np.repeat(np.arange(len(units)), lengths)
        done_symbols, done_owner = [], []
        long = lengths > LONG_UNIT
        for k in np.flatnonzero(long):
            own = self._by_heap(symbols[owner == k])
            done_symbols.append(own)
            done_owner.append(np.full(len(own), k))
        if long.any():
            keep = ~long[owner]
            symbols, owner = symbols[keep], owner[keep]
        entry = self._entries(symbols, owner)
        while len(symbols):
            rank = np.where(entry >= 0, self.pairs.rank[entry], _NONE)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            counts = np.diff(np.append(first, len(owner)))
            best = np.minimum.reduceat(rank, first)
            open_ = best < _NONE
            if not open_.all():
                keep = np.repeat(open_, counts)
                done_symbols.append(symbols[~keep])
                done_owner.append(owner[~keep])
                symbols, owner, entry, rank = symbols[keep], owner[keep], entry[keep], rank[keep]
                counts, best = counts[open_], best[open_]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, counts))
            at = hits[np.concatenate(([True], owner[hits[1:]] != owner[hits[:-1]]))]
            symbols[at] = self.pairs.merged[entry[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, entry = symbols[keep], owner[keep], entry[keep]
            at = at - np.arange(len(at))
            for spot in (at[at > 0] - 1, at):
                entry[spot] = self._entries_at(symbols, owner, spot)
        symbols = np.concatenate(done_symbols) if done_symbols else symbols
        owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(units))

    def _entries(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self._entries_at(symbols, owner, np.arange(len(symbols)))

    def _entries_at(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), -1, np.int64)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        out[inner] = self.pairs.find(symbols[at[inner]], symbols[at[inner] + 1])
        return out

    def _by_heap(self, symbols: np.ndarray) -> np.ndarray:
        found = symbols.tolist()
        after = [*range(1, len(found)), -1]
        before = [*range(-1, len(found) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (hit := self.heap_pairs.get((found[i], found[j]))):
                heapq.heappush(heap, (hit[1], i, found[i], found[j]))

        for i in range(len(found)):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or found[i] != left or found[j] != right:
                continue
            found[i], found[j] = self.heap_pairs[left, right][0], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([x for x in found if x >= 0], np.int64)

    def _learn(self, units: list[str]) -> None:
        symbols, counts = self.merge(units)
        owner = np.repeat(np.arange(len(units)), counts)
        other = symbols >= self.size
        if other.any():
            codes = symbols[other] - self.size
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes]
            if (self.bytes_at < 0).any():
                raw_ids = [[self.unknown] for _ in raw]
            else:
                raw_ids = [self.bytes_at[list(x)].tolist() for x in raw]
            sizes = np.ones(len(symbols), np.int64)
            sizes[other] = [len(x) for x in raw_ids]
            spread = np.repeat(symbols, sizes)
            spread[np.repeat(other, sizes)] = list(chain.from_iterable(raw_ids))
            symbols, owner = spread, np.repeat(owner, sizes)
            counts = np.bincount(owner, minlength=len(units))
        base = len(self.unit_ids)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.unit_starts = np.concatenate((self.unit_starts, base + np.cumsum(counts) - counts))
        self.unit_sizes = np.concatenate((self.unit_sizes, counts))
        self.unit_ids = np.concatenate((self.unit_ids, symbols.astype(np.int32)))

    # -- texts --------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and n + 1 offsets."""
        prefix = SPACE if self.dummy_prefix else ""
        units = [self.unit.findall(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > MOST_UNITS:
            self._forget()
        fresh = set(chain.from_iterable(units)) - self.known.keys()
        if fresh:
            self._learn(sorted(fresh))
        counts = np.array([len(u) for u in units], np.int64)
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
        sizes = self.unit_sizes[index]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        offsets = ends[np.concatenate(([0], np.cumsum(counts)))]
        return self.unit_ids[ragged(self.unit_starts[index], sizes)], offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each row of ids. Control ids have no text; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.flat[ragged(self.starts[ids], sizes)]
        begin, end = ends[offsets[:-1]], ends[offsets[1:]]
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        if self.dummy_prefix:
            heads = filled[self.spaced[ids[offsets[:-1][filled]]]]
            begin[heads] += 1
        kinds = self.special[ids]
        odd = np.zeros(len(begin), bool)
        if kinds.any():
            rows = np.repeat(np.arange(len(begin)), np.diff(offsets))
            odd[rows[(kinds == 1) | (kinds == 2)]] = True
            for row in np.unique(rows[kinds == 3]):
                try:
                    flat[begin[row] : end[row]].tobytes().decode()
                except UnicodeDecodeError:
                    odd[row] = True
        if not odd.any():
            lengths = end - begin
            at = np.concatenate(([0], np.cumsum(lengths)))
            whole = flat[ragged(begin, lengths)]
            return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(at.tobytes()), pa.py_buffer(whole.tobytes()))
        texts = [
            self._slow_text(ids[offsets[k] : offsets[k + 1]]) if odd[k] else flat[begin[k] : end[k]].tobytes().decode()
            for k in range(len(begin))
        ]
        return pa.array(texts, pa.large_string())

    def _slow_text(self, ids: np.ndarray) -> str:
        out, raw, begun = [], bytearray(), False

        def flush() -> None:
            while raw:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[:size]).decode())
                        break
                    except UnicodeDecodeError:
                        size = 0
                if not size:
                    out.append("�")
                del raw[: size or 1]

        for k in ids.tolist():
            if self.special[k] == 3:
                raw += self.flat[self.starts[k] : self.starts[k] + 1].tobytes()
                begun = True
                continue
            flush()
            text = self.flat[self.starts[k] : self.starts[k] + self.sizes[k]].tobytes().decode()
            if not begun and self.dummy_prefix and self.spaced[k]:
                text = text[1:]
            begun |= self.special[k] != 1
            out.append(text)
        flush()
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The model at ``path``, read once by each worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids)`` for each row of ``documents(doc_id, text)``, without begin or end ids.

    A null or empty text has no ids. Rows that repeat and null doc_ids stay as they are; other
    columns are not read. ``model_path`` must be readable on every worker.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = model.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, text)`` for each row of ``encoded(doc_id, ids)``; null or empty ids give an empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            most = max(1, int(300_000 * batch.num_rows / max(1, len(pc.list_flatten(batch.column("ids"))))))
            for begin in range(0, batch.num_rows, most):
                part = batch.slice(begin, most)
                sizes = np.asarray(pc.fill_null(pc.list_value_length(part.column("ids")), 0)).astype(np.int64)
                ids = pc.list_flatten(part.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
                text = model.decode(ids, np.concatenate(([0], np.cumsum(sizes)))).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), text], ["doc_id", "ids", "text"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, text string")
