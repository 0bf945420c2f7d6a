"""Words, hashes and slices of Arrow text columns as flat numpy arrays.

Words are the runs of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased, other bytes of
UTF-8 stay. A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose low and high bits depend on all input bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_STEP = 0x2545F4914F6CDD1D


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return flat[:0], np.zeros(1, np.int64)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, cut where the texts reach ``most`` bytes."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """The words of a slice of texts: ``start``, ``end`` in ``data``, and ``doc``, the row of each."""

    def __init__(self, column: pa.Array, lower: bool = True):
        data, offsets = text_buffer(column)
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(self.data)
        inside = np.empty(n + 1, dtype=bool)
        np.logical_not(_SPACE[self.data], out=inside[:n])
        inside[n] = False
        begins = inside[:n].copy()
        begins[1:] &= ~inside[: max(n - 1, 0)]
        cut = offsets[1:-1][offsets[1:-1] < n]
        begins[cut] = inside[cut]
        self.start = np.flatnonzero(begins)
        stops = inside[:n] & ~inside[1:]
        before = cut[cut > 0] - 1
        stops[before] = inside[before]
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, _U)
        lengths = self.end - self.start
        powers = np.ones(int(lengths.max()), dtype=_U)
        if len(powers) > 1:
            powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, _STEP, dtype=_U))
        out = np.empty(len(self.start), dtype=_U)
        for begin in range(0, len(lengths), 200_000):
            part = slice(begin, begin + 200_000)
            size = lengths[part]
            heads = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(heads, size)
            at = within + np.repeat(self.start[part], size)
            out[part] = np.add.reduceat(_BYTE[self.data[at]] * powers[within], heads)
        return mix(out + lengths.astype(_U))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + sizes[i] - 1 of all i, one after the other."""
    heads = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(heads - starts, sizes)


def by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The runs of equal ``column`` in a sorted stream of batches, one table for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        if held and held[-1].column(column)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begin:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def longs(values: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of unsigned 64-bit words."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).view(_U).reshape(-1, width)


def blobs(values: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as one flat array of ``dtype`` and n + 1 offsets into it."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    if not len(offsets):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    raw = values.buffers()[2]
    flat = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(flat.tobytes(), dtype=dtype), (offsets - offsets[0]) // size
