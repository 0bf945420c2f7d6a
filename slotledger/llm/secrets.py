"""Secrets in texts: fixed patterns, and tokens that have the format of known credentials.

The patterns (``assign``, ``access``, ``hex``) give the base spans. Their values are the labelled
credentials: for each kind an automaton is learned from distinct values, and one more from other
tokens. Of very many values a sample is learned from, taken in turn from every format, a format being
a length and the classes of characters that occur; each sampled value stands for its share of the
format, and all values count for how frequent a kind is. Then every token of at least ``shortest``
credential characters, the least length of a labelled value, and what base spans leave of a longer
token, is scored by every automaton. It is a further span, of the kind ``format``, if by its likelihood
and by how many values there are of each kind it is a credential rather than another token, by odds of
``margin`` for the whole token: so what ordinary words may be by chance is not taken for a secret.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.arrays import slices, text_buffer
from slotledger.llm.automata import CLASSES, Automaton, learn
from slotledger.llm.shared import written

# fixed patterns and lengths of the base spans
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ["assign", "access", "hex", "format"]

_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_CREDENTIAL = np.zeros(256, bool)
_CREDENTIAL[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", np.uint8)] = True


@dataclass(frozen=True)
class SecretParams:
    """``sample``: distinct values of a kind that are learned from. ``margin``: log odds of a token, in nats."""

    sample: int = 1_500
    shortest: int = LEAST_ASSIGN
    margin: float = 7.0


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes in ``table``, within texts, of at least ``least``."""
    inside = np.concatenate(([False], table[data], [False]))
    step = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = step[::2], step[1::2]
    cuts = offsets[1:-1]
    inner = np.searchsorted(cuts, begin, side="right") != np.searchsorted(cuts, end, side="left")
    if inner.any():  # a run that goes over the end of a text
        extra = np.unique(np.concatenate([cuts[(cuts > b) & (cuts < e)] for b, e in zip(begin[inner], end[inner], strict=True)]))
        begin, end = np.sort(np.concatenate((begin, extra))), np.sort(np.concatenate((end, extra)))
    keep = end - begin >= least
    return begin[keep], end[keep]


class Scanned:
    """The base spans of a slice of texts, as byte positions in ``data``."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_buffer(column)
        rows: list[tuple[int, int, int, int, int, int]] = []
        begin, end = runs(self.data, self.offsets, _HEX, LEAST_HEX)
        row = np.searchsorted(self.offsets, begin, side="right") - 1
        rows += [(r, b, 2, e, b, e) for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True)]
        sign = np.flatnonzero((self.data == 0x3A) | (self.data == 0x3D))
        candidates = set((np.searchsorted(self.offsets, sign, side="right") - 1).tolist())
        whole = self.data.tobytes()
        at = whole.find(b"AKIA")
        while at >= 0:
            candidates.add(int(np.searchsorted(self.offsets, at, side="right") - 1))
            at = whole.find(b"AKIA", at + 4)
        for r in sorted(candidates):
            first, last = int(self.offsets[r]), int(self.offsets[r + 1])
            # one character for each byte: the patterns hold ASCII only, so positions stay bytes
            text = whole[first:last].decode("latin-1")
            for m in ASSIGN.finditer(text):
                if len(m[2]) >= LEAST_ASSIGN:
                    rows.append((r, first + m.start(), 0, first + m.end(), first + m.start(2), first + m.end(2)))
            for m in ACCESS.finditer(text):
                if len(m[0]) >= LEAST_ACCESS:
                    rows.append((r, first + m.start(), 1, first + m.end(), first + m.start(), first + m.end()))
        rows.sort()
        self.spans = np.array(rows, np.int64).reshape(-1, 6)

    def others(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of credential characters outside of base spans, at least ``least`` long."""
        data = self.data
        if len(self.spans):
            covered = np.zeros(len(data) + 1, np.int64)
            np.add.at(covered, self.spans[:, 1], 1)
            np.add.at(covered, self.spans[:, 3], -1)
            data = np.where(np.cumsum(covered[:-1]) > 0, np.uint8(0x20), data)
        return runs(data, self.offsets, _CREDENTIAL, least)


def _format(value: bytes) -> int:
    """The length of a value, up to 255, and the classes of characters that are in it, as one number."""
    classes = int(np.bitwise_or.reduce(1 << CLASSES[np.frombuffer(value, np.uint8)]))
    return min(len(value), 255) << 12 | classes


def credentials(documents: DataFrame, params: SecretParams = SecretParams()) -> dict[str, list[tuple[str, float]]]:
    """Distinct values of each kind and of ``other`` tokens, at most ``sample`` of each, and what each stands for.

    Values are taken from all formats in turn, in each by smallest hash, so that a rare format is among
    them however many values there are. Of ``other`` tokens there are as many with a digit, and without.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scanned = Scanned(part.column("text"))
                spans = scanned.spans
                begin, end = scanned.others(params.shortest)
                whole = scanned.data.tobytes()
                values = {(k, whole[b:e]) for k, b, e in spans[:, [2, 4, 5]].tolist()}
                # words would leave hardly any other format in one sample: those without a digit have their own
                found = {whole[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)}
                values |= {(4 if v.translate(None, b"0123456789") == v else 3, v) for v in found}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in values], pa.int32()), pa.array([v.decode() for _, v in values], pa.string()),
                        pa.array([_format(v) for _, v in values], pa.int32()),
                    ],
                    ["kind", "value", "format"],
                )

    texts = documents.select(F.col("text").cast("string").alias("text"))
    found = written(texts.mapInArrow(work, "kind int, value string, format int").distinct(), "secret-values")
    # the limit on the rank holds in each task before the shuffle, so no format is gathered
    by_hash = Window.partitionBy("kind", "format").orderBy(F.xxhash64("value"), "value")
    ranked = found.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= params.sample)
    ranked = written(ranked, "secret-samples")
    # one row for each format of a kind: lengths up to 255, and sets of 11 classes
    sizes = {(r.kind, r.format): r["count"] for r in found.groupBy("kind", "format").count().collect()}
    out: dict[str, list[tuple[str, float]]] = {}
    for k, kind in enumerate([*KINDS[:3], "other", "other"]):
        rows = ranked.where(F.col("kind") == k).orderBy("rank", F.xxhash64("value"), "value").limit(params.sample).collect()
        taken = Counter(r.format for r in rows)
        # formats beyond the sample are spread over those in it
        lost = sum(n for (of, _), n in sizes.items() if of == k) / max(1, sum(sizes[k, f] for f in taken))
        out.setdefault(kind, []).extend((r.value, lost * sizes[k, r.format] / taken[r.format]) for r in rows)
    return out


def train(documents: DataFrame, params: SecretParams = SecretParams()) -> dict[str, Automaton]:
    """An automaton for each kind that has values, and one for other tokens."""
    values = credentials(documents, params)

    def learned(kind: str, found: list[tuple[str, float]]) -> Automaton:
        examples = [CLASSES[np.frombuffer(v.encode("latin-1"), np.uint8)].tolist() for v, _ in found]
        # what a sample of all other tokens does not show may well be one of them
        return learn(examples, weights=[w for _, w in found], unseen=1.0 if kind == "other" else 0.1)

    return {k: learned(k, v) for k, v in values.items() if v or k == "other"}


def _added(scanned: Scanned, automata: dict[str, Automaton], params: SecretParams) -> list[tuple[int, int, int, int]]:
    """Further spans of the kind ``format``, as ``(row, start, kind, end)`` in bytes."""
    known = [a for k, a in automata.items() if k != "other"]
    begin, end = scanned.others(params.shortest)
    if not known or not len(begin):
        return []
    symbols, sizes = CLASSES[scanned.data], end - begin
    other = automata["other"]
    best = np.min([a.costs(symbols, begin, sizes) - a.prior for a in known], axis=0)
    found = other.costs(symbols, begin, sizes) - other.prior - best > params.margin
    row = np.searchsorted(scanned.offsets, begin[found], side="right") - 1
    return [(r, b, 3, e) for r, b, e in zip(row.tolist(), begin[found].tolist(), end[found].tolist(), strict=True)]


def redact(documents: DataFrame, automata: dict[str, Automaton], mark: str, params: SecretParams = SecretParams()) -> DataFrame:
    """``documents`` with the value of every span in ``text`` replaced by ``mark``, and ``n_chars`` to match.

    Of an ``assign`` span the value alone is replaced; spans that overlap are replaced once. Texts
    without spans, and null texts, stay as they are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scanned = Scanned(part.column("text"))
                rows = [(int(r), int(b), int(e)) for r, b, e in scanned.spans[:, [0, 4, 5]]]
                rows += [(r, b, e) for r, b, _, e in _added(scanned, automata, params)]
                texts, sizes = part.column("text").to_pylist(), part.column("n_chars").to_pylist()
                whole, done = scanned.data.tobytes(), {}
                for r, begin, end in sorted(rows):
                    pieces, at = done.setdefault(r, ([], int(scanned.offsets[r])))
                    if begin >= at:
                        pieces += [whole[at:begin], mark.encode()]
                    done[r] = pieces, max(at, end)
                for r, (pieces, at) in done.items():
                    texts[r] = (b"".join(pieces) + whole[at : int(scanned.offsets[r + 1])]).decode()
                    sizes[r] = len(texts[r])
                columns = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
                yield pa.RecordBatch.from_arrays(
                    [columns.get(n, part.column(k)) for k, n in enumerate(part.schema.names)], part.schema.names
                )

    typed = documents.withColumns({"text": F.col("text").cast("string"), "n_chars": F.col("n_chars").cast("long")})
    return typed.mapInArrow(work, typed.schema)


def scan(documents: DataFrame, automata: dict[str, Automaton], params: SecretParams = SecretParams()) -> DataFrame:
    """``(doc_id, spans)`` for each row of ``documents(doc_id, text)``; spans are ``(kind, start, end)``.

    Positions count code points, the end is exclusive, spans are in the order of start and kind. A
    null or empty text has none. Rows that repeat or lack a doc_id are scanned each for itself;
    other columns are not read. Without any automaton for credentials there are base spans only.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scanned = Scanned(part.column("text"))
                rows = sorted([tuple(x) for x in scanned.spans[:, :4].tolist()] + _added(scanned, automata, params))
                # code points are the bytes that do not continue one
                points = np.concatenate(([0], np.cumsum(scanned.data & 0xC0 != 0x80)))
                lists: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for r, begin, kind, end in rows:
                    base = points[scanned.offsets[r]]
                    lists[r].append({"kind": KINDS[kind], "start": int(points[begin] - base), "end": int(points[end] - base)})
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lists, kind)], ["doc_id", "spans"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")
