"""A quality score by a generalised additive model with pairwise interactions.

Fifteen numbers describe a text (``FEATURES``). Each is cut into bins at quantiles of the training
rows. Boosting goes round the features in turn; each step fits one shallow tree to the gradients of
the bins of one feature and adds a small part of it to the feature's lookup table. The pairs whose
tables would lower the loss most are then boosted in the same way, each step a tree with one cut on
either side. A score is the sigmoid of the sum of the table entries of a text's bins.

Only labelled rows are fitted, at most ``QualityParams.sample`` of them (those of the smallest
hashes of doc_id, so the choice does not depend on the layout of the table). Every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.llm.arrays import Words, slices

FEATURES = [
    "log_words", "word_bytes", "upper_share", "symbol_share", "bar_share", "shout_share", "digit_share",
    "stop_share", "other_share", "distinct_words", "top_word", "repeat_words", "marked_words", "distinct_lines",
    "line_words",
]


@dataclass(frozen=True)
class QualityParams:
    sample: int = 20_000
    bins: int = 32
    rounds: int = 150
    pair_rounds: int = 60
    pairs: int = 6
    rate: float = 0.1
    leaves: int = 4
    threshold: float = 0.7


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[np.frombuffer(chars.encode(), np.uint8)] = 1
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SYMBOL = _table("#$%&*@^~<>{}[]\\+=_/`")
_BAR = _table("|")
_SHOUT = _table("!?")
_DIGIT = _table("0123456789")
_STOP = _table(".,;:")
_LETTER = _table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER[128:] = 1


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; an empty text has zeros."""
    words = Words(column, lower=False)
    data, offsets = words.data, words.offsets
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)))
    sizes, counts = np.diff(offsets), np.diff(words.first)

    def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    solid = np.maximum(1, per_row(words.end - words.start, words.first))
    share = lambda table: per_row(table[data], offsets) / solid
    out[:, 0] = np.log1p(counts)
    out[:, 1] = solid / np.maximum(1, counts)
    for k, table in enumerate((_UPPER, _SYMBOL, _BAR, _SHOUT, _DIGIT, _STOP), 2):
        out[:, k] = share(table)
    out[:, 8] = 1 - share(_LETTER) - out[:, 3:8].sum(axis=1)
    h = words.hashes()
    marks = np.concatenate(([0], np.cumsum((_SYMBOL | _SHOUT | _BAR)[data])))
    marked = marks[words.end] - marks[words.start] > 0
    out[:, 12] = per_row(marked, words.first) / np.maximum(1, counts)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    out[:, 11] = per_row(same, words.first) / np.maximum(1, counts)
    newline = np.flatnonzero(data == 10)
    line_of = np.searchsorted(newline, words.start)
    for row in range(rows):
        begin, end = words.first[row], words.first[row + 1]
        if begin == end:
            continue
        own = np.sort(h[begin:end])
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[row, 9] = len(heads) / len(own)
        out[row, 10] = np.diff(np.append(heads, len(own))).max() / len(own)
        lines = line_of[begin:end]
        starts = np.flatnonzero(np.concatenate(([True], lines[1:] != lines[:-1])))
        sums = np.add.reduceat(h[begin:end], starts)
        out[row, 13] = len(np.unique(sums)) / len(sums)
        out[row, 14] = np.log1p(len(own) / len(sums))
    out[sizes == 0] = 0
    return out


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values for the bins of one feature: the best cuts first, until there are ``leaves``."""
    g, w = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), (a, b), int(cuts[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def _square(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best table of four quadrants for a pair of features, and what it gains."""
    def corner(x: np.ndarray) -> np.ndarray:
        return np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))

    g, w = corner(gradient), corner(weight)
    rows, cols = np.arange(1, gradient.shape[0]), np.arange(1, gradient.shape[1])
    if not len(rows) or not len(cols):
        return 0.0, np.zeros_like(gradient)
    quarters = []
    for c in (g, w):
        a = c[1:-1, 1:-1]
        top, left, all_ = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        quarters.append((a, top - a, left - a, all_ - top - left + a))
    gains = sum(x * x / (y + 1.0) for x, y in zip(*quarters, strict=True))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    values = [x[i, j] / (y[i, j] + 1.0) for x, y in zip(*quarters, strict=True)]
    out = np.empty_like(gradient)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = values[0], values[1]
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values[2], values[3]
    return float(gains[i, j] - g[-1, -1] ** 2 / (w[-1, -1] + 1.0)), out


@dataclass
class Gam:
    """Bin edges and lookup tables; without training rows every score is a half."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.edges:
            at = self.binned(x)
            for k, table in enumerate(self.tables):
                total += table[at[:, k]]
            for (i, j), table in self.pairs.items():
                total += table[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, params: QualityParams = QualityParams()) -> Gam:
    """Cyclic boosting of the single tables, then of the most useful pairs."""
    model = Gam()
    if not len(y):
        return model
    grid = np.linspace(0, 1, params.bins + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, k], grid)) for k in range(x.shape[1])]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(mean / (1 - mean)))
    at = model.binned(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    total = np.full(len(y), model.base)

    def state() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(params.rounds):
        for k, n in enumerate(sizes):
            g, w = state()
            step = params.rate * _tree(np.bincount(at[:, k], g, n), np.bincount(at[:, k], w, n), params.leaves)
            model.tables[k] += step
            total += step[at[:, k]]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        cell, shape = at[:, i] * sizes[j] + at[:, j], (sizes[i], sizes[j])
        g, w = state()
        n = sizes[i] * sizes[j]
        return np.bincount(cell, g, n).reshape(shape), np.bincount(cell, w, n).reshape(shape)

    gains = {pair: _square(*grids(*pair))[0] for pair in combinations(range(len(sizes)), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[: params.pairs]
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for i, j in chosen}
    for _ in range(params.pair_rounds):
        for i, j in chosen:
            step = params.rate * _square(*grids(i, j))[1]
            model.pairs[i, j] += step
            total += step[at[:, i], at[:, j]]
    return model


def train(documents: DataFrame, labels: DataFrame, learn: Column, params: QualityParams = QualityParams()) -> Gam:
    """Fit on ``labels(doc_id, quality)`` where ``learn`` holds, a condition on doc_id.

    At most ``sample`` labels are taken, those of the smallest hashes. Null labels or doc_ids, labels
    other than 0 and 1, and labels without a document teach nothing; a doc_id with both labels is an
    example of each. Without any labels every score is that of no evidence. Other columns are not read.
    """
    spark = documents.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(params.sample).collect()
    chosen = spark.createDataFrame([(r.doc_id, r.quality) for r in marked], "doc_id long, quality int")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = features(part.column("text"))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("quality"), lists], ["doc_id", "quality", "x"]
                )

    # at most ``sample`` small rows, so the hint is safe
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = joined.mapInArrow(work, "doc_id long, quality int, x array<double>")
    # rows that repeat a doc_id are one example for each label that it has, so these are ``sample`` rows at most
    rows = rows.groupBy("doc_id", "quality").agg(F.max("x").alias("x")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r.quality) for r in rows]), params)


def keep(documents: DataFrame, model: Gam, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``documents`` (with all columns) whose text is predicted to be good, without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.scores(features(part.column("text"))) >= params.threshold))

    return documents.mapInArrow(work, documents.schema)


def score(documents: DataFrame, model: Gam, params: QualityParams = QualityParams()) -> DataFrame:
    """``(doc_id, score, predicted)`` for each row of ``documents(doc_id, text)``.

    Null and empty texts are scored like any other, by features that are all zero. Rows that repeat
    or lack a doc_id are scored each for itself; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = model.scores(features(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found), pa.array((found >= params.threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, score double, predicted int")
