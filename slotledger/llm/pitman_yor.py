"""A hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

The context of a word is the word before it, whole; the first word of a text follows an end. There is a
restaurant for each word before. All have the root as their parent, whose base is uniform over the known
words and one unknown. Neither dishes, each word in each context, nor restaurants are bounded, and
both are distributed.

Pairs of a word and the word before are dealt into buckets by a grid: ranges of the word's hash times
ranges of the hash of the word before. Thus neither a frequent word nor a frequent context is in one
bucket. A dish's seats depend on other dishes only through its restaurant's numbers of customers and
tables, and through the word's numbers at the root. One sweep resamples the tables of every dish given
the numbers after the sweep before, from the exact conditional distribution (generalised Stirling
numbers) for up to ``EXACT`` customers; customers beyond are seated a sixteenth of those seated at a
time. Then each bucket sends its sums of each context and word to the shard of that hash. Shards add
them up, seat the root, and answer each bucket. Words that were learned once have one customer at one
table whatever is drawn, so they are exchanged only once. Only the root's two sums pass through the driver.

A bucket's state is not stored: it is computed again from its counts, the seed and the answers so far.
Probabilities are averaged over the sweeps after burn-in. Pairs that are to be scored but were not
learned are in the buckets with a count of 0, so that a bucket knows the numbers of all that it scores.

Scoring sends each word occurrence to its pair's bucket, packed by batches of documents, and brings
back sums for each document. Buckets with many occurrences are split by batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.llm.arrays import Words, by_group, ragged, slices
from slotledger.llm.shared import written

EXACT = 32
#: Customers beyond ``EXACT`` are seated this share of those seated at a time.
SHARE = 16
#: Rows of a batch, which are numbered in 16 bits.
ROWS = 1 << 16
_U = np.uint64
_END = _U(0x9D39247E33776D41)


@dataclass(frozen=True)
class PitmanYorParams:
    """``strength``: of the restaurants of a word before, and of the root. ``bucket_tokens``: in a bucket, on average."""

    sweeps: int = 4
    burn_in: int = 2
    strength: tuple[float, float] = (1.0, 1.0)
    bucket_tokens: int = 3_000_000
    batch_tokens: int = 3_000_000
    seed: int = 7


# -- tokens -------------------------------------------------------------------------------------


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, context, row)`` of every token of a slice of texts, each text's end included.

    The context is the hash of the word before, for the first token of a text that of an end.
    """
    words = Words(column)
    rows = len(words.offsets) - 1
    word = np.full(len(words.start) + rows, _END, _U)
    word[np.arange(len(words.start)) + words.doc] = words.hashes()
    # the last token is an end
    return word, np.roll(word, 1), np.repeat(np.arange(rows), np.diff(words.first) + 1)


def _batches(stream: Iterator[pa.RecordBatch], most: int):
    """Tokens of consecutive slices, joined up to about ``most``: ``(ids, learned, word, context, row)``."""
    held: list[tuple] = []
    count = rows = 0
    for batch in stream:
        for part in (p.slice(k, ROWS - 1) for p in slices(batch, "text") for k in range(0, p.num_rows, ROWS - 1)):
            word, context, row = tokens(part.column("text"))
            if held and (count + len(word) > most or rows + part.num_rows >= ROWS):
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, count, rows = [], 0, 0
            ids = np.asarray(part.column("at").to_numpy(zero_copy_only=False))
            learned = part.column("learned").to_numpy(zero_copy_only=False).astype(bool)
            held.append((ids, learned, word, context, row + rows))
            count, rows = count + len(word), rows + part.num_rows
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _grid(buckets: int) -> tuple[int, int]:
    """Ranges of words and of contexts: ``buckets`` of their products, or some more."""
    contexts = max(1, math.isqrt(buckets))
    return -(-buckets // contexts), contexts


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The number of the range that a hash is in, of ``ranges`` equal ones."""
    return ((hashes >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _by_bucket(word: np.ndarray, context: np.ndarray, grid: tuple[int, int], *more: np.ndarray):
    """``(bucket, columns)`` of each bucket that has any; the order in a bucket stays."""
    number = _range(word, grid[0]) * grid[1] + _range(context, grid[1])
    order = np.argsort(number, kind="stable")
    number, columns = number[order], [x[order] for x in (word, context, *more)]
    head = _heads(number)
    for begin, end in zip(head, np.append(head[1:], len(number)), strict=True):
        yield int(number[begin]), [x[begin:end] for x in columns]


def _heads(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate(([True], new))) if len(columns[0]) else np.zeros(0, np.int64)


def _counts(grid: tuple[int, int], params: PitmanYorParams):
    """How often each batch has each (word, context) in learned rows, one row for each bucket."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, learned, word, context, row in _batches(stream, params.batch_tokens):
            word, context, count = _added([(word, context, learned[row].astype(np.int64))])
            for bucket, part in _by_bucket(word, context, grid, count):
                yield _count_row(bucket, part)

    return work


COUNTS = "bucket long, words binary, entries binary, contexts binary, places binary, counts binary, tokens long"
#: Up to so many buckets to be split are broadcast; beyond, they are joined.
MOST_BROADCAST = 100_000


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs, after that number of bytes."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    out = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return out.view("<i8").ravel()


def _pack_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes: the first, and the steps between them."""
    return hashes[:1].tobytes() + _pack(np.diff(hashes))


def _unpack_hashes(packed: bytes) -> np.ndarray:
    if len(packed) < 8:
        return np.zeros(0, _U)
    steps = _unpack(memoryview(packed)[8:]).view(_U)
    return np.cumsum(np.concatenate((np.frombuffer(packed, _U, 1), steps)), dtype=_U)


def _packed(word: np.ndarray, context: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Sorted words once, how many entries each has, contexts once, and which of them each entry has."""
    head = _heads(word)
    contexts, place = np.unique(context, return_inverse=True)
    return _pack_hashes(word[head]), _pack(np.diff(np.append(head, len(word)))), _pack_hashes(contexts), _pack(place)


def _count_row(bucket: int, total: list) -> pa.RecordBatch:
    word, context, count = total
    columns = (*_packed(word, context), _pack(count))
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket]), *[pa.array([x], pa.binary()) for x in columns], pa.array([int(count.sum())])],
        [c.split()[0] for c in COUNTS.split(", ")],
    )


def _merged(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: the counts of its batches added up as they come, a few at a time."""
    bucket, parts = None, []
    for batch in stream:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            if parts and row["bucket"] != bucket:
                yield _count_row(bucket, _added(parts))
                parts = []
            bucket = row["bucket"]
            parts.append(_opened(row))
            if len(parts) == 16:
                parts = [_added(parts)]
    if parts:
        yield _count_row(bucket, _added(parts))


def _added(parts: list) -> list[np.ndarray]:
    word, context, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((context, word))
    word, context, count = word[order], context[order], count[order]
    head = _heads(word, context)
    return [word[head], context[head], np.add.reduceat(count, head) if len(head) else count]


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, contexts = _unpack_hashes(row["words"]), _unpack_hashes(row["contexts"])
    return np.repeat(words, _unpack(row["entries"])), contexts[_unpack(row["places"])], _unpack(row["counts"])


# -- seating ------------------------------------------------------------------------------------


def log_stirling(discount: float, most: int) -> np.ndarray:
    """log S(c, t): the weight of all ways to seat c customers at t tables."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, table[c, t] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        table[c + 1, t] = np.logaddexp(table[c, t - 1], stay)
    return table


def draw_tables(count: np.ndarray, chance: np.ndarray, stirling: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of dishes with ``count`` customers; ``chance`` is the weight of a new table."""
    tables = np.minimum(count, 1)
    small = np.minimum(count, EXACT)
    order = np.argsort(small, kind="stable")
    ends = np.searchsorted(small[order], np.arange(EXACT + 2))
    with np.errstate(divide="ignore"):
        weight = np.log(chance)
    for c in range(2, EXACT + 1):
        who = order[ends[c] : ends[c + 1]]
        if not len(who):
            continue
        t = np.arange(1, c + 1)
        p = stirling[c, 1 : c + 1][None, :] + weight[who][:, None] * t
        p = np.exp(p - p.max(axis=1, keepdims=True)).cumsum(axis=1)
        tables[who] = 1 + (rng.random(len(who))[:, None] * p[:, -1:] > p[:, :-1]).sum(axis=1)
    who = np.flatnonzero(count > EXACT)
    seated = np.full(len(who), EXACT)
    while len(who):
        batch = np.minimum(seated // SHARE, count[who] - seated)
        new = chance[who] / (chance[who] + seated - discount * tables[who])
        tables[who] += rng.binomial(batch, new)
        seated = seated + batch
        on = seated < count[who]
        who, seated = who[on], seated[on]
    return tables


@dataclass
class Totals:
    """Tables and customers of the root after one sweep."""

    root: int
    root_customers: int


@dataclass
class Corpus:
    """What is known of all learned tokens: their number, distinct words, those learned once, and discounts."""

    tokens: int
    words: int
    once: int
    discounts: tuple[float, float]

    @property
    def base(self) -> float:
        return 1.0 / (self.words + 1)


class Bucket:
    """The dishes of one bucket in their contexts, with their seats and the answers of the shards so far.

    ``seen``, ``customers`` and ``root_tables`` are of the words at the root, ``size`` and
    ``context_tables`` of the contexts' restaurants; all are of the whole corpus.
    """

    def __init__(self, row: dict):
        self.number = row["bucket"]
        self.words, self.contexts = _unpack_hashes(row["words"]), _unpack_hashes(row["contexts"])
        entries = _unpack(row["entries"])
        self.word, self.context = np.repeat(np.arange(len(entries)), entries), _unpack(row["places"])
        self.count = _unpack(row["counts"])
        self.keys = self.word * len(self.contexts) + self.context
        self.tables = np.minimum(self.count, 1)
        # of the exchanged words and contexts; all, before any answer
        self.live_words, self.live_contexts = (np.arange(len(x)) for x in (self.words, self.contexts))
        self.heard = 0
        answers: dict[int, list] = {}
        for found in row.get("answers") or []:
            answers.setdefault(found["sweep"], []).append((found["shard"], found["of_words"], found["of_contexts"]))
        self.answers = {k: sorted(v) for k, v in answers.items()}

    def hear(self, sweep: int) -> None:
        """Take the shards' answers after a sweep, if not yet taken; sweep 0 is the first seating."""
        if sweep < self.heard:
            return
        self.heard = sweep + 1
        parts = self.answers[sweep]
        first = not sweep
        words = np.concatenate([_unpack(w).reshape(2 + first, -1) for _, w, _ in parts], axis=1)
        contexts = np.concatenate([_unpack(c).reshape(1 + first, -1) for _, _, c in parts], axis=1)
        if first:
            self.seen, self.customers, self.root_tables = words
            self.size, self.context_tables = contexts
            self.live_words, self.live_contexts = np.flatnonzero(self.seen > 1), np.flatnonzero(self.size > 1)
        else:
            self.customers[self.live_words], self.root_tables[self.live_words] = words
            self.context_tables[self.live_contexts] = contexts[0]

    def of_words(self, corpus: Corpus, totals: Totals, strength) -> np.ndarray:
        """The probabilities of the words at the root; for one not learned, that of all unknown ones."""
        d0, s0 = corpus.discounts[1], strength[1]
        return (self.customers - d0 * self.root_tables + (s0 + d0 * totals.root) * corpus.base) / (s0 + totals.root_customers)

    def chances(self, corpus: Corpus, totals: Totals, strength) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probabilities of the entries and of the words, and what each context leaves to the root."""
        d1, s1 = corpus.discounts[0], strength[0]
        word = self.of_words(corpus, totals, strength)
        left = (s1 + d1 * self.context_tables) / (s1 + self.size)
        entry = (self.count - d1 * self.tables) / (s1 + self.size[self.context]) + left[self.context] * word[self.word]
        return entry, word, left

    def sweep(self, corpus: Corpus, totals: Totals, params: PitmanYorParams, number: int) -> None:
        """Resample all tables given the numbers after the sweep before, ``totals`` at the root."""
        self.hear(number - 1)
        d1, s1 = corpus.discounts[0], params.strength[0]
        rng = np.random.default_rng((params.seed, number, self.number))
        word = self.of_words(corpus, totals, params.strength)
        new = (s1 + d1 * self.context_tables[self.context]) * word[self.word]
        self.tables = draw_tables(self.count, new, log_stirling(d1, EXACT), d1, rng)

    def sent(self, shards: int) -> list[tuple]:
        """For each shard the exchanged words and contexts, each with its tables here, at first with its customers too."""
        numbers = (self.tables,) if self.heard else (self.count, self.tables)
        sides = []
        for keys, at, live in ((self.words, self.word, self.live_words), (self.contexts, self.context, self.live_contexts)):
            sums = np.stack([np.bincount(at, x, len(keys)).astype(np.int64)[live] for x in numbers])
            # keys are sorted, and shards are ranges of them
            sides.append((keys[live], sums, np.searchsorted(_range(keys[live], shards), np.arange(shards + 1))))
        rows = []
        for shard in range(shards):
            # a bucket's first row has its sums
            out = [shard, self.number, *(int((self.count == k).sum()) if not shard else 0 for k in (1, 2))]
            for keys, sums, cuts in sides:
                part = slice(cuts[shard], cuts[shard + 1])
                out += [_pack_hashes(keys[part]), _pack(sums[:, part].ravel())]
            # every bucket has an answer to each sweep
            if not shard or len(out[4]) > 1 or len(out[6]) > 1:
                rows.append(tuple(out))
        return rows


SENT = "shard long, bucket long, once long, twice long, words binary, of_words binary, contexts binary, of_contexts binary"
ANSWERS = (
    "bucket long, sweep long, shard long, of_words binary, of_contexts binary, tokens long, kinds long, customers long,"
    " tables long, words_once long, root_once long, root_twice long, once long, twice long"
)


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if t == "binary" else pa.int64()) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)],
        [n for n, _ in fields],
    )


def _summed(parts: list[dict], keys: str, values: str, numbers: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of the values of each key over all parts, by column, and where each part's keys are."""
    every = [_unpack_hashes(p[keys]) for p in parts]
    unique, at = np.unique(np.concatenate(every), return_inverse=True)
    columns = np.concatenate([_unpack(p[values]).reshape(numbers, -1) for p in parts], axis=1)
    sums = np.stack([np.bincount(at, x, len(unique)).astype(np.int64) for x in columns])
    return sums, np.split(at, np.cumsum([len(x) for x in every])[:-1])


def _answers(sweep: int, corpus: Corpus | None, totals: Totals | None, params: PitmanYorParams):
    """Numbers of the whole corpus of each shard's words and contexts, answered to the buckets that sent them."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(stream, "shard"):
            parts = table.to_pylist()
            shard = parts[0]["shard"]
            words, of_words = _summed(parts, "words", "of_words", 2 if corpus is None else 1)
            contexts, of_contexts = _summed(parts, "contexts", "of_contexts", 2 if corpus is None else 1)
            customers, seen = words[-1], words[0] if corpus is None else np.zeros(0, np.int64)
            if corpus is None:
                tables = np.minimum(customers, 1)
            else:
                d0, s0 = corpus.discounts[1], params.strength[1]
                new = np.full(len(customers), (s0 + d0 * totals.root) * corpus.base)
                rng = np.random.default_rng((params.seed, sweep, shard, 1))
                tables = draw_tables(customers, new, log_stirling(d0, EXACT), d0, rng)
            words = np.concatenate([words, tables[None]])
            sums = (
                seen.sum(), (seen > 0).sum(), customers.sum(), tables.sum(), (seen == 1).sum(), (customers == 1).sum(), (customers == 2).sum(),
                sum(p["once"] for p in parts), sum(p["twice"] for p in parts),
            )
            rows = []
            for p, w, c in zip(parts, of_words, of_contexts, strict=True):
                rows.append((p["bucket"], sweep, shard, _pack(words[:, w].ravel()), _pack(contexts[:, c].ravel()), *map(int, sums)))
                sums = (0,) * len(sums)
            yield _table(ANSWERS, rows)

    return work


# -- the model ----------------------------------------------------------------------------------


class PitmanYor:
    """A trained model: the table of counts and answers, the corpus, and the root's numbers after each sweep."""

    def __init__(self, documents: DataFrame, counts: DataFrame, buckets: int, params: PitmanYorParams):
        self.documents, self.stored, self.buckets, self.params = documents, counts, buckets, params
        self.corpus, self.totals, self.answers = None, [], None
        for number in range(params.sweeps + 1):
            self._exchange(number)

    @property
    def counts(self) -> DataFrame:
        """One row for each bucket, with the answers to all sweeps so far."""
        if self.answers is None:
            return self.stored
        found = F.collect_list(F.struct("sweep", "shard", "of_words", "of_contexts")).alias("answers")
        return self.stored.join(self.answers.groupBy("bucket").agg(found), "bucket", "left")

    def _exchange(self, number: int) -> None:
        """One sweep (0: the first seating), and the numbers of the whole corpus after it."""
        corpus, totals, params, shards = self.corpus, list(self.totals), self.params, self.buckets

        def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                for k in range(batch.num_rows):
                    bucket = Bucket({n: batch.column(n)[k].as_py() for n in batch.schema.names})
                    for sweep, before in enumerate(totals, 1):
                        bucket.sweep(corpus, before, params, sweep)
                    yield _table(SENT, bucket.sent(shards))

        sent = self.counts.mapInArrow(work, SENT).repartition("shard").sortWithinPartitions("shard", "bucket")
        found = sent.mapInArrow(_answers(number, corpus, totals[-1] if totals else None, params), ANSWERS)
        found = _kept(found, "pitman-yor-answers")
        names = [f.split()[0] for f in ANSWERS.split(",")][5:]
        sums = {n: v or 0 for n, v in found.agg(*[F.sum(n).alias(n) for n in names]).first().asDict().items()}
        if corpus is None:
            rates = [(sums["once"], sums["twice"]), (sums["root_once"], sums["root_twice"])]
            discounts = tuple(float(np.clip(one / max(1, one + 2 * two), 0.1, 0.95)) for one, two in rates)
            self.corpus = Corpus(sums["tokens"], sums["kinds"], sums["words_once"], discounts)
            self.totals.append(Totals(sums["tables"], sums["customers"]))
        else:
            # words learned once are at one table as one customer
            self.totals.append(Totals(sums["tables"] + corpus.once, sums["customers"] + corpus.once))
        self.answers = found if self.answers is None else self.answers.unionByName(found)

    def over(self, documents: DataFrame) -> PitmanYor:
        """The same model, with the pairs of other documents in its buckets too."""
        pairs = _rows(documents, F.lit(False)).mapInArrow(_counts(_grid(self.buckets), self.params), COUNTS)
        return PitmanYor(documents, _merge(self.stored.unionByName(pairs)), self.buckets, self.params)


def _merge(counted: DataFrame) -> DataFrame:
    merged = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged, COUNTS)
    return _kept(merged, "pitman-yor-counts")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and its shuffle files removed, which no later job reads."""
    conf, option = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(option)
    conf.set(option, "true")
    try:
        return written(df, name)
    finally:
        conf.set(option, before)


def _rows(documents: DataFrame, learn: Column) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select(F.col("doc_id").alias("at"), F.coalesce(learn, F.lit(True)).alias("learned"), "text")


def train(documents: DataFrame, learn: Column, params: PitmanYorParams = PitmanYorParams()) -> PitmanYor:
    """Learn from the rows of ``documents(doc_id, text)`` for which ``learn``, a condition on doc_id, is not false."""
    rows = _rows(documents, learn)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(size) // (6 * params.bucket_tokens)))
    counts = _merge(rows.mapInArrow(_counts(_grid(buckets), params), COUNTS))
    return PitmanYor(documents, counts, buckets, params)


def _occurrences(grid: tuple[int, int], params: PitmanYorParams):
    """For each batch one row with its doc_ids, and one for each bucket with its occurrences."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for ids, _, word, context, row in _batches(stream, params.batch_tokens):
            batch = (task << 32) + number
            number += 1
            valid = ~np.isnan(ids) if ids.dtype.kind == "f" else np.ones(len(ids), bool)
            sizes = np.bincount(row, minlength=len(ids)).astype("<u4")
            ids = np.where(valid, ids, 0).astype(np.int64)
            yield _occurrence_row(batch, -1, ids.tobytes(), sizes.tobytes(), valid.tobytes(), b"", b"")
            order = np.argsort(word, kind="stable")
            for bucket, (w, c, r) in _by_bucket(word[order], context[order], grid, row[order].astype(np.uint16)):
                yield _occurrence_row(batch, bucket, *_packed(w, c), r.tobytes())

    return work


OCCURRENCES = "batch long, bucket long, words binary, entries binary, contexts binary, places binary, counts binary"


def _occurrence_row(batch: int, bucket: int, *columns: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([batch]), pa.array([bucket]), *[pa.array([c], pa.binary()) for c in columns]],
        [c.split()[0] for c in OCCURRENCES.split(", ")],
    )


class Scorer:
    """Log10 probabilities of a bucket's occurrences, averaged over the sweeps after burn-in."""

    def __init__(self, row: dict, bucket: int, model_corpus: Corpus, totals: list[Totals], params: PitmanYorParams):
        self.corpus, self.params = model_corpus, params
        self.bucket = Bucket({**row, "bucket": bucket})
        self.samples = []
        for number, (before, after) in enumerate(zip(totals[:-1], totals[1:], strict=True), 1):
            self.bucket.sweep(model_corpus, before, params, number)
            if number > params.burn_in:
                self.bucket.hear(number)
                self.samples.append((after, *self.bucket.chances(model_corpus, after, params.strength)))

    def score(self, words: np.ndarray, entries: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(log10 probability, log10 base probability, known)`` of each occurrence.

        A context is its place among the bucket's contexts; one beyond them has no customers.
        """
        own, corpus = self.bucket, self.corpus
        at, found = _places(own.words, words)
        seen = np.zeros(len(words), np.int64)
        seen[found] = own.seen[at[found]]
        base = np.log10((seen + 0.1) / (corpus.tokens + 0.1 * (corpus.words + 1)))
        # the probability depends on (word, context) only
        width = len(own.contexts) + 1
        index = np.repeat(np.arange(len(words)), entries)
        key, where = np.unique(index * width + np.minimum(context.astype(np.int64), width - 1), return_inverse=True)
        index, u = key // width, key % width
        is_known, has_context = seen[index] > 0, u < width - 1
        word = at[index]
        entry, has_entry = _places(own.keys, word * (width - 1) + u)
        has_entry &= found[index] & has_context
        d0, s0 = corpus.discounts[1], self.params.strength[1]
        mean = np.zeros(len(key))
        for totals, p_entry, p_word, left in self.samples:
            p = np.full(len(key), (s0 + d0 * totals.root) / (s0 + totals.root_customers) * corpus.base)
            p[is_known] = p_word[word[is_known]]
            p[has_context] *= left[u[has_context]]
            p[has_entry] = p_entry[entry[has_entry]]
            mean += p / len(self.samples)
        return np.log10(mean)[where], np.repeat(base, entries), np.repeat(seen > 0, entries)


def _places(among: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in a sorted array (0 if nowhere), and whether it is there."""
    at = np.searchsorted(among, values)
    found = at < len(among)
    found[found] = among[at[found]] == values[found]
    return np.where(found, at, 0), found


def score(documents: DataFrame, model: PitmanYor) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` for each row of ``documents(doc_id, text)``.

    A null or empty text is its end alone. Rows that repeat or lack a doc_id are scored each for
    itself. Other columns are not read. A model without any tokens gives every token the base
    probability of the one unknown word. An empty table gives an empty result. Of documents other than
    those that the model was trained from, the pairs are first put into the model's buckets.
    """
    if documents is not model.documents:
        model = model.over(documents)
    params, corpus, totals = model.params, model.corpus, model.totals
    occurrences = _rows(documents, F.lit(True)).mapInArrow(_occurrences(_grid(model.buckets), params), OCCURRENCES)
    # One pair may be a third of all tokens. Its bucket is split: the batches are dealt over ``splits``
    # tasks, each with a copy of the bucket's counts, which have one entry for each pair.
    splits = F.greatest(F.ceil(F.col("tokens") / params.bucket_tokens), F.lit(1)).cast("long")
    sizes = model.stored.select("bucket", splits.alias("splits")).where("splits > 1")
    if sizes.count() <= MOST_BROADCAST:
        sizes = F.broadcast(sizes)
    split = F.pmod(F.xxhash64("batch"), F.coalesce("splits", F.lit(1).cast("long")))
    left = occurrences.join(sizes, "bucket", "left").withColumn(
        "place", F.when(F.col("bucket") < 0, F.xxhash64("batch")).otherwise(F.xxhash64("bucket", split))
    ).drop("splits")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("splits", F.lit(1).cast("long")) - 1))

    def dealt(rows: DataFrame, order: int) -> DataFrame:
        rows = rows.join(sizes, "bucket", "left").withColumn("split", copies)
        return rows.withColumns({"batch": F.lit(order).cast("long"), "place": F.xxhash64("bucket", "split")}).drop("split", "splits")

    counts = dealt(model.stored.drop("tokens"), -2)
    answers = dealt(model.answers.select("bucket", "sweep", "shard", "of_words", "of_contexts"), -1)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counted = None, {}
        for batch in stream:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                if row["bucket"] < 0:
                    yield _sum_row(row["batch"], row["words"], row["entries"], row["contexts"], None, None, None)
                    continue
                if row["batch"] == -2:
                    scorer, counted = None, {**row, "answers": []}
                    continue
                if row["batch"] == -1:
                    counted["answers"].append(row)
                    continue
                scorer = scorer or Scorer(counted, row["bucket"], corpus, totals, params)
                entries = _unpack(row["entries"])
                docs = np.frombuffer(row["counts"], np.uint16)
                # every pair is in its bucket
                among = np.searchsorted(scorer.bucket.contexts, _unpack_hashes(row["contexts"]))
                found, base, known = scorer.score(_unpack_hashes(row["words"]), entries, among[_unpack(row["places"])])
                who = np.unique(docs)
                yield _sum_row(
                    row["batch"], None, None, None, who.tobytes(),
                    np.stack([np.bincount(docs, x)[who] for x in (found, base)]).tobytes(),
                    np.bincount(docs, known)[who].astype("<u4").tobytes(),
                )

    schema = "batch long, ids binary, sizes binary, valid binary, docs binary, sums binary, known binary"
    rows = left.unionByName(counts, allowMissingColumns=True).unionByName(answers, allowMissingColumns=True)
    sums = rows.repartition("place").sortWithinPartitions("place", "bucket", "batch").mapInArrow(work, schema)

    def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(stream, "batch"):
            parts = table.to_pylist()
            meta = next(p for p in parts if p["ids"] is not None)
            ids, valid = np.frombuffer(meta["ids"], np.int64), np.frombuffer(meta["valid"], bool)
            total, known = np.zeros((2, len(ids))), np.zeros(len(ids), np.int64)
            for p in sorted((p for p in parts if p["ids"] is None), key=lambda p: (p["docs"], p["sums"])):
                who = np.frombuffer(p["docs"], np.uint16)
                total[:, who] += np.frombuffer(p["sums"], np.float64).reshape(2, -1)
                known[who] += np.frombuffer(p["known"], "<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~valid), pa.array(np.frombuffer(meta["sizes"], "<u4").astype(np.int64)), pa.array(known),
                 pa.array(total[1]), pa.array(total[0])],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return sums.repartition("batch").sortWithinPartitions("batch").mapInArrow(
        gather, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )


def _sum_row(batch: int, *columns: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([batch]), *[pa.array([c], pa.binary()) for c in columns]],
        ["batch", "ids", "sizes", "valid", "docs", "sums", "known"],
    )
