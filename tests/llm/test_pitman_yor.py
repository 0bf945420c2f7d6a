import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from slotledger.llm import pitman_yor as py
from slotledger.llm.shared import ship
from tests.llm.rows import awkward, documents, words


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_stirling_weights_are_those_of_all_seatings():
    """S(c, t) by seating one customer after the other."""
    d = 0.4
    table = np.exp(py.log_stirling(d, 6))
    ways = {(1,): 1.0}
    for c in range(1, 7):
        sums = Counter()
        for seating, weight in ways.items():
            sums[len(seating)] += weight
        for t, weight in sums.items():
            assert math.isclose(table[c, t], weight)
        following = Counter()
        for seating, weight in ways.items():
            following[(*seating, 1)] += weight
            for k, n in enumerate(seating):
                following[(*seating[:k], n + 1, *seating[k + 1 :])] += weight * (n - d)
        ways = following


def test_draws_follow_the_conditional_distribution():
    d, chance, c = 0.5, 0.7, 5
    stirling = py.log_stirling(d, py.EXACT)
    drawn = py.draw_tables(np.full(40_000, c), np.full(40_000, chance), stirling, d, np.random.default_rng(1))
    weight = np.exp(stirling[c, 1 : c + 1]) * chance ** np.arange(1, c + 1)
    assert np.allclose(np.bincount(drawn, minlength=c + 1)[1:] / 40_000, weight / weight.sum(), atol=0.01)
    many = py.draw_tables(np.full(50, 100_000), np.full(50, 2.0), stirling, d, np.random.default_rng(1))
    assert (many >= 1).all() and (many < 100_000).all()


def test_scores_sums_and_held_out_gain(spark):
    ship(spark)
    rng = np.random.default_rng(2)
    vocabulary = words(3, 40).split()
    texts = []
    for k in range(60):  # a word's end tells which words may follow
        at, out = 0, []
        for _ in range(60):
            at = (at * 7 + int(rng.integers(0, 3))) % 40
            out.append(vocabulary[at])
        texts.append((1000 + k, " ".join(out)))
    texts += awkward()
    table = documents(spark, texts).withColumns({c: F.lit(1) for c in ("at", "learned", "words", "entries", "sums")})
    params = py.PitmanYorParams(bucket_tokens=2_000, batch_tokens=1_500)
    model = py.train(table, F.col("doc_id") % 10 != 0, params)
    found = py.score(table, model).collect()
    assert len(found) == len(texts)
    learned = Counter(t for i, x in texts if i is None or i % 10 for t in tokens(x))
    total, kinds = sum(learned.values()), len(learned)
    assert (model.corpus.tokens, model.corpus.words) == (total, kinds)
    expected = sorted(
        (len(tokens(x)), sum(t in learned for t in tokens(x)), round(sum(math.log10((learned[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens(x)), 6))
        for _, x in texts
    )
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected
    held = [r for r in found if r.doc_id is not None and r.doc_id >= 1000 and r.doc_id % 10 == 0]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in py.score(table, model).collect()}
    assert all(math.isclose(again[r.doc_id], r.score) for r in found if r.doc_id not in (None, 6))


def test_probabilities_sum_to_one(spark):
    """Over all known words and the unknown one, in a context seen and in one not seen."""
    ship(spark)
    table = documents(spark, [(k, words(k % 7, 80)) for k in range(20)])
    params = py.PitmanYorParams()
    model = py.train(table, F.lit(True), params)
    scorer = py.Scorer(model.counts.first().asDict(), 0, model.corpus, model.totals, params)
    known = scorer.bucket.words
    unknown = np.setdiff1d(np.array([1, 2, 3], np.uint64), known)[:1]
    both = np.sort(np.concatenate((known, unknown)))
    for context in (0, int(scorer.bucket.context[-1]), 12345):
        p, _, _ = scorer.score(both, np.ones(len(both), np.int64), np.full(len(both), context, np.uint32))
        assert math.isclose((10**p).sum(), 1, rel_tol=1e-9)


def test_empty_tables(spark):
    ship(spark)
    empty = documents(spark, [])
    model = py.train(empty, F.lit(True))
    assert py.score(empty, model).collect() == []
    r = py.score(documents(spark, [(1, "a b")]), model).first()
    assert (r.n_tokens, r.n_known, r.score) == (3, 0, 0.0)


def test_each_word_before_has_its_own_restaurant(spark):
    """Two words that end alike and share low bits of their hash are followed by different words."""
    import pyarrow as pa

    ship(spark)
    names = [f"{k}z" for k in range(3_000)]
    hashes = py.tokens(pa.array([" ".join(names)]))[0][:-1]
    low = hashes & np.uint64(1023)
    one, two = next((i, j) for i in range(len(names)) for j in range(i) if low[i] == low[j])
    texts = [(k, f"{names[one]} left" if k % 2 else f"{names[two]} right") for k in range(200)]
    word, context, row = py.tokens(pa.array([texts[0][1], "", texts[1][1]]))
    end = word[2]
    assert context.tolist() == [end, word[0], word[1], end, end, word[4], word[5]]
    assert word[0] == hashes[two] and word[4] == hashes[one] and row.tolist() == [0, 0, 0, 1, 2, 2, 2]
    table = documents(spark, [*texts, (1000, f"{names[one]} right"), (1001, f"{names[two]} left")])
    found = {r.doc_id: r.score for r in py.score(table, py.train(table, F.col("doc_id") < 1000)).collect()}
    assert min(found[0], found[1]) > max(found[1000], found[1001]) + 1


def test_buckets_agree_on_the_numbers_of_the_whole_corpus(spark):
    """Customers and tables of each context and word, added up over all buckets after the last sweep."""
    ship(spark)
    table = documents(spark, [(k, words(k % 9, 150)) for k in range(60)] + [(60, "once")])
    params = py.PitmanYorParams(bucket_tokens=300, batch_tokens=1_000)
    model = py.train(table, F.col("doc_id") % 5 != 0, params)
    buckets = []
    for row in model.counts.collect():
        scorer = py.Scorer(row.asDict(), row["bucket"], model.corpus, model.totals, params)
        buckets.append(scorer.bucket)
    assert len(buckets) > 4
    sums = [Counter() for _ in range(4)]
    for b in buckets:
        for at, key in ((b.word, b.words), (b.context, b.contexts)):
            for k, (n, t) in enumerate(zip(b.count, b.tables, strict=True)):
                sums[0 if key is b.words else 2][int(key[at[k]])] += int(n)
                sums[1 if key is b.words else 3][int(key[at[k]])] += int(t)
    root = {}
    for b in buckets:
        for name, keys, mine in ((0, b.words, b.seen), (1, b.words, b.customers), (2, b.contexts, b.size), (3, b.contexts, b.context_tables)):
            assert [sums[name][int(k)] for k in keys] == mine.tolist()
        root |= zip(b.words.tolist(), b.root_tables.tolist(), strict=True)
    assert any(t > 1 for t in sums[3].values())
    last = model.totals[-1]
    assert (last.root, last.root_customers) == (sum(root.values()), sum(sums[1].values()))


def test_other_documents_are_scored_by_the_same_model(spark):
    ship(spark)
    rows = [(k, words(k % 9, 60)) for k in range(40)]
    params = py.PitmanYorParams(bucket_tokens=200, batch_tokens=500)
    table = documents(spark, rows)
    model = py.train(table, F.lit(True), params)
    found = {r.doc_id: r.score for r in py.score(table, model).collect()}
    others = documents(spark, [*rows[:5], (100, "unheard of words"), (101, None)])
    again = {r.doc_id: r for r in py.score(others, model).collect()}
    assert len(again) == 7 and all(math.isclose(again[k].score, found[k]) for k in range(5))
    assert again[100].n_tokens == 4 and again[100].score < 0
