import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from slotledger.llm import packing, pieces, token_files
from slotledger.llm.queries import PIECE_MODEL, WORD_MODEL, tokenizer_path
from slotledger.llm.shared import new_path, ship
from slotledger.llm.tokens import WordEncoder
from tests.llm.rows import awkward, documents, words


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path(WORD_MODEL))


def noise(seed, letters, count, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(size))) for _ in range(count)]


def test_pieces_are_those_of_the_library(library):
    model = pieces.PieceModel(tokenizer_path(PIECE_MODEL))
    texts = [t for _, t in awkward()] + noise(1, "thein g▁ \n.", 400, 60) + noise(2, "abE é1日🙂▁\x00", 30, 2000)
    texts += [" " * 1500, "ab" * 1500, "<s>x</s><unk><0x41>"]
    ids, offsets = model.encode(texts)
    expected = [library.encode(t or "") for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == expected
    assert model.decode(ids.astype(np.int64), offsets).to_pylist() == [library.decode(e) for e in expected]


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(3)
    rows = [[rng.randrange(300 if rng.random() < 0.5 else 32_000) for _ in range(rng.randrange(8))] for _ in range(2000)]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    model = pieces.load(tokenizer_path(PIECE_MODEL))
    assert model.decode(np.array(sum(rows, []), np.int64), offsets).to_pylist() == [library.decode(r) for r in rows]


def test_pieces_over_a_table(spark, library):
    ship(spark)
    path = tokenizer_path(PIECE_MODEL)
    found = pieces.decode(pieces.encode(documents(spark, awkward()), path), path).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in awkward()]
    assert sorted([(r.doc_id, list(r.ids), r.text) for r in found], key=key) == sorted(expected, key=key)
    assert pieces.decode(pieces.encode(documents(spark, []), path), path).collect() == []


def test_words_have_the_ids_of_whole_texts(tokenizer):
    encoder = WordEncoder(tokenizer_path(WORD_MODEL))
    letters = "abzABZ 's'tre'LL'd09.,!$é É ßÑ×÷ªº\n\t́日\x1cµİΣς"
    texts = [t for _, t in awkward()] + noise(4, letters, 3000, 40) + ["<|endoftext|> a<|startoftext|>b", "'s't"]
    for end in (None, 2):
        ids, offsets = encoder.encode(texts, end)
        expected = [e.ids + [end] * (end is not None) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == expected


def test_token_files_round_trip(spark, tokenizer):
    ship(spark)
    texts = [(i, t) for i, t in awkward() if i != 6]
    path = new_path(spark, "test-files")
    token_files.write_tokens(documents(spark, texts), tokenizer_path(WORD_MODEL), path)
    rows = token_files.read_tokens(spark, path)
    found = token_files.with_starts(rows, token_files.checksums(rows)).orderBy("start").collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts if i is not None}
    assert [r.doc_id for r in found][:2] == [None, None]
    at = found[2].start
    for r, (i, expected) in zip(found[2:], sorted(ids.items()), strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(expected))
        assert r.ids_crc32 == zlib.crc32(np.array(expected, "<u4").tobytes())
        at += len(expected)
    few = token_files.read_tokens(spark, path, 4, 5).select("doc_id", "ids")
    assert {r.doc_id: r.ids for r in few.collect()} == {4: ids[4], 5: ids[5]}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,4)" in plan and "start_in_part" not in plan


def test_token_files_of_an_empty_table(spark):
    path = new_path(spark, "test-files")
    token_files.write_tokens(documents(spark, []), tokenizer_path(WORD_MODEL), path)
    rows = token_files.read_tokens(spark, path)
    assert token_files.with_starts(rows, token_files.checksums(rows)).collect() == []


def test_every_id_lies_in_one_piece_without_padding(spark, tokenizer):
    ship(spark)
    texts = [(i, t) for i, t in awkward() if i not in (None, 6)] + [(k, words(k, 30 + k)) for k in range(100, 180)]
    params = packing.PackParams(window=256, shard_bytes=20_000)
    found = packing.pack(documents(spark, texts), tokenizer_path(WORD_MODEL), params).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts}
    for i, expected in ids.items():
        at = 0
        for r in sorted((r for r in found if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(expected))
            assert r.ids_crc32 == zlib.crc32(np.array(expected[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(expected)
    for s in {r.sequence_id for r in found}:
        at = 0
        for r in sorted((r for r in found if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(documents(spark, []), tokenizer_path(WORD_MODEL), params).collect() == []


def test_neighbours_share_a_window():
    """Two topics without common words: no window mixes them before either runs out."""
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, 40) + 100 * (k % 2) for k in range(40)]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    found = packing.pack_shard(np.concatenate(docs), offsets, packing.PackParams(window=160))
    topics = {}
    for doc, _, _, sequence, _ in found:
        topics.setdefault(sequence, set()).add(doc % 2)
    assert sum(len(t) == 1 for t in topics.values()) >= len(topics) - 1


def test_weights_follow_all_documents_not_those_of_a_shard(spark, tokenizer):
    """Postings of every shard against BM25 by hand over the whole table."""
    ship(spark)
    texts = [(k, words(k, 10 + k % 30)) for k in range(60)] + [(100, None), (None, words(7, 5))]
    terms = tokenizer.get_vocab_size()
    rows = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in texts]
    ids = spark.createDataFrame([(np.array(r, "<u2").tobytes(),) for r in rows], "ids binary").repartition(5)
    corpus = packing.statistics(ids, "<u2", terms)
    df = {t: sum(t in r for r in rows) for r in rows for t in r}
    assert (corpus.count, corpus.tokens) == (len(rows), sum(map(len, rows)))
    assert {int(t): int(corpus.df[t]) for t in np.flatnonzero(corpus.df)} == df
    params, part = packing.PackParams(), rows[:4]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in part])))
    index = packing.Bm25(np.array(sum(part, []), "<u2"), offsets, params, corpus)
    mean = sum(map(len, rows)) / len(rows)
    for t, a, b in zip(index.terms, index.heads, index.ends, strict=True):
        idf = np.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5))
        for d, w in zip(index.docs[a:b], index.weights[a:b], strict=True):
            tf, norm = part[d].count(t), params.k1 * (1 - params.b + params.b * len(part[d]) / mean)
            assert np.isclose(w, idf * tf * (params.k1 + 1) / (tf + norm))


def test_terms_are_rare_by_all_documents(spark, tokenizer, monkeypatch):
    """The order of terms follows the counts of all rows, more than 2,000 and one of them longer than 64 KB."""
    ship(spark)
    texts = [(k, f"alpha w{k % 50} {words(k % 9, 3)}") for k in range(2_300)] + [(5_000, "omega " + "beta " * 20_000)]
    seen, real = [], packing.placing_order
    monkeypatch.setattr(packing, "placing_order", lambda corpus: seen.append(corpus) or real(corpus))
    found = packing.pack(documents(spark, texts), tokenizer_path(WORD_MODEL), packing.PackParams(shard_bytes=50_000))
    assert found.select("doc_id").distinct().count() == len(texts)
    df = np.zeros(len(seen[0].df), np.int64)
    for _, t in texts:
        df[sorted({*tokenizer.encode(t, add_special_tokens=False).ids, 2})] += 1
    assert seen[0].count == len(texts) and (seen[0].df == df).all()
    place = real(seen[0])
    assert sorted(place.tolist()) == list(range(len(df)))
    one = packing.Corpus(seen[0].count, seen[0].tokens, np.where(np.arange(len(df)) == 2, 1, df))
    assert real(one)[2] < place[2]  # rarer, hence earlier


def test_all_terms_of_a_seed_count():
    """A long seed: what shares its 49th or a later term is found, and scores are sums over all terms."""
    docs = [list(range(200)), *[[k] for k in range(200)], [500]]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    ids = np.array(sum(docs, []))
    corpus = packing.Corpus.of(ids, offsets, 501)
    index = packing.Bm25(ids, offsets, packing.PackParams(), corpus)
    assert sorted(index.neighbours(0, np.arange(len(docs)) > 0)) == list(range(1, 201))
    expected = np.zeros(len(docs))
    np.add.at(expected, index.docs, np.where(np.repeat(index.terms, index.ends - index.heads) < 200, index.weights, 0))
    assert np.allclose(index.scores(0), expected)


def greedy(docs, window, params):
    """Packing as it is said, with dictionaries: (document, start, length) of each sequence in turn."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1

    def score(seed, other):
        total, norm = 0.0, params.k1 * (1 - params.b + params.b * len(docs[other]) / mean)
        for t in sorted(set(docs[seed])):
            tf = docs[other].count(t)
            if tf:
                total += math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (params.k1 + 1) / (tf + norm)
        return total

    unused, sequences, now, room, rest = list(range(n)), [], [], window, None
    while rest or unused:
        doc, start = rest or (unused.pop(0), 0)
        take = min(len(docs[doc]) - start, room)
        now.append((doc, start, take))
        room, rest = room - take, (doc, start + take) if start + take < len(docs[doc]) else None
        if not rest and room:
            ranked = sorted((k for k in unused if score(doc, k) > 0), key=lambda k: (-score(doc, k), k))
            cut = None
            for k in ranked:
                if len(docs[k]) <= room:
                    now.append((k, 0, len(docs[k])))
                    room -= len(docs[k])
                    unused.remove(k)
                    if not room:
                        break
                elif cut is None:
                    cut = k
            if room and cut is not None:
                now.append((cut, 0, room))
                unused.remove(cut)
                room, rest = 0, (cut, now[-1][2])
        if not room:
            sequences.append(now)
            now, room = [], window
    return sequences, now


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_filling_is_that_of_its_definition(seed):
    rng = random.Random(seed)
    docs = [[rng.randrange(60) for _ in range(rng.randrange(1, 70))] for _ in range(60)]
    params = packing.PackParams(window=100)
    pieces = packing.pack_shard(np.array(sum(docs, []), "<u2"), np.cumsum([0, *map(len, docs)]), params)
    sequences, last = greedy(docs, 100, params)
    found = {}
    for doc, start, length, sequence, _ in pieces:
        found.setdefault(sequence, []).append((doc, start, length))
    assert [found[k] for k in range(len(sequences))] == sequences
    # what is left is the same documents, cut into powers of two
    rest = [p for k in range(len(sequences), len(found)) for p in found[k]]
    assert sum(p[2] for p in rest) == sum(p[2] for p in last)


def test_near_copies_are_placed_in_one_shard(spark):
    ship(spark)
    pairs = [(2 * k + s, words(k, 120) + f" {words(1000 + 2 * k + s, 6)}") for k in range(150) for s in (0, 1)]
    random.Random(5).shuffle(pairs)
    params = packing.PackParams(window=256, shard_bytes=6_000)
    shard = {r.doc_id: r.shard for r in packing.pack(documents(spark, pairs), tokenizer_path(WORD_MODEL), params).collect()}
    assert len(set(shard.values())) >= 15
    assert sum(shard[2 * k] == shard[2 * k + 1] for k in range(150)) >= 90  # by chance 10


def test_many_equal_rows_are_dealt_to_several_shards(spark):
    ship(spark)
    rows = [(None, words(1, 50))] * 200 + [(7, words(2, 50))] * 200 + [(k, words(k, 50)) for k in range(100, 150)]
    params = packing.PackParams(window=256, shard_bytes=10_000)
    found = packing.pack(documents(spark, rows), tokenizer_path(WORD_MODEL), params).collect()
    whole = [r for r in found if r.start == 0]
    assert len(whole) == len(rows) and sum(r.length for r in found) == sum(r.doc_tokens for r in whole)
    for doc_id in (None, 7):
        counts = Counter(r.shard for r in whole if r.doc_id == doc_id)
        assert len(counts) > 3 and max(counts.values()) <= 100
    assert all(r.offset + r.length <= 256 for r in found)
