import random
import re

import numpy as np
import pytest

from slotledger.llm.components import connected_components
from slotledger.llm.minhash import MinHashParams, near_duplicates, unequal_minima
from slotledger.llm.shingles import MinHasher, packed_bits
from tests.llm.rows import awkward, documents, words


def shingles(text, size):
    found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)}


def brute(texts, size):
    """doc_id to (set size, component) by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in texts if i is not None}
    component = {i: i for i in sets}
    while True:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and component[i] != component[j]:
                    component[i] = component[j] = min(component[i], component[j])
                    changed = True
        if not changed:
            return {i: (len(s), component[i]) for i, s in sets.items()}


def edited(text, rng, share):
    return " ".join(rng.choice(["zz", "yy", "xx"]) if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("size", [2, 5])
def test_classes_match_all_pairs(spark, size):
    rng = random.Random(4)
    texts = awkward()
    for base in range(6):
        text = words(100 + base, 150)
        texts += [(100 * (base + 1) + k, edited(text, rng, 0.012 * k)) for k in range(14)]
    found = near_duplicates(documents(spark, texts), MinHashParams(shingle=size, tile=5)).collect()
    assert len(found) == len(texts)
    expected = brute(texts, size)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.component_id == r.doc_id)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).collect() == []


def test_bits_count_unequal_minima(spark):
    params = MinHashParams()
    rng = np.random.default_rng(1)
    a = MinHasher(160).minima(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    b = MinHasher(160).minima(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    rows = [tuple(np.frombuffer(packed_bits(x, params.bits).ljust(8 * params.words, b"\0"), np.int64).tolist() for x in (a, b))]
    found = spark.createDataFrame(rows, "x array<long>, y array<long>").select(unequal_minima("x", "y", params.bits)).first()[0]
    assert found == int(((a ^ b) & 15 != 0).sum())


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(100, k) for k in range(101, 150)] + [(5, 5), (None, 3), (7, 8), (8, 7), (7, 8)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.id, r.component) for r in found} == (
        {(k, 10) for k in range(10, 61)} | {(k, 100) for k in range(100, 150)} | {(7, 7), (8, 7)}
    )
