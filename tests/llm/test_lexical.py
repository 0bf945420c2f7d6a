"""Ranked search against a plain count of terms; pieces and blocks small enough to cut texts and items."""

import math
import re
from collections import Counter

import pytest

from slotledger.llm import lexical
from slotledger.llm.queries import op12_automaton_search
from tests.conftest import SF_DIR
from tests.llm.rows import awkward, documents, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in wanted.items():
        scored = []
        for doc, c in found:
            m = 25 + 75 * sum(c.values()) * n // max(total, 1)
            score = sum(
                r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, r in query.items() if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, doc, score) for rank, (_, _, doc, score) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, items):
    rows = [(i, t, "x") for i, t in items]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [
    (1, "One"), (2, words(1, 12)), (2, words(2, 3)), (3, None), (4, " ,;"), (None, "one"), (5, "日本語 é É ½x 𝔸🙂 one one ONE"),
    (6, words(5, 300)), (7, words(5, 40) + " tail x"), (8, "tail\x1c\x00x"),
]


@pytest.mark.parametrize("params", [{}, {"k": 2, "block_bytes": 30, "piece_bytes": 100, "cells": 40}, {"k": 1, "piece_bytes": 1000}])
def test_equals_brute_force(spark, params):
    docs = awkward() + [(20 + k, words(100 + k % 7, 20)) for k in range(30)] + [(60, "one ONE-one\x7fone"), (61, "x" * 5000 + " tail")]
    have = found(lexical.search(documents(spark, docs), items_of(spark, ITEMS), lexical.SearchParams(**params)))
    assert have == brute(docs, ITEMS, params.get("k", 10))


def test_empty_tables(spark):
    assert found(lexical.search(documents(spark, []), items_of(spark, ITEMS))) == []
    assert found(lexical.search(documents(spark, awkward()), items_of(spark, []))) == []


def test_a_short_last_page_keeps_all_and_ties_go_to_smaller_ids(spark):
    docs = [(k, "same words here") for k in range(30, 0, -1)] + [(None, "same words here"), (40, "other")]
    have = found(lexical.search(documents(spark, docs), items_of(spark, [(1, "words other")])))
    assert have == brute(docs, [(1, "words other")])


def test_query_equals_brute_force_on_the_samples(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").select(*c).collect()]
    assert found(op12_automaton_search(spark, SF_DIR)) == brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
