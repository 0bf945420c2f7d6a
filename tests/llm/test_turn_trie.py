"""The conversation trie against a brute-force one, with blocks and shards small enough to have edges."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from slotledger.llm import turn_trie
from slotledger.llm.queries import op11_turn_trie
from tests.conftest import SF_DIR

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(turns, heads=lambda c: (c, 0)):
    """Rows of the trie from ``(conv_id, turn, role, text)``, by dictionaries of prefixes."""
    own = {}
    for c, t, r, x in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [turn[2:] for turn in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        base, h = heads(c)
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(cs) - 1) * words
    return sorted(
        (
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node)).encode()).hexdigest(),
        )
        for node, cs in members.items()
    )


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def table(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(7) for c in ("shard", "seq", "words", "n", "node", "depth", "key")})


def trie(spark, turns, **params):
    return found(turn_trie.prefix_trie(turn_trie.sequences(table(spark, turns)), turn_trie.TrieParams(**params)))


def invented(seed, conversations, most, kinds=3):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice("ua"), rng.choice(["x", "y z", " a\tb c ", None][:kinds]))
        for c in range(conversations) for t in range(rng.randrange(most))
    ]


AWKWARD = [
    (5, 0, "u", "a b"), (5, 0, "u", "a b"), (5, None, None, None), (7, 1, "u", "a"), (7, 0, "", ""), (None, 0, "u", "x"),
    (9, None, "", ""), (9, 1, "u", "a"), (11, 2, None, "a"), (-3, 0, "u", "é\x85 x"), (12, 0, "u", "a b"), (13, 0, "ua", " b"),
]


@pytest.mark.parametrize("turns", [AWKWARD, [], [(1, None, None, None)], invented(1, 60, 6), [(c, 0, "u", "a b") for c in range(40)]])
@pytest.mark.parametrize("params", [{}, {"columns": 2, "piece": 3}, {"columns": 5, "cells": 40}])
def test_equals_brute_force(spark, turns, params):
    assert trie(spark, turns, **params) == (brute(turns) if any(t[0] is not None for t in turns) else [])


@pytest.mark.parametrize("shards", [2, 7, 40])
def test_edges_of_shards_recombine(spark, shards):
    long = [(900 + k, t, "u", "w " * (t % 5) + ("end" if t == 150 + k // 2 else "")) for k in range(6) for t in range(160 + k)]
    copies = [(1000 + k, t, "u", "same") for k in range(200) for t in range(2)]
    turns = invented(2, 300, 9) + long + copies
    settings = {
        "spark.sql.shuffle.partitions": str(shards), "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    held = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert trie(spark, turns, columns=16) == brute(turns)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_query_equals_brute_force_on_the_samples(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    heads = lambda c: (c - c % 20, zlib.crc32(str(c).encode()) % 4)
    assert found(op11_turn_trie(spark, SF_DIR)) == brute(rows, heads)


def test_heads_of_absent_and_shorter_conversations(spark):
    turns = [(3, t, "u", f"own {t}") for t in range(5)] + [(20, 0, "u", "head")] + [(c, t, "u", f"t{t}") for c in (21, 22, 25) for t in range(c - 20)]
    heads = lambda c: (c - c % 20, zlib.crc32(str(c).encode()) % 4)
    rows = turn_trie.sequences(table(spark, turns))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    built = turn_trie.with_heads(rows, head, 3, F.expr("conv_id - conv_id % 20"))
    assert found(turn_trie.prefix_trie(built)) == brute(turns, heads)
