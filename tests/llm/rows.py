"""Small tables for the operators: awkward texts, and columns whose names the operators use inside."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHING = ["id", "key", "label", "place", "tile", "shard", "part", "batch", "bucket", "vector", "n", "start", "score"]


def words(seed: int, count: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 7))) for _ in range(count))


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]], clash: bool = True) -> DataFrame:
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clash else df


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, no text, no words, one word, repeated rows, long texts, other scripts and controls."""
    long = words(5, 12_000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one"), (6, words(1, 60)), (6, words(1, 60)),
        (7, words(1, 60)), (8, words(2, 60)), (None, words(1, 60)), (None, None), (9, long), (10, long + " tail"),
        (11, "日本語 テキスト é é ﬁ ½\x00\x1c 𝔸🙂"), (12, "a" * 3000), (13, " " * 50 + "x"), (14, "A b C Σς"),
    ]
