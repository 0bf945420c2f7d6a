"""Documents to training sequences: quality, near duplicates, secrets, packing.

Each stage takes all that the one before kept, as ``documents(doc_id, text, lang, source, n_chars)``,
and its decisions take effect: documents that the quality model rejects go; one document of each
group of near duplicates stays, the one of the smallest doc_id; secrets in a text are replaced by
``SECRET``; what is left is packed into sequences, one row for each piece.

Rows that share a doc_id are one document and stay or go together. Rows without a doc_id are in no
group of near duplicates; they stay unless the quality model rejects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm import minhash, packing, quality, secrets
from slotledger.llm.queries import WORD_MODEL, tokenizer_path
from slotledger.llm.shared import ship, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SECRET = "[SECRET]"

#: Not SQL: a trained model, MinHash groups, learned formats and packing.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality model predicts to be good."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return quality.keep(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a similarity of 0.8 or more."""
    ship(spark)
    found = minhash.near_duplicates(docs, minhash.MinHashParams()).where("kept").select("doc_id")
    docs = docs.select(*COLUMNS)
    return docs.join(found, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced; ``n_chars`` follows the new text."""
    ship(spark)
    return secrets.redact(docs.select(*COLUMNS), secrets.train(docs), SECRET)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences.

    Workers outlive a stage and keep their caches, so this one's is small beside other stages' needs.
    """
    ship(spark)
    return packing.pack(docs, tokenizer_path(WORD_MODEL), packing.PackParams(cached_words=60_000))


STAGES = [("quality", clean), ("near_duplicates", distinct), ("secrets", without_secrets), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
