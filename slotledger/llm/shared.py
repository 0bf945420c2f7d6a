"""Folders that every executor shares, and tables written there to cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one of our own only where the session names none."""
    named = spark.conf.get(CHECKPOINT_DIR, "") or spark.sparkContext.getConf().get(CHECKPOINT_DIR, "")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} names no folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="slotledger-shared-")
        spark.conf.set(CHECKPOINT_DIR, named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/slotledger/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and it outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give executors this package, as ``--py-files`` would; once for a Spark application."""
    context = spark.sparkContext
    if getattr(context, "_slotledger_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="slotledger-files-"))
    staged = folder / "files" / package.name
    shutil.copytree(package, staged, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", staged.parent))
    context._slotledger_shipped = True
