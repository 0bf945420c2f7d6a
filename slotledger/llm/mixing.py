"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources share the words of all documents by weight; no target is above ``most`` times its source's
words. Each document of a source is expected target / source words times. These expectations are
added up over the source's documents, from the longest to the shortest, a random offset is added, and
a document is taken once for each whole number that its own share crosses. As the order is by length,
the words taken differ from the target by less than the source's longest document.

No window sees all rows of a source. Documents of a source are ranked through counts: by length (d
different lengths need d * (d - 1) / 2 words, so few of them exist), by one of 4,096 buckets of a random
key among documents of equal length, and by the key in a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.shared import written

WORDS = r"[^\x20\x09-\x0D]+"
OFFSETS = 4096


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)  # of the sources in order, repeating
    most: int = 3  # times that a source is taken at most
    seed: str = "mix"


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _number(key: Column) -> Column:
    """0 .. 4095 from a key's first three digits."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def sized(documents: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``(doc_id, source, size, key)``: words of the text, and a random key from the id and the text."""
    doc_id, text = F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        _key(F.lit(params.seed), F.coalesce(doc_id, F.lit("")), text).alias("key"),
    )


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0, in the order of ``source``, a null one last.

    Rows are put in order by ranges and numbered in each range; only counts of ranges meet in one task.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("_range", F.shiftright("_at", 33)), "mix-sources")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = dealt.join(starts, "_range")
    return placed.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_range", "_before")


def targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``(source, source_size, weight, target)`` of ``sizes(source, size)``, rows of a source added up.

    Sources that reach their limit are those whose words by weight are least. Weights are few, so
    sources are counted by weight and words, and the limit is found along these counts in exact whole
    numbers: a source stops if its limit is at most its share of what earlier ones leave.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in params.weights]), (F.col("place") % len(params.weights)).cast("int") + 1)
    placed = _numbered(by_source).withColumn("weight", weight.cast("long"))

    def exact(column: str) -> Column:
        return F.col(column).cast("decimal(38,0)")

    alike = placed.groupBy("weight", "source_size").agg(F.count("*").alias("n"))
    upto = Window.orderBy(F.col("source_size") / F.col("weight"), "weight", "source_size").rowsBetween(Window.unboundedPreceding, -1)
    whole = alike.agg(F.sum(exact("source_size") * exact("n")).alias("words"), F.sum(exact("weight") * exact("n")).alias("weights"))
    total = whole.first()  # one row
    words, weights = int(total["words"] or 0), int(total["weights"] or 0)
    limit = exact("source_size") * params.most
    stopped = alike.select(
        "weight", limit.alias("limit"), (limit * exact("n")).alias("_limit"), (exact("weight") * exact("n")).alias("_weight"),
        F.coalesce(F.sum(limit * exact("n")).over(upto), F.lit(0)).cast("decimal(38,0)").alias("taken"),
        F.coalesce(F.sum(exact("weight") * exact("n")).over(upto), F.lit(0)).cast("decimal(38,0)").alias("gone"),
    ).where(exact("limit") * (F.lit(weights).cast("decimal(20,0)") - F.col("gone")) <= exact("weight") * (F.lit(words).cast("decimal(20,0)") - F.col("taken")))
    sums = stopped.agg(F.sum("_limit").alias("words"), F.sum("_weight").alias("weights")).first()  # one row
    rest, shares = words - int(sums["words"] or 0), weights - int(sums["weights"] or 0)
    bound = F.col("source_size") * params.most
    # what is left for the sources that do not stop, in the proportion of their weights
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(max(shares, 1)))
    capped = F.lit(shares == 0) | (exact("source_size") * params.most * F.lit(shares).cast("decimal(20,0)") <= exact("weight") * F.lit(rest).cast("decimal(20,0)"))
    return placed.select("source", "source_size", "weight", F.when(capped, bound.cast("double")).otherwise(share).alias("target"))


def mix(documents: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``(doc_id, key, source, size, source_size, target, copies)`` of each row of ``documents(doc_id, text, source)``.

    ``size`` counts the words ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none. ``target`` is of the
    row's source, in words; a null source is a source, the last one. ``copies`` is how often the mix
    takes the row, from 0 to ``most``. The offset and the order of documents of equal length follow
    from ``seed``, the ids and the texts, so a run gives what the one before gave. Rows that repeat or
    lack a doc_id are taken each for itself. Other columns are not read. An empty table gives no rows.
    """
    rows = written(sized(documents, params), "mix-sizes").withColumn("bucket", _number(F.col("key")))
    aimed = written(targets(rows.select("source", "size"), params), "mix-targets")

    # nulls would not meet in the joins below
    source = F.struct("source")
    rows = rows.select("doc_id", "key", source.alias("_source"), "size", "bucket")
    counts = rows.groupBy("_source", "size", "bucket").agg(F.count("*").alias("n"))
    among = Window.partitionBy("_source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.partitionBy("_source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.select("_source", "size", "bucket", F.coalesce(F.sum("n").over(among), F.lit(0)).alias("_bucket_first"))
    lengths = counts.groupBy("_source", "size").agg(F.sum("n").alias("n"))
    lengths = lengths.select("_source", "size", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("_size_first"))
    firsts = buckets.join(lengths, ["_source", "size"]).join(aimed.select(source.alias("_source"), "source_size", "target"), "_source")

    inside = Window.partitionBy("_source", "size", "bucket").orderBy("key", "doc_id")
    placed = rows.withColumn("_in", F.row_number().over(inside)).join(firsts, ["_source", "size", "bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _number(_key(F.lit(params.seed), F.coalesce("_source.source", F.lit("")))) / float(OFFSETS)
    rank = F.col("_size_first") + F.col("_bucket_first") + F.col("_in")

    def crossed(upto: Column) -> Column:
        return F.floor(upto.cast("double") * F.col("_rate") + F.col("_offset"))

    ready = placed.withColumns({"_rate": rate, "_offset": offset, "_rank": rank})
    return ready.select(
        "doc_id", "key", F.col("_source.source").alias("source"), "size", "source_size", "target",
        (crossed(F.col("_rank")) - crossed(F.col("_rank") - 1)).cast("long").alias("copies"),
    )


def emitted(documents: DataFrame, mixed: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: the columns of ``documents``, each row as often as :func:`mix` takes it, and ``copy`` from 1.

    Rows that agree in doc_id and text share their copies.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = _key(F.lit(params.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    taken = mixed.groupBy(F.col("key").alias("_key")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    found = documents.withColumn("_key", key).dropDuplicates(["_key"]).join(taken, "_key")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_key", "_copies")
