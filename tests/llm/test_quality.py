import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from slotledger.llm import quality
from slotledger.llm.shared import ship
from tests.llm.rows import awkward, documents, words


def test_features_of_hand_made_texts():
    x = quality.features(pa.array(["", None, "a a a b", "A! b|", "x\nx\ny z"]))
    get = lambda row, name: x[row, quality.FEATURES.index(name)]
    assert (x[:2] == 0).all()
    assert get(2, "distinct_words") == 0.5 and get(2, "top_word") == 0.75 and get(2, "repeat_words") == 0.5
    assert get(3, "upper_share") == 0.25 and get(3, "shout_share") == 0.25 and get(3, "bar_share") == 0.25 and get(3, "marked_words") == 1
    assert np.isclose(get(4, "distinct_lines"), 2 / 3)


def test_single_and_pair_tables_are_learned():
    """One feature matters alone, two only together."""
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    both = (x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)
    y = ((x[:, 0] > 0.7) | both).astype(float)
    model = quality.fit(x[:3000], y[:3000], quality.QualityParams(pairs=1))
    assert list(model.pairs) == [(1, 2)]
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_without_rows_and_with_one_class():
    x = np.zeros((3, 2))
    assert quality.fit(x[:0], np.zeros(0)).scores(x).tolist() == [0.5, 0.5, 0.5]
    assert (quality.fit(x, np.ones(3)).scores(x) > 0.9).all()


def test_training_and_scoring_tables(spark):
    ship(spark)
    texts = [(k, words(k, 40)) for k in range(100, 160)] + [(k, " ".join(w + "$$$" for w in words(k, 40).split())) for k in range(200, 260)]
    table = documents(spark, texts + awkward()).withColumn("quality", F.lit(0))
    marks = [(i, int(i < 200), 0) for i, _ in texts] + [(None, 1, 0), (100, None, 0), (7, 5, 1), (99_999, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality.train(table, labels, F.col("doc_id") % 4 != 2)
    found = quality.score(table, model).collect()
    assert len(found) == len(texts) + len(awkward()) and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.doc_id and 100 <= r.doc_id < 300 and r.doc_id % 4 == 2]
    assert all(r.predicted == (r.doc_id < 200) for r in held) and len(held) == 30
    kept = quality.keep(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r.predicted for r in found)
    empty = documents(spark, [])
    assert quality.score(empty, quality.train(empty, labels.where("false"), F.lit(True))).collect() == []


def test_held_out_accuracy_on_the_samples(spark):
    from slotledger.llm.queries import op8_additive_quality
    from tests.conftest import SF_DIR

    found = op8_additive_quality(spark, SF_DIR).where("held_out").join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id")
    right, rows = found.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * rows


def test_a_repeated_doc_id_is_one_example(spark):
    ship(spark)
    table = documents(spark, [(1, words(k, 30)) for k in range(300)] + [(2, "$$$ " * 30)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (1, 1)], "doc_id long, quality int")
    model = quality.train(table, labels, F.lit(True), quality.QualityParams(sample=4))
    assert 0 <= quality.score(table, model).where("doc_id = 2").first().score <= 1


def test_ties_and_very_long_texts(spark):
    ship(spark)
    long = words(3, 60_000)
    table = documents(spark, [(1, long), (2, long), (3, "a" * 500_000)])
    model = quality.train(table, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    scores = {r.doc_id: (r.score, r.predicted) for r in quality.score(table, model).collect()}
    assert scores == {k: (0.5, 0) for k in (1, 2, 3)}
    at_the_threshold = quality.score(table, model, quality.QualityParams(threshold=0.5)).collect()
    assert all(r.predicted == 1 for r in at_the_threshold)
