import corpus_pipeline
from slotledger.llm import minhash, quality, secrets
from tests.conftest import SF_DIR
from tests.llm.rows import documents, words


def test_stages_keep_their_promises(spark, tmp_path):
    """Each stage against its operator, on what the stage before has kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    at, sizes = {}, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        at[name] = before, docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    before, after = at["near_duplicates"]
    kept = {r.doc_id for r in minhash.near_duplicates(before, minhash.MinHashParams()).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    assert after.subtract(before).count() == 0
    before, after = at["secrets"]
    assert secrets.scan(before, {}).where("size(spans) > 0").count() > 0
    assert secrets.scan(after, {}).where("size(spans) > 0").count() == 0
    before, after = at["packing"]
    whole = {r.doc_id: r.n for r in after.groupBy("doc_id", "doc_tokens").sum("length").toDF("doc_id", "t", "n").collect()}
    assert len(whole) == before.count()


def test_rows_without_an_id_stay(spark):
    docs = documents(spark, [(None, words(1, 80)), (None, words(1, 80)), (1, words(1, 80)), (2, words(1, 80)), (3, None)], clash=False)
    found = corpus_pipeline.distinct(spark, docs, SF_DIR).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 1), (False, 3), (True, 0), (True, 0)]
    assert corpus_pipeline.clean(spark, docs, SF_DIR).columns == corpus_pipeline.COLUMNS
    assert quality.FEATURES
