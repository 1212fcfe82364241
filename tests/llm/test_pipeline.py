"""The stages of the pipeline on awkward rows, and the whole of it on a small table."""

import importlib

import pytest
from pyspark.sql import functions as F
from test_documents import AWKWARD, BASE, NEAR, frame, text_of

corpus_pipeline = importlib.import_module("corpus_pipeline")
LINE = "A line that many of these documents have in common"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    item = text_of(300, 25) + ". " + text_of(301, 9) + "."
    own = [(100 + i, f"{text_of(800 + i, 120)}\n{LINE}\n{text_of(900 + i, 20)}") for i in range(12)]
    rows = [*AWKWARD, *own, (200, own[0][1]), (201, own[1][1] + " end"), (202, f"{text_of(5, 90)} {item} {text_of(6, 60)}"), (203, "spam spam " * 60), (6, text_of(77, 90))]
    frame(spark, rows).withColumnRenamed("fp", "_row").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.mark.parametrize("k", range(5))
def test_a_stage_keeps_columns_and_handles_awkward_rows(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, sf)
    ids = {r.doc_id for r in out.collect()}
    if k < 4:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert stage(spark, docs.limit(0), sf).count() == 0
    good = set(range(100, 112))
    if name == "quality rules":
        assert good <= ids and not ids & {0, 1, 2, 3, 203}
    if name == "line dedup":
        kept = {r.doc_id: r.text for r in out.collect() if r.doc_id and r.doc_id >= 100}
        assert out.count() == docs.count() and [d for d, t in kept.items() if LINE in t] == [201] and BASE in {r.text for r in out.collect()}
    if name == "n-gram Jaccard join":
        texts = [(r.doc_id, r.text) for r in out.collect()]
        assert good <= ids and not ids & {5, 200, 201} and (6, NEAR) not in texts and (6, text_of(77, 90)) in texts and len(texts) == len(set(texts))
        assert {0, 1, 2, 3, 4, 7, 8, None} <= ids
    if name == "benchmark decontamination":
        assert out.count() == docs.count() - 1 and 202 not in ids
    if name == "mixing to target weights":
        assert ids and out.filter("weight < 1 OR probability > 1").count() == 0


def test_run_is_the_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), stage(spark, docs, sf).schema)
    got = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted(str(tuple(r)) for r in df.select("doc_id", F.md5(F.coalesce("text", F.lit(""))), "probability").collect())
    assert key(got) == key(docs) and got.count()
