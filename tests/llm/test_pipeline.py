"""The corpus pipeline: stages alone on awkward rows, and all of them on the smallest tables."""

import pytest
from helpers import AWKWARD, awkward

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_takes_awkward_rows(spark, stage):
    docs = awkward(spark)
    kept = stage[1](spark, docs, DATA)
    if stage[0] != "packing":
        assert kept.columns == docs.columns
    n = kept.count()
    if stage[0] == "suffix_dedup":
        assert n == len(AWKWARD)
    if stage[0] == "jaccard_join":
        assert n == len(AWKWARD) - 1 and kept.where("doc_id = 4").count() == 1
    assert stage[1](spark, docs.limit(0), DATA).count() == 0


def test_near_copies_leave_one_of_each_class(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    from weftgraph.llm import jaccard_join

    classes = {r["class_id"] for r in jaccard_join.link(docs).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_copy_stage(spark, docs, DATA).collect()} == classes


def test_near_copies_deal_out_each_text_once_to_choose(spark, capsys):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    corpus_pipeline.near_copy_stage(spark, docs.unionByName(docs), DATA).explain()
    above, found, _ = capsys.readouterr().out.partition("LeftSemi")
    assert found and "Exchange" not in above


def test_good_labelled_documents_pass_the_filters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    good = docs.join(good, "doc_id", "left_semi")
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.quality_stage):
        kept = stage(spark, docs, "/root/testdata/sf0.01")
        assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()


def test_run_gives_packed_pieces(spark):
    packed = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(packed.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 4096
