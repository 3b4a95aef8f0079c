"""Null ids of documents and benchmark items in decontamination."""

import corpus_pipeline
from vellum.llm import decontamination

ITEM, OTHER = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
DOCS = [(1, f"y {ITEM} z"), (None, f"y {ITEM} z"), (None, f"z {OTHER}"), (None, "clean words and no more of them"), (2, "clean as well and of no item")]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_items_and_documents_without_an_id_are_found(spark):
    items = spark.createDataFrame([(None, ITEM), (7, OTHER), (None, "q q q q q q")], "item_id long, text string")
    got = {tuple(r)[:4] for r in decontamination.find_items(frame(spark, DOCS), items).collect()}
    assert got == {(1, None, 8, 8), (None, None, 8, 8), (None, 7, 8, 8)}


def test_stage_takes_out_documents_without_an_id(spark, tmp_path):
    items = spark.createDataFrame([(None, ITEM), (7, OTHER)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, frame(spark, DOCS), str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(DOCS[3:], key=str)
