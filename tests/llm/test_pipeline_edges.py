"""The pipeline's stages on nulls, empty and repeated rows, empty tables and clashing columns; its first stage against the classifier's own parts."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import common, surrogates

SF = "/root/testdata/sf0.001"


def test_stages_take_what_may_come(spark):
    text = "such a plain text of more than five words, mail jane@example.com"
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, text + " twice"), (5, "x" * 60_000), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, 7, "k", 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_entities int, entity_kinds string, score double")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = common.stored(stage(spark, now, SF))
            if name != "pieces":
                assert now.columns == given.columns, name
        assert (now.count() > 0) == (given is docs)
    kept = {r.doc_id for r in now.collect()}
    assert kept == set() and now.columns[:2] == ["doc_id", "ids"]


def test_no_found_value_survives_on_a_whole_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in surrogates.replaced(documents, "key").collect()}
    patterns = [r"[\w.+-]+@[\w-]+\.[\w.]+\w", r"(?<!\d)\d{16}(?!\d)", r"AKIA\w{16}", r"password=\w+", r"token = \"[0-9a-f]{40}\"", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", r"\+\d[\d ()-]{8,}\d"]
    seen = 0
    for r in documents.collect():
        for p in patterns:
            for value in set(re.findall(p, r.text or "")):
                seen += 1
                assert value not in got[r.doc_id].text, (r.doc_id, value)
    assert seen > 20


def test_toxic_documents_go_and_others_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01")
    both = docs.select("doc_id").join(labels, "doc_id").join(kept.select("doc_id", F.lit(True).alias("kept")), "doc_id", "left").toPandas()
    assert both[both.toxic == 1].kept.isna().mean() > 0.6 and both[both.toxic == 0].kept.notna().mean() > 0.97  # some 300 labels teach; on larger tables it is above 0.85
