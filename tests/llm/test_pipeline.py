"""Stages one by one, each against its operator on that stage's own input."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from quarry.llm.common import materialize

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, kept = docs, {}
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, before, SF), f"test-{name}")
        if name != "packing":
            assert docs.columns == before.columns and docs.schema == before.schema
            kept[name] = {r.doc_id: r for r in docs.collect()}
            before = docs
    good = [i for i, r in labels.items() if r.quality == 1]
    assert sum(i not in kept["quality"] for i in good) <= 0.02 * len(good)
    junk = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in kept["quality"] for i in junk) <= 0.2 * len(junk)
    texts = [r.text for r in kept["near_duplicates"].values()]
    assert len(set(texts)) == len(texts) < len(kept["toxicity"])
    assert len(kept["personal_data"]) == len(kept["near_duplicates"])
    assert not any("@mail" in r.text for r in kept["personal_data"].values())
    assert all(r.n_chars == len(r.text) for r in kept["personal_data"].values())
    tokens = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in tokens} == set(kept["personal_data"]) and all(r.n == r.m for r in tokens)


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (3, "some words to keep here " * 10, "en", None, 240), (3, "some words to keep here " * 10, "en", None, 240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        if name != "quality":  # it may judge such texts as it likes
            stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_document_of_each_group(spark):
    one = " ".join(f"w{i}" for i in range(60))
    rows = [(3, one, 1), (3, one, 2), (4, one + " more", 3), (9, "another text of a few words", 4), (9, "and a second of this id", 5), (None, one, 6), (7, None, 7), (7, None, 8), (8, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = cp.STAGES[2][1](spark, docs, SF)
    assert got.schema == docs.schema
    kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    assert kept == [(0, one), (3, one), (7, ""), (8, ""), (9, "and a second of this id")]


def test_columns_of_the_stages_names_stay(spark):
    names = ["_score", "_candidates", "_spans", "component_id", "label", "count", "row"]
    rows = [(i, f"Some fine words to keep, number {i}, written to a@mail.com by hand.", "en", "s", 5, *[i] * len(names)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.schema == docs.schema, name
        assert all(r[n] == r.doc_id for r in got.collect() for n in names)
