"""The stages on a table with planted cases, each on what the one before kept."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choice("kamotanerulisp") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(40)) for i in range(5)]
    clean = {i: prose(rng.randint(60, 400)) for i in range(60)}
    clean[5] = "kamo tane"
    clean[6] = prose(6000)
    base = prose(150)
    planted = {100: None, 101: "", 102: "12 34 ?!", 110: base, 111: base.upper(), 112: base.replace(base.split()[7], "xylo", 1), 113: base + " and more", 120: prose(80) + " " + items[2][1] + ". " + prose(80), 121: items[3][1].title()}
    texts = clean | planted
    rows = [(i, t, "aa" if i % 2 else "bb", "s", len(t or "")) for i, t in texts.items()]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, set(clean)


def test_each_stage_catches_its_cases_and_keeps_the_rest(spark, corpus):
    folder, clean = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id for r in docs.collect()}
        assert clean <= seen[name], name
    assert not {100, 101, 102} & seen["language"]
    assert len({110, 111} & seen["exact_dedup"]) == 1 and {112, 113} <= seen["exact_dedup"]
    assert len({110, 111, 112, 113} & seen["near_dedup"]) == 1
    assert {120, 121} <= seen["near_dedup"] and not {120, 121} & seen["decontamination"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == seen["decontamination"]
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_run_is_the_stages_in_order(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, corpus[0]).select("doc_id").distinct().count() == len(corpus[1]) + 1


def test_an_empty_corpus(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
