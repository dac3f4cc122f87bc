"""The pipeline on a small folder of tables: the stages' columns, decisions and order."""

import random

import corpus_pipeline
import pytest

from relgraph.llm import classifier, mixing, rules, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    out = str(tmp_path_factory.mktemp("tables"))
    words = ["".join(rng.choice(["th", "er", "on", "an", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(120)) + "." for _ in range(120)]
    bad = [" ".join(rng.choice(["###", "$$$", "&&&"]) for _ in range(90)) for _ in range(40)]
    texts = [*good, *bad, good[3], good[4] + " thering", None, ""]
    spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name == "quality_classifier":
            expected = {r["doc_id"] for r in classifier.classify(before, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in docs.collect()} == expected and set(range(120)) <= expected and not expected & set(range(120, 160))
        elif name == "quality_rules":
            expected = {r["doc_id"] for r in rules.quality_rules(before, *rules._paths()).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == expected and set(range(120)) <= expected
        elif name == "simhash_dedup":
            ids = {r["doc_id"] for r in docs.collect()}
            assert ids == {r["component_id"] for r in simhash.simhash_groups(before).collect()} and 160 not in ids
        elif name == "mix_sources":
            expected = {r["doc_id"]: r["passes"] for r in mixing.mix(before).collect() if r["passes"]}
            found = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert found == expected
        if name != "byte_bpe":
            assert docs.columns == columns
    assert docs.count() == kept["mix_sources"].count()


def test_run_agrees(spark, folder):
    first = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert first and first == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
