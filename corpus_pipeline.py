"""A corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, of the
columns of `documents` for all but the last, which gives a row of token digests for each document of the mix.
A stage that finds nothing to drop passes its documents on; null texts are dropped by the quality rules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.llm import bpe, classifier, mixing, rules, simhash
from relgraph.llm.common import shared_dir, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among `docs`, predicts to be good."""
    return classifier.keep_predicted(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and the fertility bands."""
    return rules.keep_good(docs, *rules._paths())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document is there as often as it is taken, up to three times."""
    mixed = mixing.mix(docs, carry=True).where("passes > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("_row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    import public_tokenizers

    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_classifier", classify), ("quality_rules", apply_rules), ("simhash_dedup", near_dedup), ("mix_sources", mix_sources), ("byte_bpe", tokenize)]

#: The classifier and the fingerprints have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what a stage kept is a table in the shared folder, which the next one reads."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
