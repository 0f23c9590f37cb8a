"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet in the shared folder and
reads again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, decontaminate, ngram_join, substring_dedup, toxicity
from graphloom.llm.common import drop_table, materialize


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field calls toxic go; one whose rows share an id goes by that row's text alone."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least id."""
    return ngram_join.keep_one(docs, ngram_join.near_duplicates(docs))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of smaller id has too are cut out of the text."""
    return substring_dedup.cut(docs, materialize(substring_dedup.repeats(docs), "removals"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    pairs = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.drop_contaminated(docs, materialize(pairs, "contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip): byte-level BPE, decoded again as a check."""
    return bpe.encode(docs, check=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_copies),
    ("substring_dedup", remove_repeats),
    ("decontamination", remove_benchmark),
    ("byte_bpe", tokenize),
]

#: Training a field and merging token pairs are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return docs
