"""The registered queries of this package's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, chat, decontaminate, langid, ngram_join, substring_dedup, token_frames, toxicity, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of words that an earlier document has too, verbatim or edited, over all documents."""
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies over all documents: one row a document that has one."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, over all documents and items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in shards of independent frames."""
    return token_frames.token_shards(table(spark, sf_dir, "documents"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every vector whose id is divisible by 20."""
    return ann.knn(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one training text."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, decoded again as a check."""
    return bpe.encode(table(spark, sf_dir, "documents"), check=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, spans and verdict, by a field fitted on labelled documents."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language and code length, by models fitted on labelled documents."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.withColumn("bits", F.round("bits", 1))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's canonical URL, the rules that match it and whether it is blocked."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_substring_dedup,
        op2_ngram_join,
        op3_decontaminate,
        op4_token_frames,
        op5_nearest_vectors,
        op6_chat_format,
        op7_bpe,
        op8_toxicity,
        op9_language,
        op10_url_filter,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": chat.SQL, "op10_url_filter": urlfilter.sql()}
