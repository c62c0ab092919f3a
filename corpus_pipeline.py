"""The corpus pipeline: STAGES in order, each stage's rows written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, mixing, token_store, toxicity
from tidemark.llm.common import scratch, stored
from tidemark.llm.queries import table, tokenizer_path

#: Ids of dropped copies that are sent to the texts, 8 bytes each; beyond that texts are shuffled to meet them.
SENT_IDS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the machine, fitted on the labels of these documents, scores below 0.5, each by its own text.

    Null and empty texts have the score of no terms; null ids and repeated rows are rows like others; rows stay in place.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one document of each component of near copies, the one with the least doc_id.

    Rows that repeat it all stay; so do texts without words and rows with a null id. Of an id with different texts that
    are told apart, all go if one of them is a copy of a lesser id's.
    """
    found = jaccard_join.jaccard_components(docs)
    copies = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_copy_id")).distinct(), "copies")
    few = copies.count() <= SENT_IDS
    return docs.join(F.broadcast(copies) if few else copies, docs.doc_id == F.col("_copy_id"), "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs, each by its own text; null texts have none, rows stay in place."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice; null ids and repeated rows are rows like others."""
    return mixing.apply_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary files, and from these each document's doc_id, start, n_tokens and ids_crc32."""
    return token_store.encode_and_read(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
#: SQL has no tokenizer and no fitted machine; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
