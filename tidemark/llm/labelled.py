"""A bounded sample of labelled documents, to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches, unit_hash


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, seed: int = 11) -> DataFrame:
    """Rows doc_id, text, y of about per_class documents of either label, drawn by a seeded hash; written and reread.

    labels has doc_id and the column, 0 or 1; rows with a null in either are no labels, and of a repeated doc_id the
    greatest label counts. At most 4 * per_class ids are sent to the documents, whose texts so stay where they are.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    share = {r.y: min(1.0, per_class / r.n) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = known.where(unit_hash(seed, F.col("doc_id")) < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    chosen = chosen.orderBy(unit_hash(seed, F.col("doc_id")), "doc_id").limit(4 * per_class)  # the same ones in each run
    texts = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(texts.join(F.broadcast(chosen), "doc_id"), "labelled")
