"""A training-data pipeline of five stages, each on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet below the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.llm import decontamination, near_copies, packing, secret_scan, toxicity
from stocktide.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold.

    The model is learned from the labelled documents of ``sf_dir`` that are not
    held out. Null and empty texts hold no term and stay.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (Jaccard of five-word shingles at least 0.8).

    Texts are brought together by the grid join of their SimHash fingerprints and by bands of min-hashes. Rows that repeat the id that stays are one document: the smallest of them
    by its columns stays. Rows without id can't be told apart and stay.
    """
    groups = near_copies.near_copies(docs)
    stays = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    kept = docs.where("doc_id is not null").join(stays, "doc_id", "left_semi")
    one = kept.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return one.unionByName(docs.where("doc_id is null").select(*COLUMNS)).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, edits allowed; null and empty texts stay."""
    return decontamination.remove_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts masked and ``n_chars`` counted anew where one was; null texts stay null."""
    masked = secret_scan.redact(docs.select(*COLUMNS, F.length("text").alias("secret_length")))
    changed = F.length("text") != F.col("secret_length")
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Learned models, similarity joins and packing can't be said in SQL; tests hold the near-dedup stage against a plain version.
ORACLE_SQL: str | None = None


#: Bytes of the Arrow batches that stages send to Python; a batch of whole texts otherwise holds 10,000 of them in every copy made of it.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The session with batches of bounded bytes, and as it was afterwards."""
    name, limit = BATCH_BYTES
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    with small_batches(spark):
        for _, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir))
    return docs
