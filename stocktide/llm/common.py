"""Helpers shared by the training-data operators: staged tables, group ids, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.session import cut_lineage, staged  # noqa: F401

#: Parts that the rows of one hot key are split into before a join that meets one small row for each key.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def held_out(c: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _smallest(edges: DataFrame, key: str, value: str) -> DataFrame:
    return edges.groupBy(key).agg(F.min(value).alias("low"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node of an edge table ``(a, b)``: rows ``(node, component)``.

    ``component`` is the smallest node of the component. Alternating large-star
    and small-star rounds (every round is two grouped minima and two equal
    joins): the edges of a node are never gathered, its minimum is pre-aggregated
    before the shuffle, and each round's edge table is checkpointed. Nodes
    without any edge are not in the result; self loops are ignored.
    """
    e = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _smallest(both, "a", "b").select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut_lineage(large.where("a <> b").distinct())
        # small star: a node and its smaller neighbours are linked to the smallest of them
        low = _smallest(large, "a", "b")
        small = (
            large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionAll(low.select("a", F.col("low").alias("b")))
        )
        e = cut_lineage(small.distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def bounded_sample(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``label`` (all where there are fewer), fixed by a hash of ``key``.

    The size bound is what allows a model to be fitted and broadcast.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("class_size"))
    share = F.lit(float(per_class)) / F.col("class_size")
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(sizes), label).where(place < share).drop("class_size")


def learning_texts(docs: DataFrame, labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """``(text, label)`` of a bounded sample of the labelled ``(doc_id, label)`` rows that may be learned from."""
    usable = labelled.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias(label))
    picked = bounded_sample(usable, label, "doc_id", per_class)
    texts = docs.select(F.col("doc_id"), text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.select("text", label)
