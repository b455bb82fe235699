"""Embedding near duplicates: randomised-rotation binary codes with correction factors.

A unit vector x is rotated by a random orthonormal matrix and reduced to its
signs s. With f = <s, x> / sqrt(d) (the stored correction factor), the value
<s, y> / (f * sqrt(d)) is an unbiased estimate of <x, y> for any y, and its error
is at most sqrt(1 - f^2) / f * sqrt(1 - <x, y>^2). So a pair whose estimate lies
below the link threshold by more than that bound can't be linked, and only the
others are computed exactly, in double precision.

Which pairs meet: sign bits of further rotations form the keys of several hash
tables; the bits of a key grow with the logarithm of the number of vectors, and
the number of tables follows from ``RECALL`` for a pair right at the threshold
(closer pairs are found with more certainty). A bucket of any size is cut into
blocks, and each pair of blocks is one unit of work, so no vector or pair is
left out and no task grows with a hot bucket. Pairs are counted in the first
table in which they meet, and never leave a unit: it returns sums and at most
one edge for each vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import connected_components, shuffle_partitions, staged

THRESHOLD = 0.9
#: Chance to find a pair of exactly the threshold.
RECALL = 0.995
#: Vectors of a bucket on average, and of a block of a larger bucket.
BUCKET, BLOCK = 128, 1024
#: Pairs that are computed at once.
PAIRS = 1 << 18


def table_shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` vectors."""
    bits = max(6, ceil(log2(max(2, n / BUCKET))))
    meet = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - meet)))


@lru_cache(maxsize=8)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthonormal matrices side by side: dim x (count * dim); the same in every task."""
    rng = np.random.default_rng(20_251 + dim)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)], axis=1)


def keys_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Hash keys, one column for each table."""
    dim = x.shape[1]
    signs = (x @ rotations(dim, ceil(bits * tables / dim) + 1)[:, dim:][:, : bits * tables]) > 0
    return signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows with a dot product of at least ``threshold``; with ``same``, each pair once."""
    dim = x.shape[1]
    turn = rotations(dim, 1)
    xr, yr = (x @ turn).astype(np.float32), (y @ turn).astype(np.float32)
    signs = np.where(xr > 0, np.float32(1), np.float32(-1))
    factor = np.abs(xr).sum(axis=1) / np.float32(dim ** 0.5)
    bound = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * (1 - threshold**2) ** 0.5 + 1e-4
    estimate = (signs @ yr.T) / (factor[:, None] * np.float32(dim ** 0.5))
    unsure = estimate >= (threshold - bound)[:, None]
    if same:
        unsure &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
    if unsure.mean() > 0.05:  # one product of matrices leaves out what is surely too far; what is left is decided as elsewhere
        unsure &= x @ y.T >= threshold - 1e-9
    a, b = np.nonzero(unsure)
    good = np.concatenate([
        np.einsum("ij,ij->i", x[a[k:k + PAIRS // 8]], y[b[k:k + PAIRS // 8]]) >= threshold for k in range(0, len(a), PAIRS // 8)
    ]) if len(a) else np.zeros(0, bool)
    return a[good], b[good]


def _unit_of_work(t: pa.Table, bits: int, tables: int, threshold: float, kind: type) -> pa.RecordBatch | None:
    """Links of one pair of blocks: sums for each vector, and an edge to the smallest it is connected to here."""
    cid, many = t["cid"].to_numpy(), t["many"].to_numpy()
    block, table_no = t["block"].to_numpy(), t["table"][0].as_py()
    x = np.frombuffer(b"".join(t["vector"].to_pylist()), kind).reshape(t.num_rows, -1).astype(float)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    low, high = t["low"][0].as_py(), t["high"][0].as_py()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    a, b = linked_pairs(x[left], x[right], threshold, low == high)
    if not len(a):
        return None
    a, b = left[a], right[b]
    keys = keys_of(x, bits, table_no)
    new = np.ones(len(a), bool)
    for k in range(table_no):
        new &= keys[a, k] != keys[b, k]
    links = np.bincount(a[new], many[b[new]], len(cid)) + np.bincount(b[new], many[a[new]], len(cid))
    label = cid.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        if (label == before).all():
            break
    told = (links > 0) | (label != cid)
    return pa.RecordBatch.from_arrays(
        [pa.array(cid[told]), pa.array(label[told]), pa.array(links[told].astype(np.int64))], names=["a", "b", "links"]
    )


def _meetings(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Every class once in each table: ``(table, key, cid, many, vector)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_dim: dict[int, list[int]] = {}
            for i, n in enumerate(pa.compute.list_value_length(b.column(2)).to_pylist()):
                by_dim.setdefault(n, []).append(i)
            for dim, rows in by_dim.items():
                part = b.take(pa.array(rows))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                # so that no square overflows; a power of two leaves the components as they are
                scaled = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]).astype(x.dtype)
                keys = keys_of(scaled.astype(float), bits, tables)
                vectors = [v.tobytes() for v in scaled]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), pa.array(keys[:, t] * 4096 + dim), part.column(0), part.column(1), pa.array(vectors, pa.binary())],
                        names=["table", "key", "cid", "many", "vector"],
                    )

    return classes.select("cid", "many", "embedding").mapInArrow(run, "table int, key long, cid long, many long, vector binary")


def _links(classes: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    met = _meetings(classes, bits, tables)
    kind = np.float64 if _element(classes, "embedding") == "double" else np.float32
    large = met.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    units = (
        met.join(large, ["table", "key"], "left")
        .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("table", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "many", "vector")
    )
    unit = ["table", "key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            marks = np.stack([b.column(k).to_numpy() for k in range(4)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                mark = tuple(marks[:, start].tolist())
                if mark != last and held:
                    if (done := finish(held)) is not None:
                        yield done
                    held = []
                last = mark
                held.append(b.slice(start, end - start))
        if held and (done := finish(held)) is not None:
            yield done

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        return _unit_of_work(t, bits, tables, threshold, kind) if t.num_rows > 1 else None

    dealt = units.repartition(shuffle_partitions(classes.sparkSession), *unit).sortWithinPartitions(*unit)
    return dealt.mapInArrow(run, "a long, b long, links long")


def _element(rows: DataFrame, c: str) -> str:
    """Type that the components of a vector column are kept in: 32-bit ones as they are, all others as doubles."""
    return "float" if rows.schema[c].dataType.simpleString() == "array<float>" else "double"


def _usable(c: str) -> Column:
    e = F.col(c)
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda v: v != 0)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row.

    Rows with the same vector form one class with a count, so copies are never
    paired. Vectors that are null, empty, zero, or hold null or non-finite
    components, and rows without id, link with nothing: no link, their own id as
    component, kept. Vectors of different length never link. Repeated rows are
    other vectors to each other and link at cosine 1. An empty table gives none.
    """
    kind = _element(rows, vector_col)
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("raw"))
    base = base.withColumn("embedding", F.when(_usable("raw") & F.col("id").isNotNull(), F.transform("raw", lambda v: v + F.lit(0.0).cast(kind))))
    alone = base.where(F.col("embedding").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    usable = base.where(F.col("embedding").isNotNull())
    classes = usable.groupBy("embedding").agg(F.min("id").alias("low_id"), F.count(F.lit(1)).alias("many"))
    classes = staged(staged(classes).withColumn("cid", F.monotonically_increasing_id()))
    bits, tables = table_shape(classes.count(), threshold, recall)
    links = staged(_links(classes, bits, tables, threshold))
    nodes = connected_components(links.select("a", "b"))
    sums = links.groupBy("a").agg(F.sum("links").alias("links"))
    found = (
        classes.join(nodes, F.col("cid") == F.col("node"), "left").join(sums, F.col("cid") == F.col("a"), "left")
        .select("embedding", "low_id", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    )
    names = found.groupBy("component").agg(F.min("low_id").alias("component_id"))
    named = found.join(names, "component").select(F.col("embedding").alias("same"), F.xxhash64("embedding").alias("key"), "n_links", "component_id")
    linked = usable.withColumn("key", F.xxhash64("embedding")).join(named, "key").where(F.col("embedding") == F.col("same"))
    out = linked.select("id", "n_links", "component_id").unionAll(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
