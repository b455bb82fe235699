"""SimHash near duplicates: fingerprints, segment-popcount grid join, components.

Two fingerprints are linked when they differ in few bits. The 64 bits are cut
into 32 segments of two; the bit counts of the segments are a point in a grid,
and the Manhattan distance of two points never exceeds the Hamming distance of
the fingerprints. The segments form three blocks; of a distance of at most 4,
some two blocks hold at most 2, so two linked points meet in a cell at Manhattan
distance at most 1 from both of them in those two blocks. Every point is sent to
these cells (about 33 for each pair of blocks); what meets in a cell is tested
by the Manhattan bound and then exactly. Unrelated fingerprints meet in a cell
with a probability below one in a million.

A cell that holds more than ``CELL`` points (thousands of near copies) is not
paired. All its points take another exact way: two fingerprints differ in at
most 4 bits if and only if some 64-bit value differs from both in at most 2, so
each sends its 2,081 such values and is linked to the smallest fingerprint that
meets it there. A value is met by at most 2,081 different fingerprints, so this
way is linear and has no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import connected_components, shuffle_partitions, staged

#: Most fingerprints of a grid cell that are compared pair by pair.
CELL = 512
#: Largest number of differing bits of a link; the grid join is built for it.
MAX_BITS = 4
LOW_BITS = 0x5555555555555555


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a whole text, in order; none when it has no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    flat = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    hash64 = xxhash.xxh64_intdigest
    return np.fromiter(
        (hash64(flat[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n
    )


def simhash_of(hashes: np.ndarray) -> int:
    bits, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        block = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of the word shingles of a whole text; 0 when it has no word."""
    return simhash_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _thermometer(fp: Column) -> Column:
    """Segment counts 0, 1, 2 written as bits 00, 01, 11: their Manhattan distance is the bit count of an xor."""
    next_bit = F.shiftrightunsigned(fp, 1)
    low = fp.bitwiseOR(next_bit).bitwiseAND(F.lit(LOW_BITS))
    high = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(F.shiftleft(high, 1))


#: Segments of a grid: those of two of the three blocks 0-10, 11-21, 22-31.
GRIDS = ((*range(0, 22),), (*range(0, 11), *range(22, 32)), (*range(11, 32),))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _sent(t: Column, grid: int) -> Column:
    """Keys of the cells of one grid within Manhattan distance 1 of a point; the grid's number is in the top bits."""
    low22, high20 = F.lit((1 << 22) - 1), F.shiftrightunsigned(t, 44)
    at = (
        t.bitwiseAND(F.lit((1 << 44) - 1)),
        t.bitwiseAND(low22).bitwiseOR(F.shiftleft(high20, 22)),
        F.shiftrightunsigned(t, 22),
    )[grid].bitwiseOR(F.lit(grid << 60))
    cells = [at]
    for k in range(len(GRIDS[grid])):
        low, high = F.lit(1 << (2 * k)), F.lit(2 << (2 * k))
        cells.append(F.when(at.bitwiseAND(high) == 0, at.bitwiseXOR(low)))  # 0 <-> 1
        cells.append(F.when(at.bitwiseAND(low) != 0, at.bitwiseXOR(high)))  # 1 <-> 2
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


def _meet(cell: int):
    """Streams rows sorted by key: pairs of fingerprints that meet and are close, or (fp, null) where a cell is too full."""

    def thermometer(fp: np.ndarray) -> np.ndarray:
        bits = np.uint64(LOW_BITS)
        return ((fp | (fp >> np.uint64(1))) & bits) | ((fp & (fp >> np.uint64(1)) & bits) << np.uint64(1))

    def pairs(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        points, apart = thermometer(fps), 1
        at = np.flatnonzero(keys[1:] == keys[:-1])
        while len(at):
            near = at[np.bitwise_count(points[at] ^ points[at + apart]) <= MAX_BITS]  # Manhattan distance: a lower bound
            near = near[np.bitwise_count(fps[near] ^ fps[near + apart]) <= MAX_BITS]
            if len(near):
                yield fps[near], fps[near + apart]
            apart += 1
            at = at[at + apart < len(keys)]
            at = at[keys[at] == keys[at + apart]]

    def batch(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, full = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
            last = np.searchsorted(keys, keys[-1])  # the last cell may go on in the next batch
            whole_keys, whole = keys[:last], fps[:last]
            keys, fps = keys[last:], fps[last:]
            if len(whole):
                _, start, size = np.unique(whole_keys, return_index=True, return_counts=True)
                crowded = np.repeat((size > cell) | (whole_keys[start] == full), size) if full is not None else np.repeat(size > cell, size)
                if crowded.any():
                    yield batch(whole[crowded], None)
                for found in pairs(whole_keys[~crowded], whole[~crowded]):
                    yield batch(*found)
                full = None
            if len(keys) > cell:  # nothing of a crowded cell is kept
                full = keys[0]
                yield batch(fps, None)
                keys, fps = keys[:0], fps[:0]
            elif full is not None and len(keys) and keys[0] == full:
                yield batch(fps, None)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            if len(keys) > cell or keys[0] == full:
                yield batch(fps, None)
            else:
                for found in pairs(keys, fps):
                    yield batch(*found)

    return run


def _ball(fp: Column) -> Column:
    """All values that differ from ``fp`` in at most two bits."""
    one = [1 << k for k in range(64)]
    masks = [0, *one, *(a | b for a, b in combinations(one, 2))]
    signed = F.array(*[F.lit(_signed(m)) for m in masks])
    return F.transform(signed, lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges ``(a, b)`` between different fingerprints ``fp`` of at most four differing bits.

    Pairs that meet in cells of at most ``cell`` points come out whole; the
    points of fuller cells come out with enough edges to connect what is linked.
    """
    partitions = shuffle_partitions(distinct.sparkSession)
    t = _thermometer(F.col("fp"))
    sent = distinct.repartition(partitions).select(F.explode(F.concat(*[_sent(t, g) for g in range(3)])).alias("key"), "fp")
    met = sent.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_meet(cell), "a long, b long")
    met = staged(met.distinct())
    pairs = met.where("b is not null")
    crowded = met.where("b is null").select(F.col("a").alias("fp"))
    ball = crowded.select("fp", F.explode(_ball(F.col("fp"))).alias("value"))
    low = ball.groupBy("value").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("value", "low")
    star = ball.join(low, "value").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.unionAll(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, cell: int = CELL) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most four
    differing bits, the row's own included. A null or blank text has
    fingerprint zero and links like any other; repeated rows and ids give one
    row each; ids that are null are never chosen as component, so rows whose
    whole component lacks ids have a null component. An empty table gives none.
    Columns other than the two named ones are not read.
    """
    fps = staged(fingerprints(docs, id_col, text_col, words))
    classes = fps.groupBy("fp").agg(F.min("id").alias("low_id"))
    nodes = connected_components(links(classes.select("fp"), cell))
    found = classes.join(nodes, F.col("fp") == F.col("node"), "left").select(
        "fp", "low_id", F.coalesce("component", "fp").alias("component")
    )
    names = found.groupBy("component").agg(F.min("low_id").alias("component_id"))
    named = found.join(names, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
