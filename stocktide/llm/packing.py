"""Best-fit packing into sequences of several permitted lengths.

Rows are dealt to shards of bounded size. In a shard, pieces are placed by
decreasing length into the open bin that they fill best; a piece that fits
nowhere opens a bin of the permitted length of least cost. The permitted lengths
are chosen jointly: the shard is packed once for every smallest length that may
be opened, and the packing of least total cost after downsizing stays. At the
end each bin shrinks to the smallest permitted length that holds its contents.
Only ids and lengths are shuffled, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import staged, text_or_empty

#: Permitted sequence lengths in tokens.
CAPACITIES = (1024, 2048, 4096, 8192)
#: Tokens of a shard, on average: some thousand bins, so its unfilled rest weighs little.
SHARD_TOKENS = 16_000_000
#: Cost of a sequence of length c: c + c * c / ATTENTION + PER_BIN.
ATTENTION, PER_BIN = 32_768.0, 256.0


def bin_cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION + PER_BIN


def _place(lengths: list[int], order: list[int], capacities: tuple[int, ...], least: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of every piece; opened capacity and fill of every bin."""
    free: list[tuple[int, int]] = []  # (room, bin), by room
    where, offset = [0] * len(lengths), [0] * len(lengths)
    opened: list[int] = []
    fill: list[int] = []
    for i in order:
        n = lengths[i]
        k = bisect_left(free, (n, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            fits = [c for c in capacities if c >= max(n, least)] or [c for c in capacities if c >= n]
            room = min(fits, key=lambda c: (bin_cost(c) / c, c))
            b = len(opened)
            opened.append(room)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            insort(free, (room - n, b))
    return where, offset, opened, fill


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece, and the final capacity of every bin. No piece may exceed the largest capacity."""
    capacities = tuple(sorted(capacities))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    best = None
    for least in capacities:
        where, offset, _, fill = _place(lengths, order, capacities, least)
        final = [capacities[bisect_left(capacities, f)] for f in fill]
        cost = sum(map(bin_cost, final))
        if best is None or cost < best[0]:
            best = cost, where, offset, final
    return best[1:] if best else ([], [], [])


def byte_tokens(text_col: str = "text") -> Column:
    """Tokens of a byte-level model: the UTF-8 bytes of the whole text and one end mark."""
    return F.octet_length(text_or_empty(text_col)).cast("long") + 1


def pack(
    docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Place of every piece: ``(id, piece, start, n_tokens, bin_id, capacity, bin_offset)``.

    ``length`` is the number of tokens of a row (default: UTF-8 bytes of
    ``text`` and an end mark, so null and empty texts have one token); rows of
    no token are placed too. A row longer than the largest capacity is cut into
    consecutive pieces, none of it is lost. Repeated rows and null ids are
    placed like any other; ties go by order in the shard, which is fixed by the
    staged length table. An empty table gives no row.
    """
    largest = max(capacities)
    sizes = staged(docs.select(F.col(id_col).cast("long").alias("id"), (byte_tokens() if length is None else length).cast("long").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(1, ceil(total / shard_tokens))
    pieces = (
        sizes.withColumn("row", F.monotonically_increasing_id())
        .select("id", "n", "row", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(largest).cast("long"))).alias("piece", "start"))
        .select("id", "row", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(largest)).alias("n_tokens"))
        .withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([("row", "ascending"), ("piece", "ascending")])  # a shard of bounded size
        lengths = t["n_tokens"].to_pylist()
        where, offset, final = best_fit(lengths, capacities)
        first = t["shard"][0].as_py() << 32
        yield from pa.table({
            "id": t["id"], "piece": t["piece"], "start": t["start"], "n_tokens": t["n_tokens"],
            "bin_id": pa.array([first + b for b in where], pa.int64()), "capacity": pa.array([final[b] for b in where], pa.int32()),
            "bin_offset": pa.array(offset, pa.int32()),
        }).to_batches()

    placed = pieces.groupBy("shard").applyInArrow(run, "id long, piece int, start long, n_tokens long, bin_id long, capacity int, bin_offset int")
    return placed.withColumnRenamed("id", id_col)
