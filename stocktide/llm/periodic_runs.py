"""Periodic runs of words, found by online dyadic square catching.

The words of a text are appended from left to right. Every completed block of
2**k words (aligned at multiples of 2**k) has a catcher: it waits for its block
to come again as a suffix of what was appended, at a distance of 2*2**k - 1 to
4*2**k - 2 words. At any moment exactly two blocks of a size are at such a
distance, so an appended word costs two suffix comparisons per size; suffixes
are compared by names (64-bit hashes of 2**k words, made of two names of the
size below). A square of period q has, for the size with 2*2**k - 1 <= q <=
4*2**k - 2, a whole block in its first half that comes again q words later, so
no square is missed. Catches of neighbouring blocks at one distance merge, are
carried on to both sides by names of falling size, and give a run if the stretch
is at least as long as its period; the words of each run are compared at last.

Texts are appended to one catcher many at a time, kept apart by words that occur
once, so that numpy works on long arrays whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run.
LEAST = 12
#: Words that are gathered from several texts, and words appended at once.
BATCH_WORDS, STEP = 1 << 17, 1 << 15

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left ^ (left >> np.uint64(32))) * _A + (right ^ (right >> np.uint64(29))) * _B
    return (h ^ (h >> np.uint64(32))) * _C


class SquareCatchers:
    """Squares of a growing sequence of word numbers; ``longest`` bounds the text that a square can lie in."""

    def __init__(self, capacity: int, longest: int | None = None):
        self.words = np.empty(capacity, np.int64)
        self.longest = capacity if longest is None else longest
        self.size = 0
        self.names: list[np.ndarray] = []  # by k: names of the 2**k words from each position on
        self.named: list[int] = []
        self.caught: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by k: (distances, first words of blocks)

    def append(self, words: np.ndarray) -> None:
        self.words[self.size:self.size + len(words)] = words
        self.size += len(words)
        k = 0
        while 3 * (1 << k) - 1 <= min(self.size, self.longest):
            self._advance(k)
            k += 1

    def _advance(self, k: int) -> None:
        block = 1 << k
        if k == len(self.names):
            self.names.append(np.empty(len(self.words), np.uint64))
            self.named.append(0)
            self.caught.append([])
        first, last = self.named[k], self.size - block + 1
        if first >= last:
            return
        names = self.names[k]
        if k == 0:
            names[first:last] = _joined(self.words[first:last].view(np.uint64), np.zeros(1, np.uint64))
        else:
            half = self.names[k - 1]
            names[first:last] = _joined(half[first:last], half[first + block // 2:last + block // 2])
        self.named[k] = last
        suffix = np.arange(max(first, 2 * block - 1), last)
        for later in (0, 1):  # the two blocks that are at the right distance
            start = ((suffix - (2 * block - 1)) >> k << k) - later * block
            if later:
                suffix, start = suffix[start >= 0], start[start >= 0]
            hit = np.flatnonzero(names[suffix] == names[start])
            if len(hit):
                self.caught[k].append((suffix[hit] - start[hit], start[hit]))

    def runs(self, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and smallest periods of all maximal runs so far, by start, then period."""
        found = [self._merged(k) for k, caught in enumerate(self.caught) if caught]
        if not found:
            return (np.empty(0, np.int64),) * 3
        low, high, period = (np.concatenate(x) for x in zip(*found))
        long = (high - low >= period) & (high + period - low >= least)
        low, end, period = low[long], (high + period)[long], period[long]
        order = np.lexsort((period, end, low))
        low, end, period = low[order], end[order], period[order]
        if len(low):  # the multiples of a run's period give the same words
            new = np.concatenate(([True], (low[1:] != low[:-1]) | (end[1:] != end[:-1])))
            low, end, period = low[new], end[new], period[new]
        true = [np.array_equal(self.words[a:b - q], self.words[a + q:b]) for a, b, q in zip(low.tolist(), end.tolist(), period.tolist())]
        if not all(true):
            raise ArithmeticError("two different stretches of words have one name")
        order = np.lexsort((period, low))
        return low[order], (end - low)[order], period[order]

    def _merged(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches [low, high) whose words come again ``period`` words later, as long as they can be."""
        block = 1 << k
        distance, start = (np.concatenate(x) for x in zip(*self.caught[k]))
        order = np.lexsort((start, distance))
        distance, start = distance[order], start[order]
        new = np.flatnonzero(np.concatenate(([True], (distance[1:] != distance[:-1]) | (start[1:] - start[:-1] != block))))
        low, period = start[new].copy(), distance[new]
        high = start[np.append(new[1:], len(start)) - 1] + block
        for j in range(k - 1, -1, -1):  # what is left on either side is shorter than a block
            step, names = 1 << j, self.names[j]
            at = np.flatnonzero(high + period + step <= self.size)
            more = at[names[high[at]] == names[high[at] + period[at]]]
            high[more] += step
            at = np.flatnonzero(low >= step)
            more = at[names[low[at] - step] == names[low[at] - step + period[at]]]
            low[more] -= step
        return low, high, period


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> Iterator[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words."""
    seen: dict[bytes, int] = {}
    numbers = []
    for k, words in enumerate(texts):
        numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
        numbers.append(np.array([-1 - k], np.int64))  # a word that occurs nowhere else
    flat = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    catchers = SquareCatchers(len(flat), max(map(len, texts), default=0))
    for at in range(0, len(flat), STEP):
        catchers.append(flat[at:at + STEP])
    start, length, period = catchers.runs(least)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(start, np.concatenate(([0], ends)))
    for k in range(len(texts)):
        part = slice(cut[k], cut[k + 1])
        first = int(ends[k]) - len(texts[k]) - 1
        yield list(zip((start[part] - first).tolist(), length[part].tolist(), period[part].tolist()))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space between them, without those in a run after its first period."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _search(least: int):
    def batch(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = list(runs_of_texts(texts, least))
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, _RUNS),
             pa.array([collapsed(t, r) for t, r in zip(texts, found)], pa.binary())],
            names=["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = (text.as_py() or b"").split()
                ids.append(key)
                texts.append(words)
                held += len(words) + 1
                if held >= BATCH_WORDS:
                    yield batch(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield batch(ids, texts)

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of every row of ``docs``; nothing is shuffled.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` holds (start,
    length, period) of every stretch of at least ``least`` words and two smallest
    periods that can't be made longer, by start, then period. ``collapsed`` is the
    text without the words that lie in a run after its first period. Null, empty
    and blank texts have no words and no runs; a long text is one sequence, however
    long; repeated rows and null ids give one row each; an empty table gives none.
    Columns other than the two named ones are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(_search(least), "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: one document in ten, by crc32 of its id, has the words from a place on replaced by a repeated stretch.

    With h that hash, g = floor(h / 10) and n words, the place is a = g % n and the
    period p = 1 + floor((n - a) / (3 + g % 8)). Rows without id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", F.coalesce(h % 10 == 0, F.lit(False)).alias("chosen"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("chosen"), F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    d = d.withColumn("words", words).withColumn("n", F.size("words"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.concat_ws(" ", F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))))
    return d.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), turned).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each document and digests of all its runs and of its collapsed text."""
    longest = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"]).cast("int"))
                                 .when(x["start"] != y["start"], F.sign(x["start"] - y["start"]).cast("int"))
                                 .otherwise(F.sign(x["period"] - y["period"]).cast("int"))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = F.col("top")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
