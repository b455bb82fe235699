"""Exact duplicates by a sharded cuckoo-filter index of live digests.

A text's key is the SHA-256 of its normalised form (white space deleted). The
keys are dealt to shards by their first bits. The index of a shard has a cuckoo
filter (16-bit fingerprints, four slots a bucket, two buckets a key) in front of
its content: the live keys in the buckets of their first choice, each with its
count and its best row. A key that the filter does not know is new and goes in
unseen; a hit is verified against the content of its bucket, as the filter may
be wrong. Deleting the last live row of a key takes its fingerprint out again. A
filter that can't place a key is built anew, twice as large, from the stored
keys.

Every task first runs its own rows through a small index and sends one row per
key, so that a text with a third of all copies is one row per task. The rows of
keys that are so frequent that one task would get more than an even share meet
their answer by broadcast (there can't be many of them: ``hot_limit``), all others
by an equal join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import shuffle_partitions, staged

SLOTS, KICKS = 4, 200
#: Keys that a task's own index holds before it is sent on and begun anew.
LOCAL_KEYS = 1 << 17
#: Rows that a shard is meant to hold.
SHARD_ROWS = 1 << 17
SPACES = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))


class CuckooFilter:
    """Set of 64-bit keys by 16-bit fingerprints; may say yes for a key that is not in it, never no for one that is."""

    def __init__(self, log_buckets: int = 6):
        self.log_buckets = log_buckets
        self.mask = np.uint64((1 << log_buckets) - 1)
        self.table = np.zeros((1 << log_buckets, SLOTS), np.uint16)
        self._rng = np.random.default_rng(log_buckets)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = keys & self.mask
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)

    def _settle(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put what finds a free slot into it; True for the rest."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.table[b] == 0
        fits = rank < free.sum(axis=1)
        at = np.argmax(np.cumsum(free[fits], axis=1) == rank[fits][:, None] + 1, axis=1)
        self.table[b[fits], at] = prints[order[fits]]
        left = np.ones(len(b), bool)
        left[order[fits]] = False
        return left

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys; False when some can't be placed, the table is then to be built anew."""
        prints, bucket, second = self._places(keys)
        left = self._settle(bucket, prints)
        prints, bucket = prints[left], second[left]
        for _ in range(KICKS):
            if not len(prints):
                return True
            left = self._settle(bucket, prints)
            prints, bucket = prints[left], bucket[left]
            if not len(prints):
                return True
            _, one = np.unique(bucket, return_index=True)  # one of each full bucket takes the place of another print
            slot = self._rng.integers(0, SLOTS, len(one))
            pushed = self.table[bucket[one], slot]
            self.table[bucket[one], slot] = prints[one]
            prints[one] = pushed
            bucket = self._other(bucket, prints) if len(one) == len(bucket) else np.where(np.isin(np.arange(len(bucket)), one), self._other(bucket, prints), bucket)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out one fingerprint of each key; the keys must be in the set."""
        for print_, first, second in zip(*self._places(keys)):
            for bucket in (first, second):
                slot = np.flatnonzero(self.table[bucket] == print_)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break
            else:
                raise KeyError("a deleted key was not in the filter")


@dataclass
class Entry:
    """A live key: how many rows hold it, and the row that stays."""

    count: int
    points: int
    id: int | None

    def better(self, points: int, id_: int | None) -> bool:
        return (points, id_ is not None, -(id_ or 0)) > (self.points, self.id is not None, -(self.id or 0))


@dataclass
class DigestIndex:
    """Live digests of a shard behind a cuckoo filter."""

    filter: CuckooFilter = field(default_factory=CuckooFilter)
    buckets: dict[int, dict[bytes, Entry]] = field(default_factory=dict)
    size: int = 0
    false_hits: int = 0
    resized: int = 0

    @staticmethod
    def keys(digests: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)

    def _bucket(self, key: int) -> dict[bytes, Entry]:
        return self.buckets.setdefault(key & int(self.filter.mask), {})

    def find(self, digests: list[bytes]) -> list[Entry | None]:
        """The live entries of different digests: the filter first, its hits verified against the content."""
        keys = self.keys(digests)
        found: list[Entry | None] = [None] * len(digests)
        for k in np.flatnonzero(self.filter.contains(keys)).tolist():
            found[k] = self.buckets.get(int(keys[k]) & int(self.filter.mask), {}).get(digests[k])
            self.false_hits += found[k] is None
        return found

    def insert(self, digests: list[bytes], entries: list[Entry]) -> None:
        """Add rows, already counted by digest; the digests differ."""
        new: list[int] = []
        for k, (old, entry) in enumerate(zip(self.find(digests), entries)):
            if old is None:
                new.append(k)
                continue
            old.count += entry.count
            if old.better(entry.points, entry.id):
                old.points, old.id = entry.points, entry.id
        if not new:
            return
        keys = self.keys([digests[k] for k in new])
        for key, k in zip(keys.tolist(), new):
            self._bucket(key)[digests[k]] = entries[k]
        self.size += len(new)
        if self.size > 0.9 * self.filter.table.size or not self.filter.insert(keys):
            self._grow()

    def delete(self, digests: list[bytes], counts: list[int]) -> list[bytes]:
        """Take out so many rows of each digest; returns the digests that are no longer live. Those never inserted are passed over."""
        gone = []
        for d, n, entry in zip(digests, counts, self.find(digests)):
            if entry is None:
                continue
            entry.count -= n
            if entry.count <= 0:
                gone.append(d)
        if gone:
            keys = self.keys(gone)
            self.filter.delete(keys)
            for key, d in zip(keys.tolist(), gone):
                del self.buckets[key & int(self.filter.mask)][d]
            self.size -= len(gone)
        return gone

    def items(self) -> Iterator[tuple[bytes, Entry]]:
        for content in self.buckets.values():
            yield from content.items()

    def _grow(self) -> None:
        """A filter of twice the size (more if need be), filled from the stored keys."""
        stored = list(self.items())
        keys, log_buckets = self.keys([d for d, _ in stored]), self.filter.log_buckets
        while True:
            log_buckets += 1
            self.filter = CuckooFilter(log_buckets)
            self.resized += 1
            if self.size <= 0.9 * self.filter.table.size and self.filter.insert(keys):
                break
        self.buckets = {}
        for key, (d, entry) in zip(keys.tolist(), stored):
            self._bucket(key)[d] = entry


_SENT = "shard long, digest binary, n long, points long, id long"
_SCHEMA = pa.schema([("shard", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("points", pa.int64()), ("id", pa.int64())])


def _shard_of(digest: bytes, shards: int) -> int:
    return int.from_bytes(digest[8:16], "big") * shards >> 64


def _counted(digests: pa.Array, n: np.ndarray, points: np.ndarray, ids: pa.Array) -> tuple[list[bytes], list[Entry]]:
    """The different digests of a batch, each with its count and its best row."""
    coded = digests.dictionary_encode()
    code, different = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    nameless = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((number, nameless, -points, code))
    first = order[np.searchsorted(code[order], np.arange(len(different)))]
    count = np.zeros(len(different), np.int64)
    np.add.at(count, code, n)
    entries = [Entry(c, p, None if gone else k) for c, p, gone, k in
               zip(count.tolist(), points[first].tolist(), nameless[first].tolist(), number[first].tolist())]
    return different, entries


def _sent(index: DigestIndex, shards: int) -> Iterator[pa.RecordBatch]:
    rows = [(_shard_of(d, shards), d, e.count, e.points, e.id) for d, e in index.items()]
    for at in range(0, len(rows), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + (1 << 14)]), _SCHEMA)], schema=_SCHEMA)


def _local(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex()
        for b in batches:
            if b.num_rows:
                index.insert(*_counted(b.column(1), np.ones(b.num_rows, np.int64), b.column(2).to_numpy(), b.column(0)))
            if index.size >= LOCAL_KEYS:
                yield from _sent(index, shards)
                index = DigestIndex()
        yield from _sent(index, shards)

    return run


def _merge(shards: int):
    """Rows sorted by shard: the index of one shard after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, current = DigestIndex(), None
        for b in batches:
            of = b.column(0).to_numpy()
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                if not len(part):
                    continue
                if of[part[0]] != current:
                    yield from _sent(index, shards)
                    index, current = DigestIndex(), of[part[0]]
                rows = b.slice(part[0], len(part))
                index.insert(*_counted(rows.column(1), rows.column(2).to_numpy(), rows.column(3).to_numpy(), rows.column(4)))
        yield from _sent(index, shards)

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, points)`` of every row: SHA-256 of the text without white space, code points of the text as it is."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"), F.length(text).cast("long").alias("points"))


def live_digests(rows: DataFrame, shards: int) -> DataFrame:
    """``(shard, digest, n, points, id)`` of every different digest of ``rows`` (of ``digests``), by the shards' indexes."""
    sent = rows.mapInArrow(_local(shards), _SENT)
    return sent.repartition(shuffle_partitions(rows.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(_merge(shards), _SENT)


def shards_for(rows: int) -> int:
    return max(1, -(-rows // SHARD_ROWS))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``.

    Texts are equal when they are identical after deleting white space
    (``[\\x20\\x09-\\x0D]``); null counts as empty. Of equal texts the row with the
    most code points stays, then the one with the smallest id; a null id comes
    last. Rows that repeat both id and text of the row that stays can't be told
    from it and are all ``kept``. An empty table gives none. Columns other than the
    two named ones are not read.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    rows = staged(digests(docs, id_col, text_col))
    total = rows.count()
    groups = staged(live_digests(rows, max(shards_for(total), partitions)).where("n > 1").select("digest", F.col("n").alias("group_size"), F.col("id").alias("keep_id")))
    # at most 2 * partitions groups hold more rows than half of an even share
    hot_limit = total // (2 * partitions)
    hot, cold = groups.where(F.col("group_size") > hot_limit), groups.where(F.col("group_size") <= hot_limit)
    frequent = rows.join(F.broadcast(hot), "digest")
    others = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest", "left")
    out = frequent.unionByName(others)
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


# The index as a table: one row per live digest, changed shard by shard.


def _by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """Counted digests of ``rows``, pre-aggregated in the tasks."""
    return rows.mapInArrow(_local(shards), _SENT)


def _restored(table: pa.Table) -> DigestIndex:
    index = DigestIndex()
    if table.num_rows:
        index.insert(*_counted(table["digest"].combine_chunks(), table["n"].to_numpy(), table["points"].to_numpy(), table["id"].combine_chunks()))
    return index


def _change(shards: int):
    def run(live: pa.Table, changes: pa.Table) -> pa.Table:
        index = _restored(live)
        signs = changes["sign"].to_numpy()
        for sign in (-1, 1):  # deletions first
            part = changes.filter(pa.array(signs == sign))
            if not part.num_rows:
                continue
            names, entries = _counted(part["digest"].combine_chunks(), part["n"].to_numpy(), part["points"].to_numpy(), part["id"].combine_chunks())
            if sign > 0:
                index.insert(names, entries)
            else:
                index.delete(names, [e.count for e in entries])
        return pa.Table.from_batches(list(_sent(index, shards)), _SCHEMA)

    return run


def change_index(live: DataFrame, inserted: DataFrame, deleted: DataFrame, shards: int) -> DataFrame:
    """The table of live digests after deleting and inserting rows (of ``digests``).

    ``live`` is what ``live_digests`` gave for the same number of shards. A digest
    stays live while rows hold it; deletions of unknown digests do nothing. The
    best row of a digest is the best ever inserted since it became live. Each
    shard's index is restored from its stored keys in one task, so ``shards`` is to
    keep a shard within ``SHARD_ROWS`` digests or so.
    """
    signed = _by_shard(inserted, shards).withColumn("sign", F.lit(1)).unionAll(_by_shard(deleted, shards).withColumn("sign", F.lit(-1)))
    return live.groupBy("shard").cogroup(signed.groupBy("shard")).applyInArrow(_change(shards), _SENT)


def _known(table: pa.Table, asked: pa.Table) -> pa.Table:
    index = _restored(table)
    names = asked["digest"].combine_chunks().unique()
    found = index.find(names.to_pylist()) if len(names) else []
    rows = [(d, e.count, e.id) for d, e in zip(names.to_pylist(), found) if e is not None]
    return pa.table({"digest": pa.array([r[0] for r in rows], pa.binary()), "group_size": pa.array([r[1] for r in rows], pa.int64()), "keep_id": pa.array([r[2] for r in rows], pa.int64())})


def known_digests(live: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """``(digest, group_size, keep_id)`` of those digests of ``rows`` that are live."""
    asked = _by_shard(rows, shards)
    return live.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_known, "digest binary, group_size long, keep_id long")
