"""Importance resampling towards a target distribution, on hashed word n-grams.

Features are runs of one to three words; a feature's bucket is the CRC-32 of its
bytes modulo ``BUCKETS``. CRC-32 is linear apart from a constant that depends on
the length only: the checksum of a message is that constant XOR the sum (XOR) of
what each byte contributes at its distance from the end. Contributions come from
a table (distance, byte); the words of many texts lie in one array of bytes with
one space between them, so that every feature is a span of it, and
``bitwise_xor.reduceat`` sums over all spans at once. Spans that are longer than
the table are folded block by block: a block's sum, moved by one table's length
of zero bytes, XOR the next block's sum.

A bucket's gain is the log ratio of its smoothed shares in target and corpus; a
document's weight is the sum over its features. Gumbel noise from a hash of the
id makes the highest scores a draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import staged
from stocktide.operators.ordering import global_running

BUCKETS = 10_000
LONGEST = 3
#: Words that are turned into features at once, and distances that the table holds.
BLOCK_WORDS, REACH = 1 << 14, 256
#: Reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


_BYTE = _byte_table()


def _zero_bytes(state: np.ndarray, n: int = 1) -> np.ndarray:
    for _ in range(n):
        state = (state >> np.uint32(8)) ^ _BYTE[state & np.uint32(255)]
    return state


def _position_table() -> np.ndarray:
    """By distance from the end and byte: what the byte adds to the checksum."""
    rows = [_BYTE]
    for _ in range(REACH - 1):
        rows.append(_zero_bytes(rows[-1]))
    return np.stack(rows)


_TABLE = _position_table()
_FLAT = _TABLE.ravel()
#: By byte of a state (lowest first) and its value: the state REACH zero bytes later.
_SHIFT = np.stack([_zero_bytes(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), REACH) for k in range(4)])


def _constants(longest: int) -> np.ndarray:
    """By length: the checksum of so many zero bytes."""
    out, state = np.empty(longest + 1, np.uint32), np.array([0xFFFFFFFF], np.uint32)
    for n in range(longest + 1):
        out[n] = state[0] ^ np.uint32(0xFFFFFFFF)
        state = _zero_bytes(state)
    return out


_CONSTANT = _constants(REACH)


def _moved(state: int) -> int:
    return int(_SHIFT[0][state & 255] ^ _SHIFT[1][state >> 8 & 255] ^ _SHIFT[2][state >> 16 & 255] ^ _SHIFT[3][state >> 24])


def long_crc(span: np.ndarray) -> int:
    """Checksum of one span of any length, folded in blocks of ``REACH`` bytes."""
    head = len(span) % REACH
    # the start value 0xFFFFFFFF is the same as flipping the first four bytes
    flipped = span.copy()
    flipped[:4] ^= np.uint8(255)
    far = np.arange(REACH - 1, -1, -1)
    state = int(np.bitwise_xor.reduce(_TABLE[far[REACH - head:], flipped[:head]])) if head else 0
    for at in range(head, len(span), REACH << 10):
        blocks = flipped[at:at + (REACH << 10)].reshape(-1, REACH)
        for block in np.bitwise_xor.reduce(_TABLE[far, blocks], axis=1).tolist():
            state = _moved(state) ^ block
    return state ^ 0xFFFFFFFF


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for spans of at least one byte."""
    length = ends - starts
    out = np.empty(len(starts), np.uint32)
    short = np.flatnonzero(length <= REACH)
    if len(short):
        n, e = length[short], ends[short]
        first = np.cumsum(n) - n
        back = np.repeat((first + n - 1).astype(np.int32), n) - np.arange(int(n.sum()), dtype=np.int32)  # distance from the end
        byte = data[np.repeat((e - 1).astype(np.int32), n) - back]
        out[short] = np.bitwise_xor.reduceat(_FLAT[(back << 8) | byte], first) ^ _CONSTANT[n]
    for k in np.flatnonzero(length > REACH).tolist():
        out[k] = long_crc(data[starts[k]:ends[k]])
    return out


_CLASS = np.zeros(256, np.uint8)  # by byte: its lower-case form if it belongs to a word, else 0
for _b in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _CLASS[_b] = _b + 32 if 0x41 <= _b < 0x5B else _b


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts: bytes with one space after each word, starts and ends of the words, and number of each word's text."""
    low = _CLASS[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    inside = low != 0
    before = np.concatenate(([False], inside[:-1]))
    closes = ~inside & before
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    owner = np.searchsorted(text_ends, np.flatnonzero(inside & ~before), side="right")
    kept = inside | closes
    data = low[kept]
    ends = np.flatnonzero(data == 0)
    data[ends] = 0x20
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    return data, starts, ends, owner


def feature_blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (number of the text, bucket) for every feature of every text."""
    data, starts, ends, owner = words_of(texts)
    n = len(starts)
    for at in range(0, n, BLOCK_WORDS):
        for k in range(LONGEST):
            stop = min(at + BLOCK_WORDS, n - k)
            if stop <= at:
                continue
            whole = np.flatnonzero(owner[at:stop] == owner[at + k:stop + k]) + at
            if len(whole):
                yield owner[whole], span_crcs(data, starts[whole], ends[whole + k]) % np.uint32(BUCKETS)


#: Bytes of text that are taken together.
BATCH_BYTES = 1 << 22


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of bounded size (a longer one by itself) with the number of the first."""
    first, texts, size = 0, [], 0
    for k, t in enumerate(column):
        text = t.as_py() or b""
        if texts and size + len(text) > BATCH_BYTES:
            yield first, texts
            first, texts, size = k, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, texts in _groups(b.column(0)):
            for _, bucket in feature_blocks(texts):
                total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket, added up in the tasks first; buckets without feature are left out."""
    found = texts.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(_count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """``(bucket, gain)`` of every bucket from the two tables of counts; at most ``BUCKETS`` rows."""
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    all_buckets = corpus.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    rows = all_buckets.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    all_s, all_t = rows.agg(F.sum("s"), F.sum("t")).first()
    dbl = lambda c: c.cast("double")
    ratio = dbl(F.col("t") + 1) * F.lit(float(all_s + BUCKETS)) / (dbl(F.col("s") + 1) * F.lit(float(all_t + BUCKETS)))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for first, texts in _groups(b.column(1)):
                count, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for owner, bucket in feature_blocks(texts):
                    count += np.bincount(owner, minlength=len(texts))
                    edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    total[owner[edge]] += np.add.reduceat(gain[bucket], edge)
                part = slice(first, first + len(texts))
                features[part], weight[part] = count, total
                # n words have n + (n - 1) + (n - 2) features
                words[part] = np.where(count < 3, (count + 1) // 2, (count + 3) // 3)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_features, weight)`` of every row."""
    table = np.zeros(BUCKETS, np.int64)
    for r in gain.collect():  # BUCKETS rows
        table[r["bucket"]] = r["gain"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_weigh(table), "id long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             percent: int = 5, fewest_words: int = 20, seed: int = 42) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of every row of ``docs``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
    case; features are all runs of one to three words, repeats counted. Of the N
    rows with at least ``fewest_words`` words the floor(percent * N / 100) highest
    scores are drawn and ranked from 1, ties to the smaller id; the rank of all
    others is null. Null and empty texts have no feature and weight 0. A null id
    takes its noise from an empty text and comes first among ties; repeated rows
    are ranked one after the other. Without documents there are no rows; without
    target texts every bucket's share in the target is the same. Columns other than
    the named ones are not read.
    """
    table = gains(staged(bucket_counts(docs, text_col)), staged(bucket_counts(target, target_text)))
    rows = staged(weights(docs, table, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = rows.where(F.col("n_words") >= fewest_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc()]
    ranked = global_running(able.withColumn("one", F.lit(1.0)), order, "one")
    rank = F.when(F.col("row_rank") <= drawn, F.col("row_rank")).cast("long")
    out = ranked.select("id", "n_features", "weight", "score", rank.alias("rank"))
    rest = rows.where(F.col("n_words") < fewest_words).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return out.unionAll(rest).withColumnRenamed("id", id_col)
