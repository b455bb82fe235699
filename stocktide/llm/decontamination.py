"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of words. The CGK walk reads a sequence with a pointer and
gives out the word below it at every step; whether the pointer moves on is a
random bit of (step, word). Two sequences of small edit distance meet again after
an edit and give out mostly the same words, so edit distance becomes Hamming
distance. A table samples a few steps of a walk as its key. Walks start at every
word of a benchmark item and at every ``STRIDE``-th word of a document and run
over item-sized windows; steps are sampled from several horizons, and the walks
and tables are repeated until a passage at the edit limit is found with the
target recall (measured in the tests). Every meeting is verified: the item must
occur in the document with at most ``MAX_EDITS`` of its words inserted, deleted
or replaced.

Short items have no window to speak of and are searched exactly: of one part more
than edits are allowed, some part is unedited, so the parts are looked up word for
word and what they meet is verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import text_or_empty

#: Edits allowed, as a share of the item's words.
MAX_EDITS = 0.2
#: Walks, sampled steps of a key, horizons (steps) of the tables of each walk, documents' words between window starts.
WALKS, SAMPLED, HORIZONS, STRIDE = 4, 7, (12, 16, 22), 3
#: Items with fewer words are looked up by unedited parts, which loses none.
FEWEST_WORDS = 12
#: Items that are searched at once; more are taken block by block, so what tasks hold stays bounded.
ITEM_BLOCK = 20_000
#: Characters of documents whose words are counted through for the window starts, and of those that are embedded at once
#: (a longer document is one piece); some 30 bytes of memory are needed for each character of a piece.
CHUNK_CHARS, PIECE_CHARS = 4_000_000, 500_000
#: Most bits of a table's key filter; it has at least 64 places for each key.
FILTER_BITS = 22

_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Typographic marks and spaces outside ASCII; other characters above 127 count as parts of words.
_MARKS = re.compile(r"[^\x00-\x7f\w]")
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])
_POWERS = np.cumprod(np.full(1024, _PRIME, np.uint64))


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of the words of all texts, one after the other, and the number of words of each.

    Letter case, punctuation and white space do not count. No code is 0.
    """
    parts = [_MARKS.sub(" ", (t or "").lower()).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    inside = _IN_WORD[data]
    turns = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    firsts = np.cumsum(np.array([0] + [len(p) + 1 for p in parts], np.int64))
    sizes = np.diff(np.searchsorted(starts, firsts))
    if not len(starts):
        return np.empty(0, np.uint32), sizes
    before = np.cumsum(lengths) - lengths
    place = np.arange(before[-1] + lengths[-1])
    place -= np.repeat(before, lengths)
    place &= 1023
    mixed = data[inside].astype(np.uint64)
    mixed += np.uint64(1)
    mixed *= _POWERS[place]
    mixed = np.add.reduceat(mixed, before)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _PRIME
    return (mixed >> np.uint64(32)).astype(np.uint32) | np.uint32(1), sizes


def _plan() -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each walk: a multiplier for every step, and the sampled steps of its tables."""
    rng = np.random.default_rng(7)
    return [
        (rng.integers(1, 1 << 31, max(HORIZONS), dtype=np.uint32) * np.uint32(2) + np.uint32(1),
         [np.sort(rng.choice(h, SAMPLED, replace=False)) for h in HORIZONS])
        for _ in range(WALKS)
    ]


def embed(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(table, keys, last word read) of the windows that begin at ``starts``; ``codes`` ends with zeros."""
    for w, (factors, tables) in enumerate(_plan()):
        at = starts.copy()
        keys = [np.zeros(len(starts), np.uint64) for _ in tables]
        for step in range(max(HORIZONS)):
            word = codes[at]
            for t, sampled in enumerate(tables):
                if step in sampled:
                    keys[t] = (keys[t] ^ word) * _PRIME
                    if step == sampled[-1]:
                        yield w * len(tables) + t, keys[t], at.copy()
            mixed = word * factors[step]
            at += ((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(9)) & np.uint32(1)


@dataclass
class ItemIndex:
    """Keys of all windows of a bounded block of items."""

    ids: list[int] = field(default_factory=list)
    words: list[list[int]] = field(default_factory=list)
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    short: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)  # words of a part: its hash: item, offset


def _place(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Places of keys in the filter of a table, whose size is a power of two."""
    return keys >> np.uint64(65 - len(held).bit_length())


def _sequence_hash(words: list[int]) -> int:
    out = 0
    for w in words:
        out = ((out ^ w) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return out


def index_items(items: list[tuple[int, str | None]], max_edits: float = MAX_EDITS) -> ItemIndex:
    index = ItemIndex()
    flat, starts, ends, item_of, offset_of = [], [], [], [], []
    codes, sizes = word_codes([text for _, text in items])
    for (item_id, _), row in zip(items, np.split(codes, np.cumsum(sizes)[:-1])):
        words = row.tolist()
        n = len(index.ids)
        index.ids.append(item_id)
        index.words.append(words)
        if 0 < len(words) < FEWEST_WORDS:
            parts = min(int(max_edits * len(words)) + 1, len(words))
            cuts = [k * len(words) // parts for k in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                index.short.setdefault(b - a, {}).setdefault(_sequence_hash(words[a:b]), []).append((n, a))
        elif words:
            base = len(flat)
            starts += range(base, base + len(words))
            ends += [base + len(words)] * len(words)
            item_of += [n] * len(words)
            offset_of += range(len(words))
            flat += words
    flat += [0] * (max(HORIZONS) + 1)
    ends, item_of, offset_of = np.array(ends), np.array(item_of), np.array(offset_of)
    for table, keys, last in embed(np.array(flat, np.uint32), np.array(starts, np.int64)):
        whole = last < ends  # the window lies in the item
        order = np.argsort(keys[whole], kind="stable")
        sorted_keys = keys[whole][order]
        held = np.zeros(1 << min(FILTER_BITS, (64 * len(sorted_keys) + 1).bit_length()), bool)
        held[_place(sorted_keys, held)] = True
        index.tables[table] = sorted_keys, item_of[whole][order], offset_of[whole][order], held
    return index


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Fewest edits between the item and any stretch of the text, and where the first such stretch ends (bit-parallel)."""
    n = len(item)
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for k, w in enumerate(text):
        eq = places.get(w, 0)
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        up = (minus | ~(d0 | plus)) & full
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(d0 | up)) & full
        minus = up & d0 & full
        if score < best:
            best, end = score, k + 1
    return best, end


def leaks(texts: list[str | None] | pa.Array, index: ItemIndex, max_edits: float = MAX_EDITS) -> Iterator[tuple[int, int, int]]:
    """(text number, item number, edits) of the items that occur in the texts; the strings of one piece are held at a time."""
    piece, held, counted, before = [], 0, 0, 0
    for k, text in enumerate(texts):
        piece.append(text.as_py() if isinstance(text, pa.Scalar) else text)
        held += len(piece[-1] or "")
        whole = counted + held >= CHUNK_CHARS
        if whole or held >= PIECE_CHARS or k == len(texts) - 1:
            codes, sizes = word_codes(piece)
            for doc, item, edits in _piece_leaks(codes, sizes, before, index, max_edits):
                yield k + 1 - len(piece) + doc, item, edits
            counted, before = (0, 0) if whole else (counted + held, before + len(codes) + GAP * len(sizes))
            piece, held = [], 0


#: Zeros between documents, so that no window crosses.
GAP = max(HORIZONS) + 1


def _piece_leaks(words: np.ndarray, sizes: np.ndarray, before: int, index: ItemIndex, max_edits: float) -> Iterator[tuple[int, int, int]]:
    """``leaks`` of texts given as word codes; window starts are counted on from the ``before`` places that lie before them."""
    bases = np.cumsum(sizes) - sizes + GAP * np.arange(len(sizes))
    at = int(bases[-1] + sizes[-1]) if len(sizes) else 0
    codes = np.zeros(at + GAP, np.uint32)
    codes[np.arange(len(words)) + GAP * np.repeat(np.arange(len(sizes)), sizes)] = words
    docs = [codes[b:b + n] for b, n in zip(bases.tolist(), sizes.tolist())]
    yield from _short_leaks(docs, index, max_edits)
    if not index.tables:
        return
    starts = np.arange(-before % STRIDE, at, STRIDE, dtype=np.int64)
    starts = starts[codes[starts] != 0]
    met = []
    for table, keys, _ in embed(codes, starts):
        sorted_keys, item_of, offset_of, bits = index.tables[table]
        hit = np.flatnonzero(bits[_place(keys, bits)])
        low, high = (np.searchsorted(sorted_keys, keys[hit], side) for side in ("left", "right"))
        times = high - low
        entry = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        met.append(np.stack([item_of[entry], np.repeat(starts[hit], times) - offset_of[entry], np.repeat(starts[hit], times)]))
    wanted = np.concatenate(met, axis=1)
    doc_of = np.searchsorted(bases, wanted[2], side="right") - 1
    wanted = np.unique(np.stack([doc_of, wanted[0], wanted[1] - bases[doc_of]]), axis=1)
    best: dict[tuple[int, int], int] = {}
    done: dict[tuple[int, int], int] = {}
    for doc, item, place in wanted.T.tolist():  # places ascend
        pair = doc, item
        if place <= done.get(pair, -len(index.words[item])) or best.get(pair) == 0:
            continue
        words, limit = index.words[item], int(max_edits * len(index.words[item]))
        done[pair] = place + limit  # one look covers all places near it
        stretch = docs[doc][max(0, place - limit):place + len(words) + 2 * limit].tolist()
        there = set(stretch)
        if sum(w in there for w in words) >= len(words) - limit:
            edits = best_match(words, stretch)[0]
            if edits <= limit:
                best[pair] = min(edits, best.get(pair, edits))
    for (doc, item), edits in best.items():
        yield doc, item, edits


def _short_leaks(docs: list[np.ndarray], index: ItemIndex, max_edits: float) -> Iterator[tuple[int, int, int]]:
    known = {n: (np.array(sorted(parts), np.uint64), parts) for n, parts in index.short.items()}
    for doc, words in enumerate(docs if known else []):
        row, best = words.astype(np.uint64), {}
        for n, (wanted, parts) in known.items():
            if len(words) < n:
                continue
            keys = np.zeros(len(words) - n + 1, np.uint64)
            for k in range(n):
                keys = (keys ^ row[k:k + len(keys)]) * _PRIME
            for place in np.flatnonzero(np.isin(keys, wanted)).tolist():
                for item, offset in parts[int(keys[place])]:
                    if best.get(item) == 0:
                        continue
                    look, limit = index.words[item], int(max_edits * len(index.words[item]))
                    stretch = words[max(0, place - offset - limit):place - offset + len(look) + limit].tolist()
                    edits = best_match(look, stretch)[0]
                    if edits <= limit:
                        best[item] = min(edits, best.get(item, edits))
        for item in sorted(best):
            yield doc, item, best[item]


def _item_blocks(items: DataFrame, id_col: str, text_col: str, max_edits: float) -> Iterator[ItemIndex]:
    """Indexes of bounded blocks of the items (rows without id or text hold nothing to look for)."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    blocks = max(1, -(-rows.count() // ITEM_BLOCK))
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).distinct().orderBy("id", "text").collect()
        yield index_items([(r.id, r.text) for r in block], max_edits)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", max_edits: float = MAX_EDITS,
) -> DataFrame:
    """``(id, item_id, edits)`` of every document and item that occurs in it; ``edits`` is 0 for a word-for-word copy.

    Letter case, punctuation and white space do not count. Null and empty texts
    and items without a word match nothing; repeated rows give repeated pairs;
    null document ids are kept as null; of an item id with several texts, each
    is looked for. An empty table on either side gives no row. Whole texts are
    searched.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    def search(index: ItemIndex) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(leaks(b.column(1), shared.value, max_edits))
                ids = b.column(0).take(pa.array([d for d, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([shared.value.ids[i] for _, i, _ in found], pa.int64()), pa.array([e for _, _, e in found], pa.int32())],
                    names=["id", "item_id", "edits"],
                )

        return rows.mapInArrow(run, "id long, item_id long, edits int")

    found = reduce(DataFrame.unionAll, map(search, _item_blocks(items, item_id_col, item_text_col, max_edits)))
    return found.withColumnRenamed("id", id_col)


def remove_leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """``docs`` without the rows whose ``text`` holds an item; all columns stay."""
    spark = docs.sparkSession
    place = docs.columns.index("text")
    for index in _item_blocks(items, "item_id", "text", max_edits):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = {d for d, _, _ in leaks(b.column(place), shared.value, max_edits)}
                yield b.filter(pa.array([k not in found for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
