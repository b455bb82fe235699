"""Near copies by Jaccard similarity of word shingles: min-hash bands, SimHash filter, exact check, components.

Texts meet in two ways. The grid join of ``simhash`` brings together all texts
whose fingerprints are equal or differ in at most four bits. Texts at Jaccard 0.8
differ in about 6 to 13 of the 64 bits, too many for it; these meet in bands of
min-hashes (a pair at the limit shares one of the bands with a probability of
about 0.998), where a meeting whose fingerprints differ in more than ``MAX_BITS`` bits is dropped, the
bit counts of segments being the lower bound that is tested first. Every
meeting is then checked on the shingles of the whole texts.

Bands may hold thousands of near copies, so their pairs are never made. First
each text of a band is checked with the smallest one, which settles most of a
crowd in linear work. Bands that still hold several components (one of those with
the same texts) are cut into blocks of bounded size; every pair of blocks is a
unit of work in which the shared shingles of all texts are counted by matrix products,
and gives one link for each two components that it joins. So no link that could
join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import connected_components, shuffle_partitions, staged, text_or_empty
from stocktide.llm import simhash
from stocktide.llm.simhash import LOW_BITS, shingle_hashes, simhash_of

WORDS, LIMIT = 5, 0.8
#: Bands and min-hashes of a band: a pair at the limit shares a band with probability 1 - (1 - 0.8**6)**20 = 0.998.
BANDS, ROWS = 20, 6
#: Differing bits at Jaccard 0.8 are about 10 with a deviation of 3: 20 bits keep 0.9995 of the pairs.
MAX_BITS = 20

_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_key(text: str) -> int:
    """Code of the words of a text; 0 when it has none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(tokens)) if tokens else 0


def bands(hashes: np.ndarray) -> list[int]:
    """Band keys of a set of shingle hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        block = (hashes[at:at + 2048, None] ^ _XOR) * _FACTORS
        low = np.minimum(low, block.min(axis=0))
    return [xxhash.xxh3_64_intdigest(part.tobytes(), seed=k) for k, part in enumerate(low.reshape(BANDS, ROWS))]


def _signed(values) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _signed(text_key(t.as_py()) for t in b.column(1))], names=["id", "node"])


_SKETCH = "node long, fp long, size long, keys array<long>"


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, sizes, keys = [], [], [], []
            for node, text in dict(zip(b.column(0).to_pylist(), b.column(1))).items():
                hashes = shingle_hashes(text.as_py(), words)
                if len(hashes):
                    nodes.append(node)
                    fps.append(simhash_of(hashes))
                    different = np.unique(hashes)
                    sizes.append(len(different))
                    keys.append(np.array(bands(different), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _signed(fps), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["node", "fp", "size", "keys"])

    return run


def _hashed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return run


#: Bits of a node that choose a row of the filter, at most 2**18 rows of 64 places each however many nodes there are.
FILTER_ROWS = 18


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose node is in ``nodes``.

    A bit filter of bounded size, broadcast, drops nearly all other texts where
    they are read, so only what is left is shuffled for the exact join.
    """
    row, bit = f"shiftrightunsigned(node, {64 - FILTER_ROWS})", f"shiftleft(1L, CAST(shiftrightunsigned(node, {58 - FILTER_ROWS}) & 63 AS INT))"
    held = nodes.groupBy(F.expr(row).alias("row")).agg(F.expr(f"bit_or({bit})").alias("bits"))
    near = texts.withColumn("row", F.expr(row)).join(F.broadcast(held), "row").where(F.expr(f"bits & {bit} <> 0"))
    return near.select("node", "text").join(nodes.distinct(), "node")


def _sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, hashes)`` of the given nodes only: their sorted shingle hashes. All texts of a node have the same."""
    found = _texts_of(texts, nodes).mapInArrow(_hashed(words), "node long, hashes binary")
    return staged(found.groupBy("node").agg(F.first("hashes").alias("hashes")))


def _segments(fp: np.ndarray) -> np.ndarray:
    bits, one = np.uint64(LOW_BITS), np.uint64(1)
    return ((fp | (fp >> one)) & bits) | ((fp & (fp >> one) & bits) << one)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints differ in at most ``MAX_BITS`` bits; segment counts are a lower bound of the distance."""
    near = np.bitwise_count(_segments(a) ^ _segments(b)) <= MAX_BITS
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= MAX_BITS
    return near


def _first_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node: each with the first one of its key."""
    head = None  # key, node, fingerprint
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in b.columns])
        if head is not None:
            rows = np.concatenate([head, rows], axis=1)
        starts = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        first = np.repeat(starts, np.diff(np.append(starts, rows.shape[1])))
        at = np.flatnonzero((first != np.arange(len(first))) & (rows[1] != rows[1][first]))
        at = at[close(rows[2][first[at]].view(np.uint64), rows[2][at].view(np.uint64))]
        yield pa.RecordBatch.from_arrays([pa.array(rows[1][first[at]]), pa.array(rows[1][at])], names=["a", "b"])
        head = rows[:, first[-1]:first[-1] + 1].copy()


def _grid_meetings(sketches: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of texts that the SimHash grid join links: the smallest texts of two near fingerprints, and every text with the smallest one of its own."""
    first = staged(sketches.groupBy("fp").agg(F.min("node").alias("first")))
    same = sketches.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = lambda fp, name: first.select(F.col("fp").alias(fp), F.col("first").alias(name))
    near = simhash.links(first.select("fp")).join(side("a", "x"), "a").join(side("b", "y"), "b")
    return same.unionAll(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _similar(x: np.ndarray, y: np.ndarray, limit: float) -> bool:
    if min(len(x), len(y)) < limit * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= limit * (len(x) + len(y) - both)


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _check(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [_similar(_set(x), _set(y), limit) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, limit: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets of shingle hashes have at least the wanted Jaccard similarity."""
    side = lambda name, other: sets.select(F.col("node").alias(name), F.col("hashes").alias(other))
    sides = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")
    return staged(sides.select("a", "b", "left", "right").mapInArrow(_check(limit), "a long, b long"))


#: Most texts and bytes of shingle hashes of a block; shingles that are counted at once.
BLOCK, BLOCK_BYTES, SLAB = 1024, 1 << 25, 4096


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every two sets."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    values, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    several = times > 1
    number, owner = (np.cumsum(several) - 1)[number][several[number]], owner[several[number]]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2**24 are exact
    for at in range(0, int(several.sum()), SLAB):
        part = slice(*np.searchsorted(number, (at, at + SLAB)))
        held = np.zeros((len(sets), min(SLAB, int(several.sum()) - at)), np.float32)
        held[owner[part], number[part] - at] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    np.fill_diagonal(both, size)
    return both


def joining(nodes: list[int], labels: list[int], sets: list[np.ndarray], limit: float) -> list[tuple[int, int]]:
    """A link for each two components (``labels``) that have similar sets."""
    if len(set(labels)) < 2:
        return []
    size, (_, label) = np.fromiter(map(len, sets), np.int64, len(sets)), np.unique(labels, return_inverse=True)
    both = shared_counts(sets)
    x, y = np.nonzero(np.triu(both >= limit * (size[:, None] + size[None, :] - both), 1))
    x, y = x[label[x] != label[y]], y[label[x] != label[y]]
    pair = np.minimum(label[x], label[y]) * (label.max() + 1) + np.maximum(label[x], label[y])
    _, first = np.unique(pair, return_index=True)
    return [(nodes[a], nodes[b]) for a, b in zip(x[first].tolist(), y[first].tolist())]


def _within(limit: float):
    """Rows (unit, node, component, hashes) sorted by unit: links between the components of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for b in batches:
            found = []
            for u, node, component, hashes in zip(*[b.column(i).to_pylist() for i in range(3)], b.column(3)):
                if u != unit:
                    found += joining(*zip(*held), limit) if held else []
                    unit, held = u, []
                held.append((node, component, _set(hashes)))
            yield _links(found)
        yield _links(joining(*zip(*held), limit) if held else [])

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _mixed(rows: DataFrame) -> DataFrame:
    """``(key, blocks)`` of the bands of ``rows`` (key, node, size, component) that still hold several components, one of those with the same texts."""
    one = F.xxhash64("node")
    each = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.bit_xor(one).alias("x"), F.bit_xor(F.xxhash64(one)).alias("y"))
    open_ = each.where("low < high AND n > 2")  # two texts have been compared
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("held") * 8 / BLOCK_BYTES)).cast("long")
    return open_.groupBy("n", "x", "y").agg(F.min(F.struct("key", "held")).alias("first")).select("first.key", "n", "first.held").select("key", blocks.alias("blocks"))


def _crowds(rows: DataFrame, texts: DataFrame, words: int, limit: float) -> DataFrame:
    """Links in the bands that hold several components; ``rows`` are (key, node, size, component)."""
    rows = staged(rows.join(_mixed(rows), "key"))
    sets = _sets(texts, rows.select("node"), words)
    units = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    unit = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    whole = units.select("node", unit.alias("unit"), "component").join(sets, "node").select("unit", "node", "component", "hashes")
    return whole.repartition(shuffle_partitions(rows.sparkSession), "unit").sortWithinPartitions("unit").mapInArrow(_within(limit), "a long, b long")


def links(texts: DataFrame, words: int = WORDS, limit: float = LIMIT) -> DataFrame:
    """Edges ``(a, b)`` that connect all nodes of ``(node, text)`` linked by shingle similarity.

    A node may come several times, with texts of the same words; what is shuffled
    are sketches and sets of hashes, never texts that met nothing.
    """
    partitions = shuffle_partitions(texts.sparkSession)
    each = texts.mapInArrow(_sketch(words), _SKETCH).groupBy("node").agg(F.first(F.struct("fp", "size", "keys")).alias("s"))
    sketches = staged(each.select("node", "s.*"))
    sent = sketches.select(F.explode("keys").alias("key"), "node", "fp", "size")
    met = sent.select("key", "node", "fp").repartition(partitions, "key").sortWithinPartitions("key", "node").mapInArrow(_first_meetings, "a long, b long")
    met = staged(met.unionAll(_grid_meetings(sketches)).distinct())
    edges = _verified(met, _sets(texts, met.select(F.explode(F.array("a", "b")).alias("node")), words), limit)
    components = connected_components(edges).select("node", "component")
    # components are looked up once a text, not once a band; one exchange by key serves the grouping and the join
    known = sketches.join(components, "node", "left").select(F.explode("keys").alias("key"), "node", "size", F.coalesce("component", "node").alias("component"))
    rows = known.repartition(partitions, "key")
    return edges.unionAll(staged(_crowds(rows, texts, words, limit)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, limit: float = LIMIT) -> DataFrame:
    """``(id, component_id)`` of every row of ``docs``.

    ``component_id`` is the smallest id reachable over texts whose sets of word
    shingles have a Jaccard similarity of at least ``limit``, the row's own
    included; letter case (ASCII) and white space do not count. Null and blank
    texts are one group; a text of fewer words is one shingle; repeated rows and
    ids give one row each; ids that are null are never chosen as component.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    nodes = staged(rows.mapInArrow(_keys, "id long, node long"))
    texts = rows.mapInArrow(_keyed, "node long, text string")
    classes = nodes.groupBy("node").agg(F.min("id").alias("low_id"))
    found = classes.join(connected_components(links(texts, words, limit)), "node", "left").select(
        "node", "low_id", F.coalesce("component", "node").alias("component")
    )
    names = found.groupBy("component").agg(F.min("low_id").alias("component_id"))
    return nodes.join(found.join(names, "component").select("node", "component_id"), "node").select(F.col("id").alias(id_col), "component_id")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([_signed(text_key(t.as_py()) for t in b.column(1)), b.column(1)], names=["node", "text"])
