"""Exact duplicates by the cuckoo-filter index, against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from stocktide.llm import exact_dedup as ed


def digest(x):
    return hashlib.sha256(str(x).encode()).digest()


def test_filter_keeps_every_key_and_forgets_deleted_ones():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 64, 3000, dtype=np.uint64))
    f = ed.CuckooFilter(10)
    assert f.insert(keys) and f.contains(keys).all()
    others = rng.integers(0, 1 << 64, 20000, dtype=np.uint64)
    assert f.contains(others).mean() < 0.002
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01


def test_filter_reports_overflow():
    f = ed.CuckooFilter(2)
    assert not f.insert(np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def test_index_grows_from_stored_keys_and_verifies_hits():
    rng, live, index = random.Random(1), {}, ed.DigestIndex()
    for _ in range(60):
        names = [digest(rng.randrange(4000)) for _ in range(300)]
        names = list(dict.fromkeys(names))
        if rng.random() < 0.4:
            gone = set(index.delete(names, [1] * len(names)))
            for d in names:
                if d in live:
                    live[d] -= 1
                    assert (d in gone) == (live[d] == 0)
                    if live[d] == 0:
                        del live[d]
        else:
            index.insert(names, [ed.Entry(1, 5, k) for k in range(len(names))])
            for d in names:
                live[d] = live.get(d, 0) + 1
        assert index.size == len(live) and {d: e.count for d, e in index.items()} == live
    assert index.resized > 2
    # a filter of one fingerprint for all is wrong at nearly every look-up; the content is not
    index.filter.table[:] = 1
    odd = [k for k in range(10_000, 12_000) if digest(k)[:2] in (b"\0\0", b"\0\1")] or [10_000]
    assert index.find([digest(k) for k in odd]) == [None] * len(odd)


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in ed.SPACES)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        bare = "".join(c for c in t or "" if c not in ed.SPACES)
        keep = min(groups[bare])[3]
        out.append((i, keep, len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_duplicates_equal_the_plain_version(spark):
    rng = random.Random(4)
    bases = ["", "a b", "ab", "a\tb\n", "é è x", "éè x", "Ab", "long " * 30_000, "long" * 30_000]
    rows = [(k, rng.choice(bases)) for k in range(300)] + [(1000 + k, f"only {k}") for k in range(200)]
    rows += [(5000 + k, "hot  text" if k % 2 else "hottext ") for k in range(400)]
    rows += [(None, "a b"), (None, "nobody"), (None, None), (2000, None), (7, "again"), (7, "again"), (-3, "ag ain"), (2**63 - 1, "x"), (-2**63, "x")]
    docs = spark.createDataFrame([(i, t, "d", "k", 0) for i, t in rows], "doc_id long, text string, digest string, keep_id string, n long")
    got = sorted((tuple(r) for r in ed.exact_duplicates(docs).collect()), key=str)
    assert got == plain(rows)
    assert ed.exact_duplicates(docs.limit(0)).count() == 0


def test_index_table_changes_and_answers(spark):
    def frame(pairs):
        return ed.digests(spark.createDataFrame(pairs, "doc_id long, text string"))

    live = ed.live_digests(frame([(1, "a"), (2, "a "), (3, "b"), (4, "c")]), 3)
    live = ed.change_index(live, frame([(5, "d"), (6, "b")]), frame([(1, "a"), (4, "c"), (9, "never")]), 3)
    got = {r.digest: r.n for r in live.collect()}
    assert got == {hashlib.sha256(t.encode()).digest(): n for t, n in (("a", 1), ("b", 2), ("d", 1))}
    asked = ed.known_digests(live, frame([(10, "a"), (11, " a"), (12, "c"), (13, "d")]), 3)
    assert {r.digest for r in asked.collect()} == {hashlib.sha256(t.encode()).digest() for t in ("a", "d")}
