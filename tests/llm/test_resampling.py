"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from stocktide.llm import resampling as rs


def test_span_crcs_equal_zlib():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8)
    sizes = [1, 2, 3, 4, 5, 7, 8, 255, 256, 257, 258, 259, 260, 261, 511, 512, 513, 1000, 4096, 300_000]
    starts = np.array([int(rng.integers(0, len(data) - n)) for n in sizes])
    ends = starts + np.array(sizes)
    raw = data.tobytes()
    assert rs.span_crcs(data, starts, ends).tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, ends)]


def plain_features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target):
    found = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    out = [(r[0], *r[2:], k + 1 if k < len(able) * 5 // 100 else None) for k, r in enumerate(able)]
    return sorted(out + [(r[0], *r[2:], None) for r in rows if r[1] < 20], key=str)


def test_resample_equals_the_plain_version(spark):
    rng = random.Random(8)
    vocabulary = ["Alpha", "beta", "x-y", "naïve", "ÉTÉ", "9", "it's", "日本", "_", "Zeta9", "q" * 300, "%"]

    def text():
        return "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "-"]) for _ in range(rng.randint(0, 60)))

    rows = [(k, text()) for k in range(500)]
    rows += [(600, None), (601, ""), (602, "---"), (603, "y" * 700_000 + " " + "b c " * 50), (604, "a b"), (605, "one two three " * 60_000)]
    rows += [(700, "same words " * 15)] * 3 + [(None, "no id " * 20), (None, "no id " * 20)]
    target = ["alpha beta naïve", "zeta9 it's", None, "", "日本 x"]
    docs = spark.createDataFrame([(i, t, -1, "b", 0) for i, t in rows], "doc_id long, text string, n_words long, bucket string, id long")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in rs.resample(docs, bench).collect()), key=str)
    assert got == plain(rows, target)
    assert rs.resample(docs.limit(0), bench).count() == 0
    none = rs.resample(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and sum(r.rank is not None for r in none) == sum(plain_features(t)[0] >= 20 for _, t in rows) * 5 // 100
