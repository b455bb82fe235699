"""Periodic runs against a direct search."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from stocktide.llm import periodic_runs as pr


def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_query(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def sample(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [b"a"] * rng.randint(0, 70)
    if kind == 1:
        return [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 120))]
    if kind == 2:  # Fibonacci words hold as many runs as words can
        x, y = [b"a"], [b"a", b"b"]
        for _ in range(rng.randint(2, 8)):
            x, y = y, y + x
        return y
    p, reps = rng.randint(1, 25), rng.randint(2, 6)
    part = [b"w%d" % rng.randrange(1 + rng.randrange(9)) for _ in range(p)]
    head, tail = ([b"h%d" % rng.randrange(4) for _ in range(rng.randint(0, 20))] for _ in range(2))
    return head + part * reps + part[:rng.randrange(p)] + tail


def test_runs_equal_a_direct_search():
    rng = random.Random(5)
    texts = [sample(rng) for _ in range(400)]
    for got, words in zip(pr.runs_of_texts(texts), texts, strict=True):
        assert got == plain_runs(words), words


@pytest.mark.parametrize("step", [1, 3, 64])
def test_appended_words_give_the_same_runs_at_every_step(step):
    rng = random.Random(step)
    words = [rng.choice([0, 1]) for _ in range(90)] + [2, 3, 4] * 30 + [7] * 20
    catchers = pr.SquareCatchers(len(words))
    for at in range(0, len(words), step):
        catchers.append(np.array(words[at:at + step]))
        if at % 60 == 0:
            part = words[:at + step]
            assert list(zip(*(x.tolist() for x in catchers.runs()))) == plain_runs(part)
    assert list(zip(*(x.tolist() for x in catchers.runs()))) == plain_runs(words)


def test_long_text_of_one_word_and_a_long_period():
    one = [b"x"] * 200_000
    far = [b"%d" % k for k in range(50_000)] * 3
    got = list(pr.runs_of_texts([one, far, []]))
    assert got == [[(0, 200_000, 1)], [(0, 150_000, 50_000)], []]
    assert pr.collapsed(one, got[0]) == b"x" and pr.collapsed(far, got[1]) == b" ".join(far[:50_000])


def test_query_equals_the_plain_version(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "eins", "a " * 12, "é x " * 30] + [" ".join(w.decode() for w in sample(rng)) for _ in range(200)]
    texts += [" ".join(f"t{rng.randrange(300)}" for _ in range(rng.randint(1, 150))) for _ in range(100)]
    rows = [(k, t, "r", -1, "c") for k, t in enumerate(texts)] + [(6, texts[6], "r", -1, "c"), (None, "b " * 20, "r", -1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n long, collapsed string")
    got = pr.digests(pr.find_runs(pr.with_periodic_tails(docs))).collect()
    assert len(got) == len(rows)
    nameless = [r for r in got if r.doc_id is None]
    assert [tuple(r)[1:5] for r in nameless] == [(1, 0, 20, 1)]
    want = {k: plain_query(k, t) for k, t in enumerate(texts)}
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:] == want[r.doc_id], r
    assert pr.find_runs(docs.limit(0)).count() == 0
