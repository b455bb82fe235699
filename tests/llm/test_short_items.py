"""Benchmark items of few words, edits allowed, against brute force."""

import random

from stocktide.llm import decontamination


def plain_edits(item, text):
    """Fewest edits between the item and any stretch of the text (table method)."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, v in enumerate(text, 1):
            row[j] = min(last[j - 1] + (v != w), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_short_items_with_edits_equal_brute_force():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in range(1, 12) for _ in range(6)]
    texts = []
    for item in items:
        for edits in range(4):
            copy = list(item)
            for _ in range(edits):
                k = rng.randrange(len(copy) + 1)
                copy[k:k + rng.randint(0, 1)] = [] if rng.random() < 0.3 else [rng.choice(vocabulary)]
            texts.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] + copy + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))])
    want = {}
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            edits = plain_edits(item, text)
            if edits <= int(0.2 * len(item)):
                want[d, k] = edits
    index = decontamination.index_items([(k, " ".join(item)) for k, item in enumerate(items)])
    found = list(decontamination.leaks([" ".join(t) for t in texts] + [None, ""], index))
    assert len(found) == len(set(found)) and {(d, k): e for d, k, e in found} == want
    assert any(want.values())
