"""Links of vectors whose cosine is at the threshold, within rounding."""

import numpy as np
import pytest

from stocktide.llm import embedding_dedup


@pytest.mark.parametrize("kind", ["float", "double"])
def test_pairs_at_the_threshold_are_decided_in_double(spark, kind):
    rng, dim, rows, want = np.random.default_rng(6), 48, [], {}
    for k in range(300):
        x = rng.normal(size=dim)
        side = rng.normal(size=dim)
        side -= x * (side @ x) / (x @ x)
        cosine = 0.9 + rng.uniform(-1e-8, 1e-8)
        y = cosine * x / np.linalg.norm(x) + (1 - cosine**2) ** 0.5 * side / np.linalg.norm(side)
        scale = 10.0 ** rng.integers(-12, 12)
        pair = [x * scale, y / scale]
        if kind == "float":
            pair = [v.astype(np.float32).astype(float) for v in pair]
        rows += [(2 * k, pair[0].tolist()), (2 * k + 1, pair[1].tolist())]
        x, y = (np.array(v) / np.abs(v).max() for v in pair)
        exact = x @ y / np.sqrt((x @ x) * (y @ y))
        if abs(exact - 0.9) > 1e-14:
            want[2 * k] = want[2 * k + 1] = int(exact >= 0.9)
    docs = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(docs, recall=0.99999).collect()}
    wrong = [k for k, n in want.items() if got[k] != n]
    assert 100 < sum(want.values()) < 500 and not [k for k in wrong if got[k] > want[k]]
    assert len(wrong) <= 4  # a pair may meet in no table


def test_crowded_units_are_decided_like_others():
    rng = np.random.default_rng(1)
    base = rng.normal(size=32)
    x = np.array([base + rng.normal(size=32) * 0.45 for _ in range(200)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = embedding_dedup.linked_pairs(x, x, 0.9, True)
    one = np.einsum("ij,ij->i", x[np.triu_indices(200, 1)[0]], x[np.triu_indices(200, 1)[1]]) >= 0.9
    assert len(a) == one.sum() > 0
