"""The near-dedup stage links texts that meet in the SimHash grid join only."""

import random

import pyarrow as pa

import corpus_pipeline
from stocktide.llm import near_copies, simhash


def texts():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    near = " ".join(["other", *base[1:]])  # one of 396 shingles
    mixed = " ".join(rng.sample(base, len(base)))
    return [" ".join(base), near, mixed, "a b", None]


def test_fingerprints_meet_in_the_grid_without_any_band(spark, monkeypatch):
    """Before, texts met in bands of min-hashes only: without a common band nothing was linked."""
    def none(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    given = texts()
    fps = [simhash.fingerprint(t, near_copies.WORDS) for t in given[:3]]
    assert (fps[0] ^ fps[1]).bit_count() <= simhash.MAX_BITS < (fps[0] ^ fps[2]).bit_count()
    monkeypatch.setattr(near_copies, "_first_meetings", none)
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(given)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {0, 2, 3, 4}
