"""The near-dedup stage shuffles and stages sketches, not texts."""

import random

from stocktide.llm import near_copies


def test_no_text_is_staged_and_copies_have_one_sketch(spark, monkeypatch):
    """Before, all texts were grouped by their key and written again."""
    written = []
    plain = near_copies.staged

    def staged(df):
        out = plain(df)
        written.append((df.columns, out))
        return out

    monkeypatch.setattr(near_copies, "staged", staged)
    words = [f"w{i}" for i in range(60)]
    near = ["x", *words[1:]]
    given = [(1, " ".join(words)), (2, "  ".join(words).upper()), (2, " ".join(words)), (3, " ".join(near)), (4, "a b"), (None, "A  b"), (5, None), (6, " ")]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    found = near_copies.near_copies(docs).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in found) == [("1", 1), ("2", 1), ("2", 1), ("3", 1), ("4", 4), ("5", 5), ("6", 5), ("None", 4)]
    assert not any("text" in columns for columns, _ in written)
    for columns, table in written:
        if "fp" in columns and "keys" in columns or columns == ["node", "hashes"]:
            assert table.count() == table.select("node").distinct().count()


def test_texts_that_met_nothing_are_dropped_before_the_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(400)] + [0, -1, 1, -(1 << 63), (1 << 63) - 1]
    rows = [(k, f"text {k}") for k in keys] + [(keys[0], "again")]
    wanted = keys[:20] + keys[-5:]
    texts, nodes = spark.createDataFrame(rows, "node long, text string"), spark.createDataFrame([(k,) for k in wanted * 2], "node long")
    for bits in (near_copies.FILTER_ROWS, 1):  # a full filter loses nothing either
        monkeypatch.setattr(near_copies, "FILTER_ROWS", bits)
        found = near_copies._texts_of(texts, nodes)
        assert sorted(map(tuple, found.collect())) == sorted(r for r in rows if r[0] in set(wanted))
    monkeypatch.undo()
    plan = near_copies._texts_of(texts, nodes)._jdf.queryExecution().optimizedPlan().toString()
    exact, filter_ = [line for line in plan.splitlines() if "Join " in line]
    assert "strategy=broadcast" not in exact and "strategy=broadcast" in filter_
