"""Bounded memory of the pipeline: leak search in pieces, batches of bounded bytes."""

import random
import tracemalloc

import pyarrow as pa

import corpus_pipeline
from stocktide.llm import decontamination


def planted(n=900, words=1000):
    rng = random.Random(3)
    vocabulary = [f"w{k:04d}" for k in range(5000)]
    text = lambda size: [rng.choice(vocabulary) for _ in range(size)]
    items = [text(rng.choice((8, 30, 60))) for _ in range(40)]
    docs = []
    for k in range(n):
        doc = text(rng.randrange(words // 2, words))
        if k % 7 == 0:
            copy = list(items[k % len(items)])
            copy[rng.randrange(len(copy))] = "edited"
            doc[200:200] = copy
        docs.append(" ".join(doc) if k % 50 else (None, "")[k % 4 // 2])
    return docs, decontamination.index_items([(k, " ".join(item)) for k, item in enumerate(items)])


def test_memory_of_a_batch_is_that_of_a_piece():
    docs, index = planted()
    column = pa.array(docs, pa.string())
    assert sum(len(d or "") for d in docs) > 3_500_000
    tracemalloc.start()
    found = list(decontamination.leaks(column, index))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 100 and peak < 40e6
    assert sum(a.nbytes for table in index.tables.values() for a in table) < 2e6


def test_pieces_find_what_a_whole_batch_finds(monkeypatch):
    docs, index = planted(400)
    got = sorted(decontamination.leaks(pa.array(docs, pa.string()), index))
    for piece, chunk in ((10**9, 10**9), (10_000, 10**9), (1, 10**9)):
        monkeypatch.setattr(decontamination, "PIECE_CHARS", piece)
        monkeypatch.setattr(decontamination, "CHUNK_CHARS", chunk)
        assert sorted(decontamination.leaks(docs, index)) == got
    assert got


def test_pipeline_stages_get_batches_of_bounded_bytes(spark, tmp_path, monkeypatch):
    docs = [(k, f"{k} " * 20_000, "en", "s", 5) for k in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    def measure(spark, docs, sf_dir):
        return docs.mapInArrow(sizes, "bytes long, rows long")

    name = corpus_pipeline.BATCH_BYTES[0]
    before = spark.conf.get(name)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("measure", measure)])
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.rows for r in found) == 120 and max(r.bytes for r in found) < 6e6
    assert spark.conf.get(name) == before
