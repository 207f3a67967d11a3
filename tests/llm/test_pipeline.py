"""The pipeline on planted documents, against what a plain reading of its stages keeps."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from vellum.llm import pieces


def _words(rng, n):
    return ["".join(rng.choice(["the", "and", "tion", "er", "ing", "ha", "wh", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    item = _words(rng, 30)
    rows, labels, want = [], [], {}
    for i in range(400):
        words, keep = _words(rng, 60), True
        if i % 9 == 4:
            words[7], keep = "grobian", False
        if i % 2:
            labels.append((i, 1, int(i % 9 == 4)))
        if i == 20:
            words[5:17], keep = item[3:15], False  # a window of a benchmark item
        rows.append([i, " ".join(words), "en", "s", 0])
        want[i] = keep
    for i, source in ((400, 30), (401, 30), (402, 33), (403, 22)):  # exact and near copies; 22 is toxic, and so is its copy
        copy = rows[source][1].split(" ")
        if i > 400 and source != 22:
            copy[-1] = f"new{i}"
        rows.append([i, " ".join(copy), "en", "s", 0])
        want[i] = False
    assert not want[22]
    rows += [[404, None, "en", "s", 0], [405, "", "en", "s", 0], [406, "123 !?", "en", "s", 0], [407, rows[50][1], "en", "s", 0], [50, rows[50][1], "en", "s", 0]]
    want |= {404: False, 405: False, 406: False, 407: False}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, keep in want.items() if keep)
    texts, model = {r[0]: r[1] for r in rows}, pieces.model("piece_bpe_32k.model")
    assert all(r.round_trip and model.decode(np.array(r.ids, np.int64)) == texts[r.doc_id] for r in out)


def test_stages_return_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
