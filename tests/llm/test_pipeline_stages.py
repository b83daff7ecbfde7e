"""Stages of the corpus pipeline on repeated rows and null ids."""

from __future__ import annotations

import pytest

import corpus_pipeline

LONG = " ".join(f"word{i}" for i in range(60))
NEAR = LONG.replace("word59", "other")
PASSAGE = "one two three four five six seven eight nine ten eleven"

CASES = {
    "language": (
        [(1, "hello there", "en"), (1, "12 34", "en"), (None, "12 !", "en"), (None, "good day", "en"), (2, "hello you", None)],
        ["good day", "hello there", "hello you"],
    ),
    "exact_dedup": (
        [(1, "same text", "en")] * 2 + [(1, "other text", "en")] + [(None, "copy", "en")] * 3 + [(5, "cop y", "en"), (4, "copy", "en")],
        ["cop y", "other text", "same text"],
    ),
    "ngram_join": (
        [(7, LONG, "en"), (3, NEAR, "en"), (7, "apart from all", "en"), (None, LONG, "en")]
        + [(None, LONG[::-1], "en"), (None, LONG[::-1] + " x", "en")],
        sorted([NEAR, "apart from all", LONG[::-1]]),
    ),
    "decontamination": (
        [(1, PASSAGE, "en"), (1, "clean", "en"), (None, f"x {PASSAGE}", "en"), (None, "clean too", "en")],
        ["clean", "clean too"],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_stages_decide_by_row(spark, tmp_path, name):
    rows, expected = CASES[name]
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == expected


def pipeline_rows():
    """One source and one language; every stage has something to drop."""
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + k % 26)}{'xyz'[(i * k) % 3]}" for k in range(i, i + 40)), "en", "s") for i in range(30)]
    rows += [(100, "12 34", "en", "s"), (101, rows[0][1], "en", "s"), (102, LONG, "en", "s"), (103, NEAR, "en", "s"), (104, f"x {PASSAGE} y", "en", "t")]
    rows += [(None, None, None, None), (105, None, "en", "t")]
    return rows


@pytest.mark.parametrize("labelled", [True, False])
def test_whole_pipeline(spark, tmp_path, labelled):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(i, t, lang if labelled else None, s) for i, t, lang, s in pipeline_rows()]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in found}
    # Of two sources the mix may leave out documents, but none that a stage dropped comes back.
    assert kept <= set(range(30)) | {102} and len(kept) > 20
    total = sum(len((t or "").split()) for i, t, *_ in rows if i in set(range(30)) | {102})
    assert {r["source_size"] for r in found} == {total}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
