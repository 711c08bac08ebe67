"""Rows that share a doc_id: one document for the operator, rows of their own in the pipeline."""
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from detecteval.llm import neardup  # noqa: E402
from detecteval.session import ensure_importable  # noqa: E402

X = " ".join(f"x{i}" for i in range(40))
UNIQUE = " ".join(f"u{i}" for i in range(40))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    ensure_importable(spark)
    rows = [(3, X), (5, X + " tail"), (5, UNIQUE), (7, "a b c d e f"), (7, "a b c d e f"), (None, X), (None, "q w e r t y"),
            (None, "q w e r t y"), (9, ""), (9, ""), (11, None), (12, "one"), (13, "one"), (14, UNIQUE + " z"), (14, "")]
    return spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], DOCS)


def test_rows_of_one_id_are_one_document(docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(3, 36, 3, True), (5, 37, 3, False), (5, 36, 3, False), (7, 2, 7, True), (7, 2, 7, True),
                          (None, 36, None, True), (None, 2, None, True), (None, 2, None, True), (9, 0, 9, True), (9, 0, 9, True),
                          (11, 0, 11, True), (12, 1, 12, True), (13, 1, 12, False), (14, 37, 3, False), (14, 0, 3, False)], key=repr)


def test_pipeline_keeps_every_text_once(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()), key=repr)
    assert got == sorted([(3, X), (5, UNIQUE), (7, "a b c d e f"), (None, "q w e r t y"), (9, ""), (9, ""), (11, None),
                          (12, "one"), (14, "")], key=repr)


def test_similar_pairs_of_few_shingles_are_found(spark):
    """Pairs that share 3 of 4 shingles, most of them beyond the guaranteed distance."""
    rows = []
    for i in range(1500):
        words = [f"p{i}w{k}" for k in range(8)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:7]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3000 and all(r.component_id == r.doc_id - r.doc_id % 2 for r in got)
