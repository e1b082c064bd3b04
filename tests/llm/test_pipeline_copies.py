"""Copies of a text of short lines through the stages of line dedup and near-dedup."""

import random

import corpus_pipeline
from edge_rows import frame


def test_exact_copies_leave_one_document(spark, sf_dir):
    draw = random.Random(3)
    texts = ["\n".join(" ".join(f"w{draw.randrange(10**6)}" for _ in range(9)) for _ in range(n)) for n in range(2, 22)]
    docs = frame(spark, [(100 * copy + i, text) for copy in range(3) for i, text in enumerate(texts)])
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, sf_dir)
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == list(enumerate(texts))
