"""The stages against plain versions of each, on the smallest tables."""

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import connect
from test_hyperminhash import brute as near_brute
from test_packing import check as check_pieces
from test_packing import tokenizer  # noqa: F401
from test_poisson_mix import brute as mix_brute
from rainledger.llm import chunk_dedup, quality_mil

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    paths = [f"{sf_dir}/documents.parquet"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        paths.append(f"{folder}/{i}/*.parquet")
        out.append(docs)
    return out, paths


def rows(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def test_columns(outputs):
    assert all(sorted(o.columns) == sorted(COLUMNS) for o in outputs[0][:-1])


def test_quality_keeps_what_the_model_accepts(spark, sf_dir, outputs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_mil.AttentionModel.of_bytes(quality_mil.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    want = [r for r in rows(docs) if model.forward(quality_mil.passages(r[1].encode()), np.array([0]))["score"][0] >= 0.3]
    assert rows(outputs[0][0]) == want
    assert {r["doc_id"] for r in docs.collect()} - {r[0] for r in want}


def test_lines(sf_dir, outputs):
    duck = connect(sf_dir)
    duck.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{outputs[1][1]}'")
    found = duck.execute(f"SELECT doc_id, text, chunks_removed FROM ({chunk_dedup.ORACLE})").fetchall()
    want = sorted((d, t) for d, t, cut in found if t or not cut)
    assert sorted((r["doc_id"], r["text"]) for r in outputs[0][1].collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in outputs[0][1].collect())


def test_near_copies(outputs):
    before, after = rows(outputs[0][1]), rows(outputs[0][2])
    kept = {r[0] for r in near_brute([(r[0], r[1]) for r in before], 5, 80) if r[3]}
    assert after == [r for r in before if r[0] in kept]


def test_mix(outputs):
    want = mix_brute([(r[0], r[1], r[2], r[3]) for r in rows(outputs[0][2])])
    assert sorted((r[0], r[1]) for r in rows(outputs[0][3])) == sorted((d, t) for (d, t, _, _), n in want.items() for _ in range(n))


def test_packing(outputs, tokenizer):  # noqa: F811
    docs = [(r["doc_id"], r["text"]) for r in outputs[0][3].collect()]
    check_pieces(docs, outputs[0][4], tokenizer, 2048)


def test_run(spark, sf_dir, outputs):
    assert contract.queries()["pipeline"](spark, sf_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in contract.oracle_sql()
