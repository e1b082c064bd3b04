import numpy as np
from pyspark.sql import functions as F

from rainledger.llm import graph_ann
from rainledger.llm.graph_ann import _beam_search, _prune, _units, build_graph, direction_nodes, nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank string, shard string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in vectors], SCHEMA).repartition(4)


def brute(vectors, asks, k=5):
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(np.array(v, np.float32), np.float64)
    out = {}
    for q in filter(asks, good):
        hits = []
        for i, v in good.items():
            if i != q and len(v) == len(good[q]):
                hits.append((-float(v @ good[q] / (np.linalg.norm(v) * np.linalg.norm(good[q]))), i))
        out[q] = sorted((round(s, 12), i) for s, i in hits)[:k]
    return out


def compare(got, want):
    """Share of the true nearest that were found."""
    rows = {}
    for r in got:
        rows.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q, best in want.items():
        mine = sorted(rows.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert len(mine) == len(best)
        keys = [(-r["score"], r["vec_id"]) for r in mine]
        assert [round(s, 12) for s, _ in keys] == sorted(round(s, 12) for s, _ in keys)
        hits += len({i for _, i in best} & {i for _, i in keys})
        total += len(best)
    return hits / max(total, 1)


def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pairs = [(r["vec_id"], list(r["embedding"])) for r in vectors.collect()]
    got = nearest(vectors, F.col("vec_id") % 50 == 0, shard_bytes=700 * 1024).collect()
    assert compare(got, brute(pairs, lambda i: i % 50 == 0)) >= 0.95


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]),
               (7, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (10, [-1.0, 0.0])]
    got = nearest(table(spark, vectors), F.lit(True)).collect()
    assert compare(got, brute(vectors, lambda i: True)) == 1.0


def test_a_third_of_all_rows_share_a_vector(spark):
    draw = np.random.RandomState(0)
    vectors = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else draw.normal(size=4).tolist()) for i in range(900)]
    got = nearest(table(spark, vectors), F.col("vec_id") % 90 == 0, shard_bytes=200 * 304).collect()
    assert compare(got, brute(vectors, lambda i: i % 90 == 0)) >= 0.98


def test_many_groups_of_queries_meet_each_graph(spark, monkeypatch):
    draw = np.random.RandomState(8)
    vectors = [(i, draw.normal(size=3 if i % 7 == 0 else 5).tolist()) for i in range(600)]
    whole = nearest(table(spark, vectors), F.lit(True), shard_bytes=100 * 316).collect()
    monkeypatch.setattr(graph_ann, "QUERY_GROUP", 50)
    monkeypatch.setattr(graph_ann, "QUERY_BLOCK", 7)
    split = nearest(table(spark, vectors), F.lit(True), shard_bytes=100 * 316).collect()
    assert sorted(split) == sorted(whole)
    assert compare(split, brute(vectors, lambda i: True)) >= 0.98


def test_the_beam_knows_true_distances():
    draw = np.random.RandomState(9)
    vectors = draw.normal(size=(400, 6)).astype(np.float32)
    edges, start = build_graph(vectors, degree=12)
    queries = draw.normal(size=(30, 6)).astype(np.float32)
    ids, near = _beam_search(vectors, edges, start, queries, 20)
    true = ((queries[:, None] - vectors[None]) ** 2).sum(axis=2)
    assert np.allclose(np.take_along_axis(true, ids, 1), near, atol=1e-4)
    assert (np.diff(near, axis=1) >= 0).all() and all(len(set(row)) == 20 for row in ids)
    assert (ids[:, :3] == np.argsort(true, axis=1)[:, :3]).mean() >= 0.95


def test_pruning_follows_the_rule():
    draw = np.random.RandomState(10)
    vectors = draw.normal(size=(60, 4)).astype(np.float32)
    candidates = np.array([[j for j in range(60) if j != i][:25] + [i, -1, -1] for i in range(60)])
    got = _prune(vectors, np.arange(60), candidates, 8, 1.2)
    far = ((vectors[:, None].astype(float) - vectors[None]) ** 2).sum(axis=2)
    for i in range(60):
        left, want = sorted((far[i, j], j) for j in set(candidates[i].tolist()) - {i, -1}), []
        while left and len(want) < 8:
            best = left[0][1]
            want.append(best)
            left = [(d, j) for d, j in left[1:] if 1.2**2 * far[best, j] > d]
        assert [x for x in got[i].tolist() if x < 60] == want


def test_empty(spark):
    assert nearest(table(spark, [(1, [1.0])]).limit(0), F.lit(True)).collect() == []


def test_graph_edges_are_diverse_and_bounded():
    vectors = np.random.RandomState(1).normal(size=(300, 8)).astype(np.float32)
    edges, start = build_graph(vectors, degree=10)
    assert edges.shape == (300, 10) and 0 <= start < 300
    assert all(len(set(row[row < 300])) == (row < 300).sum() and i not in row for i, row in enumerate(edges))


def test_a_third_of_all_rows_are_scaled_copies(spark):
    draw = np.random.RandomState(4)
    base = draw.normal(size=8)
    vectors = [(i, ((0.5 + draw.rand()) * base if i % 3 == 0 else draw.normal(size=8) + base / 2).tolist()) for i in range(1500)]
    got = nearest(table(spark, vectors), F.col("vec_id") % 25 == 1).collect()
    want = brute(vectors, lambda i: i % 25 == 1)
    scores = {}
    for r in got:
        scores.setdefault(r["query_id"], []).append(-r["score"])
    near = [abs(a - b) < 1e-6 for q in want for a, (b, _) in zip(sorted(scores[q]), want[q], strict=True)]
    assert sum(near) >= 0.95 * len(near)


def test_copies_do_not_fill_each_others_edges():
    draw = np.random.RandomState(6)
    base = draw.normal(size=8)
    exact = np.vstack([[(0.5 + draw.rand()) * base for _ in range(60)], draw.normal(size=(300, 8))]).astype(np.float32).astype(float)
    assert len(set(direction_nodes(_units(exact))[:60])) <= 4
    edges, start = build_graph(_units(exact))
    reached, todo = {start}, [start]
    while todo:
        fresh = {int(x) for x in edges[todo.pop()] if x < len(exact)} - reached
        reached |= fresh
        todo += fresh
    assert len(reached & set(range(60, 360))) >= 285
