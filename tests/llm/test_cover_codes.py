import hashlib
import math
import random

import numpy as np
import pytest

from rainledger.llm import cover_codes
from rainledger.llm.cover_codes import assign, build_tree, codebooks_sha256, compress, entry_sums, point_entries, squared

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, label_error string, ids string, trees string"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(partitions)


def brute(rows, entries, rounds=4, parts=4):
    """Code and error per row, and the codebooks, comparing every part with every entry in whole numbers."""
    kept = [
        (i, [math.floor(1024 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = [nearest(v, books[p])[1] for v in cut[p]]
            for i in set(found):
                own = [v for v, j in zip(cut[p], found, strict=True) if i == j]
                books[p][i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    final = [[nearest(v, books[p]) for v in cut[p]] for p in range(parts)]
    codes = [(i, "".join(f"{final[p][k][1]:02x}" for p in range(parts)), sum(final[p][k][0] for p in range(parts)), label) for k, (i, _, label) in enumerate(kept)]
    return sorted(codes, key=repr), books


def same(spark, rows, entries=16):
    found, books = compress(table(spark, rows), entries=entries)
    want, want_books = brute(rows, entries)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_key"]) for r in found.collect()), key=repr)
    assert [b.tolist() for b in books] == want_books
    assert got == want
    text = ",".join(str(x) for b in want_books for e in b for x in e)
    assert codebooks_sha256(books) == hashlib.sha256(text.encode()).hexdigest()


def vectors(draw, n, centres=7, width=8):
    around = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [[x + draw.gauss(0, 0.1) for x in draw.choice(around)] for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_a_tree_assigns_as_all_comparisons_do(seed):
    draw = np.random.default_rng(seed)
    spread = [3, 40, 900, 1 << 26][seed]
    points = draw.integers(-spread, spread + 1, (700, 5))
    points[::3] = points[0]
    tree, entries = build_tree(points), draw.integers(-spread, spread + 1, (31, 5))
    assert (tree.points == points[tree.order]).all() and sorted(tree.order) == list(range(700))
    found = assign(tree, entries)
    want = squared(points, entries).argmin(axis=1)
    assert (point_entries(tree, found) == want).all()
    counts, sums = entry_sums(tree, found, 31)
    assert counts.tolist() == np.bincount(want, minlength=31).tolist()
    assert sums.tolist() == [points[want == e].sum(axis=0).tolist() for e in range(31)]
    if spread < 1 << 20:
        assert (found.stops - found.starts).max() >= 233  # the equal points are one node


def test_cover_separation_and_nesting():
    points = np.array([[round(1000 * x) for x in v] for v in vectors(random.Random(3), 600)])
    tree = build_tree(points)
    for n in range(len(tree.start)):
        own = tree.points[tree.start[n] : tree.stop[n]]
        away = np.sqrt(squared(own, own[:1]))
        assert away.max() <= tree.radius[n] + 1e-9
        if tree.children[n]:
            kids = np.arange(tree.child[n], tree.child[n] + tree.children[n])
            assert tree.start[kids[0]] == tree.start[n] and tree.stop[kids[-1]] == tree.stop[n]
            assert (tree.start[kids[1:]] == tree.stop[kids[:-1]]).all()
            centres = tree.points[tree.start[kids]]
            apart = np.sqrt(squared(centres, centres))[~np.eye(len(kids), dtype=bool)]
            assert (tree.radius[kids] <= tree.radius[n] / 2).all() and (apart > tree.radius[n] / 2).all()


def test_far_groups_are_assigned_whole():
    points = np.concatenate([np.full((1, 4), 10000 * k) + np.random.default_rng(k).integers(0, 9, (300, 4)) for k in range(5)])
    tree = build_tree(points)
    found = assign(tree, np.array([[10000 * k] * 4 for k in range(5)]))
    assert len(found.points) == 0 and len(found.starts) < 20


def test_rounds_against_brute_force(spark):
    draw = random.Random(1)
    same(spark, [(i, v, draw.choice([None, 1, 2])) for i, v in enumerate(vectors(draw, 400))])


def test_nulls_ties_and_repeated_rows(spark):
    draw = random.Random(2)
    some = vectors(draw, 60, width=4)
    rows = [(i, v, i % 3) for i, v in enumerate(some)]
    rows += [(5, some[5], 2), (5, some[5], 2), (None, some[7], None), (None, some[8], 1), (7, some[9], None)]
    rows += [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0, 3.0], 1), (103, [float("nan")] * 4, 1), (104, [float("inf"), 0.0, 0.0, 0.0], 1)]
    rows += [(200 + i, [0.0] * 4, 9) for i in range(30)]  # one vector in a third of all rows
    same(spark, rows)


def test_fewer_vectors_than_entries(spark):
    same(spark, [(3, [0.5, 1.5, -2.5, 0.001], 1), (1, [-0.5, 1.5, 2.5, -0.001], None)])


def test_empty_and_unlike_lengths(spark):
    found, books = compress(table(spark, [(1, [1.0] * 4, 1)]).limit(0))
    assert found.collect() == [] and books == []
    assert found.columns == ["vec_id", "label_key", "code", "error"]
    with pytest.raises(ValueError):
        compress(table(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)]))
    with pytest.raises(ValueError):
        compress(table(spark, [(1, [1.0] * 5, 1)]))


def test_blocks_make_no_difference(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(draw, 300))]
    monkeypatch.setattr(cover_codes, "BLOCK_ROWS", 37)
    same(spark, rows)
