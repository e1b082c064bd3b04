import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from edge_rows import EDGES, frame
from rainledger.llm.best_fit import LENGTH, Places, best_fit, op12_best_fit, pack_whole, packing_plan, reduced


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def counted(sizes, length):
    return np.bincount(sizes, minlength=length + 1)


def total(patterns):
    return sum(times for times, _ in patterns)


def fewest(sizes, length):
    """The least number of sequences, by trying all sets for the largest piece."""

    @lru_cache(None)
    def solve(left):
        if not left:
            return 0
        first, rest = left[-1], left[:-1]
        sets = {()}
        for s in rest:
            sets |= {(*x, s) for x in sets if sum(x) + s + first <= length}
        best = len(left)
        for chosen in sets:
            remains = list(rest)
            for s in chosen:
                remains.remove(s)
            best = min(best, 1 + solve(tuple(remains)))
        return best

    return solve(tuple(sorted(sizes)))


def one_by_one(sizes, length):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= s
        else:
            rooms.append(length - s)
    return sorted(rooms)


def test_fixed_sets_are_part_of_a_best_packing():
    draw = random.Random(4)
    shown = 0
    for _ in range(400):
        length = draw.choice([10, 13, 20])
        low = draw.choice([1, 3, 4])
        sizes = [draw.randrange(low, length + 1) for _ in range(draw.randrange(1, 10))]
        fixed, left = reduced(counted(sizes, length), length)
        rest = [s for s, n in enumerate(left) for _ in range(n)]
        held = [s for times, pattern in fixed for s, n in pattern for _ in range(times * n)]
        assert sorted(held + rest) == sorted(sizes)
        assert all(sum(s * n for s, n in pattern) <= length for _, pattern in fixed)
        assert total(fixed) + fewest(rest, length) == fewest(sizes, length)
        shown += len(fixed)
    assert shown > 400


def test_best_fit_is_that_of_single_pieces():
    draw = random.Random(5)
    for _ in range(200):
        length = draw.choice([12, 40])
        sizes = [draw.randrange(1, length + 1) for _ in range(draw.randrange(60))]
        patterns = best_fit(counted(sizes, length), length)
        rooms = [length - sum(s * n for s, n in p) for times, p in patterns for _ in range(times)]
        assert sorted(rooms) == one_by_one(sizes, length)


def test_places_are_gapless():
    draw = random.Random(6)
    sizes = np.array([draw.choice([1, 5, 7, 7, 30, 64, 90, 99]) for _ in range(5000)])
    places = Places(packing_plan(counted(sizes, 100), 100))
    ranks = np.zeros(len(sizes), np.int64)
    for s in set(sizes.tolist()):
        ranks[sizes == s] = np.arange((sizes == s).sum())
    held = defaultdict(list)
    for s, sequence, offset in zip(sizes, *places.of(sizes, ranks), strict=True):
        held[sequence].append((offset, s))
    assert sorted(held) == list(range(places.sequences))
    for parts in held.values():
        at = 0
        for offset, s in sorted(parts):
            assert offset == at
            at += s
        assert at <= 100


def test_a_plan_for_very_many_pieces():
    """The work depends on the sizes alone: a billion pieces of each size."""
    draw = random.Random(7)
    counts = np.array([0] + [10**9 + draw.randrange(1000) for _ in range(LENGTH)])
    plan = packing_plan(counts)
    held = np.zeros(LENGTH + 1, object)
    for times, pattern in plan:
        assert sum(s * n for s, n in pattern) <= LENGTH
        for s, n in pattern:
            held[s] += times * n
    assert (held == counts).all() and len(plan) < 4 * LENGTH
    tokens = sum(int(s) * int(c) for s, c in enumerate(counts))
    assert total(plan) <= -(-tokens // LENGTH) * 1.001


def check(rows, packed, tokenizer, length):
    pieces = packed.collect()
    want = defaultdict(int)
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), length):
            part = np.array(ids[k : k + length], "<u4").tobytes()
            want[doc_id, k // length, k, len(part) // 4, part, len(ids)] += 1
    got, held = defaultdict(int), defaultdict(list)
    for p in pieces:
        got[p["doc_id"], p["piece"], p["start"], p["length"], bytes(p["ids"]), p["doc_tokens"]] += 1
        held[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(held), sum(p["length"] for p in pieces)


@pytest.mark.parametrize("length", [7, LENGTH])
def test_edges(edges, tokenizer, length):
    check(EDGES, pack_whole(edges, length), tokenizer, length)


def test_whole_texts_of_the_tables(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sequences, tokens = check(rows, pack_whole(docs), tokenizer, LENGTH)
    assert sequences <= 1.01 * -(-tokens // LENGTH) + 1


def test_shuffled_counts_give_the_same_packing(spark, edges, tokenizer):
    from rainledger.operators.lookup import LIMIT_SETTING

    spark.conf.set(LIMIT_SETTING, "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(EDGES, pack_whole(edges, 50), tokenizer, 50)
    finally:
        spark.conf.unset(LIMIT_SETTING)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_size_for_a_third_of_all_rows(spark, tokenizer):
    rows = [(i, "same words here again") for i in range(500)] + [(1000 + i, "w " * (i % 40)) for i in range(1000)]
    sequences, tokens = check(rows, pack_whole(frame(spark, rows, 7), 64), tokenizer, 64)
    assert sequences <= -(-tokens // 64) + 5


def test_query_columns(spark, sf_dir, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for p in op12_best_fit(spark, sf_dir).collect()[:100]:
        ids = [*tokenizer.encode(texts[p["doc_id"]], add_special_tokens=False).ids, 0]
        part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
        assert zlib.crc32(part) == p["ids_crc32"] and p["start"] == p["piece"] * LENGTH


def test_empty(empty):
    assert pack_whole(empty).collect() == []
