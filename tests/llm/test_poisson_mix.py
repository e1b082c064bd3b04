import hashlib
import math
from collections import Counter

import pytest

from edge_rows import EDGES, frame
from rainledger.llm.poisson_mix import SEED, mix


def brute(rows, weights=None):
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source or ""] += len((text or "").encode()) + 1
    weight = {s: 1.0 if weights is None else weights.get(s, 0.0) for s in sizes}
    whole, all_weights = sum(sizes.values()), sum(weight.values())
    out = Counter()
    for doc_id, text, _, source in rows:
        s = source or ""
        rate = weight[s] * whole / (all_weights * sizes[s])
        text_hash = hashlib.md5((text or "").encode()).hexdigest()
        named = f"{SEED}|{'' if doc_id is None else doc_id}|{text_hash}"
        u = int(hashlib.md5(named.encode()).hexdigest()[:13], 16) / 2**52
        k, log = 0, -rate
        below = math.exp(log)
        while rate > 0 and below <= u and k < 10 * rate + 100:
            k += 1
            log += math.log(rate) - math.log(k)
            below += math.exp(log)
        for copy in range(1, k + 1):
            out[doc_id, text, source, copy] += 1
    return out


def got(docs, weights=None):
    return Counter((r["doc_id"], r["text"], r["source"], r["copy"]) for r in mix(docs, weights).collect())


def full(rows):
    return [(*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]


def test_edges(spark, edges):
    assert got(edges) == brute(full(EDGES))


@pytest.mark.parametrize("weights", [None, {"hot": 1.0, "s1": 3.0, "s2": 0.5}])
def test_shares(spark, weights):
    rows = [(i, "x" * (i % 40), "en", "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(6000)]
    found = got(frame(spark, rows, 6), weights)
    assert found == brute(rows, weights)
    size = Counter()
    for (_, text, source, _), n in found.items():
        size[source] += n * (len(text) + 1)
    want = weights or {s: 1.0 for s in size}
    for source, w in want.items():
        assert abs(size[source] / sum(size.values()) - w / sum(want.values())) < 0.04


def test_large_rate(spark):
    rows = [(i, "x", "en", "many") for i in range(3000)] + [(9999, "x", "en", "one")]
    assert got(frame(spark, rows, 4)) == brute(rows)


def test_order_is_random_and_repeatable(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}") for i in range(500)]
    first = [r["doc_id"] for r in mix(frame(spark, rows, 2)).collect()]
    again = [r["doc_id"] for r in mix(frame(spark, rows[::-1], 7)).collect()]
    assert sorted(first) == sorted(again) and first != sorted(first)


def test_empty(empty):
    assert mix(empty).collect() == []


def test_a_very_large_rate(spark):
    """Two rows of a tiny source beside a large text: a rate of a million, drawn in a hundred parts."""
    from pyspark.sql import functions as F

    docs = frame(spark, [(1, "", "en", "tiny"), (2, "ab", "en", "tiny"), (3, "x" * 8_000_000, "en", "large")])
    found = mix(docs).where("source = 'tiny'").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("different"))
    rows = {r["doc_id"]: r for r in found.collect()}
    rate = (8_000_001 + 4) / (2 * 4)
    for doc_id in (1, 2):
        assert abs(rows[doc_id]["n"] - rate) < 6 * math.sqrt(rate) and rows[doc_id]["different"] == rows[doc_id]["n"]
    assert rows[1]["n"] != rows[2]["n"]
