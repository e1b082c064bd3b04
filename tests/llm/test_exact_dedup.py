import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from edge_rows import EDGES, frame
from rainledger.llm.exact_dedup import digest_rows, exact_duplicates, merge_tree


def brute(rows, best):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("largest", [True, False])
def test_edges(edges, largest):
    got = [tuple(r) for r in exact_duplicates(edges, keep_largest=largest).collect()]
    assert sorted(got, key=repr) == brute(EDGES, max if largest else min)


def test_hot_group(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 700}") for i in range(3000)]
    got = [tuple(r) for r in exact_duplicates(frame(spark, rows, 20)).collect()]
    assert sorted(got, key=repr) == brute(rows, max)


def test_empty(empty):
    assert exact_duplicates(empty).collect() == []


def test_runs_are_merged_by_sorting(spark):
    rows = digest_rows(frame(spark, [(i, f"t{i % 5}") for i in range(100)], 20))
    plan = merge_tree(rows, True, fan_in=4)._jdf.queryExecution().toString()
    assert plan.count("SortAggregate") >= 6


def test_one_digest_for_two_texts_stops(spark):
    rows = digest_rows(frame(spark, [(1, "a"), (2, "b")])).withColumn("digest", F.lit(b"d"))
    with pytest.raises(Exception, match="one digest for two texts"):
        merge_tree(rows, True).collect()
