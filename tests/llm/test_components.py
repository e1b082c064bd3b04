"""Connected components, and how the joins of a large star are dealt."""

import random

import pytest

from rainledger.llm.components import _star, connect
from pyspark.sql import functions as F

SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {(x, find(x)) for x in list(root) if find(x) != x}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    found = connect(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {(r["node"], r["component"]) for r in found.collect()} == brute(edges)


def test_no_edges(spark):
    assert connect(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("large", [True, False])
def test_the_centre_of_a_large_star_is_split(spark, tmp_path, large):
    """Two thirds of the edges hang on one node: in the join of the star its rows go to several tasks."""
    n = 150_000
    hot = F.when(F.col("id") % 3 != 0, F.lit(n)).otherwise(F.col("id"))
    ends = spark.range(n).select(hot.alias("centre"), (F.col("id") + 2 * n).alias("other"))
    pair = ("centre", "other") if large else ("other", "centre")
    rows = ends.select(F.least(*pair).alias("a"), F.greatest(*pair).alias("b"))
    if not large:  # the centre is the larger end
        rows = ends.select((F.col("other") - 2 * n).alias("a"), (F.col("centre") + 2 * n).alias("b")).where("a < b")
    rows.repartition(8).write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    try:
        tied = _star(edges, large)
        tied.collect()
        plan = tied._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
