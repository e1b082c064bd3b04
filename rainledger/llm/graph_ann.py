"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainledger.llm.tables import keep

#: Memory of a shard, whose graph one task builds; edges per vector; lengths of the search list.
SHARD_BYTES = 16 << 20
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 128
#: Relaxation of the pruning rule in the first and the second pass.
RELAXED = (1.0, 1.2)
#: Queries that walk in step, and queries that a copy of a graph meets: about as many bytes as the graph has.
QUERY_BLOCK = 256
QUERY_GROUP = 16_384
#: More tasks than shards or groups of queries, so that few share one; no more than this, whatever their number.
_SPREAD, _MOST_TASKS = 4, 20_000
_BUILD_BLOCK = 512
#: Distances that one pruning step holds at a time.
_PRUNE_CELLS = 8_000_000
#: Directions that agree on a grid of this width are one node; squared distances below the second are rounding.
_SAME_DIRECTION = 2.0**-18
_ROUNDING = 1e-6


def _entries(near: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distance, node and an open mark in one number that sorts by distance; the bits of a float that isn't negative sort as it does."""
    bits = np.maximum(near, 0).astype(np.float32).view(np.int32).astype(np.int64)
    return bits << 32 | nodes << 1


def _beam_search(
    vectors: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of the ``beam`` nearest seen of each query, nearest first; -1 where there are fewer.

    All queries of a block walk in step: each expands its nearest node that it hasn't expanded yet. Distances are
    computed only to nodes that a query meets for the first time.
    """
    nobody = np.int64(np.iinfo(np.int64).max)  # expanded already, and behind every node
    count, none = len(queries), len(vectors)
    seen = np.zeros((count, none + 1), bool)
    seen[:, none] = seen[:, start] = True
    squares, own = np.einsum("nd,nd->n", vectors, vectors), np.einsum("qd,qd->q", queries, queries)
    lists = np.full((count, beam), nobody)
    lists[:, 0] = _entries(squares[start] + own - 2 * (queries @ vectors[start]), np.int64(start))
    active = np.arange(count)
    while len(active):
        unopened = lists[active] & 1 == 0
        place = np.argmax(unopened, axis=1)
        going = unopened[np.arange(len(active)), place]
        active, place = active[going], place[going]
        if not len(active):
            break
        nodes = edges[(lists[active, place] & 0xFFFFFFFF) >> 1]
        lists[active, place] |= 1
        row, slot = np.nonzero(~seen[active[:, None], nodes])
        met, asking = nodes[row, slot], active[row]
        seen[asking, met] = True
        far = squares[met] + own[asking] - 2 * np.einsum("nd,nd->n", vectors[met], queries[asking])
        wider = np.full((len(active), beam + nodes.shape[1]), nobody)
        wider[:, :beam] = lists[active]
        wider[row, beam + slot] = _entries(far, met.astype(np.int64))
        wider.sort(axis=1)
        lists[active] = wider[:, :beam]
    found = lists != nobody
    ids = np.where(found, (lists & 0xFFFFFFFF) >> 1, -1)
    near = np.where(found, (lists >> 32).astype(np.int32).view(np.float32), np.inf).astype(np.float32)
    return ids, near


def _different(points: np.ndarray, candidates: np.ndarray, none: int) -> np.ndarray:
    """Each candidate of a point once, without the point itself."""
    candidates = np.sort(np.where((candidates < 0) | (candidates == points[:, None]), none, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = none
    return candidates


def _prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """Robust pruning: take the nearest candidate, drop those much nearer to it than to the point, and so on.

    ``candidates`` has -1 for none; the result has len(vectors) for none.
    """
    none = len(vectors)
    candidates = _different(points, candidates, none)
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])
    there = padded[candidates]
    products = there @ there.transpose(0, 2, 1)
    squares = np.einsum("pcc->pc", products).copy()
    mine = vectors[points]
    to_point = squares + np.einsum("pd,pd->p", mine, mine)[:, None] - 2 * np.einsum("pcd,pd->pc", there, mine)
    to_point = np.where(candidates != none, np.maximum(to_point, 0), np.inf)
    out = np.full((len(points), degree), none)
    rows = np.arange(len(points))
    for k in range(degree):
        best = np.argmin(to_point[rows], axis=1)
        left = np.isfinite(to_point[rows, best])
        rows, best = rows[left], best[left]
        if not len(rows):
            break
        out[rows, k] = candidates[rows, best]
        between = squares[rows] + squares[rows, best][:, None] - 2 * products[rows, best]
        between[between < _ROUNDING] = 0
        to_point[rows] = np.where(relaxed**2 * between > to_point[rows], to_point[rows], np.inf)
        to_point[rows, best] = np.inf
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 5) -> tuple[np.ndarray, int]:
    """Edges (len(vectors) for none) and the start node of a shard.

    From random edges, two passes over all points: greedy search proposes neighbours, pruning keeps diverse
    ones, and each chosen neighbour gets an edge back, pruned again where it has too many.
    """
    n = len(vectors)
    none = n
    if n == 1:
        return np.full((1, degree), none), 0
    draw = np.random.RandomState(seed)
    edges = draw.randint(0, n, (n, degree))
    edges[edges == np.arange(n)[:, None]] = none
    start = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    for relaxed in RELAXED:
        order = draw.permutation(n)
        for low in range(0, n, _BUILD_BLOCK):
            points = order[low : low + _BUILD_BLOCK]
            found, _ = _beam_search(vectors, edges, start, vectors[points], beam)
            mine = np.where(edges[points] == none, -1, edges[points])
            chosen = _prune(vectors, points, np.concatenate([found, mine], axis=1), degree, relaxed)
            edges[points] = chosen
            target, source = chosen.ravel(), np.repeat(points, degree)
            real = target != none
            target, source = target[real], source[real]
            by_target = np.argsort(target, kind="stable")
            source = source[by_target]
            heads, counts = np.unique(target, return_counts=True)
            ends = np.cumsum(counts)
            widest_first = np.argsort(-counts, kind="stable")
            at = 0
            while at < len(heads):
                width = int(counts[widest_first[at]])
                part = widest_first[at : at + max(1, _PRUNE_CELLS // (degree + width) ** 2)]
                at += len(part)
                back = np.full((len(part), width), -1)
                for row, head in enumerate(part):
                    back[row, : counts[head]] = source[ends[head] - counts[head] : ends[head]]
                nodes = heads[part]
                old = np.where(edges[nodes] == none, -1, edges[nodes])
                all_of = np.sort(_different(nodes, np.concatenate([old, back], axis=1), none), axis=1)
                full = all_of[:, degree] != none
                edges[nodes[~full]] = all_of[~full, :degree]
                edges[nodes[full]] = _prune(vectors, nodes[full], all_of[full], degree, relaxed)
    return edges, start


def shard_count(classes: DataFrame, shard_bytes: int) -> int:
    """Shards of about that many bytes: a vector in double and in single precision, and its edges."""
    each = F.size("embedding") * 12 + 8 * DEGREE
    total = classes.agg(F.coalesce(F.sum(each), F.lit(0)).alias("bytes")).first()["bytes"]
    return max(1, -(-total // shard_bytes))


def usable(vector: Column) -> Column:
    """Vectors that have a direction: not NULL, no NULL or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def vector_classes(vectors: DataFrame, keep_ids: int) -> DataFrame:
    """One row per different vector with its ``keep_ids`` smallest ids, and a shard.

    Equal vectors are equally near to every query and ties go to smaller ids, so no other id of the class can
    be among the nearest. Salted ranks come first: a vector that a third of all rows share is cut down in many tasks.
    """
    by = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    few = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = few.withColumn("place", F.row_number().over(by)).where(F.col("place") <= keep_ids)
    ids = F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep_ids)
    return few.groupBy("embedding").agg(ids.alias("ids"))


def _units(exact: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaling by the largest component keeps squares in range."""
    scaled = exact / np.abs(exact).max(axis=1)[:, None]
    return (scaled / np.linalg.norm(scaled, axis=1)[:, None]).astype(np.float32)


def direction_nodes(unit: np.ndarray) -> np.ndarray:
    """For each unit vector the number of its direction, in order of first appearance."""
    grid = np.ascontiguousarray(np.round(unit / _SAME_DIRECTION).astype(np.int32))
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(row.tobytes(), len(numbers)) for row in grid])


def graph_rows(classes: DataFrame, shards: int) -> DataFrame:
    """One row per dimension and shard: ids of the classes, their vectors, edges and start node, all as bytes.

    A node is a direction: vectors that differ in length alone share it, as copies at distance 0 would fill each
    other's edges. ``members`` counts the classes of each node; classes are sorted by node.
    """
    sharded = classes.withColumns(
        {"dims": F.size("embedding"), "shard": F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")}
    )

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(least=[int(x[0]) for x in rows["ids"]]).sort_values("least")
        exact = np.array(rows["embedding"].tolist(), np.float64)
        nodes = direction_nodes(_units(exact))
        by_node = np.argsort(nodes, kind="stable")
        exact, members = exact[by_node], np.bincount(nodes).astype(np.int32)
        edges, start = build_graph(_units(exact[np.cumsum(members) - members]))
        ids = [np.asarray(rows["ids"].iloc[i], np.int64) for i in by_node]
        counts = np.array([len(x) for x in ids], np.int32)
        flat = np.concatenate(ids)
        return pd.DataFrame(
            [(int(key[0]), int(key[1]), flat.tobytes(), counts.tobytes(), members.tobytes(), exact.tobytes(), edges.astype(np.int32).tobytes(), start)],
            columns=["dims", "shard", "ids", "counts", "members", "vectors", "edges", "start"],
        )

    schema = "dims int, shard int, ids binary, counts binary, members binary, vectors binary, edges binary, start int"
    spread = sharded.repartition(min(_SPREAD * shards, _MOST_TASKS), "dims", "shard")
    return spread.groupBy("dims", "shard").applyInPandas(build, schema)


def _cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; scaling by the largest component keeps squares in range."""
    q = query / np.abs(query).max()
    v = vectors / np.abs(vectors).max(axis=1)[:, None]
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


@dataclass
class Shard:
    """A graph as a worker holds it: class ``c`` has the vector ``exact[c]`` and ``counts[c]`` of the ids."""

    exact: np.ndarray
    counts: np.ndarray
    flat: np.ndarray
    members: np.ndarray
    edges: np.ndarray
    start: int

    @classmethod
    def of(cls, row: dict) -> Shard:
        members = np.frombuffer(row["members"], np.int32)
        return cls(
            np.frombuffer(row["vectors"]).reshape(-1, row["dims"]),
            np.frombuffer(row["counts"], np.int32),
            np.frombuffer(row["ids"], np.int64),
            members,
            np.frombuffer(row["edges"], np.int32).reshape(len(members), -1),
            row["start"],
        )

    def __post_init__(self) -> None:
        self.first_id = np.cumsum(self.counts) - self.counts
        self.first_class = np.cumsum(self.members) - self.members
        self.unit = _units(self.exact[self.first_class])

    def nearest(self, asking: np.ndarray, asked: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """Query, vec_id and exact cosine of the ``k`` best that the beam finds, the query itself aside."""
        found, _ = _beam_search(self.unit, self.edges, self.start, _units(asked), beam)
        for query, vector, nodes in zip(asking.tolist(), asked, found, strict=True):
            nodes = nodes[nodes >= 0]
            of_nodes = np.concatenate([np.arange(self.first_class[n], self.first_class[n] + self.members[n]) for n in nodes])
            scores = _cosines(vector, self.exact[of_nodes])
            if len(scores) > k + 1:  # one of the best k + 1 can be the query itself; equal scores stay
                near = scores >= np.partition(scores, -k - 1)[-k - 1]
                of_nodes, scores = of_nodes[near], scores[near]
            hits = [
                (-score, int(v))
                for c, score in zip(of_nodes, scores.tolist(), strict=True)
                for v in self.flat[self.first_id[c] : self.first_id[c] + self.counts[c]]
                if v != query
            ]
            yield from ((query, v, -score) for score, v in sorted(hits)[:k])


def search(graphs: DataFrame, queries: DataFrame, shards: int, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` nearest found of each query in each shard, by exact cosines of what the beam has found.

    Rows of a shard and a group of queries are sorted with the graph in front: a worker decodes it once and answers
    the queries as they stream by, so neither needs the other in memory whole, nor travels once per pair.
    """
    groups = max(1, -(-queries.count() // QUERY_GROUP))
    asking = (
        queries.withColumn("dims", F.size("embedding"))
        .withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    copies = graphs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    place = ["dims", "shard", "group"]
    met = (
        copies.unionByName(asking, allowMissingColumns=True)
        .repartition(min(_SPREAD * shards * groups, _MOST_TASKS), *place)
        .sortWithinPartitions(*place, F.col("start").asc_nulls_last())
        .select(*graphs.columns, "group", "query_id", "embedding")
    )
    graph_columns = graphs.columns

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for batch in batches:
            where = np.stack([batch.column(name).to_numpy() for name in place], axis=1)
            is_graph = batch.column("start").is_valid().to_numpy(zero_copy_only=False)
            new = np.append(np.any(where[1:] != where[:-1], axis=1) | is_graph[1:], True).nonzero()[0] + 1
            low = 0
            for high in new.tolist():
                if is_graph[low]:
                    row = batch.select(graph_columns).slice(low, 1).to_pylist()[0]
                    shard, at, low = Shard.of(row), tuple(where[low]), low + 1
                for first in range(low, high, QUERY_BLOCK):
                    if at != tuple(where[first]):
                        break  # no vector of that length in this shard
                    count = min(QUERY_BLOCK, high - first)
                    asked = batch.column("embedding").slice(first, count).flatten().to_numpy().reshape(count, -1)
                    out = list(shard.nearest(batch.column("query_id").slice(first, count).to_numpy(), asked, k, beam))
                    columns = list(zip(*out, strict=True)) or [[], [], []]
                    types = [pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["query_id", "vec_id", "score"]
                    )
                low = high

    return met.mapInArrow(answers, "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each row that ``queries`` marks.

    ``vectors`` has vec_id and embedding; the measure is the cosine of the original vectors in double precision.

    - Vectors that are NULL, zero or hold NULL or non-finite components neither ask nor answer; nor do rows without vec_id.
    - Vectors are compared with those of their own number of components.
    - A row is no answer to itself. Equal vectors all count; ties go to the smaller vec_id.
    - Rows repeated whole are one. With fewer than k candidates all are returned; an empty table gives no rows.
    - Further columns are not read, whatever their names.
    """
    exact = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = keep(
        good.select("vec_id", exact.alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
        .dropDuplicates(["vec_id", "embedding"]),
        "vectors",
    )
    classes = keep(vector_classes(rows.select("vec_id", "embedding"), k + 1), "vector-classes")
    shards = shard_count(classes, shard_bytes)
    graphs = keep(graph_rows(classes, shards), "graphs")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = keep(search(graphs, asked, shards, k), "shard-answers")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_graph_ann(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0)
