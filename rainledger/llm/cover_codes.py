"""Codes of vectors by parts: Lloyd's rounds that assign whole subtrees of cover trees at once."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.llm.tables import join_groups, keep

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors of one cover tree; a task holds one tree per part at a time.
BLOCK_ROWS = 4096
#: A node of so few points is not split any more.
LEAF_POINTS = 8
#: Whole components beyond this would not leave room for squared distances in 64 bits.
LARGEST = 1 << 26


class Tree(NamedTuple):
    """A cover tree over the points of one part, as arrays.

    ``points`` stand in tree order, ``order`` tells their rows. Node n holds the points ``start[n]`` to ``stop[n]``, around
    the point ``centre[n]``, the first of its points, within ``radius[n]``; its children are the nodes ``child[n]`` to
    ``child[n] + children[n]``. Levels halve the radius: each point lies within the level's radius of its node (cover), the
    centres of siblings further apart than that (separation), and a node's centre is that of its first child too (nesting).
    ``sums`` are the points summed up from the first on, so a node's sum is the difference of two of them.
    """

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray
    sums: np.ndarray


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, exact: in doubles where they are below 2**53, else in 64-bit integers."""
    largest = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if 4 * int(largest) ** 2 * points.shape[1] < 1 << 53 else np.int64
    a, b = points.astype(kind), entries.astype(kind)
    found = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return found.astype(np.int64)


def build_tree(points: np.ndarray) -> Tree:
    """Nodes level by level; a node's points are dealt to centres that are further apart than the level's radius."""
    order = np.arange(len(points))
    far = np.sqrt(squared(points, points[:1]).max(initial=0))
    nodes = {k: [] for k in ("start", "stop", "radius", "child", "children")}

    def add(start: int, stop: int, radius: float) -> None:
        for k, v in zip(nodes, (start, stop, radius, 0, 0), strict=True):
            nodes[k].append(v)

    add(0, len(points), float(far))
    at = 0
    while at < len(nodes["start"]):
        start, stop, radius = (nodes[k][at] for k in ("start", "stop", "radius"))
        if radius > 0 and stop - start > LEAF_POINTS:
            own = order[start:stop]
            nets = _net(points[own], radius / 2)
            nodes["child"][at], nodes["children"][at] = len(nodes["start"]), len(nets)
            order[start:stop] = own[np.concatenate([rows for rows, _ in nets])]
            for rows, reach in nets:
                add(start, start + len(rows), reach)
                start += len(rows)
        at += 1
    ordered = points[order]
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(ordered, axis=0, dtype=np.int64)])
    kinds = {"radius": np.float64}
    return Tree(ordered, order, sums=sums, **{k: np.array(v, kinds.get(k, np.int64)) for k, v in nodes.items()})


def _net(points: np.ndarray, within: float) -> list[tuple[np.ndarray, float]]:
    """Rows around each centre, the centre first, and the largest distance from it."""
    left, found = np.arange(len(points)), []
    while len(left):
        away = np.sqrt(squared(points[left], points[left[:1]])[:, 0])
        near = away <= within
        found.append((left[near], float(away[near].max())))
        left = left[~near]
    return found


class Found(NamedTuple):
    """Node ranges that lie with one entry, and single points with theirs."""

    starts: np.ndarray
    stops: np.ndarray
    of_range: np.ndarray
    points: np.ndarray
    of_point: np.ndarray


def assign(tree: Tree, entries: np.ndarray) -> Found:
    """The nearest entry of every point, ties to the lower one.

    With d the distance of a node's centre to its nearest entry and r the node's radius, an entry further than
    d + 2 r from the centre is nearest to none of its points. If one entry is left, all points of the node are its
    own; a node of equal points takes the nearest one. The others hand the entries that are left to their children, and
    the points of small nodes are compared with those that are left for them.
    """
    starts, stops, of_range, points, of_point = [], [], [], [], []
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    worst = np.iinfo(np.int64).max
    while len(nodes):
        away = np.where(open_, squared(tree.points[tree.start[nodes]], entries), worst)
        best = away.argmin(axis=1)
        nearest = np.sqrt(away[np.arange(len(nodes)), best].astype(np.float64))
        reach = (nearest + 2 * tree.radius[nodes]) * (1 + 1e-9) + 1e-6
        open_ &= np.sqrt(away.astype(np.float64)) <= reach[:, None]
        sure = (open_.sum(axis=1) == 1) | (tree.radius[nodes] == 0)
        starts.append(tree.start[nodes[sure]])
        stops.append(tree.stop[nodes[sure]])
        of_range.append(best[sure])
        leaf = ~sure & (tree.children[nodes] == 0)
        sizes = (tree.stop - tree.start)[nodes[leaf]]
        own = np.repeat(tree.start[nodes[leaf]], sizes) + _counting(sizes)
        compared = np.where(np.repeat(open_[leaf], sizes, axis=0), squared(tree.points[own], entries), worst)
        points.append(own)
        of_point.append(compared.argmin(axis=1))
        down = ~sure & ~leaf
        number = tree.children[nodes[down]]
        open_ = np.repeat(open_[down], number, axis=0)
        nodes = np.repeat(tree.child[nodes[down]], number) + _counting(number)
    return Found(*map(np.concatenate, (starts, stops, of_range, points, of_point)))


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def entry_sums(tree: Tree, found: Found, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Points per entry and their sum, a whole range at a time."""
    counts, sums = np.zeros(entries, np.int64), np.zeros((entries, tree.points.shape[1]), np.int64)
    np.add.at(counts, found.of_range, found.stops - found.starts)
    np.add.at(sums, found.of_range, tree.sums[found.stops] - tree.sums[found.starts])
    np.add.at(counts, found.of_point, 1)
    np.add.at(sums, found.of_point, tree.points[found.points])
    return counts, sums


def point_entries(tree: Tree, found: Found) -> np.ndarray:
    """The entry of each row, in the rows' own order."""
    in_order = np.empty(len(tree.points), np.int64)
    sizes = found.stops - found.starts
    in_order[np.repeat(found.starts, sizes) + _counting(sizes)] = np.repeat(found.of_range, sizes)
    in_order[found.points] = found.of_point
    rows = np.empty_like(in_order)
    rows[tree.order] = in_order
    return rows


def _packed(tree: Tree) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree._asdict())
    return out.getvalue()


def _unpacked(raw: bytes) -> Tree:
    with np.load(io.BytesIO(raw)) as found:
        return Tree(**{name: found[name] for name in Tree._fields})


def whole_vectors(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """``vector``: floor(scale * component) of each row; rows without a vector or with a null or non-finite component go."""
    given = F.transform(vector_col, lambda x: x.cast("double"))
    good = F.coalesce(
        F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(given) > 0), F.lit(False)
    )

    def whole(x: Column) -> Column:
        found = F.floor(x * scale)
        return F.when(F.abs(found) <= LARGEST, found).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))

    return vectors.where(good).withColumn("vector", F.transform(given, whole))


def first_entries(rows: DataFrame, id_col: str, entries: int) -> np.ndarray:
    """The vectors of the smallest ids (NULL last, ties by components); at most ``entries`` rows."""
    first = rows.select(id_col, "vector").orderBy(F.col(id_col).asc_nulls_last(), "vector").limit(entries)
    return np.array([r["vector"] for r in first.collect()], np.int64)


def tree_rows(rows: DataFrame, id_col: str, parts: int) -> DataFrame:
    """Blocks of vectors with one packed tree per part; stored, as every round reads them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(at, BLOCK_ROWS)
                flat = block.column("vector").flatten().to_numpy().astype(np.int64).reshape(block.num_rows, -1)
                trees = [_packed(build_tree(part)) for part in np.split(flat, parts, axis=1)]
                lists = [pa.array([block.column(c).to_pylist()], pa.list_(block.schema.field(c).type)) for c in (id_col, "label_key")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (id_col, "label_key")}
    schema = f"ids array<{kinds[id_col]}>, labels array<{kinds['label_key']}>, trees array<binary>"
    return keep(rows.select(id_col, "label_key", "vector").mapInArrow(build, schema), "cover-trees")


def lloyd_round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry becomes the floor of its points' mean; one without points stays.

    Each partition adds up its trees and sends one row per part and entry; the sums come back to the driver, which holds
    the codebooks: parts * entries rows, whatever the input.
    """
    dims = books[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros_like(b) for b in books]
        for batch in batches:
            for packed in batch.column("trees"):
                for p, raw in enumerate(packed):
                    tree = _unpacked(raw.as_buffer().to_pybytes())
                    more, total = entry_sums(tree, assign(tree, books[p]), len(books[p]))
                    counts[p] += more
                    sums[p] += total
        for p, book in enumerate(books):
            used = np.flatnonzero(counts[p])
            columns = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used])]
            values = [pa.array(sums[p][used, d]) for d in range(dims)]
            yield pa.RecordBatch.from_arrays([*columns, *values], names=["part", "entry", "points", *[f"sum{d}" for d in range(dims)]])

    schema = "part int, entry int, points bigint, " + ", ".join(f"sum{d} bigint" for d in range(dims))
    added = trees.select("trees").mapInArrow(add, schema).groupBy("part", "entry").agg(
        F.sum("points").alias("points"), *[F.sum(f"sum{d}").alias(f"sum{d}") for d in range(dims)]
    )
    moved = [b.copy() for b in books]
    for row in added.collect():
        moved[row["part"]][row["entry"]] = [row[f"sum{d}"] // row["points"] for d in range(dims)]
    return moved


def coded(trees: DataFrame, books: list[np.ndarray], id_col: str) -> DataFrame:
    """id, label_key, code and error of every vector."""
    kinds = {c: trees.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, packed in zip(*(batch.column(c) for c in ("ids", "labels", "trees")), strict=True):
                codes = np.empty((len(ids), len(books)), np.uint8)
                errors = np.zeros(len(ids), np.int64)
                for p, raw in enumerate(packed):
                    tree = _unpacked(raw.as_buffer().to_pybytes())
                    codes[:, p] = found = point_entries(tree, assign(tree, books[p]))
                    errors[tree.order] += ((tree.points - books[p][found[tree.order]]) ** 2).sum(axis=1)
                texts = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(texts), pa.array(errors)], names=[id_col, "label_key", "code", "error"])

    return trees.mapInArrow(code, f"`{id_col}` {kinds['ids']}, label_key {kinds['labels']}, code string, error bigint")


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """id, label_key, code and error of every vector, and the final codebooks, one array of entries per part.

    - Rows whose vector is null, empty or holds null or non-finite components take no part. A whole component beyond
      LARGEST stops the job.
    - All vectors have the length of the one with the smallest id, a multiple of ``parts``; others stop the job.
    - NULL ids come last and ties of ids go by the components when the first entries are chosen; with fewer vectors than
      ``entries`` the codebooks are shorter. Rows repeated whole are coded each.
    - An empty table gives no rows and empty codebooks. Further columns are not read, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte per part")
    named = vectors.select(id_col, vector_col, F.col(label_col).alias("label_key"))
    rows = keep(whole_vectors(named, vector_col, scale).select(id_col, "label_key", "vector"), "whole-vectors")
    first = rows.select(id_col, "vector").orderBy(F.col(id_col).asc_nulls_last(), "vector").first()
    if first is None:
        return rows.select(id_col, "label_key", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    width = len(first["vector"])
    if width % parts or not rows.where(F.size("vector") != width).isEmpty():
        raise ValueError(f"vectors of one length, a multiple of {parts}, are needed")
    trees = tree_rows(rows, id_col, parts)
    books = np.split(first_entries(rows, id_col, entries), parts, axis=1)
    for _ in range(rounds):
        books = lloyd_round(trees, books)
    return coded(trees, books, id_col), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def op13_cover_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, and the errors summed per label."""
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = keep(found.withColumn("label_key", F.struct("label_key")), "vector-codes")
    totals = keep(
        rows.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("members")), "label-errors"
    )
    joined = join_groups(rows, totals, "label_key", "members")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Each round is three steps: the nearest entry of every part, the sums, and the new entries."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (
    SELECT vec_id, label, part, v, min_by(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
        SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d
        FROM parts p JOIN book{r} b USING (part)) GROUP BY ALL)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""book{r + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
        SELECT part, entry, list(mean ORDER BY i) AS v FROM (
            SELECT part, entry, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS mean
            FROM near{r}, generate_series(1, len(v)) AS g(i) GROUP BY part, entry, i) GROUP BY part, entry
    ) m USING (part, entry))"""
            )
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), parts AS MATERIALIZED (
    SELECT vec_id, label, part, list_slice(v, part * len(v) // {PARTS} + 1, (part + 1) * len(v) // {PARTS}) AS v
    FROM kept, range({PARTS}) AS r(part)
), book0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v
    FROM parts QUALIFY entry < {ENTRIES}
), {", ".join(steps)}, hashed AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS digest FROM book{ROUNDS}
), codes AS (
    SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
    FROM near{ROUNDS} GROUP BY ALL
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM codes, hashed
"""


ORACLE = _oracle()
