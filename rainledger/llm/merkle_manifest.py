"""A Merkle tree over the documents of each language, with a proof per document."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rainledger.llm.tables import documents, join_groups, join_sized, keep

#: Nodes that become one parent.
FAN_OUT = 8
#: Levels that one grouping reduces: a group has at most FAN_OUT ** LEVELS nodes.
LEVELS = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_WORD_BITS = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Siblings left and right of a node, level by level, and the two roots above.
_PATH = "`left` array<string>, `right` array<string>, subroot string, root string"


def digest(*values: Column) -> Column:
    """SHA-256 of the values one after another: `-` for NULL, else the length in bytes, a colon and the value."""
    shown = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)]
    return F.sha2(F.concat(*shown), 256)


def lowered(text: Column) -> Column:
    """A-Z as a-z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def leaf_rows(docs: DataFrame, claimed: Column) -> DataFrame:
    """doc_id, tree (the language as a text that sorts NULL first), leaf, and the leaf of the claimed text; stored."""
    rest = [F.col(c) for c in COLUMNS[:-1]]
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        digest(*rest, F.col("text")).alias("leaf"),
        F.when(claimed.eqNullSafe(F.col("text")), F.lit(None)).otherwise(digest(*rest, claimed)).alias("claimed_leaf"),
    )
    return keep(rows, "leaves")


def numbered(rows: DataFrame, keys: list[str], count: str, name: str) -> DataFrame:
    """Stored rows with ``before``: the sum of ``count`` over all rows that sort before them by ``keys``.

    The rows are sorted over range partitions; sums inside a partition go along its rows, and those of the partitions
    before are a sum over one row per partition.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            counts = batch.column(count).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, run, np.int32)), pa.array(ends - counts)],
                names=[*batch.schema.names, "run", "in_run"],
            )
            total = int(ends[-1]) if len(ends) else total

    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    runs = keep(ranged.mapInArrow(run_sums, f"{kinds}, run int, in_run bigint"), name)
    earlier = runs.groupBy("run").agg(F.sum(count).alias("total")).selectExpr(
        "run", "coalesce(sum(total) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base"
    )
    return runs.join(F.broadcast(earlier), "run").withColumn("before", F.col("base") + F.col("in_run")).drop("run", "in_run", "base")


def directory(leaves: DataFrame) -> DataFrame:
    """The merged bitmaps of all trees with their counts: one row per tree and 64 neighbouring ids that hold one.

    ``bits`` are the ids that are there, merged by OR before and after the exchange; ids that are not there cost nothing,
    whatever the gaps. ``members`` are the rows, more than the bits if ids are repeated or NULL, and ``before`` the rows of
    the tree with smaller ids. NULL ids have a row of their own before all others.
    """
    words = leaves.groupBy(F.struct("tree", F.shiftright("doc_id", _WORD_BITS).alias("word")).alias("place")).agg(
        F.coalesce(F.bit_or(F.expr("shiftleft(1L, CAST(doc_id & 63 AS INT))")), F.lit(0).cast("long")).alias("bits"),
        F.count("*").alias("members"),
    )
    counted = keep(numbered(words.select("place.tree", "place.word", "bits", "members"), ["tree", "word"], "members", "bitmaps"), "directory")
    trees = keep(counted.groupBy("tree").agg(F.min("before").alias("tree_start"), F.sum("members").alias("tree_rows")), "trees")
    joined = join_sized(counted, trees, ["tree"], "inner", F.octet_length("tree") + 48)
    own = joined.select(
        F.struct("tree", "word").alias("place"), "bits", "members", (F.col("before") - F.col("tree_start")).alias("before"), "tree_rows"
    )
    return keep(own, "popcounts")


def coordinates(leaves: DataFrame) -> DataFrame:
    """Leaves with their rank in the tree and its number of rows, by counting bits.

    An id that is there once has as many smaller ones as rows stand before its word and bits before its own. Only rows in
    words with repeated or NULL ids are sorted, by id and leaf, over range partitions.
    """
    words = directory(leaves)
    placed = leaves.withColumn("place", F.struct("tree", F.shiftright("doc_id", _WORD_BITS).alias("word")))
    found = keep(join_groups(placed, words, "place", "members"), "leaf-words")
    alone = F.col("members") == F.bit_count("bits")
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, CAST(doc_id & 63 AS INT))"))
    result = ["doc_id", "tree", "leaf", "claimed_leaf", "tree_rows"]
    ranked = found.where(alone).select(*result, (F.col("before") + below).alias("rank"))
    tied = found.where(~alone).select(*result, "place", F.col("before").alias("word_before"), F.lit(1).cast("long").alias("one"), "members")
    sorted_ = keep(numbered(tied, ["tree", "doc_id", "leaf"], "one", "tied-leaves"), "tied-places")
    firsts = keep(sorted_.groupBy("place").agg(F.min("before").alias("first"), F.count("*").alias("rows")), "tied-words")
    in_word = join_groups(sorted_.drop("members"), firsts, "place", "rows")
    resolved = in_word.select(*result, (F.col("word_before") + F.col("before") - F.col("first")).alias("rank"))
    return keep(ranked.unionByName(resolved), "leaf-places")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def block_levels(slots: list[str], total: int, levels: int) -> list[list[str]]:
    """The nodes of a block, level by level; the last list holds its one root.

    A block of a tree with more nodes than a block goes up all ``levels``, however few it holds; one that is its whole
    tree only until one node is left.
    """
    found = [slots]
    while len(found) <= levels if total > FAN_OUT**levels else len(found[-1]) > 1:
        below = found[-1]
        found.append([_sha("".join(below[i : i + FAN_OUT])) for i in range(0, len(below), FAN_OUT)])
    return found


def siblings(levels: list[list[str]], slot: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a slot's node in its run, on each level below the root."""
    left, right = [], []
    for nodes in levels[:-1]:
        first = slot - slot % FAN_OUT
        left.append("".join(nodes[first:slot]))
        right.append("".join(nodes[slot + 1 : first + FAN_OUT]))
        slot //= FAN_OUT
    return left, right


def _slots(table: pa.Table, levels: int) -> tuple[list[int], list[str]]:
    """The slot of each row, and the nodes put into their slots: an array keyed by slot, no sort."""
    own = [r % FAN_OUT**levels for r in table.column("rank").to_pylist()]
    nodes = [""] * len(own)
    for slot, node in zip(own, table.column("node").to_pylist(), strict=True):
        nodes[slot] = node
    return own, nodes


def _block(levels: int) -> Column:
    return F.expr(f"rank DIV {FAN_OUT**levels}").alias("block")


def reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, rank, node, tree_rows of the blocks' roots; ``nodes`` has the same columns."""

    def up(table: pa.Table) -> pa.Table:
        _, slots = _slots(table, levels)
        total = table.column("tree_rows")[0].as_py()
        root = block_levels(slots, total, levels)[-1][0]
        rank = table.column("rank")[0].as_py() // FAN_OUT**levels
        blocks = -(-total // FAN_OUT**levels)
        return pa.table({"tree": [table.column("tree")[0].as_py()], "rank": [rank], "node": [root], "tree_rows": [blocks]})

    return nodes.select("tree", "rank", "node", "tree_rows", _block(levels)).groupBy("tree", "block").applyInArrow(
        up, "tree string, rank bigint, node string, tree_rows bigint"
    )


def climbed(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """All stored stages from the nodes to one node per tree; each stage has a share of the one before."""
    stages = [nodes]
    while not stages[-1].where("tree_rows > 1").isEmpty():
        stages.append(keep(reduced(stages[-1], levels), name))
    return stages


def _with_paths(nodes: DataFrame, paths: DataFrame, levels: int, work: Callable[..., pa.Table], schema: str) -> DataFrame:
    """``work(table, slots, nodes by level, above)`` on each block of nodes and the one path of its root.

    ``paths`` has tree, rank and _PATH of every node of the stage above; a block meets exactly one of them.
    """

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        own, slots = _slots(left, levels)
        by_level = block_levels(slots, left.column("tree_rows")[0].as_py(), levels)
        (above,) = right.select(["left", "right", "subroot", "root"]).to_pylist()
        return work(left, own, by_level, above)

    blocks = nodes.withColumn("block", _block(levels)).groupBy("tree", "block")
    return blocks.cogroup(paths.withColumn("block", F.col("rank")).groupBy("tree", "block")).applyInArrow(down, schema)


def _path_rows(table: pa.Table, own: list[int], levels: list[list[str]], above: dict) -> pa.Table:
    paths = [siblings(levels, slot) for slot in own]
    return pa.table(
        {
            "tree": table.column("tree"),
            "rank": table.column("rank"),
            "left": pa.array([x + above["left"] for x, _ in paths], pa.list_(pa.string())),
            "right": pa.array([y + above["right"] for _, y in paths], pa.list_(pa.string())),
            "subroot": pa.array([above["subroot"]] * len(own), pa.string()),
            "root": pa.array([above["root"]] * len(own), pa.string()),
        }
    )


def descended(stages: list[DataFrame], top: DataFrame, levels: int, name: str) -> DataFrame:
    """Paths of the nodes of the second stage, from those of the last (``top``)."""
    paths = top
    for nodes in reversed(stages[1:-1]):
        paths = keep(_with_paths(nodes, paths, levels, _path_rows, f"tree string, rank bigint, {_PATH}"), name)
    return paths


def folded(leaf: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for x, y in zip(left, right, strict=True):
        leaf = _sha(x + leaf + y)
    return leaf


def _proof_rows(kind: pa.DataType):
    def prove(table: pa.Table, own: list[int], levels: list[list[str]], above: dict) -> pa.Table:
        proofs, roots = [], []
        for slot, leaf, claimed in zip(own, table.column("node").to_pylist(), table.column("claimed_leaf").to_pylist(), strict=True):
            left, right = siblings(levels, slot)
            left, right = left + above["left"], right + above["right"]
            proofs.append(_sha("".join(x + y for x, y in zip(left, right, strict=True))))
            roots.append(folded(claimed or leaf, left, right))
        return pa.table(
            {
                "doc_id": table.column("doc_id").cast(kind),
                "leaf": table.column("node"),
                "subroot": pa.array([above["subroot"]] * len(own), pa.string()),
                "root": pa.array([above["root"]] * len(own), pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(roots, pa.string()),
                "verified": pa.array([r == above["root"] for r in roots], pa.bool_()),
            }
        )

    return prove


def manifest(docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    ``claimed`` is the text that is checked against the manifest, ``docs.text`` itself if left out. Every language is a tree
    of its leaves by doc_id, with FAN_OUT nodes to a parent; the trees' roots, by language, are a tree again.

    - A NULL in any column is told apart from an empty text. A NULL lang is a language of its own, before the others.
    - A NULL doc_id comes before all others; rows with one doc_id, or none, go by their leaf. Rows repeated whole have
      equal leaves, and each has its own place and proof.
    - A claimed text that is NULL where the text is not (or the other way round) is another leaf.
    - An empty table gives no rows. Further columns are not read, whatever their names.
    """
    given = docs.select(*COLUMNS, (F.col("text") if claimed is None else claimed).alias("claimed"))
    leaves = coordinates(leaf_rows(given, F.col("claimed"))).withColumnRenamed("leaf", "node")
    stages = climbed(leaves, levels, "nodes")
    subroots = stages[-1].select("tree", F.col("node"), F.lit(1).cast("long").alias("one"))
    number = subroots.count()
    languages = numbered(subroots, ["tree"], "one", "languages").select(
        F.lit("").alias("tree"), F.col("before").alias("rank"), "node", F.lit(number).cast("long").alias("tree_rows"), F.col("tree").alias("lang_tree")
    )
    languages = keep(languages, "subroots")
    upper = climbed(languages.drop("lang_tree"), levels, "roots")
    root = F.col("node")
    none = F.array().cast("array<string>")
    top = upper[-1].select("tree", "rank", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), root.alias("root"))
    if len(upper) > 1:
        below = descended(upper, top, levels, "root-paths")
        top = keep(_with_paths(languages.drop("lang_tree"), below, levels, _path_rows, f"tree string, rank bigint, {_PATH}"), "subroot-paths")
    own = languages.select("rank", F.col("lang_tree"), "node")
    tops = join_sized(own, top.select("rank", "left", "right", "root"), ["rank"], "inner", F.lit(4096)).select(
        F.col("lang_tree").alias("tree"), F.lit(0).cast("long").alias("rank"), "left", "right", F.col("node").alias("subroot"), "root"
    )
    if len(stages) == 1:  # every tree is one leaf
        stages, tops = [leaves, leaves], keep(tops, "lone-paths")
        paths = tops
    else:
        paths = descended(stages, keep(tops, "tree-paths"), levels, "node-paths")
    kind = docs.schema["doc_id"].dataType
    schema = (
        f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean"
    )
    return _with_paths(stages[0], paths, levels, _proof_rows(to_arrow_type(kind)), schema)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked against texts of which about a third is lower-cased."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    claimed = F.when(chosen, lowered(F.col("text"))).otherwise(F.col("text"))
    return manifest(documents(spark, sf_dir), claimed)


def _oracle() -> str:
    def shown(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    rest = " || ".join(shown(c) for c in COLUMNS[:-1])
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    # Bit by bit: -1 stands for a shift after each of a character's eight bits.
    crc = """xor(list_reduce(
        [4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""

    def tree(name: str, source: str) -> str:
        return f"""{name} AS (
    SELECT tree, 0 AS level, pos, node, count(*) OVER (PARTITION BY tree) AS n FROM {source}
    UNION ALL
    SELECT tree, level + 1, pos // {FAN_OUT}, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + {FAN_OUT - 1}) // {FAN_OUT})
    FROM {name} WHERE n > 1 GROUP BY tree, level, pos // {FAN_OUT}
), {name}_runs AS MATERIALIZED (
    SELECT a.tree, a.level, a.pos, any_value(a.node) AS node, any_value(a.n) AS n,
           coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
           coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.pos // {FAN_OUT} = b.pos // {FAN_OUT}
    GROUP BY a.tree, a.level, a.pos
)"""

    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM (
        SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({rest} || {shown("text")}) AS node,
               CASE WHEN {crc} % 3 = 0 THEN sha256({rest} || {shown(lower)}) END AS other
        FROM documents)
), {tree("nodes", "leaves")}, subroots AS MATERIALIZED (
    SELECT '' AS tree, tree AS own, row_number() OVER (ORDER BY tree) - 1 AS pos, node FROM nodes WHERE n = 1
), {tree("tops", "subroots")}, walk AS (
    SELECT doc_id, tree AS own, tree, pos AS leaf_pos, pos, 0 AS level, false AS up, node AS leaf, coalesce(other, node) AS node, '' AS proof
    FROM leaves
    UNION ALL
    SELECT w.doc_id, w.own, coalesce(n.tree, ''), w.leaf_pos, coalesce(n.pos // {FAN_OUT}, t.pos // {FAN_OUT}, s.pos),
           CASE WHEN s.pos IS NULL THEN w.level + 1 ELSE 0 END, w.up OR s.pos IS NOT NULL, w.leaf,
           CASE WHEN s.pos IS NULL THEN sha256(coalesce(n.l, t.l) || w.node || coalesce(n.r, t.r)) ELSE w.node END,
           w.proof || coalesce(n.l || n.r, t.l || t.r, '')
    FROM walk w
    LEFT JOIN nodes_runs n ON NOT w.up AND n.n > 1 AND n.tree = w.own AND n.level = w.level AND n.pos = w.pos
    LEFT JOIN tops_runs t ON w.up AND t.n > 1 AND t.level = w.level AND t.pos = w.pos
    LEFT JOIN subroots s ON NOT w.up AND n.n IS NULL AND s.own = w.own
    WHERE n.n IS NOT NULL OR t.n IS NOT NULL OR s.pos IS NOT NULL
), ends AS (
    SELECT *, row_number() OVER (PARTITION BY own, leaf_pos ORDER BY up DESC, level DESC) AS latest FROM walk
)
SELECT e.doc_id, e.leaf, s.node AS subroot, t.node AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = t.node AS verified
FROM ends e JOIN subroots s ON s.own = e.own, (SELECT node FROM tops WHERE n = 1) t
WHERE e.latest = 1
"""


ORACLE = _oracle()
