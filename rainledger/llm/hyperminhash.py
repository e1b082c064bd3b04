"""Near duplicates by HyperMinHash sketches, banding, estimates and verification on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainledger.llm.components import connect
from rainledger.llm.tables import documents, join_groups, join_groups_sized, join_sized, keep, keep_texts
from rainledger.llm.words import give_back, mixed, remember_only, shingles, utf8_rows

#: Buckets of a sketch, and the keys that a document gives to the banding.
BUCKETS = 128
KEYS = 32
MANTISSA_BITS = 10
#: Nodes of a block, about, and bytes of their sets; a task holds two blocks.
BLOCK_ROWS = 256
BLOCK_BYTES = 24 << 20
#: Sets of so few shingles are linked only when equal, whatever the similarity from 0.75 on.
TINY = 4
#: Standard errors that an estimate may fall short of the threshold before a pair is given up.
MARGIN = 6.0
#: From this level of log2(set size) on, bands of BUCKETS / KEYS registers are taken once.
_WIDE_LEVEL = 6
_ORDERS = [np.arange(BUCKETS)] + [np.random.RandomState(i).permutation(BUCKETS) for i in range(1, KEYS)]


def registers(hashes: np.ndarray) -> np.ndarray:
    """One 16-bit register per bucket: 0 if empty, else leading zeros and mantissa of the bucket's smallest hash.

    The top 7 bits of a hash name its bucket; the rest is a number whose minimum is stored as in floating
    point: how many zeros lead it, and the bits after its first one.
    """
    mixed_hashes = np.sort(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    bucket = (mixed_hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low = mixed_hashes[first] & np.uint64((1 << 57) - 1)
    exponent = np.frexp(low.astype(np.float64))[1].astype(np.int64)  # of the highest one bit
    # a rounding up to the next power of two moves the exponent by one, the same way in every sketch
    exponent = np.minimum(exponent, 57)
    zeros = 57 - exponent
    shift = np.maximum(exponent - 1 - MANTISSA_BITS, 0).astype(np.uint64)
    mantissa = (low >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
    out = np.zeros(BUCKETS, np.uint16)
    out[bucket[first]] = ((zeros + 1) << MANTISSA_BITS | mantissa.astype(np.int64)).astype(np.uint16)
    return out


def levels(size: int, similarity: float) -> list[int]:
    """Banding levels in which a set of this size can meet a partner of at least this similarity."""
    level = min(size.bit_length() - 1, _WIDE_LEVEL)
    above = level + 1
    return [level, above] if above <= _WIDE_LEVEL and size >= similarity * (1 << above) else [level]


def band_keys(sketch: np.ndarray, size: int, similarity: float) -> list[int]:
    """Keys under which the set meets every partner, or misses one with a chance below one in a million.

    At level l the registers form 2**(l - 1) bands, in 32 / 2**(l - 1) orders. Sets of fewer than 2**(l + 1)
    shingles at similarity 0.8 differ in fewer than 2**(l - 1) elements, so a band without any difference is left
    in each order; empty bands give no key. From 64 shingles on it is 32 bands of 4 registers: a pair at 0.8 shares none of them
    with a chance of (1 - 0.8**4)**32 = 5e-8.
    """
    if size < TINY:
        return []
    keys = []
    for level in levels(size, similarity):
        bands = 1 << (level - 1)
        for turn in range(KEYS // bands):
            rows = sketch[_ORDERS[turn]].reshape(bands, -1)
            for band in np.flatnonzero(rows.any(axis=1)):
                name = bytes((level, turn, band)) + rows[band].tobytes()
                keys.append(int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True))
    return keys


def sketch_rows(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Per document: number of shingles, a digest of the set, its sketch and its band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sets = [shingles(text, size) for text in utf8_rows(part.column("text"))]
                sketches = [registers(s) if len(s) else None for s in sets]
                keys = [band_keys(r, len(s), similarity) if len(s) else [] for r, s in zip(sketches, sets, strict=True)]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([None if r is None else r.tobytes() for r in sketches], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_digest", "sketch", "keys"],
                )
            give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles bigint, set_digest binary, sketch binary, keys array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(sketch, schema)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, and the number of buckets that either set fills.

    Of the equal registers, those expected from different minima that share zeros and mantissa are taken off:
    per bucket the sum over leading zeros z of P(z in a) P(z in b) / 2**mantissa bits.
    """
    filled = (a != 0) | (b != 0)
    used = filled.sum(axis=1)
    equal = ((a == b) & filled).sum(axis=1)
    z = np.arange(58)

    def chance(size: np.ndarray) -> np.ndarray:
        per_bucket = size[:, None] / BUCKETS
        tail = np.exp(-per_bucket * 2.0 ** -(z + 1.0))
        return tail - np.exp(-per_bucket * 2.0 ** -(z.astype(float)))

    by_chance = (chance(size_a.astype(float)) * chance(size_b.astype(float))).sum(axis=1) / 2**MANTISSA_BITS
    expected = by_chance * (used - equal)
    return np.maximum(equal - expected, 0) / np.maximum(used, 1), used


def likely(
    a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of pairs, and which are worth verifying.

    Left out are pairs whose estimate is MARGIN standard errors below the threshold, and pairs that can't be linked:
    an element of only one set changes one register at most, and linked sets differ in few elements.
    """
    found, used = estimate(a, b, size_a, size_b)
    similarity = percent / 100
    least = similarity - MARGIN * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))
    return found, (found >= least) & _can_link(a, b, size_a, size_b, percent)


def _can_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    return (a != b).sum(axis=1) * percent <= (100 - percent) * np.minimum(size_a, size_b)


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """Keep the pairs that are worth verifying."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sketch_a", "sketch_b"))
                _, good = likely(a, b, *(batch.column(c).to_numpy() for c in ("size_a", "size_b")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(check, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Keep the pairs with 100 * intersection >= percent * union on the full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                linked = []
                for x, y in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True):
                    one, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(one, other, assume_unique=True))
                    linked.append(100 * both >= percent * (len(one) + len(other) - both))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            give_back()

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(check, f"a {kind}, b {kind}")


def set_rows(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node and its full set, for the documents named by ``nodes``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sets = [shingles(text, size).tobytes() for text in utf8_rows(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["node", "shingles"])
            give_back()

    wanted = join_sized(docs.select("doc_id", "text"), nodes.withColumnRenamed("node", "doc_id"), ["doc_id"], "left_semi", F.lit(48))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(build, f"node {kind}, shingles binary").dropDuplicates(["node"])


def _with_both(pairs: DataFrame, rows: DataFrame, **columns: str) -> DataFrame:
    for end in ("a", "b"):
        side = rows.select(F.col("node").alias(end), *[F.col(c).alias(f"{new}_{end}") for c, new in columns.items()])
        pairs = pairs.join(side, end)
    return pairs


def _stars(buckets: DataFrame, percent: int) -> DataFrame:
    """Each bucket's smallest node with its other nodes, if the sizes of their sets allow a link."""
    first = buckets.where(F.col("node") == F.col("first")).select("key", F.col("node").alias("a"), F.col("n").alias("n_a"))
    rest = buckets.where(F.col("node") != F.col("first")).select("key", F.col("node").alias("b"), F.col("n").alias("n_b"))
    close = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return first.join(rest, (first["key"] == rest["key"]) & close).select("a", "b").distinct()


def _open_buckets(buckets: DataFrame, component: DataFrame) -> DataFrame:
    """key, node and component of the buckets that the stars have not settled.

    A bucket of two is settled, and so is one whose nodes are all in one component. The open keys are stored before the
    join, so that adaptive execution can split a hot bucket.
    """
    placed = (
        buckets.where("members > 2")
        .join(component, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    spread = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    still_open = keep(spread.where("least < most").select("key"), "open-keys")
    return placed.select("key", "node", "component").join(still_open, "key", "left_semi")


def _blocks(groups: DataFrame, by: str, octets: Column) -> DataFrame:
    """Each node once per pair of blocks that it takes part in.

    A group is dealt into blocks of about BLOCK_ROWS nodes and BLOCK_BYTES, so no task gets a whole large
    one; each pair of blocks (p, q) is worked on by itself.
    """
    sizes = groups.groupBy(by).agg(F.count("*").alias("nodes"), F.sum(octets).alias("octets"))
    count = F.greatest(F.ceil(F.col("nodes") / BLOCK_ROWS), F.ceil(F.col("octets") / BLOCK_BYTES)).cast("int")
    several = keep(sizes.select(by, count.alias("blocks")).where("blocks > 1"), "large-groups")
    dealt = (
        join_sized(groups, several, [by], "left", F.lit(48))
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("other", "blocks")


class _Joined:
    """Which rows hang together, at first those of one component."""

    def __init__(self, component: pd.Series):
        firsts: dict = {}
        self.parent = [firsts.setdefault(c, i) for i, c in enumerate(component)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[i] = j
        return i != j


def _likely_of_blocks(rows: pd.DataFrame, percent: int) -> list[tuple]:
    """Components with a likely pair between them by their sketches, as a forest that ties each such pair.

    All nodes of one or two blocks are compared; fewer pairs than components are returned.
    """
    sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(-1, BUCKETS)
    sizes, names = rows["n"].to_numpy(np.int64), rows["component"].tolist()
    component, block = pd.factorize(rows["component"])[0], rows["block"].to_numpy()
    within = len(np.unique(block)) == 1
    tied, pairs = _Joined(rows["component"]), []
    for i in range(1, len(rows)):
        fits = (component[:i] != component[i]) & (within | (block[:i] != block[i]))
        fits &= 100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])
        others = np.flatnonzero(fits)
        if len(others):
            partners = _likely_partners(sketches, sizes, i, others, percent)
            pairs += [(names[j], names[i]) for j in partners if tied.join(j, i)]
    return pairs


def _likely_partners(sketches: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """The rows worth verifying with row i, the nearest by estimate first."""
    others = others[_can_link(sketches[others], sketches[i], sizes[others], sizes[i], percent)]
    if not len(others):
        return others
    one = np.broadcast_to(sketches[i], (len(others), BUCKETS))
    found, good = likely(one, sketches[others], np.full(len(others), sizes[i]), sizes[others], percent)
    order = np.argsort(-found, kind="stable")
    return others[order[good[order]]]


def _links_of_blocks(rows: pd.DataFrame, percent: int) -> list[tuple]:
    """Links that join different components among one block's nodes, or between two blocks' nodes.

    The nearest by estimate come first, and a pair that earlier links have joined isn't looked at again; so there are
    fewer links than nodes, and a pair is left out only if it is joined, far too different, or verified as no link.
    """
    sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(-1, BUCKETS)
    sizes = rows["n"].to_numpy(np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    nodes, block = rows["node"].tolist(), rows["block"].to_numpy()
    within = len(np.unique(block)) == 1
    joined = _Joined(rows["component"])
    parent = np.array(joined.parent)
    links = []
    order = np.argsort(-np.bincount(parent, minlength=len(rows))[parent], kind="stable")  # of large components first
    for at, i in enumerate(order):
        others = order[:at]
        others = others if within else others[block[others] != block[i]]
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        apart = np.array([j for j in others if joined.find(j) != joined.find(i)], int)
        if not len(apart):
            continue
        for j in _likely_partners(sketches, sizes, i, apart, percent):
            if joined.find(i) == joined.find(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                joined.join(i, j)
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if 100 * intersection >= percent * union of their word-shingle sets; percent from 80 on.

    1. Sketch every text. Documents with equal sets are one node, named by the smallest doc_id.
    2. Nodes that share a band key form a bucket. First each bucket's smallest node is compared with its others.
       Buckets of more than two nodes that this leaves in several components are dealt into pairs of blocks, which
       tie likely pairs of different components together by their sketches; no list of all pairs is ever made.
    3. Pairs whose sketches are far too different are passed over. The others, in trees dealt into blocks again, are
       verified on the full sets.
    4. Links join components; component_id is the smallest doc_id of the component.

    - No words or NULL text: n_shingles 0, linked with nothing.
    - A row without doc_id takes no part in links: component_id NULL, kept.
    - Rows with one doc_id are one document; repeated rows come back repeated.
    - An empty table gives no rows. Further columns are not read, whatever their names.
    """
    rows = keep_texts(sketch_rows(docs, size, percent / 100), "sketches")
    named = rows.where(F.col("doc_id").isNotNull())
    with_words = named.where("n_shingles > 0")
    classes = keep(
        with_words.groupBy("set_digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("members")), "classes"
    )
    belongs = keep(
        join_groups(with_words.select("doc_id", "set_digest"), classes, "set_digest", "members").select("doc_id", "node"),
        "class-members",
    )
    copies = belongs.where(F.col("doc_id") != F.col("node")).select("doc_id").distinct()
    nodes = join_sized(with_words.where(F.size("keys") > 0), keep(copies, "copies"), ["doc_id"], "left_anti", F.lit(48))
    nodes = nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch", "keys")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = keep(
        keyed.groupBy("key")
        .agg(F.count("*").alias("members"), F.min("node").alias("first"))
        .where("members > 1"),
        "shared-keys",
    )
    buckets = keep(join_groups_sized(keyed, shared, "key", "members", 96), "buckets")
    links = _links(docs, nodes, buckets, size, percent)
    return _answer(rows, belongs, links)


def _links(docs: DataFrame, nodes: DataFrame, buckets: DataFrame, size: int, percent: int) -> DataFrame:
    """node and component of every node that is linked with a smaller one."""
    kind = nodes.schema["node"].dataType.simpleString()
    in_buckets = keep(buckets.select("node").distinct(), "bucket-nodes")
    sketches = join_sized(nodes.select("node", "n", "sketch"), in_buckets, ["node"], "left_semi", F.lit(48))
    sketches = keep(sketches.dropDuplicates(["node"]), "bucket-sketches")

    # Stars: the smallest node of each bucket with the others.
    pairs = _with_both(_stars(buckets, percent), sketches, sketch="sketch", n="size")
    near = keep(_estimated(pairs, percent), "likely-stars")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = keep_texts(set_rows(docs, keep(ends, "star-nodes"), size), "star-sets")
    starred = keep_texts(_verified(_with_both(near, sets, shingles="set"), percent), "star-links")
    component = connect(starred)

    # Buckets that are left open: a forest of likely pairs by sketches, and its trees by full sets.
    open_buckets = keep(_open_buckets(buckets, component).join(sketches, "node"), "open-buckets")

    def tie(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_likely_of_blocks(rows, percent), columns=["a", "b"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_links_of_blocks(rows, percent), columns=["a", "b"])

    met = _blocks(open_buckets, "key", F.octet_length("sketch")).groupBy("key", "p", "q")
    ties = keep(met.applyInPandas(tie, f"a {kind}, b {kind}").distinct(), "likely-ties")
    if ties.isEmpty():
        return component
    trees = connect(ties).select(F.col("node").alias("component"), F.col("component").alias("tree"))
    trees = trees.unionByName(trees.select(F.col("tree").alias("component"), "tree")).distinct()
    open_nodes = open_buckets.select("node", "component").distinct()
    trees = keep(open_nodes.join(trees, "component"), "trees")
    more_sets = keep_texts(set_rows(docs, keep(trees.select("node").join(sets, "node", "left_anti"), "more-nodes"), size), "more-sets")
    full = trees.join(sketches, "node").join(sets.unionByName(more_sets), "node")
    grouped = _blocks(keep(full, "full-trees"), "tree", F.octet_length("shingles")).groupBy("tree", "p", "q")
    more = keep(grouped.applyInPandas(link, f"a {kind}, b {kind}"), "block-links")
    if more.isEmpty():
        return component
    return connect(more.unionByName(component.select(F.col("node").alias("b"), F.col("component").alias("a"))))


def _answer(rows: DataFrame, belongs: DataFrame, component: DataFrame) -> DataFrame:
    of_node = belongs.join(component, "node", "left").select(
        "doc_id", F.coalesce("component", "node").alias("component_id")
    )
    of_doc = of_node.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return (
        rows.select("doc_id", "n_shingles")
        .join(of_doc, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op7_hyperminhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), size=4, percent=80)


ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words
), classes AS (
    SELECT min(doc_id) AS node, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 2
), items AS (
    SELECT node, len(s) AS n, hash(unnest(s)) AS item FROM classes
), links AS (
    SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.item = b.item AND a.node <> b.node
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT node, node AS other FROM classes
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), component AS (
    SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id,
       coalesce(k.component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND c.s = list_sort(s.s) LEFT JOIN component k ON k.node = c.node
"""
