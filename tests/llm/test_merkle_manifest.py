import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from edge_rows import EDGES, frame
from rainledger.llm.merkle_manifest import lowered, manifest
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """All levels of a tree of 8."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def path(levels, pos):
    found = []
    for nodes in levels[:-1]:
        first = pos - pos % 8
        found.append((nodes[first:pos], nodes[pos + 1 : first + 8]))
        pos //= 8
    return found


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text); the columns of the manifest against texts lowered for a third of the ids."""
    by_lang = defaultdict(list)
    for r in rows:
        leaf = h(*map(shown, r))
        text = r[4]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        by_lang[r[2]].append((r[0], leaf, h(*map(shown, (*r[:4], text)))))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = tree([leaf for _, leaf, _ in by_lang[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for i, lang in enumerate(langs):
        for pos, (doc_id, leaf, claimed) in enumerate(by_lang[lang]):
            steps = path(trees[lang], pos) + path(top, i)
            node = claimed
            for left, right in steps:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in steps for x in left + right])
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def found(docs, **given):
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = manifest(docs, F.when(chosen, lowered(F.col("text"))).otherwise(F.col("text")), **given)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def of(docs):
    return [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]


def test_edges(edges):
    assert found(edges) == brute(of(edges))


def test_nulls_in_every_column(spark):
    rows = [(i, f"Text {i}", ["en", None, "", "é", "zz", "Z"][i % 6], [None, "s"][i % 2]) for i in range(200)]
    rows += [(None, "A", "en", "s"), (None, None, "en", "s"), (None, "A", "en", "s"), (-5, "B", None, None), (-(2**62), "C", "en", "s")]
    docs = frame(spark, rows).withColumn("n_chars", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")))
    assert found(docs) == brute(of(docs))


def test_several_stages(spark):
    """Blocks of 8 nodes, so that a tree of 700 leaves and the tree of languages take several steps each."""
    draw = random.Random(2)
    rows = [(draw.randrange(10**12), f"Some Text {i}", draw.choice(["en", "de"]), "s") for i in range(900)]
    rows += [(i, "One Leaf", f"l{i:03}", "s") for i in range(100)]
    docs = frame(spark, rows, 7)
    assert found(docs, levels=1) == brute(of(docs))


def test_one_id_in_a_third_of_all_rows(spark):
    rows = [(77, f"T {i % 50}", "en", "s") for i in range(300)] + [(i, f"U {i}", "en", "s") for i in range(600)]
    docs = frame(spark, rows, 5)
    assert found(docs) == brute(of(docs))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes(spark, n):
    docs = frame(spark, [(i, f"X {i}", "en", "s") for i in range(n)])
    got = found(docs)
    assert got == brute(of(docs))
    assert all(r[6] for r in got if zlib.crc32(str(r[0]).encode()) % 3)
    assert not any(r[6] for r in got if zlib.crc32(str(r[0]).encode()) % 3 == 0)


def test_unchanged_documents_are_verified(edges):
    assert all(r["verified"] for r in manifest(edges).collect())


def test_empty(empty):
    assert manifest(empty).collect() == []
