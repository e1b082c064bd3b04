import random

import numpy as np
import pytest
import xxhash

from edge_rows import EDGES, frame
from rainledger.llm import hyperminhash, words
from rainledger.llm.hyperminhash import BUCKETS, estimate, near_duplicates, registers
from rainledger.llm.words import shingles

SPACE = " \t\n\v\f\r"


def word_set(text, size):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    named = [(d, word_set(t, size)) for d, t, *_ in rows if d is not None]
    root = {d: d for d, _ in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(named):
        for b, t in named[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = []
    for d, t, *_ in rows:
        least = None if d is None else find(d)
        out.append((d, len(word_set(t, size)), least, d is None or least == d))
    return sorted(out, key=repr)


def got(docs, size=5, percent=80):
    return sorted((tuple(r) for r in near_duplicates(docs, size, percent).collect()), key=repr)


def test_edges(edges):
    assert got(edges, 4) == brute(EDGES, 4, 80)


def changed(words, draw, share):
    return [f"new{draw.randrange(10**6)}" if draw.random() < share else w for w in words]


def test_near_copies_of_all_lengths(spark):
    draw = random.Random(3)
    rows = []
    for base in range(120):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([3, 5, 6, 7, 9, 12, 18, 25, 40, 60, 90, 200]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(4):
            rows.append((len(rows), " ".join(changed(words, draw, draw.choice([0.0, 0.01, 0.03, 0.05])) + ["end"] * draw.randrange(3))))
    draw.shuffle(rows)
    for size in (4, 5):
        assert got(frame(spark, rows, 6), size) == brute(rows, size, 80)


@pytest.mark.parametrize("block_rows", [16, 256])
def test_large_group_and_frequent_line(spark, monkeypatch, block_rows):
    """Chains of near copies, variants that are seldom linked directly, and short texts that have one line in common."""
    monkeypatch.setattr(hyperminhash, "BLOCK_ROWS", block_rows)
    draw = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(words)) for i in range(100)]
    for i in range(100, 300):
        words = changed(words, draw, 0.01)
        rows.append((i, " ".join(words)))
    line = "the line that every one of them has".split()
    rows += [(i, " ".join([*line, *(f"u{draw.randrange(5000)}" for _ in range(12))])) for i in range(300, 450)]
    base = [f"b{i}" for i in range(120)]
    rows += [(i, " ".join(changed(base, draw, 0.035))) for i in range(450, 560)]
    assert got(frame(spark, rows, 6), 4) == brute(rows, 4, 80)


def test_empty(empty):
    assert near_duplicates(empty).collect() == []


def test_estimates():
    draw = np.random.RandomState(1)
    for size in (20, 100, 3000):
        base = draw.randint(0, 2**62, size * 2).astype(np.uint64)
        for shared in (0, size // 2, size):
            a, b = base[:size], np.r_[base[size - shared : size], base[size : 2 * size - shared]]
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            found, used = estimate(registers(a)[None], registers(b)[None], np.array([size]), np.array([size]))
            assert abs(found[0] - true) < 6 * np.sqrt(0.25 / used[0]) and used[0] <= BUCKETS


def test_shingles_are_sets():
    assert len(shingles(b"a b c d e a b c d e", 4)) == 5
    assert len(shingles(b"A b", 4)) == 1 and (shingles(b"A b", 4) == shingles(b" a  B\n", 4)).all()
    assert shingles(b"a b", 4) != shingles(b"a c", 4)


def test_remembered_words_stay_few_and_short(monkeypatch):
    monkeypatch.setattr(words, "CACHE_WORDS", 3)
    words.forget()
    text = b"a bb " + b"x" * 100 + b" ccc A dddd bb " + b"x" * 100
    expected = [xxhash.xxh3_64_intdigest(w) for w in text.lower().split()]
    assert words.word_hashes(text).tolist() == expected
    assert len(words._HASHES) <= 3 and max(map(len, words._HASHES)) <= words.KNOWN_BYTES
