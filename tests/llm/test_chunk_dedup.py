import random

from edge_rows import EDGES, frame
from rainledger.llm.chunk_dedup import chunks, line_dedup
from pyspark.sql import functions as F


def words(n, draw):
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))


def test_chunks_give_the_text_again(edges):
    rows = edges.select("text", chunks(F.coalesce("text", F.lit(""))).alias("c")).collect()
    for r in rows:
        assert "\n".join(c["body"] for c in r["c"]) == (r["text"] or "")
        assert [c["pos"] for c in r["c"]] == list(range(1, len(r["c"]) + 1))


def test_edges(edges):
    got = {(r["doc_id"], r["text"]): r for r in line_dedup(edges).collect()}
    assert len(got) == len({(r[0], r[1] if r[0] != 6 else "") for r in EDGES})
    assert got[6, ""]["emptied"] and got[6, ""]["bytes_removed"] == len(EDGES[4][1])
    for doc_id, text, *_ in EDGES:
        if doc_id != 6:
            assert got[doc_id, text]["chunks_removed"] == 0 and got[doc_id, text]["n_chars"] == len(text or "")


def test_repeated_passages_go_and_common_lines_stay(spark):
    draw = random.Random(5)
    passage = "\n".join(words(9, draw) for _ in range(14))
    long_line = words(60, draw)
    texts = []
    for i in range(40):
        own = [words(8, draw) for _ in range(6)]
        middle = [passage] if i % 2 else ["a common line"]
        texts.append("\n".join([*own[:3], *middle, "a common line", *own[3:], long_line]))
    got = sorted(line_dedup(frame(spark, list(enumerate(texts)))).collect(), key=lambda r: r["doc_id"])
    assert got[0]["text"] == texts[0] and passage in got[1]["text"]
    for r, text in zip(got, texts, strict=True):
        lines, before = r["text"].split("\n"), text.split("\n")
        assert (long_line in r["text"]) == (r["doc_id"] == 0)
        assert lines.count("a common line") == before.count("a common line")
        own = [x for x in before if x not in passage and x not in ("a common line", long_line)]
        assert [x for x in lines if x in own] == own
        if r["doc_id"] > 1 and r["doc_id"] % 2:
            assert sum(x in passage for x in lines if x != "a common line") <= 6


def test_one_chunk_in_a_third_of_all_places(spark):
    hot = "\n".join(f"hot line {i}" for i in range(12))
    rows = [(i, hot + f"\nown {i}") for i in range(400)] + [(1000 + i, f"x {i}\ny {i}\nz {i}") for i in range(800)]
    got = {r["doc_id"]: r for r in line_dedup(frame(spark, rows, 8)).collect()}
    assert len(got) == 1200 and got[0]["chunks_removed"] == 0
    assert len({r["text"].count("hot line") for d, r in got.items() if 0 < d < 400}) == 1
    assert all(r["chunks_removed"] == 0 for d, r in got.items() if d >= 1000)


def test_empty(empty):
    assert line_dedup(empty).collect() == []


def test_no_python_in_plan(edges):
    assert "Python" not in line_dedup(edges)._jdf.queryExecution().toString()


def test_repeated_short_passages_go_whole(spark):
    """Passages of three lines of 25 words between unlike neighbours, and a copy of a text of short lines."""
    draw = random.Random(8)
    passages = ["\n".join(words(25, draw) for _ in range(3)) for _ in range(40)]
    texts = [words(8, draw) + "\n" + p + "\n" + words(8, draw) for p in passages * 2]
    copied = "\n".join(words(3, draw) for _ in range(9)) + "\n"
    rows = [*enumerate(texts), (1000, copied), (1001, copied)]
    got = {r["doc_id"]: r for r in line_dedup(frame(spark, rows)).collect()}
    for i, text in enumerate(texts):
        lines = text.split("\n")
        assert got[i]["text"] == (text if i < 40 else f"{lines[0]}\n{lines[-1]}")
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[1000]["text"] == copied and got[1001]["emptied"] and got[1001]["bytes_removed"] == len(copied)


def brute(texts):
    """The rule in plain steps: {doc_id: (text left, cut runs as (first, last) from 0)}; doc_ids unique."""
    import hashlib
    import re

    lines = {d: t.split("\n") for d, t in texts.items()}
    n_words = lambda x: len([w for w in re.split(r"[\x09-\x0D\x20]+", x) if w])
    pairs, longs, single = {}, {}, {}
    for d in sorted(lines):
        own = lines[d]
        for i, x in enumerate(own):
            if n_words(x) >= 50:
                longs.setdefault(x, []).append((d, i))
            else:
                single[x] = single.get(x, 0) + 1
                if i + 1 < len(own) and n_words(own[i + 1]) < 50:
                    pairs.setdefault((x, own[i + 1]), []).append((d, i))
    out = {}
    for d, own in lines.items():
        n = len(own)
        md5 = [hashlib.md5(x.encode()).hexdigest() for x in own]
        ends = [
            i + 1 == n or n_words(own[i]) >= 50 or n_words(own[i + 1]) >= 50
            or (i > 0 and hashlib.md5((md5[i - 1] + md5[i]).encode()).hexdigest()[0] <= "7")
            for i in range(n)
        ]
        cuts = [(i, i) for i, x in enumerate(own) if n_words(x) >= 50 and longs[x][0] != (d, i)]
        where = {}
        for i in range(n - 1):
            places = pairs.get((own[i], own[i + 1]), [])
            if len(places) > 1 and n_words(own[i]) < 50 and n_words(own[i + 1]) < 50:
                where[i] = places
        i = 0
        while i < n:
            if i not in where or where[i][0] == (d, i):
                i += 1
                continue
            stop = i  # the last pair of the run
            src, j = where[i][0]
            while stop + 1 in where and where[stop + 1][0] == (src, j + stop + 1 - i) and where[stop + 1][0] != (d, stop + 1):
                stop += 1
            a = i + 1 if i - 1 in where else i
            z = stop if stop + 1 in where and where[stop + 1][0] == (d, stop + 1) else stop + 1
            kept_edges = [k for p in range(i, stop + 1) for k in (p, p + 1) if single[own[k]] <= 2 * len(where[p])]
            if a == 0 and z == n - 1:
                f, last, goes = a, z, True
            elif kept_edges:
                f, last = max(a, min(kept_edges)), min(z, max(kept_edges))
                starts = [k for k in range(n) if k == 0 or ends[k - 1]]
                whole = [(s, next(k for k in range(s, n) if ends[k])) for s in starts]
                goes = sum(n_words(x) for x in own[f : last + 1]) >= 50 or any(f <= s < t <= last for s, t in whole)
            else:
                goes = False
            if goes and last > f:
                cuts.append((f, last))
            i = stop + 1
        gone = {k for f, last in cuts for k in range(f, last + 1)}
        out[d] = ("\n".join(x for k, x in enumerate(own) if k not in gone), sorted(cuts))
    return out


def dedup(spark, texts):
    return {r["doc_id"]: r["text"] for r in line_dedup(frame(spark, list(texts.items()))).collect()}


def left_somewhere(texts, cuts, left):
    """Every cut passage stands in one piece in a text that is left."""
    joined = ["\n" + x + "\n" for x in left.values()]
    for d, (_, own) in cuts.items():
        lines = texts[d].split("\n")
        for f, last in own:
            assert any("\n" + "\n".join(lines[f : last + 1]) + "\n" in x for x in joined)


def test_random_texts_against_the_plain_rule(spark):
    """Texts of few different lines, so that runs of all kinds meet; no passage that goes is lost."""
    for seed in range(6):
        draw = random.Random(seed)
        pool = [words(draw.choice([1, 7, 15, 30, 55]), draw) for _ in range(draw.choice([6, 12, 40]))]
        texts = {}
        for d in range(60):
            if d and draw.random() < 0.4:
                own = texts[draw.randrange(d)].split("\n")
                at = draw.randrange(len(own))
                own[at : at + draw.randrange(3)] = [draw.choice(pool) for _ in range(draw.randrange(3))]
            else:
                own = [draw.choice(pool) for _ in range(draw.randrange(1, 14))]
            texts[d] = "\n".join(own)
        want = brute(texts)
        left = dedup(spark, texts)
        assert left == {d: t for d, (t, _) in want.items()}
        left_somewhere(texts, want, left)


def test_a_passage_that_stands_in_pieces_stays(spark):
    draw = random.Random(11)
    a, b, c = (words(30, draw) for _ in range(3))
    left = dedup(spark, {1: f"{a}\n{b}", 2: f"{b}\n{c}", 3: f"{a}\n{b}\n{c}"})
    assert left[1] == f"{a}\n{b}" and left[2] == f"{b}\n{c}"
    assert left[3] in (f"{a}\n{b}\n{c}", c, a)  # one run of two lines may go, as it is left whole in its first place
    x, y = words(30, draw), words(30, draw)
    left = dedup(spark, {1: f"{x}\n{a}", 2: f"{b}\n{y}", 3: f"{x}\n{a}\n{b}\n{y}", 4: f"{a}\n{b}"})
    assert f"{a}\n{b}" in left[3] and left[4] == ""


def test_long_lines_by_any_blank(spark):
    draw = random.Random(12)
    tabbed, indented = words(60, draw).replace(" ", "\t"), " " * 80 + "x"
    left = dedup(spark, {i: f"own {i}\n{tabbed}\nother {i}\n{indented}" for i in range(3)})
    assert left[0].count(tabbed) == 1 and all(tabbed not in left[i] and indented in left[i] for i in (1, 2))


def test_texts_of_very_many_lines(spark):
    import time

    draw = random.Random(13)
    many = "\n".join(f"{draw.randrange(10**9)} log" for _ in range(200_000))
    start = time.perf_counter()
    left = dedup(spark, {1: many, 2: many, 3: "x"})
    assert left[1] == many and left[2] == "" and left[3] == "x"
    assert time.perf_counter() - start < 60


def test_long_bodies_in_a_third_of_all_rows(spark):
    draw = random.Random(14)
    wide = words(9000, draw)
    assert len(wide) > 32 * 1024
    left = dedup(spark, {i: f"a {i}\n{wide}\nb {i}" if i < 100 else f"c {i}" for i in range(300)})
    assert sum(wide in x for x in left.values()) == 1 and wide in left[0]
