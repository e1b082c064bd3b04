import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from edge_rows import EDGES, frame
from rainledger.llm.packing import LENGTH, pack, sequences


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, packed, tokenizer, length):
    pieces = packed.collect()
    want = defaultdict(int)
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc_id, np.array(ids, "<u4").tobytes()] += 1
    by_place = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    got, open_ids = defaultdict(int), b""
    at = 0
    for p in by_place:
        assert p["sequence_id"] * length + p["offset"] == at and p["offset"] + p["length"] <= length
        assert len(p["ids"]) == 4 * p["length"] and p["start"] == len(open_ids) // 4
        at, open_ids = at + p["length"], open_ids + p["ids"]
        if len(open_ids) == 4 * p["doc_tokens"]:
            got[p["doc_id"], open_ids] += 1
            open_ids = b""
    assert not open_ids and got == want
    return by_place


@pytest.mark.parametrize("length", [7, LENGTH])
def test_edges(edges, tokenizer, length):
    packed = pack(edges, length).cache()
    pieces = check(EDGES, packed, tokenizer, length)
    stream = b"".join(p["ids"] for p in pieces)
    got = sorted(sequences(packed, length, pad_id=9).collect(), key=lambda r: r["sequence_id"])
    assert all(len(r["ids"]) == 4 * length for r in got)
    padded = b"".join(bytes(r["ids"]) for r in got)
    assert padded[: len(stream)] == stream and set(np.frombuffer(padded[len(stream) :], "<u4")) <= {9}


def test_whole_texts_of_the_tables(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    check([(r["doc_id"], r["text"]) for r in docs.collect()], pack(docs), tokenizer, LENGTH)


def test_query_columns(spark, sf_dir, tokenizer):
    from rainledger.llm.packing import op1_packing

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for p in op1_packing(spark, sf_dir).collect()[:100]:
        ids = [*tokenizer.encode(texts[p["doc_id"]], add_special_tokens=False).ids, 1]
        part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
        assert zlib.crc32(part) == p["ids_crc32"] and len(ids) == p["doc_tokens"]


def test_empty(empty):
    assert pack(empty).collect() == []


def test_cache_bound(spark, monkeypatch, tokenizer):
    from rainledger.llm import packing

    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("a b c d e", "e f g", "It's 12 o'clock"):
        assert words.encode([text.encode()])[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_text_without_blanks(tokenizer):
    from rainledger.llm import packing

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["ab1" * 100_000, "中文" * 50_000, "plain words", "x" * 200]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(map(len, words.known)) <= packing.KNOWN_BYTES


def test_slices_and_null(tokenizer):
    import pyarrow as pa

    from rainledger.llm import packing

    texts = pa.array(["one two", None, "", "three " * 9, "four", None])
    parts = list(packing.slices(texts, 10))
    assert len(parts) > 1 and [t for p in parts for t in p.to_pylist()] == texts.to_pylist()
    assert packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).encode_column(texts)[1].tolist()[1:3] == [0, 0]
    assert [p.to_pylist() for p in packing.slices(texts.slice(0, 0))] == [[]]


def test_one_model_in_memory(monkeypatch):
    from rainledger.llm import packing

    read = []
    monkeypatch.setattr("tokenizers.Tokenizer", type("Counted", (), {
        "__new__": lambda cls, model: Tokenizer(model),
        "from_file": staticmethod(lambda path: read.append(path) or Tokenizer.from_file(path)),
    }))
    packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert len(read) == 1


def test_added_token_of_letters(tmp_path, tokenizer):
    from rainledger.llm import packing

    known = Tokenizer.from_str(tokenizer.to_str())
    known.add_tokens(["foo"])
    known.save(str(tmp_path / "t.json"))
    texts = ["a foo b", "plain words", "xfoo foo", "中文 foo"]
    for text, ids in zip(texts, packing.WordIds(str(tmp_path / "t.json")).encode([t.encode() for t in texts]), strict=True):
        assert ids == np.array(known.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_of_latin_letters_and_their_marks_are_remembered_apart(tokenizer):
    """Each new word with its marks was one call of the tokenizer of its own."""
    from rainledger.llm import packing

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["été, Öl. été!! l'été, été", "Straße### (straße", "niño, niño."]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert {"été".encode(), b",", b"!!", b"###"} <= set(words.known) and not {"été,".encode(), "niño.".encode()} & set(words.known)


def test_marks_after_letters_that_normalization_changes(tokenizer):
    from rainledger.llm import packing

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    letters = ["İ", "e\u0301", "\u0958", "\u212b", "ß", "ŉ", "ǆ", "Σας", "中", "ɏ", "x\u200d", "\u1e9e", "ﬁ", "Ⅷ", "ª", "𝒜"]
    texts = [f"{a}{mark} {a}b{mark}{a}" for a in letters for mark in (",", "'s,", "..", "<|endoftext|>", "'", "1,")]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_long_parts_leave_no_ids(tokenizer):
    from rainledger.llm import packing

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    words.encode([b"short " + b"ab1" * 10_000 + b" again", b"x" * 500])
    assert sorted(words.known) == [b"", b"again", b"short"]
    assert len(words.ids) < 10 and len(words.starts) == len(words.counts) == 3


def test_rows_reach_python_in_small_batches(spark, tmp_path):
    import pyarrow as pa

    from rainledger.llm import tables

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"octets": [batch.nbytes]})

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('word ', 1000) AS text")
    kept = [r["octets"] for r in tables.keep_texts(texts.mapInArrow(sizes, "octets bigint"), "sizes").collect()]
    assert sum(kept) > 14_000_000 and max(kept) < tables.BATCH_BYTES + 100_000
    assert spark.conf.get(tables.BATCH_SETTING, None) is None
    spark.conf.set(tables.BATCH_SETTING, "1000000")
    try:
        kept = [r["octets"] for r in tables.keep_texts(texts.mapInArrow(sizes, "octets bigint"), "sizes").collect()]
        assert max(kept) < 1_100_000 and spark.conf.get(tables.BATCH_SETTING) == "1000000"
    finally:
        spark.conf.unset(tables.BATCH_SETTING)


def test_a_worker_remembers_one_kind_of_work(monkeypatch):
    from rainledger.llm import packing, words

    monkeypatch.setattr(words, "_REMEMBERED", [words._HASHES])
    words.word_hashes(b"one two")
    assert packing.encoder(packing.TOKENIZER) and packing._ENCODERS and not words._HASHES
    words.word_hashes(b"one two")
    words.remember_only()
    assert words._HASHES and not packing._ENCODERS
