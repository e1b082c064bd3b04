"""Token sequences of fixed length by concatenating all documents and cutting."""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainledger.llm.tables import documents, keep_texts
from rainledger.llm.words import give_back, remember_only

LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Parts of words, and ids of them, that a Python worker remembers after a slice; beyond that it starts anew.
CACHE_WORDS = 300_000
CACHE_IDS = 4_000_000
#: Longer parts are forgotten after their slice.
KNOWN_BYTES = 64
#: Bytes of text that are split into words at once.
SLICE_BYTES = 2 * 1024 * 1024

_ENCODERS: dict = {}
#: ASCII marks but the apostrophe, which the tokenizer can join to letters.
_MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
#: Latin letters that Unicode normalization leaves alone and that are letters in lower case too, all but U+0130.
_LETTERS = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x250)]))
_LETTERS = string.ascii_letters + _LETTERS
_ALL_LETTERS = f"^[{_LETTERS}]+$"


class WordIds:
    """Ids of texts, word by word.

    The tokenizer drops white space and splits at it before any merge, and lower-cases A to Z itself. So a text's
    ids are those of its words, in turn, and each different word needs to be encoded once. Letters and the marks
    after them never share a token either: a word is one part or two, and the parts are what is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # For words of a to z alone every step before the merges changes nothing but the white space.
        self.plain = Tokenizer(self.tokenizer.model)  # one model in memory serves both
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        # The second one doesn't know added tokens, so words that could hold one are encoded by the first.
        self.letters_alone = any(token.isascii() and token.isalpha() for token in added)
        self.last_of_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        if suffix:
            self.last_of_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Part number 0 is the empty one."""
        self.parts = pa.array([""])
        self.ids, self.starts, self.counts = np.empty(0, "<u4"), np.zeros(1, np.int32), np.zeros(1, np.int32)

    @property
    def known(self) -> list[bytes]:
        """The remembered parts by their numbers."""
        return self.parts.cast(pa.binary()).to_pylist()

    def _encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts in the order in which they are encoded, the number of ids of each, and all ids in that order.

        Words of letters alone are one run for the tokenizer, whose last token is marked: many go in one call.
        """
        plain = pc.ascii_is_alpha(parts).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        letters = np.array([t.isalpha() and t.lower().isalpha() for t in parts.take(rest).to_pylist()], bool)
        plain, letters, apart = np.flatnonzero(plain), rest[letters], [rest[~letters]]
        if self.letters_alone:
            plain, apart = plain[:0], [plain, *apart]
        order, counts, ids = [], [], []
        for tokenizer, rows in ((self.plain, plain), (self.tokenizer, letters)):
            edges = np.append(np.arange(0, len(rows), 512, dtype=np.int32), np.int32(len(rows)))
            lines = pc.binary_join(pa.ListArray.from_arrays(edges, parts.take(rows)), " ")
            for found, line in zip(self._batches(tokenizer, lines), np.split(rows, edges[1:-1]), strict=False):
                found = np.array(found, "<u4")
                ends = np.flatnonzero(self.last_of_word[found])
                if len(ends) == len(line):
                    order.append(line)
                    counts.append(np.diff(ends, prepend=-1))
                    ids.append(found)
                else:
                    apart.append(line)
        alone: list[int] = []
        order += apart
        for found in self._batches(self.tokenizer, parts.take(np.concatenate(apart))):
            counts.append([len(found)])
            alone += found
        return np.concatenate(order), np.concatenate(counts).astype(np.int32), np.concatenate([*ids, np.array(alone, "<u4")])

    @staticmethod
    def _batches(tokenizer, texts: pa.Array) -> Iterator[list[int]]:
        for i in range(0, len(texts), 4096):
            for found in tokenizer.encode_batch_fast(texts.slice(i, 4096).to_pylist(), add_special_tokens=False):
                yield found.ids

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The number of each of different parts; new ones are encoded and join the end of the tables, long ones last."""
        numbers = pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy().copy()
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = parts.take(missing)
            long = pc.greater(pc.binary_length(new), KNOWN_BYTES).to_numpy(zero_copy_only=False)
            for rows in (np.flatnonzero(~long), np.flatnonzero(long)):
                if len(rows):
                    order, counts, ids = self._encoded(new.take(rows))
                    numbers[missing[rows[order]]] = len(self.counts) + np.arange(len(order))
                    self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts, dtype=np.int32) - counts])
                    self.counts = np.concatenate([self.counts, counts])
                    self.ids = np.concatenate([self.ids, ids])
                    if not long[rows[0]]:
                        self.parts = pa.concat_arrays([self.parts, new.take(rows[order])])
        return numbers

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and their number per text; a NULL text has none."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = lists.flatten().dictionary_encode()
        heads = words.dictionary.cast(pa.string())
        letters = pc.ascii_rtrim(heads, characters=_MARKS)
        tailed = pc.and_(pc.not_equal(letters, heads), pc.match_substring_regex(letters, _ALL_LETTERS))
        tails = pc.utf8_ltrim(heads.filter(tailed), characters=_LETTERS)
        different = pa.concat_arrays([pc.if_else(tailed, letters, heads), tails]).dictionary_encode()
        numbers = self._numbers(different.dictionary)[different.indices.to_numpy()]
        parts = np.zeros((len(heads), 2), np.int32)
        parts[:, 0], parts[tailed.to_numpy(zero_copy_only=False), 1] = numbers[: len(heads)], numbers[len(heads) :]
        own, _, counts = _gathered(self.ids, self.starts, self.counts, parts.ravel())
        counts = counts.reshape(-1, 2).sum(axis=1, dtype=np.int32)
        ids, _, counts = _gathered(own, np.cumsum(counts, dtype=np.int32) - counts, counts, words.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        per_text = np.diff(ends[lists.offsets.to_numpy()])
        if len(self.counts) > len(self.parts):
            self.starts, self.counts = self.starts[: len(self.parts)], self.counts[: len(self.parts)]
            self.ids = self.ids[: self.starts[-1] + self.counts[-1]].copy()
        if len(self.parts) > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self._forget()
        give_back()
        return ids, per_text

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.binary()).cast(pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def slices(texts: pa.Array, limit: int | None = None) -> Iterator[pa.Array]:
    """The texts in turn, in slices that end with the text that reaches ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    slice_of = (np.cumsum(sizes) - sizes) // (limit or SLICE_BYTES)
    edges = np.flatnonzero(np.diff(slice_of)) + 1
    for start, end in zip([0, *edges], [*edges, len(texts)], strict=True):
        yield texts.slice(start, end - start)


def binary_rows(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per text from the ids of all texts in turn."""
    offsets = np.concatenate([[0], np.cumsum(4 * counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])


def _gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The values of the given rows in turn, and their starts and counts; a slice's values have 32-bit places."""
    starts, counts = starts[rows], counts[rows]
    before = np.cumsum(counts, dtype=np.int32) - counts
    places = np.repeat(starts - before, counts)
    places += np.arange(len(places), dtype=np.int32)
    return values[places], starts, counts


def _path(tokenizer: str) -> str:
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def encoder(tokenizer: str) -> WordIds:
    """The worker's one encoder of a tokenizer, with the parts it remembers; what earlier stages remember is freed."""
    remember_only(_ENCODERS)
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = WordIds(_path(tokenizer))
    return _ENCODERS[tokenizer]


def token_rows(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """First pass, stored: ids of each document, its partition, and the ids before it in that partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, run, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                ids, counts = words.encode_column(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = before + np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        binary_rows(ids, counts),
                        pa.array(counts),
                        pa.array(np.full(len(texts), run, np.int32)),
                        pa.array(ends - counts),
                    ],
                    names=["doc_id", "ids", "doc_tokens", "run", "before"],
                )
                before, at = int(ends[-1]), at + len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary, doc_tokens bigint, run int, before bigint"
    return keep_texts(docs.select("doc_id", "text").mapInArrow(encode, schema), "token-rows")


def pieces(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Second pass: the sums of all earlier partitions give each document its place, and windows cut it.

    The totals are one row per partition; the sums over them are broadcast, and no id is shuffled.
    """
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        tokens.groupBy("run")
        .agg(F.sum("doc_tokens").alias("total"))
        .select("run", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    )
    placed = tokens.join(F.broadcast(bases), "run").withColumn("first", F.col("base") + F.col("before"))
    cut = F.expr(
        f"""inline(transform(
            sequence(first DIV {length}, (first + doc_tokens - 1) DIV {length}),
            k -> named_struct(
                'start', greatest(first, k * {length}) - first,
                'length', least(first + doc_tokens, (k + 1) * {length}) - greatest(first, k * {length}),
                'sequence_id', k,
                'offset', greatest(first, k * {length}) - k * {length})))"""
    )
    found = placed.select("doc_id", "ids", "doc_tokens", cut)
    own = F.expr("substring(ids, CAST(start * 4 + 1 AS INT), CAST(length * 4 AS INT))")
    return found.select("doc_id", "start", "length", own.alias("ids"), "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    The documents follow one another as Spark reads them; a sequence holds ``length`` ids, the last one fewer.

    - NULL and empty texts are the end id alone. A NULL doc_id is kept as it is.
    - Repeated rows are packed each; rows with one doc_id can be told apart by sequence_id and offset.
    - A document longer than a sequence has a piece in each that it covers.
    - An empty table gives no rows. Further columns are not read, whatever their names.
    """
    return pieces(token_rows(docs, tokenizer, end_id), length)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id and ids of every sequence, padded to ``length``.

    A window inside one document is a sequence already; only boundary records, pieces that share their
    window, are shuffled. A window has at most ``length`` of them.
    """
    whole = packed.where(F.col("length") == length).select("sequence_id", "ids")
    shared = (
        packed.where(F.col("length") < length)
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.lit(b""), lambda acc, part: F.concat(acc, part["ids"])).alias("ids"),
        )
    )
    pad = np.array([pad_id], "<u4").tobytes().hex()
    padded = f"substring(concat(ids, unhex(repeat('{pad}', {length}))), 1, {4 * length})"
    return whole.unionByName(shared).withColumn("ids", F.expr(padded))


def op1_packing(spark, sf_dir):
    packed = pack(documents(spark, sf_dir))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
