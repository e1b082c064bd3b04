"""Token sequences with whole documents: dominated choices fixed first, the rest packed by best fit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainledger.llm.packing import TOKENIZER, binary_rows, encoder, slices
from rainledger.llm.tables import documents, join_sized, keep, keep_texts

LENGTH = 2048
END_ID = 0

#: Equal sequences: how many there are, and their (size, number of pieces of that size).
Pattern = tuple[int, tuple[tuple[int, int], ...]]


class _Sizes:
    """How many pieces of each size are open; the sizes that have any are the set bits of a number."""

    def __init__(self, counts: Sequence[int]):
        self.counts = [int(c) for c in counts]
        self.there = sum(1 << s for s, c in enumerate(self.counts) if c)

    def add(self, size: int, count: int) -> None:
        self.counts[size] += count
        self.there = self.there | 1 << size if self.counts[size] else self.there & ~(1 << size)

    def largest(self, upto: int) -> int:
        """The largest open size of at most ``upto``, 0 if there is none."""
        return max((self.there & ((1 << (upto + 1)) - 1)).bit_length() - 1, 0) if upto > 0 else 0

    def smallest(self, above: int) -> int:
        """The smallest open size over ``above``, 0 if there is none."""
        rest = self.there >> (above + 1)
        return above + (rest & -rest).bit_length() if rest else 0

    def smallest_sum(self, number: int, above: int = 0) -> int | None:
        """Sum of so many smallest open pieces over ``above``, None if there are fewer."""
        total, size = 0, above
        while number:
            size = self.smallest(size)
            if not size:
                return None
            taken = min(number, self.counts[size])
            total, number = total + taken * size, number - taken
        return total

    def best_pair(self, room: int) -> tuple[int, int]:
        """Two open pieces, larger first, with the largest sum within ``room``; of equal sums the largest first piece."""
        best, a = (0, 0), self.largest(room)
        while a and 2 * a > sum(best):
            b = self.largest(min(room - a, a))
            if b == a and self.counts[a] < 2:
                b = self.largest(a - 1)
            if b and a + b > sum(best):
                best = (a, b)
            a = self.largest(a - 1)
        return best


def _dominating(sizes: _Sizes, size: int, length: int) -> tuple[int, ...] | None:
    """A set of pieces with one of ``size`` that is at least as good as any other with it, if three pieces show one.

    A set is as good as another if the pieces of the other can be put, in groups, in the places of different pieces of
    its own (dominance of Martello and Toth): then some best packing holds it. ``sizes`` doesn't count the piece itself.
    """
    room = length - size
    if (least := sizes.smallest_sum(1)) is None or least > room:
        return (size,)
    partner = sizes.largest(room)
    two = sizes.smallest_sum(2)
    if partner == room or two is None or two > room:  # nothing better fits, or nothing beside one more
        return (size, partner)
    three = sizes.smallest_sum(3)
    if three is not None and three <= room:
        return None
    a, b = sizes.best_pair(room)
    if partner >= a + b:
        return (size, partner)
    # Any other pair has a larger piece of at most a. Its smaller one is over b only if two pieces over b fit.
    over = sizes.smallest_sum(2, above=b)
    return (size, a, b) if partner == a and (over is None or over > room) else None


def reduced(counts: Sequence[int], length: int) -> tuple[list[Pattern], list[int]]:
    """Patterns that some best packing holds, and how many pieces of each size they leave open.

    Going through the sizes from the largest, a set that dominates all others of its largest piece is fixed as often
    as its pieces last: what shows that it dominates still holds when fewer pieces are open. Each fix uses up
    a size, so the work grows with the sizes, not with the pieces. It ends when a whole round fixes nothing.
    """
    sizes, fixed, changed = _Sizes(counts), [], True
    while changed:
        changed = False
        size = sizes.largest(length)
        while size:
            sizes.add(size, -1)
            found = _dominating(sizes, size, length)
            sizes.add(size, 1)
            if found is None:
                size = sizes.largest(size - 1)
                continue
            per_bin = tuple((s, found.count(s)) for s in sorted(set(found), reverse=True))
            times = min(sizes.counts[s] // n for s, n in per_bin)
            for s, n in per_bin:
                sizes.add(s, -times * n)
            fixed.append((times, per_bin))
            changed = True
            size = sizes.largest(size)
    return fixed, sizes.counts


def best_fit(counts: Sequence[int], length: int) -> list[Pattern]:
    """Best fit of the pieces in falling size, many equal ones at a time: the same sequences as one by one.

    A sequence that just took a piece has the least room that is enough, so it goes on until the size no longer fits.
    """
    open_bins: dict[int, list[Pattern]] = {}
    rooms = 0

    def put(room: int, pattern: Pattern) -> None:
        nonlocal rooms
        if pattern[0]:
            open_bins.setdefault(room, []).append(pattern)
            rooms |= 1 << room

    for size in range(length, 0, -1):
        left = int(counts[size])
        while left:
            enough = rooms >> size
            if enough:
                room = size + (enough & -enough).bit_length() - 1
                bins, held = open_bins[room].pop()
                if not open_bins[room]:
                    rooms &= ~(1 << room)
            else:
                room, bins, held = length, left, ()
            each = room // size
            full = min(bins, left // each)
            put(room - each * size, (full, (*held, (size, each))))
            bins, left = bins - full, left - full * each
            if left and bins:
                put(room - left * size, (1, (*held, (size, left))))
                bins, left = bins - 1, 0
            if held:
                put(room, (bins, held))
    return [pattern for patterns in open_bins.values() for pattern in patterns]


def packing_plan(counts: Sequence[int], length: int = LENGTH) -> list[Pattern]:
    """Patterns that hold all pieces of sizes 1 to ``length``, of which ``counts[size]`` tells the number."""
    fixed, left = reduced(counts, length)
    return fixed + best_fit(left, length)


class Places:
    """Which sequence, and where in it, the n-th piece of a size gets."""

    def __init__(self, plan: list[Pattern]):
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for times, held in plan:
            offset = 0
            for size, each in held:
                first = taken.get(size, 0)
                rows.append(((size << 48) + first, each, sequence, offset, size))
                taken[size] = first + times * each
                offset += size * each
            sequence += times
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.sequences = sequence

    def of(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.rows[np.searchsorted(self.rows[:, 0], (sizes << 48) + ranks, "right") - 1]
        nth = (sizes << 48) + ranks - row[:, 0]
        return row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * row[:, 4]


def _ranks(sizes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many earlier pieces have the same size; ``seen`` counts them on."""
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    within = np.arange(len(sizes)) - np.repeat(starts, np.diff(np.r_[starts, len(sizes)]))
    ranks = np.empty(len(sizes), np.int64)
    ranks[order] = within + seen[ordered]
    seen += np.bincount(sizes, minlength=len(seen))
    return ranks


def token_rows(docs: DataFrame, length: int, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of each document, stored with its partition, the whole sequences before it there, and the rank of its tail."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, run, wholes, seen = encoder(tokenizer), TaskContext.get().partitionId(), 0, np.zeros(length, np.int64)
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                ids, counts = words.encode_column(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts.astype(np.int64) + 1
                ends = wholes + np.cumsum(counts // length)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        binary_rows(ids, counts),
                        pa.array(counts),
                        pa.array(np.full(len(texts), run, np.int32)),
                        pa.array(ends - counts // length),
                        pa.array(counts % length),
                        pa.array(_ranks(counts % length, seen)),
                    ],
                    names=["doc_id", "ids", "doc_tokens", "run", "wholes_before", "tail", "tail_rank"],
                )
                wholes, at = int(ends[-1]) if len(ends) else wholes, at + len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary, doc_tokens bigint, run int, wholes_before bigint, tail bigint, tail_rank bigint"
    return keep_texts(docs.select("doc_id", "text").mapInArrow(encode, schema), "best-fit-tokens")


def _starts(tokens: DataFrame, length: int) -> DataFrame:
    """Per partition and size of a tail: how many such tails, and whole sequences, the earlier partitions have."""
    counted = tokens.groupBy("run", "tail").agg(
        F.count("*").alias("tails"), F.sum(F.expr(f"doc_tokens DIV {length}")).alias("wholes")
    )
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = counted.groupBy("run").agg(F.sum("wholes").alias("wholes"))
    # One row per partition; the sums over the sizes are apart from each other.
    wholes = runs.select("run", F.coalesce(F.sum("wholes").over(earlier.orderBy("run")), F.lit(0)).alias("wholes_start"))
    tails = F.coalesce(F.sum("tails").over(earlier.partitionBy("tail").orderBy("run")), F.lit(0))
    return counted.select("run", "tail", "tails", tails.alias("tail_start")).join(F.broadcast(wholes), "run")


def pack_whole(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids (binary), doc_tokens, sequence_id, offset.

    A document longer than ``length`` ids gives pieces that fill a sequence each, and a tail. The tails are packed by
    their sizes alone: the driver gets how many there are of each size (fewer than ``length`` numbers, whatever
    the input), fixes the sets that dominate all others and packs the rest by best fit. The n-th tail of a size takes
    the n-th place for that size, where n follows from counts per partition. No ids are shuffled while the counts are of
    broadcast size.

    - NULL and empty texts are the end id alone. A NULL doc_id is kept as it is.
    - Repeated rows are packed each; rows with one doc_id can be told apart by sequence_id and offset.
    - Tails of one size are alike: which of them gets which place follows from the order in which Spark reads them.
    - An empty table gives no rows. Further columns are not read, whatever their names.
    """
    if not 1 < length <= 1 << 14:
        raise ValueError("a sequence holds 2 to 16384 ids")
    tokens = token_rows(docs, length, tokenizer, end_id)
    starts = keep(_starts(tokens, length), "best-fit-starts")
    counts = np.zeros(length + 1, np.int64)
    for row in starts.where("tail > 0").groupBy("tail").agg(F.sum("tails").alias("n")).collect():  # below ``length`` rows
        counts[row["tail"]] = row["n"]
    places = Places(packing_plan(counts, length))

    @F.pandas_udf("sequence bigint, place bigint")
    def place(tail: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.of(tail.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence": sequence, "place": offset})

    wholes = tokens.agg(F.coalesce(F.sum(F.expr(f"doc_tokens DIV {length}")), F.lit(0)).alias("n")).first()["n"]
    placed = join_sized(tokens, starts.drop("tails"), ["run", "tail"], "inner", F.lit(64)).withColumn(
        "tail_place", F.when(F.col("tail") > 0, place("tail", F.col("tail_start") + F.col("tail_rank")))
    )
    return placed.select("doc_id", "ids", "doc_tokens", F.inline(_pieces(length, wholes))).select(
        "doc_id",
        "piece",
        "start",
        "length",
        F.expr("substring(ids, CAST(start * 4 + 1 AS INT), CAST(length * 4 AS INT))").alias("ids"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def _pieces(length: int, wholes: int) -> Column:
    """Whole sequences come first, the packed ones after all of them."""
    return F.expr(
        f"""concat(
            transform(
                CASE WHEN doc_tokens >= {length} THEN sequence(0L, doc_tokens DIV {length} - 1) ELSE array() END,
                k -> named_struct('piece', CAST(k AS INT), 'start', k * {length}, 'length', {length}L,
                    'sequence_id', wholes_start + wholes_before + k, 'offset', 0L)),
            CASE WHEN tail = 0 THEN array() ELSE array(named_struct(
                'piece', CAST(doc_tokens DIV {length} AS INT), 'start', doc_tokens - tail, 'length', tail,
                'sequence_id', {wholes} + tail_place.sequence, 'offset', tail_place.place)) END)"""
    )


def op12_best_fit(spark, sf_dir):
    packed = pack_whole(documents(spark, sf_dir))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
