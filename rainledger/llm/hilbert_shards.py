"""Shards cut from the order of documents along a Hilbert curve over their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainledger.llm.tables import documents, keep

BITS = 4
SHARDS = 16


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def curve_steps(dims: int) -> list[int]:
    """For each orientation of a cell and each corner: the corner's place on the curve + 2**dims * next orientation.

    An orientation is (entry corner, axis). The place of a corner is its rank in the Gray code, seen from the
    entry corner; the next orientation follows from the Gray codes of the neighbouring ranks.
    """
    corners, full = 1 << dims, (1 << dims) - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & full

    rank = {_gray(i): i for i in range(corners)}
    table = []
    for entry in range(corners):
        for axis in range(dims):
            for corner in range(corners):
                place = rank[turn(corner ^ entry, dims - axis - 1)]
                way_in = _gray(2 * ((place - 1) // 2)) if place else 0
                odd = place if place % 2 else place - 1
                along = ((odd ^ (odd + 1)).bit_length() - 1) % dims if place else 0
                after = (entry ^ turn(way_in, axis + 1)) * dims + (axis + along + 1) % dims
                table.append(place + corners * after)
    return table


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index along the curve of a cell whose whole coordinates are below 2**bits."""
    dims = len(axes)
    corners = 1 << dims
    steps = F.array(*[F.lit(x) for x in curve_steps(dims)])
    powers = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])

    def step(state: Column, power: Column) -> Column:
        corner = sum(
            (F.floor(state[f"x{j}"] / power).cast("int") % 2 * (1 << j) for j in range(dims)), F.lit(0)
        )
        found = F.element_at(steps, state["turned"] * corners + corner + 1)
        return F.struct(
            (state["index"] * corners + found % corners).alias("index"),
            F.floor(found / corners).cast("int").alias("turned"),
            *[state[f"x{j}"].alias(f"x{j}") for j in range(dims)],
        )

    start = F.struct(
        F.lit(0).cast("long").alias("index"),
        F.lit(0).alias("turned"),
        *[axis.cast("int").alias(f"x{j}") for j, axis in enumerate(axes)],
    )
    return F.aggregate(powers, start, step, lambda state: state["index"])


def metadata_cell(lang: Column, source: Column, size: Column, bits: int = BITS) -> list[Column]:
    """Names fall into cells by hash, sizes by powers of two; a NULL name has a cell of its own kind."""
    cells = 1 << bits

    def named(name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(cells)).cast("int")

    return [named(lang), named(source), F.least(F.floor(F.log2(size)), F.lit(cells - 1)).cast("int")]


def ordered(cells: DataFrame) -> DataFrame:
    """Stored rows in curve order with their rank: rank in their run, plus the rows of the runs before.

    The rows are sorted by curve index and identifier over range partitions, so a cell with a third of all rows
    is dealt over many of them. The sums before each run are a window over one row per partition.
    """
    position = F.monotonically_increasing_id()
    runs = keep(
        cells.repartitionByRange("curve", "doc_id", "text_crc32")
        .sortWithinPartitions("curve", "doc_id", "text_crc32")
        .withColumn("position", position),
        "curve-runs",
    ).withColumns({"run": F.shiftright("position", 33), "place": F.col("position").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        runs.groupBy("run")
        .agg(F.count("*").alias("rows"))
        .select("run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    return runs.join(F.broadcast(starts), "run").withColumn("rank", F.col("start") + F.col("place"))


def _curve_rows(docs: DataFrame, bits: int, *more: str) -> DataFrame:
    """Stored doc_id, size, text_crc32, curve and further columns of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    curve = hilbert_index(metadata_cell(F.col("lang"), F.col("source"), F.col("size"), bits), bits)
    rows = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(text).alias("text_crc32"), *more)
    return keep(rows.select("doc_id", "size", "text_crc32", curve.alias("curve"), *more), "curve-cells")


def _in_shards(cells: DataFrame, shards: int) -> DataFrame:
    """The stored rows with their shard and their slot in it."""
    total = cells.count()
    of_rank = F.expr(f"CAST((rank * {shards}) DIV {max(total, 1)} AS INT)")
    first = F.expr(f"(CAST(shard AS LONG) * {total} + {shards - 1}) DIV {shards}")
    return ordered(cells).withColumn("shard", of_rank).withColumn("slot", F.col("rank") - first)


def shard_plan(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot of every document; shard sizes differ by one row at most.

    - size is the text's UTF-8 bytes + 1; a NULL text has none and counts as empty for the checksum.
    - NULL lang, source or doc_id: sorted like any other value (NULL first). Ties on the curve go by doc_id, then checksum;
      rows repeated whole take neighbouring slots.
    - Equal texts may have different sources, so they need not share a shard.
    - With fewer rows than shards some shards are empty; an empty table gives no rows.
    - Further columns are not read, whatever their names.
    """
    placed = _in_shards(_curve_rows(docs, bits), shards)
    return placed.select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, bits: int = BITS) -> None:
    """The documents themselves, one folder per shard, sorted along the curve so that file and row-group ranges are narrow.

    The whole rows go through the one sort by the curve, so nothing is joined back: each row is written once, with
    the shard and order of ``shard_plan``, also without doc_id or with a repeated one. A column named shard gives way. An
    empty table leaves a folder without rows.
    """
    given = [c for c in docs.columns if c != "shard"]
    whole = docs.withColumn("document", F.struct(*given))
    placed = _in_shards(_curve_rows(whole, bits, "document"), shards)
    placed.sortWithinPartitions("shard", "slot").select("document.*", "shard").write.partitionBy("shard").parquet(folder)


def op6_hilbert_shards(spark, sf_dir):
    plan = shard_plan(documents(spark, sf_dir))
    return plan.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
