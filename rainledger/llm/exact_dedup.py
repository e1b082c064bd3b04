"""Exact duplicates by a tree of merged digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainledger.llm.tables import documents, join_groups, keep

FAN_IN = 8


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, SHA-256, two further checks of the text, and the input partition as its run."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("octets"),
        F.xxhash64(text).alias("check"),
        F.spark_partition_id().alias("run"),
    )


def _merge(runs: DataFrame, best) -> DataFrame:
    """One entry per run and digest.

    ``best`` over a struct makes Spark sort each side by run and digest and merge equal neighbours, before the
    exchange and after it; a digest sends one entry per run, however many rows it has. Entries of one digest
    whose lengths or second hashes differ stop the job: the identifier that is kept is always a verified one.
    """
    merged = runs.groupBy("run", "digest").agg(
        best("entry").alias("entry"),
        F.sum("members").alias("members"),
        F.min("octets").alias("octets"),
        F.max("octets").alias("octets_to"),
        F.min("check").alias("check"),
        F.max("check").alias("check_to"),
    )
    same = (F.col("octets") == F.col("octets_to")) & (F.col("check") == F.col("check_to"))
    return merged.select(
        "run",
        "digest",
        F.when(same, F.col("members")).otherwise(F.raise_error(F.lit("one digest for two texts")).cast("long")).alias("members"),
        "entry",
        "octets",
        "check",
    )


def merge_tree(rows: DataFrame, keep_largest: bool, fan_in: int = FAN_IN) -> DataFrame:
    """Digest, identifier that stays and number of rows, merged in rounds of ``fan_in`` runs."""
    best = F.max if keep_largest else F.min
    known = F.col("doc_id").isNotNull() if keep_largest else F.col("doc_id").isNull()  # a row without id comes last
    level = _merge(rows.withColumns({"entry": F.struct(known.alias("order"), "doc_id"), "members": F.lit(1).cast("long")}), best)
    runs = (rows.agg(F.max("run").alias("last")).first()["last"] or 0) + 1
    while runs > 1:
        level = _merge(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), best)
        runs = -(-runs // fan_in)
    return level.select("digest", F.col("entry.doc_id").alias("keep_id"), F.col("members").alias("group_size"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_largest: bool = True
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; texts are equal when identical.

    - A NULL text counts as empty; all empty texts are one group.
    - A row without doc_id never stands for a group that has another; a group without any doc_id has none.
      Rows whose doc_id equals keep_id, or that have none in a group without any, are kept.
    - Rows repeated whole are counted one by one in ``group_size`` and share their flag.
    - An empty table gives no rows. Further columns are not read, whatever their names.
    """
    rows = keep(digest_rows(docs, id_col, text_col), "digests")
    merged = keep(merge_tree(rows, keep_largest), "merged")
    joined = join_groups(rows.select("doc_id", "digest"), merged, "digest", "group_size")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
