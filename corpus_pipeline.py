"""From raw documents to packed token sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.llm import chunk_dedup, hyperminhash, packing, poisson_mix, quality_mil
from rainledger.llm.tables import documents, join_sized, keep, keep_texts, labels


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the query's threshold; the labels come from ``sf_dir``.

    Stored, so that whole texts go through Python in small batches, however the result is read.
    """
    model = quality_mil.train(docs, labels(spark, sf_dir))
    found = quality_mil.scored(docs, model)
    return keep_texts(found.where(F.col("quality_score") >= quality_mil.ACCEPT).select(*docs.columns), "accepted")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated chunks; a document of which nothing is left goes."""
    return chunk_dedup.line_dedup(docs).where(~F.col("emptied")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, and all that are in none."""
    found = hyperminhash.near_duplicates(docs, size=5, percent=80)
    dropped = keep(found.where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    return join_sized(docs, dropped, ["doc_id"], "left_anti", F.lit(48))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source with the same weight, each document as often as its Poisson number says."""
    return poisson_mix.mix(docs).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", cut_repeated_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_tokens),
]

#: The classifier and the tokenizer have no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
