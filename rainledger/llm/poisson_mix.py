"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainledger.llm.tables import documents, join_sized, keep, let, without

SEED = 20
#: Fixed: a NULL source takes part under this name.
NO_SOURCE = ""
#: A larger rate is the sum of several equal ones of at most this, each with a number of its own.
LARGEST_RATE = 10_000
_ADDED = ("source_key", "rate", "draws", "draw", "cdf", "copies", "copy", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 52 bits, the same in every engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... until the rest is below what 52 bits can tell."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    logs = let(
        F.ln(rate),
        lambda log_rate: F.transform(
            F.sequence(F.lit(0), last), lambda k: F.when(k > 0, log_rate - F.ln(k)).otherwise(-rate)
        ),
    )
    state = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("seen"))

    def add(acc: Column, term: Column) -> Column:
        log = acc["log"] + term
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.array_append(acc["seen"], total).alias("seen"))

    return F.aggregate(logs, state, add, lambda acc: acc["seen"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, size: Column) -> DataFrame:
    """Per source: rows, size and mean repetitions, so that each source gets its share of the total size.

    Without ``weights`` all sources weigh the same; sources missing from ``weights`` get 0, and so no copies.
    """
    sums = docs.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("source_key")).agg(
        F.sum(size).cast("long").alias("size")
    )
    if weights is None:
        weight = F.lit(1.0)
    else:
        pairs = [x for name, w in sorted(weights.items()) for x in (F.lit(name), F.lit(float(w)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source_key")], F.lit(0.0))
    weighed = keep(sums.withColumn("weight", weight), "source-sizes")
    whole = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") * float(whole["size"] or 0) / (F.lit(float(whole["weight"] or 1)) * F.col("size"))
    draws = F.greatest(F.ceil(F.col("rate") / LARGEST_RATE), F.lit(1)).cast("long")
    cdf = F.when(F.col("rate") > 0, poisson_cdf(F.col("rate") / F.col("draws"))).otherwise(F.array().cast("array<double>"))
    return weighed.withColumn("rate", share).withColumn("draws", draws).withColumn("cdf", cdf)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """Each document as often as its Poisson number says, in a global random order, with rate, copy and shuffle_key.

    The number is the count of CDF values at or below a hash of seed, doc_id and text, so it doesn't depend on
    the order of rows or on the cluster. Size is the text's UTF-8 bytes + 1. A rate over LARGEST_RATE, that of a very small
    source, is dealt to several draws, each with a hash of its own: their numbers add up to a Poisson number with
    the whole rate, and the work stays in proportion to the copies. The copies of draw d are numbered from d times the
    length of the CDF, which no number reaches.

    - NULL source: a source of its own (with the empty name). NULL or empty text: size 1.
    - NULL doc_id: the hash takes the text alone. Rows repeated whole get the same number of copies each.
    - A weight of 0 or a missing one: no copies. An empty table gives no rows.
    - Input columns named source_key, rate, cdf, copy or shuffle_key give way to the operator's own.
    """
    docs = without(docs, *_ADDED)
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1
    rates = keep(source_rates(docs, weights, size).select("source_key", "rate", "draws", "cdf"), "source-rates")
    keyed = docs.withColumn("source_key", F.coalesce("source", F.lit(NO_SOURCE)))
    bytes_each = F.octet_length("source_key") + 64 + 8 * F.size("cdf")
    rated = join_sized(keyed, rates, ["source_key"], "inner", bytes_each)
    rated = rated.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)))
    text_hash = F.md5(F.coalesce("text", F.lit("")))
    drawn = F.when(F.col("draws") == 1, uniform(F.lit(seed), F.col("doc_id"), text_hash)).otherwise(
        uniform(F.lit(seed), F.col("doc_id"), text_hash, F.col("draw"))
    )
    number = let(drawn, lambda u: F.size(F.filter("cdf", lambda below: below <= u)))
    copies = rated.withColumn("copies", number).where("copies > 0")
    before = F.col("draw") * F.size("cdf")
    exploded = copies.withColumn("copy", F.explode(F.sequence(before + 1, before + F.col("copies")))).drop("copies", "draws", "draw")
    key = F.xxhash64(F.lit(seed), "doc_id", "text", "copy")
    return (
        exploded.drop("cdf", "source_key")
        .withColumn("shuffle_key", key)
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def op10_poisson_mix(spark, sf_dir):
    """The whole mix; of the shuffled text its length and checksum are returned."""
    mixed = mix(documents(spark, sf_dir))
    return mixed.select(
        "doc_id",
        "source",
        "copy",
        F.round("rate", 9).alias("rate"),
        F.octet_length("text").cast("long").alias("text_bytes"),
        F.md5("text").alias("text_md5"),
    )


ORACLE = """
WITH RECURSIVE sizes AS (
    SELECT coalesce(source, '') AS s, sum(strlen(coalesce(text, '')) + 1) AS size FROM documents GROUP BY 1
), rates AS (
    SELECT s, (SELECT sum(size) FROM sizes)::DOUBLE / ((SELECT count(*) FROM sizes)::DOUBLE * size) AS rate FROM sizes
), dealt AS (
    SELECT s, rate, greatest(ceil(rate / 10000), 1)::BIGINT AS draws, rate / greatest(ceil(rate / 10000), 1) AS part FROM rates
), cdf AS (
    SELECT s, part, 0 AS k, -part AS log_p, exp(-part) AS upto FROM dealt
    UNION ALL
    SELECT s, part, k + 1, log_p + ln(part) - ln(k + 1), upto + exp(log_p + (ln(part) - ln(k + 1)))
    FROM cdf WHERE k < ceil(part + 12 * sqrt(part) + 24)
), hashed AS (
    SELECT d.doc_id, d.source, d.text, r.s, r.rate, r.draws, unnest(generate_series(0, r.draws - 1)) AS draw,
           '20|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS key
    FROM documents d JOIN dealt r ON coalesce(d.source, '') = r.s
), drawn AS (
    SELECT *, ('0x' || substr(md5(CASE WHEN draws = 1 THEN key ELSE key || '|' || draw END), 1, 13))::BIGINT / pow(2, 52) AS u
    FROM hashed
), numbers AS (
    SELECT d.doc_id, d.source, d.text, d.rate, d.draw, count(*) FILTER (c.upto <= d.u) AS copies, count(*) AS length
    FROM drawn d JOIN cdf c USING (s)
    GROUP BY ALL
)
SELECT doc_id, source, unnest(generate_series(draw * length + 1, draw * length + copies))::BIGINT AS copy, round(rate, 9) AS rate,
       strlen(text)::BIGINT AS text_bytes, md5(text) AS text_md5
FROM numbers WHERE copies > 0
"""
