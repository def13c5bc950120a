"""Shards by rendezvous hashing: every row goes to the shard with the highest score for its key.

A score depends on the key, the number of the shard and its weight only. A further shard can win
rows but never moves one between the others, and a row's shard does not depend on other rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scores(key: Column, weights: list, seed: int) -> Column:
    """For every shard its score and its number, such that the greatest wins; ties go to the smaller."""
    out = []
    for shard, weight in enumerate(weights):
        part = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.lit(shard)), 11)
        share = (part.cast("double") + 0.5) / float(1 << 53)
        out.append(F.struct((F.lit(float(weight)) / -F.log(share)).alias("score"), F.lit(-shard).alias("minus")))
    return F.array(*out)


def shard_of(key: Column, weights: list, seed: int = 42) -> Column:
    """Number of the shard of a key, the shards being those of the weights; a weight of 0 takes nothing."""
    return -F.array_max(_scores(key, weights, seed))["minus"]


def sharded(docs: DataFrame, weights: list, id_col: str = "doc_id", text_col: str = "text",
            grown_weight: float | None = None, seed: int = 42, buckets: int = 512) -> DataFrame:
    """Shard and place of every row: id, ``size``, ``text_crc32``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the text's bytes plus 8 and ``text_crc32`` their checksum, a null text having no
    bytes. ``slot`` counts from 0 without gaps within a shard, in the order of a hash and the id.
    ``grown_shard`` is the shard there would be with one more of weight ``grown_weight``, null
    without such a weight. Rows of the same id go to the same shard and have slots of their own; rows without an id
    are placed by the checksum and size of their text.

    Texts are read for their size and checksum and not moved. A shard's rows are numbered in
    ``buckets`` parts by the hash, whose counts give each part its first slot, so no task gets a
    whole shard.
    """
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")
    crc = F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), size.alias("size"), crc.alias("text_crc32"))
    key = F.coalesce(
        F.concat(F.lit("i"), F.col("_id").cast("string")),
        F.concat_ws(":", F.lit("t"), F.col("text_crc32").cast("string"), F.col("size").cast("string")),
    )
    grown = shard_of(F.col("_key"), [*weights, grown_weight], seed) if grown_weight is not None else F.lit(None)
    placed = rows.withColumn("_key", key).select(
        "_id", "size", "text_crc32", shard_of(F.col("_key"), weights, seed).cast("int").alias("shard"),
        grown.cast("int").alias("grown_shard"),
        F.xxhash64(F.lit(seed + 1), "_key").alias("_hash"),
    ).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    parts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket")
    parts = parts.select(
        "shard", "_bucket", (F.sum("_rows").over(before) - F.col("_rows")).alias("_first")
    )
    within = Window.partitionBy("shard", "_bucket").orderBy("_hash", "_id", "text_crc32", "size")
    return (
        placed.withColumn("_place", F.row_number().over(within))
        .join(parts, ["shard", "_bucket"])
        .select(
            F.col("_id").alias(id_col), "size", "text_crc32", "shard",
            (F.col("_first") + F.col("_place") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
