"""Seeded sampling, splitting and first-per-key, equal on every run and cluster size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casework.functions import terms


def seed_key(c, seed: int) -> Column:
    """Pseudo-random but reproducible order key of an id."""
    c = F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))


def seeded_sample(df: DataFrame, n: int, by: str, seed: int) -> DataFrame:
    """``n`` rows without replacement, first in seeded order of their unique id ``by``; all rows
    if there are fewer.

    A plain top-n would merge n rows of every input partition in one task. A histogram over
    the leading digits of the key (at most 65,536 rows) first finds where the n-th row lies, so
    the second pass hands that task little more than n rows.
    """
    keyed = df.withColumn("_key", seed_key(by, seed)).withColumn("_head", F.substring("_key", 1, 4))
    reached = F.sum("rows").over(W.orderBy("_head"))
    cutoff = (
        keyed.groupBy("_head")
        .agg(F.count("*").alias("rows"))
        .withColumn("reached", reached)
        .filter(F.col("reached") >= n)
        .agg(F.min("_head"))
    )
    near = keyed.filter(F.col("_head") <= F.coalesce(cutoff.scalar(), F.lit("ffff")))
    return near.orderBy("_key", by).limit(n).drop("_key", "_head")


def golden_split(
    threads: DataFrame, n: int = terms.GOLDEN_ROWS, seed: int = terms.SPLIT_SEED,
    by: str = "thread_id",
) -> DataFrame:
    """Add ``split``: ``golden`` for n seeded ids, ``kb`` for the rest.

    The split is by distinct id, so all rows of one thread land on the same side. The golden
    side has at most n rows and Catalyst knows it from the limit, so it can be broadcast.
    """
    threads = threads.drop("split")
    golden = seeded_sample(threads.select(by).distinct(), n, by, seed)
    marked = threads.join(golden.withColumn("split", F.lit("golden")), by, "left")
    return marked.withColumn("split", F.coalesce("split", F.lit("kb")))


def first_per_key(df: DataFrame, keys, order, n: int = 1) -> DataFrame:
    """First n rows of each key. The rank filter also runs before the shuffle
    (WindowGroupLimit), so a hot key ships at most n rows per map task."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
