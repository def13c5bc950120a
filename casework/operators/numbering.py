"""Numbers for all rows of a table in a given order, whatever its size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits that ``monotonically_increasing_id`` leaves for the place of a row within its part.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list, store, name: str = "number") -> DataFrame:
    """``df`` with ``name`` counting from 0 without gaps in the order of ``order``.

    Rows are range-partitioned and sorted within their part, which gives every row its place
    there; what comes before a part is a running sum over one count per part. No task gets more
    than its range, except where very many rows are equal in all of ``order``. ``store`` writes
    a table and gives it back (as ``checkpoint`` does): ranges follow from a random sample, so parts
    and counts must come from the same stored rows. Rows equal in all of ``order`` are numbered in
    an arbitrary, then fixed order. Null order values come first. Runs jobs.
    """
    placed = store(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (
        placed.withColumn("_part", part).join(offsets, "_part")
        .select(*df.columns, (F.col("_before") + place).cast("long").alias(name))
    )


class Placed:
    """A table stored once, whose rows count from 0 in the order they are stored in; runs jobs.

    Unlike ``numbered`` nothing is sorted or sent. ``between`` reads only the part of the files that holds its rows.
    The driver gets a count per part.
    """

    def __init__(self, df: DataFrame, store):
        self.table = store(df.withColumn("_at", F.monotonically_increasing_id()))
        counts = self.table.groupBy(F.shiftright("_at", PLACE_BITS).alias("part")).count().collect()
        self.counts = sorted(tuple(r) for r in counts)
        self.rows = sum(n for _, n in self.counts)

    def between(self, first: int, end: int) -> DataFrame:
        """Rows from number ``first`` to before ``end``, with ``number``."""
        before, parts = 0, []
        for part, n in self.counts:
            if before < end and before + n > first:
                at = part << PLACE_BITS
                parts.append((part, before, at + max(first - before, 0), at + min(end - before, n)))
            before += n
        offsets = self.table.sparkSession.createDataFrame([p[:2] for p in parts], "_part bigint, _before bigint")
        low, high = (parts[0][2], parts[-1][3]) if parts else (0, 0)
        place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
        near = self.table.filter((F.col("_at") >= low) & (F.col("_at") < high))
        numbers = near.withColumn("_part", F.shiftright("_at", PLACE_BITS)).join(F.broadcast(offsets), "_part")
        return numbers.withColumn("number", F.col("_before") + place).drop("_part", "_before", "_at")
