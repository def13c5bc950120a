"""Tables that grow by a directory ``run=.../batch_id=...`` per micro-batch.

Beside the directories lie, in folders Spark's readers pass over:

* ``_filters/run=.../batch_id=...``: the least and greatest id of a batch and a Bloom filter of its ids, so that
  a later batch opens only directories that may hold one of its own ids;
* ``_merges/NAME.json``: which directories the merged directory ``run=NAME`` stands for. This file
  is what makes a merge take effect; before it, the merged directory does not count, after it the others don't.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.sources import files

FILTERS, MERGES, MERGED = "_filters", "_merges", "merged-"
#: Bits for each id and bits set by it: one foreign id in some millions looks stored.
BITS_PER_ID, PROBES = 32, 16
#: A filter lies in rows of so many 64-bit words; an id has all its bits in one of them.
WORDS = 1024
_BITS = WORDS * 64


def place_name(place: tuple) -> str:
    return f"run={place[0]}/batch_id={place[1]}"


def write(batch: DataFrame, path: str, place: tuple, id_column: str | None = None) -> None:
    """Write a batch over what an earlier try of it has left; with ``id_column`` also its filter."""
    directory = f"{path}/{place_name(place)}"
    batch.write.mode("overwrite").parquet(directory)
    if id_column is not None:
        ids = batch.sparkSession.read.schema(batch.schema).parquet(directory).select(F.col(id_column).cast("string").alias("id"))
        id_filter(ids).write.mode("overwrite").parquet(f"{path}/{FILTERS}/{place_name(place)}")


# ---- filters

def _segment(id_: Column, power: Column) -> Column:
    """Number of the row of a filter of 2 ** power rows that has an id's bits."""
    return F.when(power == 0, F.lit(0)).otherwise(
        F.call_function("shiftrightunsigned", F.xxhash64(id_, F.lit(-1)), F.lit(64) - power).cast("int")
    )


def _bits(id_: Column) -> Column:
    """Numbers of an id's bits within its row."""
    hashes = [F.xxhash64(id_, F.lit(i)) for i in range(-(-PROBES // 4))]
    return F.array(*[
        F.shiftrightunsigned(hashes[i // 4], 16 * (i % 4)).bitwiseAND(F.lit(_BITS - 1)).cast("int") for i in range(PROBES)
    ])


def id_filter(ids: DataFrame) -> DataFrame:
    """The filter of a column ``id``: rows (least, greatest, power, segment, words); none for no ids.

    Bits are set by an aggregation over words, so a filter may be of any size; no row of it has
    more than WORDS words.
    """
    one = ids.filter(F.col("id").isNotNull()).distinct()
    whole = one.agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"))
    # Twice as many rows as the bits would fill at least, to the next power of two.
    power = F.greatest(F.ceil(F.log2(F.col("n") * BITS_PER_ID / _BITS)), F.lit(0)).cast("int")
    whole = whole.select("least", "greatest", power.alias("power"))
    words = (
        one.withColumn("power", whole.select("power").scalar())
        .select("power", _segment(F.col("id"), F.col("power")).alias("segment"), F.explode(_bits(F.col("id"))).alias("_bit"))
        .groupBy("power", "segment", F.shiftright("_bit", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, _bit % 64)")).alias("_set"))
    )
    rows = words.groupBy("power", "segment").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_set"))).alias("_sets"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.col("_sets")[w], F.lit(0).cast("long")))
    return rows.join(F.broadcast(whole), "power").select("least", "greatest", "power", "segment", filled.alias("words"))


def _all_set(words: Column, bits: Column) -> Column:
    return F.forall(bits, lambda b: F.get(words, F.shiftright(b, 6)).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)
    ) != 0)


def may_hold(spark: SparkSession, path: str, places: list, ids: DataFrame) -> list:
    """Of the directories ``places`` (run, batch id) with a filter those that may hold one of ``ids``.

    First come the ranges, which are two values a directory, then the bits of those whose
    range has an id. The ids of the batch are sent out, not the filters.
    """
    if not places:
        return []
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
    found = _filters(spark, path, places)
    ends = wanted.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    if ends.low is None:
        return []
    near = found.filter((F.col("least") <= ends.high) & (F.col("greatest") >= ends.low))
    powers = [r.power for r in near.select("power").distinct().collect()]
    if not powers:
        return []
    probes = wanted.select("id", F.explode(F.array(*[F.lit(p) for p in powers])).alias("power")).withColumn(
        "segment", _segment(F.col("id"), F.col("power"))
    ).withColumn("_own", _bits(F.col("id")))
    hits = near.join(probes, ["power", "segment"]).filter(
        F.col("id").between(F.col("least"), F.col("greatest")) & _all_set(F.col("words"), F.col("_own"))
    )
    return sorted((r.run, int(r.batch_id)) for r in hits.select("run", "batch_id").distinct().collect())


def _filters(spark, path, places):
    base = f"{path}/{FILTERS}"
    schema = "least string, greatest string, power int, segment int, words array<bigint>, run string, batch_id bigint"
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{place_name(p)}" for p in places])


# ---- directories

def listed(spark: SparkSession, path: str) -> list:
    """(run, batch id) of all directories there are."""
    out = []
    for run in files.names(spark, path):
        if run.startswith("run="):
            out += [(run[4:], int(b[9:])) for b in files.names(spark, f"{path}/{run}") if b.startswith("batch_id=")]
    return sorted(out)


def merged(spark: SparkSession, path: str) -> dict:
    """Merged run -> the directories it stands for."""
    found = [n for n in files.names(spark, f"{path}/{MERGES}") if n.endswith(".json") and not n.startswith(".")]
    return {
        n[:-5]: [tuple(p) for p in files.read_json(spark, f"{path}/{MERGES}/{n}")["directories"]] for n in found
    }


def live(spark: SparkSession, path: str) -> list:
    """(run, batch id) of the directories that make up the table."""
    merges = merged(spark, path)
    gone = {p for parts in merges.values() for p in parts}
    return [p for p in listed(spark, path) if p not in gone and (not p[0].startswith(MERGED) or p[0] in merges)]


def read(spark: SparkSession, path: str, schema, places: list | None = None) -> DataFrame:
    """The table, or the given directories of it; also while directories are being merged.

    A reader that began before a merge must end before the old directories go (``clean``).
    """
    places = live(spark, path) if places is None else places
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{place_name(p)}" for p in places])


def holding(spark: SparkSession, path: str, ids: DataFrame, besides: tuple | None = None) -> list:
    """Directories that may hold one of ``ids``: by their filters, and those that have none."""
    there = [p for p in live(spark, path) if p != besides]
    base = f"{path}/{FILTERS}"
    filtered = [p for p in there if files.exists(spark, f"{base}/{place_name(p)}/_SUCCESS")] if files.exists(spark, base) else []
    without = sorted(set(there) - set(filtered))
    return sorted(without + may_hold(spark, path, filtered, ids)) if there else []


def merge(spark: SparkSession, path: str, schema, id_column: str, small_rows: int = 1_000_000) -> list:
    """Merge directories of fewer than ``small_rows`` rows into one with its filter; returns those merged.

    The newest directory of each run stays, as its batch may be tried again. A merge that broke off takes effect
    or not, never half: until its file in ``_merges`` is there the next call drops what it had written,
    from then on readers pass over the old directories, and ``clean`` deletes them.
    """
    merges, there = merged(spark, path), live(spark, path)
    for run, batch in listed(spark, path):
        if run.startswith(MERGED) and run not in merges:
            _drop(spark, path, (run, batch))
    newest = {run: max(b for r, b in there if r == run) for run, _ in there if not run.startswith(MERGED)}
    old = [p for p in there if newest.get(p[0]) != p[1]]
    small = _rows(spark, path, old)
    small = [p for p in old if small.get(p, 0) < small_rows]
    if len(small) < 2:
        return []
    run = f"{MERGED}{uuid.uuid4().hex}"
    write(read(spark, path, schema, small), path, (run, 0), id_column)
    files.create_json(spark, f"{path}/{MERGES}/{run}.json", {"directories": small, "writer": run})
    return small


def _rows(spark, path, places) -> dict:
    """Rows of each directory, from the footers of its files."""
    if not places:
        return {}
    paths = [f"{path}/{place_name(p)}" for p in places]
    try:
        counts = spark.read.option("basePath", path).parquet(*paths).groupBy("run", "batch_id").count().collect()
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return {}
    return {(str(r.run), int(r.batch_id)): r["count"] for r in counts}


def _drop(spark, path, place) -> None:
    for base in (path, f"{path}/{FILTERS}"):
        files.delete(spark, f"{base}/{place_name(place)}")


def clean(spark: SparkSession, path: str) -> list:
    """Delete directories that a merge has replaced; returns them. May be repeated."""
    there, gone = set(listed(spark, path)), []
    for parts in merged(spark, path).values():
        for place in parts:
            if place in there:
                _drop(spark, path, place)
                gone.append(place)
    return sorted(gone)
