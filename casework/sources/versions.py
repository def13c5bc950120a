"""Tables with versions: a manifest names the directories a version consists of.

A writer first writes a directory nobody reads, then publishes the next version with one new
file. Readers see the old table or the new one; a writer whose table has meanwhile got another version fails
and has changed nothing. Rows are never rewritten to append.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from casework.sources import files

MANIFESTS, DATA = "_versions", "data"


class Outdated(RuntimeError):
    """Somebody else has published a version since the one this change is based on."""


def latest(spark: SparkSession, path: str) -> int:
    """Number of the newest version; 0 before the first."""
    found = [n for n in files.names(spark, f"{path}/{MANIFESTS}") if n.endswith(".json") and not n.startswith(".")]
    return max((int(n.split(".")[0]) for n in found), default=0)


def directories(spark: SparkSession, path: str, version: int | None = None) -> list:
    """Directories of a version, the newest by default."""
    version = latest(spark, path) if version is None else version
    return files.read_json(spark, f"{path}/{MANIFESTS}/{version:012d}.json")["directories"] if version else []


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version; an empty typed table before the first."""
    parts = directories(spark, path, version)
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{DATA}/{d}" for d in parts])


def write(df: DataFrame, path: str) -> str:
    """Write a directory that no version has yet; returns its name."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/{DATA}/{name}")
    return name


def publish(spark: SparkSession, path: str, based_on: int, directories: list) -> int:
    """Make the next version of ``based_on``; raises Outdated if that is not the newest any more."""
    version = based_on + 1
    manifest = {"version": version, "directories": list(directories), "writer": uuid.uuid4().hex}
    if latest(spark, path) != based_on or not files.create_json(spark, f"{path}/{MANIFESTS}/{version:012d}.json", manifest):
        raise Outdated(f"{path} has version {latest(spark, path)}, this change is based on {based_on}")
    return version


def replace(df: DataFrame, path: str, based_on: int) -> int:
    """A version that consists of ``df``, which was read from version ``based_on``."""
    return publish(df.sparkSession, path, based_on, [write(df, path)])


def append(df: DataFrame, path: str, attempts: int = 10) -> int:
    """A version with the rows of ``df`` beside those of the newest one. Other writers don't hinder
    that: the manifest is made anew on theirs, the directory is written once."""
    spark, name = df.sparkSession, write(df, path)
    for _ in range(attempts):
        newest = latest(spark, path)
        try:
            return publish(spark, path, newest, [*directories(spark, path, newest), name])
        except Outdated:
            continue
    raise Outdated(f"{path} changed {attempts} times meanwhile")


def clean(spark: SparkSession, path: str, keep: int = 2) -> list:
    """Delete directories that none of the newest ``keep`` versions has, and older manifests; returns the directories'
    names. Call it while nobody writes: what is written and not yet published goes too."""
    newest = latest(spark, path)
    kept = range(max(1, newest - keep + 1), newest + 1)
    live = {d for v in kept for d in directories(spark, path, v)}
    gone = [d for d in files.names(spark, f"{path}/{DATA}") if d not in live]
    for name in gone:
        files.delete(spark, f"{path}/{DATA}/{name}")
    for name in files.names(spark, f"{path}/{MANIFESTS}"):
        if name.endswith(".json") and not name.startswith(".") and int(name.split(".")[0]) not in kept:
            files.delete(spark, f"{path}/{MANIFESTS}/{name}")
    return gone
