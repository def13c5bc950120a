"""Small files and directories beside the tables, on whatever file system a path names.

Data goes through Spark's readers and writers; this is for markers and manifests of a few lines.
"""

import json

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list:
    """Names in a directory, sorted; none if it is absent."""
    system, place = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)


def read_json(spark: SparkSession, path: str):
    system, place = _file_system(spark, path)
    stream = system.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def create_json(spark: SparkSession, path: str, value) -> bool:
    """Write a new file; False if it is there already. Of several writers one gets True.

    The text is written under a name of its own first and then renamed, which fails where the
    target exists, so nobody reads half a file. ``value`` must tell writers apart: what stands in the end decides.
    """
    system, place = _file_system(spark, path)
    if system.exists(place):
        return False
    own = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{spark._jvm.java.util.UUID.randomUUID()}.tmp")
    stream = system.create(own, False)
    try:
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        stream.close()
    renamed = not system.exists(place) and system.rename(own, place)
    if not renamed:
        system.delete(own, False)
    return renamed and read_json(spark, path) == json.loads(json.dumps(value))
