"""Filters of stored batches, and merging their directories."""

import random

import pytest
from pyspark.sql import functions as F

from casework.sources import files
from casework.streaming import batches, streams
from checks.queries import _rule_answers

SCHEMA = "id string, v int"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def frame(spark, ids, v=0):
    return spark.createDataFrame([(i if i is None else str(i), v) for i in ids], SCHEMA)


def ids_of(spark, path, places=None):
    return sorted(r.id for r in batches.read(spark, path, SCHEMA, places).collect())


def test_filters_find_every_id_and_hardly_any_other(spark):
    rng = random.Random(0)
    stored = [str(rng.randint(0, 10**9)) for _ in range(9000)]  # several rows of bits
    rows = batches.id_filter(spark.createDataFrame([(i,) for i in [*stored, None, stored[0]]], "id string")).collect()
    assert {(r.least, r.greatest) for r in rows} == {(min(stored), max(stored))}
    assert len(rows) == 2 ** rows[0].power > 4 and {len(r.words) for r in rows} == {batches.WORDS}
    filters = spark.createDataFrame(rows, "least string, greatest string, power int, segment int, words array<bigint>")
    probes = spark.createDataFrame([(i, True) for i in stored] + [(f"x{i}", False) for i in range(20000)], "id string, there boolean")
    probes = probes.withColumn("power", F.lit(rows[0].power)).withColumn("segment", batches._segment(F.col("id"), F.col("power")))
    found = filters.join(probes, ["power", "segment"]).withColumn("hit", batches._all_set(F.col("words"), batches._bits(F.col("id"))))
    hits = {r.there: r.n for r in found.filter("hit").groupBy("there").agg(F.count("*").alias("n")).collect()}
    assert hits[True] == 9000 and hits.get(False, 0) <= 1


def test_only_directories_that_may_hold_an_id_are_opened(spark, path):
    for b in range(50):  # ids of all batches are interleaved, so ranges say nothing
        batches.write(frame(spark, [f"{i:04d}-{b}" for i in range(0, 40)]), path, ("r", b), "id")
    assert batches.holding(spark, path, frame(spark, ["0003-7", "0020-41", "0020-99", None])) == [("r", 7), ("r", 41)]
    assert batches.holding(spark, path, frame(spark, ["0003-7"]), besides=("r", 7)) == []
    assert batches.holding(spark, path, frame(spark, [f"{i:04d}-x" for i in range(40)])) == []
    assert batches.holding(spark, path, frame(spark, [None])) == []
    # A directory without a filter (its writer broke off between the two) may hold anything.
    files.delete(spark, f"{path}/_filters/run=r/batch_id=9")
    assert batches.holding(spark, path, frame(spark, ["0003-7"])) == [("r", 7), ("r", 9)]


def test_a_disjoint_batch_reads_no_stored_ids(spark, path):
    """The plan of what is known about a batch's ids has no scan of the table."""
    for b in range(50):
        batches.write(frame(spark, range(1000 * b, 1000 * b + 20)), path, ("r", b), "id")
    new = streams._earlier(path, ("r", 50), "id", frame(spark, range(70_000, 70_020)))
    assert "FileScan" not in new._jdf.queryExecution().executedPlan().toString() and not new.inputFiles()
    some = streams._earlier(path, ("r", 50), "id", frame(spark, [70_000, 3005]))
    assert {f.rsplit("/", 2)[1] for f in some.inputFiles()} == {"batch_id=3"}
    assert "ReadSchema: struct<id:string>" in some._jdf.queryExecution().executedPlan().toString()


def test_merging_keeps_rows_and_the_newest_batch(spark, path):
    for b in range(6):
        batches.write(frame(spark, range(10 * b, 10 * b + 10), b), path, ("r", b), "id")
    batches.write(frame(spark, range(100, 400), 7), path, ("s", 0), "id")
    batches.write(frame(spark, range(400, 700), 7), path, ("s", 1), "id")
    before = ids_of(spark, path)
    assert batches.merge(spark, path, SCHEMA, "id", small_rows=100) == [("r", b) for b in range(5)]
    assert ids_of(spark, path) == before
    assert len(batches.live(spark, path)) == 4  # the merged one, r/5, s/0 and s/1
    assert batches.clean(spark, path) == [("r", b) for b in range(5)] and batches.clean(spark, path) == []
    assert ids_of(spark, path) == before == sorted(r.id for r in spark.read.parquet(path).collect())
    assert [p[0][:7] for p in batches.holding(spark, path, frame(spark, [33]))] == ["merged-"]
    assert batches.merge(spark, path, SCHEMA, "id", small_rows=100) == []


@pytest.mark.parametrize("at", ["write", "create_json"])
def test_a_merge_that_breaks_off_changes_nothing(spark, path, at, monkeypatch):
    for b in range(4):
        batches.write(frame(spark, [b]), path, ("r", b), "id")

    def broken(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(batches if at == "write" else batches.files, at, broken)
        with pytest.raises(KeyboardInterrupt):
            batches.merge(spark, path, SCHEMA, "id")
    assert ids_of(spark, path) == list("0123")
    assert len(batches.merge(spark, path, SCHEMA, "id")) == 3  # drops what was left and merges
    assert ids_of(spark, path) == list("0123")
    # Broken off before the old directories go: readers already pass over them, the next cleaning ends it.
    batches.clean(spark, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list("0123")


def test_streams_go_on_over_merged_batches(spark, tmp_path):
    """Old ids delivered again after a merge, also to a stream that has lost its checkpoint."""
    schema = spark.createDataFrame([], "thread_id bigint, customer_text string").schema

    def deliver(name, ids):
        spark.createDataFrame([(i, f"message {i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run(name, state):
        source = streams.read_stream(spark, str(tmp_path / name), schema)
        streams.evaluate_stream(source, _rule_answers, str(tmp_path / "out"), str(tmp_path / state)).awaitTermination()

    for k in range(4):
        deliver("in", range(20 * k, 20 * k + 20))
        run("in", "state")
    results = str(tmp_path / "out/results")
    assert len(batches.merge(spark, results, streams.schemas.RESULTS, "thread_id")) == 3
    batches.clean(spark, results)
    deliver("in", range(70, 90))
    run("in", "state")
    deliver("later", range(0, 100))
    run("later", "new-state")
    got = batches.read(spark, results, streams.schemas.RESULTS)
    assert got.count() == got.select("thread_id").distinct().count() == 100
