import pytest
from pyspark.sql import functions as F

from casework.plans import reports
from casework.streaming import streams
from checks.queries import _rule_answers

MESSAGES = "thread_id bigint, customer_text string"


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def deliver(spark, rows, path, schema=MESSAGES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(started):
    started.awaitTermination()
    assert started.exception() is None
    return started


def test_triage_stream_splits_decisions_rejects_and_failures(spark, folder):
    deliver(spark, [(1, "wifi"), (2, "refund"), (3, " "), (4, None), (5, "x" * 1001), (6, "lost")], folder("in"))

    def answer(messages):
        given = _rule_answers(messages)
        return given.withColumn("answer", F.when(F.col("id") != 6, F.col("answer")))

    source = streams.read_stream(spark, folder("in"), spark.read.parquet(folder("in")).schema)
    run(streams.triage_stream(source, answer, folder("out"), folder("state")))
    decided = {r.thread_id: (r.status, r.intent) for r in spark.read.parquet(folder("out/decisions")).collect()}
    assert decided == {"1": ("auto_handled", "device_connectivity"), "2": ("escalated", "billing_purchases")}
    rejects = {r.thread_id: r.message_status for r in spark.read.parquet(folder("out/rejects")).collect()}
    assert rejects == {3: "empty", 4: "missing", 5: "too_long"}
    assert [tuple(r)[:2] for r in spark.read.parquet(folder("out/failures")).collect()] == [("6", "empty answer")]

    # A restart without new data changes nothing; new files are decided once.
    run(streams.triage_stream(source, answer, folder("out"), folder("state")))
    deliver(spark, [(7, "hello")], folder("in"))
    run(streams.triage_stream(source, answer, folder("out"), folder("state")))
    assert sorted(r.thread_id for r in spark.read.parquet(folder("out/decisions")).collect()) == ["1", "2", "7"]


def test_evaluation_survives_redelivery(spark, folder):
    deliver(spark, [(i, f"message {i}") for i in range(200)], folder("in"))
    source = streams.read_stream(spark, folder("in"), spark.createDataFrame([], MESSAGES).schema)
    run(streams.evaluate_stream(source, _rule_answers, folder("out"), folder("state")))
    assert spark.read.parquet(folder("out/results")).count() == 200
    # 200 old ids again, 50 new ones, and a repeat within the batch.
    deliver(spark, [(i, f"message {i}") for i in range(250)] + [(249, "again")], folder("in"))
    run(streams.evaluate_stream(source, _rule_answers, folder("out"), folder("state")))
    got = spark.read.parquet(folder("out/results"))
    assert got.count() == got.select("thread_id").distinct().count() == 250
    runs = spark.read.parquet(folder("out/runs")).collect()
    assert sorted((r.results, r.rejects, r.failures) for r in runs) == [(50, 0, 0), (200, 0, 0)]


def test_evaluation_survives_a_lost_checkpoint(spark, folder):
    # The new checkpoint starts at batch 0 again and sees only part of the old input.
    schema = spark.createDataFrame([], MESSAGES).schema
    deliver(spark, [(i, f"message {i}") for i in range(200)], folder("in"))
    source = streams.read_stream(spark, folder("in"), schema)
    run(streams.evaluate_stream(source, _rule_answers, folder("out"), folder("state")))
    deliver(spark, [(i, f"message {i}") for i in range(150, 250)], folder("later"))
    source = streams.read_stream(spark, folder("later"), schema)
    run(streams.evaluate_stream(source, _rule_answers, folder("out"), folder("new-state")))
    got = spark.read.parquet(folder("out/results"))
    assert got.count() == got.select("thread_id").distinct().count() == 250


def test_evaluation_with_event_time(spark, folder):
    schema = "thread_id bigint, customer_text string, at timestamp"
    rows = [(i, f"message {i}", None) for i in range(20)]
    df = spark.createDataFrame(rows, schema).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(folder("in"))
    source = streams.read_stream(spark, folder("in"), df.schema)
    args = (_rule_answers, folder("out"), folder("state"), "at")
    run(streams.evaluate_stream(source, *args))
    df.write.mode("append").parquet(folder("in"))
    run(streams.evaluate_stream(source, *args))
    assert spark.read.parquet(folder("out/results")).count() == 20


def test_a_replayed_batch_replaces_its_output(spark, folder, tmp_path):
    schema = "thread_id bigint, customer_text string, agent_text string"
    first = spark.createDataFrame([(1, "q", "a"), (2, "q", "b")], schema)
    calls = []
    start = streams._start
    streams._start = lambda stream, each, *rest: calls.append(each)
    try:
        streams.kb_stream(first, folder("kb"), folder("state"))
    finally:
        streams._start = start
    each = calls[0]
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "metadata").write_text('{"id":"r1"}')
    each(first, 0)
    each(first, 0)
    each(spark.createDataFrame([(2, "late", "x"), (3, "q", "c")], schema), 1)
    got = sorted((r.id, r.document) for r in spark.read.parquet(folder("kb")).collect())
    assert got == [("1", "q"), ("2", "q"), ("3", "q")]


def test_kb_stream_first_id_wins(spark, folder):
    schema = "thread_id bigint, customer_text string, agent_text string"
    deliver(spark, [(1, "one", "a"), (2, None, "b")], folder("in"), schema)
    source = streams.read_stream(spark, folder("in"), spark.read.parquet(folder("in")).schema)
    run(streams.kb_stream(source, folder("kb"), folder("state")))
    deliver(spark, [(1, "changed", "z"), (3, "three", "c")], folder("in"), schema)
    run(streams.kb_stream(source, folder("kb"), folder("state")))
    got = sorted((r.id, r.document) for r in spark.read.parquet(folder("kb")).collect())
    assert got == [("1", "one"), ("2", ""), ("3", "three")]


def test_stream_results_feed_the_reports(spark, folder):
    schema = MESSAGES + ", true_intent string, should_escalate int"
    rows = [(1, "wifi", "device_connectivity", 0), (2, "refund", "other", 1), (3, " ", "other", 0), (4, "x" * 2000, None, None)]
    deliver(spark, rows, folder("in"), schema)
    source = streams.read_stream(spark, folder("in") + "/", spark.createDataFrame([], schema).schema)
    run(streams.evaluate_stream(source, _rule_answers, folder("out"), folder("state")))
    row = reports.executive_summary(spark.read.parquet(folder("out/results"))).first()
    assert (row.total, row.intent_valid, row.agent_accuracy, row.esc_valid, row.esc_recall) == (3, 2, 0.5, 2, 1.0)
    assert [tuple(r)[:2] for r in spark.read.parquet(folder("out/rejects")).collect()] == [("3", "empty")]


@pytest.mark.parametrize("name", ["plain", "odd[1]*", "a{b}"])
def test_paths_are_no_patterns(spark, folder, name):
    for other in (name, "odd1x", "ab"):
        deliver(spark, [(1, other)], folder("root/" + other).replace("\\", ""))
    assert streams.as_pattern("/a/b/") == "/a/[b]"
    source = streams.read_stream(spark, folder("root/" + name), spark.createDataFrame([], MESSAGES).schema)
    run(streams.triage_stream(source, _rule_answers, folder("out"), folder("state")))
    assert spark.read.parquet(folder("out/decisions")).count() == 1


def test_a_trigger_of_ones_own(spark, folder):
    deliver(spark, [(1, "wifi")], folder("in"))
    source = streams.read_stream(spark, folder("in"), spark.createDataFrame([], MESSAGES).schema)
    started = streams.triage_stream(source, _rule_answers, folder("out"), folder("state"), {"processingTime": "1 second"})
    started.processAllAvailable()
    deliver(spark, [(2, "refund")], folder("in"))
    started.processAllAvailable()
    assert started.isActive
    started.stop()
    assert spark.read.parquet(folder("out/decisions")).count() == 2
