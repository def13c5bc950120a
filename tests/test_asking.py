"""Answers are kept slice by slice."""

import pytest
from pyspark.sql import functions as F

from casework.functions.prompts import Templates
from casework.operators import triage
from casework.plans import workflow
from casework.sources import schemas, tables, versions

TEMPLATES = Templates(classify="message <{message}>", judge="<{message}> -> <{reply}>")
REPLY = '{"intent":"other","confidence_score":0.9,"should_escalate":false}'


def golden_rows(spark, n):
    return spark.range(n).select(
        F.col("id").alias("thread_id"), F.col("id").cast("string").alias("customer_text"),
        F.lit("other").alias("true_intent"), F.lit(0).alias("should_escalate"),
    )


# A lambda goes to the workers by value, as they can't import this module.
numbers = lambda prompts: [p.split("<")[1].split(">")[0] for p in prompts]


def test_a_dying_scorer_loses_at_most_the_batch_of_each_task(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def classifier(prompts):
        batch = len(list(asked.iterdir())) + 1
        (asked / f"{batch}-{numbers(prompts)[0]}").write_text(" ".join(numbers(prompts)))
        if batch == 7:
            raise SystemExit("killed")
        return [REPLY] * len(prompts)

    path, run = str(tmp_path / "e"), dict(batch_rows=5, callers=2)
    with pytest.raises(Exception):
        workflow.evaluate(spark, golden_rows(spark, 100), classifier, TEMPLATES, path, **run)
    kept = {r.id for r in spark.read.parquet(f"{path}/answers/classify").collect()}
    sent = [f.read_text().split() for f in asked.iterdir()]
    assert max(map(len, sent)) <= 5
    assert len(kept) >= sum(map(len, sent)) - 2 * 5 >= 20

    again = tmp_path / "again"
    again.mkdir()

    def steady(prompts):
        (again / f"{numbers(prompts)[0]}").write_text(" ".join(numbers(prompts)))
        return [REPLY] * len(prompts)

    done = workflow.evaluate(spark, golden_rows(spark, 100), steady, TEMPLATES, path, **run)
    rest = [i for f in again.iterdir() for i in f.read_text().split()]
    assert sorted(rest) == sorted({str(i) for i in range(100)} - kept)
    assert done.count() == done.select("thread_id").distinct().count() == 100


def test_every_slice_is_stored_before_the_next(spark, tmp_path):
    path = str(tmp_path / "answers")
    requests = spark.range(23).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("prompt"))
    ask = workflow.Asking(batch_rows=3, callers=2)
    given = ask(requests, lambda p: ["a"] * len(p), path, lambda a: a.filter("error IS NULL"))
    assert sorted(int(r.id) for r in given.collect()) == list(range(23))
    assert ask(requests.limit(0), lambda p: 1 / 0, path, lambda a: a).count() == 23


def test_many_batches_take_few_jobs(spark, tmp_path):
    path = str(tmp_path / "answers")
    requests = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("prompt"))
    ask = workflow.Asking(batch_rows=4, callers=spark.sparkContext.defaultParallelism)
    saved, save = [], workflow.Asking.save
    workflow.Asking.save = lambda self, some, *rest: (saved.append(some.rdd.getNumPartitions()), save(self, some, *rest))
    try:
        given = ask(requests, lambda p: [str(len(p))] * len(p), path, lambda a: a.filter("error IS NULL"))
    finally:
        workflow.Asking.save = save
    assert saved == [100]
    assert sorted(int(r.id) for r in given.collect()) == list(range(400))
    assert {r.answer for r in given.collect()} == {"4"}


def counted_tasks(spark, monkeypatch, path, rows, seconds):
    """Tasks of each job that asks ``rows`` requests in batches of 4, in jobs of 10 tasks."""
    monkeypatch.setattr(workflow, "MAX_TASKS", 10, raising=False)
    monkeypatch.setattr(workflow, "TASK_SECONDS", seconds, raising=False)
    saved, save = [], workflow.Asking.save
    monkeypatch.setattr(
        workflow.Asking, "save", lambda self, some, *rest: (saved.append(some.rdd.getNumPartitions()), save(self, some, *rest))
    )
    requests = spark.range(rows).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("prompt"))
    ask = workflow.Asking(batch_rows=4, callers=spark.sparkContext.defaultParallelism)
    given = ask(requests, lambda p: [str(len(p))] * len(p), path, lambda a: a.filter("error IS NULL")).collect()
    assert sorted(int(r.id) for r in given) == list(range(rows)) and {r.answer for r in given} == {"4"}
    return saved


def test_quick_batches_share_a_task(spark, tmp_path, monkeypatch):
    assert counted_tasks(spark, monkeypatch, str(tmp_path / "a"), 1200, 1e6) == [10, 9]  # 36 batches a task for 8 callers


def test_slow_batches_have_a_task_each(spark, tmp_path, monkeypatch):
    assert counted_tasks(spark, monkeypatch, str(tmp_path / "a"), 100, 0) == [10, 10, 5]


def test_texts_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return str(i)

    golden = golden_rows(spark, 50).withColumn("customer_text", F.udf(text, "string")("thread_id"))
    done = workflow.evaluate(spark, golden, lambda p: [REPLY] * len(p), TEMPLATES, str(tmp_path / "e"))
    assert done.count() == 50 and made.value == 50


def test_a_failure_says_the_greatest_error_of_all_runs(spark, tmp_path):
    path = str(tmp_path / "e")
    for said, greatest in ("b", "b"), ("c", "c"), ("a", "c"):
        workflow.evaluate(
            spark, golden_rows(spark, 4), lambda p, s=said: [OSError(s) if n == "2" else REPLY for n in numbers(p)], TEMPLATES, path
        )
        failed = spark.read.schema("thread_id string, error string").parquet(f"{path}/failures").collect()
        assert [tuple(r) for r in failed] == [("2", greatest)]


def test_a_job_that_fails_keeps_the_batches_that_ended(spark, tmp_path):
    path, asked = str(tmp_path / "answers"), tmp_path / "asked"
    asked.mkdir()

    def scorer(prompts):
        (asked / prompts[0]).write_text("")
        if len(list(asked.iterdir())) > 30:
            raise SystemExit("killed")
        return ["a"] * len(prompts)

    requests = spark.range(300).select(F.format_string("%03d", "id").alias("id"), F.format_string("%03d", "id").alias("prompt"))
    ask = workflow.Asking(batch_rows=3, callers=spark.sparkContext.defaultParallelism)
    with pytest.raises(Exception):
        ask(requests, scorer, path, lambda a: a.filter("error IS NULL"))
    kept = spark.read.parquet(path).count()
    assert kept >= 3 * (len(list(asked.iterdir())) - 2 * ask.callers) and kept >= 3 * 20


def test_failures_of_a_run_are_listed(spark, tmp_path):
    def classifier(prompts):
        return [TimeoutError("quota") if n == "3" else "not json" if n == "4" else REPLY for n in numbers(prompts)]

    path = str(tmp_path / "e")
    assert workflow.evaluate(spark, golden_rows(spark, 6), classifier, TEMPLATES, path).count() == 4
    failed = {r.thread_id: r.error for r in spark.read.parquet(f"{path}/failures").collect()}
    assert set(failed) == {"3", "4"} and failed["3"] == "quota" and failed["4"]
    workflow.evaluate(spark, golden_rows(spark, 6), lambda p: [REPLY] * len(p), TEMPLATES, path)
    assert spark.read.schema("thread_id string").parquet(f"{path}/failures").count() == 0


def test_runs_are_counted_while_their_tables_are_written(spark, tmp_path):
    path = str(tmp_path / "e")
    golden = golden_rows(spark, 9).withColumn("customer_text", F.when(F.col("thread_id") > 1, F.col("customer_text"))).withColumn(
        "true_intent", F.when(F.col("thread_id") > 3, F.col("true_intent"))
    )
    for broken in ("5", "-"):
        workflow.evaluate(spark, golden, lambda p, b=broken: ["no" if n == b else REPLY for n in numbers(p)], TEMPLATES, path)
    runs = sorted(map(tuple, spark.read.parquet(f"{path}/runs").select(schemas.RUNS.names).collect()))
    # results, with both intents, with both flags, completed, rejects, failures
    assert runs == [(1, 1, 1, 1, 2, 0), (6, 4, 6, 6, 2, 1)]


def test_replies_to_missing_messages_are_judged(spark, tmp_path):
    rows = [(str(i), None if i == 3 else "hello", f"reply {i}") for i in range(8)]
    results = spark.createDataFrame(rows, "thread_id string, customer_text string, drafted_reply string")
    results = tables.add_missing(results, {f.name: f.dataType.simpleString() for f in schemas.RESULTS if f.name not in results.columns})

    def judge(prompts):
        assert all(len(p) for p in prompts)
        return ['{"score_tone":4,"score_grounding":5}'] * len(prompts)

    done = workflow.run_judge(results, judge, TEMPLATES.judge, str(tmp_path / "j"))
    assert {r.thread_id for r in done.filter("judge_tone = 4").collect()} == {str(i) for i in range(8)}


def test_a_request_without_a_prompt_fails_alone(spark):
    requests = spark.createDataFrame([("a", "x"), ("b", None), ("c", "yy")], "id string, prompt string").coalesce(1)
    got = {r.id: (r.answer, r.error) for r in triage.score_batches(requests, lambda p: [str(len(t)) for t in p]).collect()}
    assert got == {"a": ("1", None), "b": (None, "no prompt"), "c": ("2", None)}


def test_published_results_have_versions(spark, tmp_path):
    path = str(tmp_path / "e")
    workflow.evaluate(spark, golden_rows(spark, 5), lambda p: [REPLY] * len(p), TEMPLATES, path)
    assert workflow.publish(spark, path) == 1
    workflow.evaluate(spark, golden_rows(spark, 9), lambda p: [REPLY] * len(p), TEMPLATES, path)
    read = lambda v=None: versions.read(spark, f"{path}/judged", schemas.RESULTS, v).count()
    assert read() == 5 and workflow.publish(spark, path) == 2
    assert (read(), read(1)) == (9, 5)
