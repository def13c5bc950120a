import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from casework.functions import terms
from casework.functions.prompts import Templates
from casework.operators import retrieve, triage
from casework.plans import workflow
from casework.sources import schemas, tables

MESSAGES = "thread_id bigint, customer_text string"
TEMPLATES = Templates("Acme\n{message}\n{signals} of {intents}", "{cases}\nTo: {message}", "{message}\n>> {reply} {\"n\": 1} {keys}")

# The workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answers(spark, rows):
    return spark.createDataFrame(rows, "id string, answer string, error string")


def reply(intent="general_inquiry", confidence=0.9, escalate=False):
    return json.dumps({"intent": intent, "confidence_score": confidence, "should_escalate": escalate})


def test_checked_messages_lose_nothing(spark):
    df = spark.createDataFrame([(1, " ok "), (2, ""), (3, None), (4, "x" * 1001)], MESSAGES)
    checked = triage.checked_messages(df)
    assert [tuple(r) for r in triage.valid_messages(checked).collect()] == [(1, "ok")]
    assert {r.thread_id: r.message_status for r in triage.rejected_messages(checked).collect()} == {
        2: "empty", 3: "missing", 4: "too_long",
    }


def test_triage_batch(spark):
    messages = spark.createDataFrame(
        [(1, "which one to buy"), (2, "refund please"), (3, "hm"), (4, "hello"), (5, "no answer"), (6, "broken")], MESSAGES
    )
    given = answers(spark, [
        ("1", reply(), None), ("2", reply(), None), ("3", reply(confidence=0.59), None),
        ("4", None, "timeout"), ("6", "not json", None),
    ])
    near = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 1)], "q bigint, n bigint, rk bigint")
    texts = answers(spark, [("1", ' "a drafted reply" ', None), ("2", "never used", None)])
    got = {r.thread_id: r for r in triage.triage_batch(messages, given, near, texts).collect()}
    assert (got["1"].status, got["1"].reply, got["1"].retrieved_examples) == ("auto_handled", "a drafted reply", 2)
    assert (got["2"].status, got["2"].reply, got["2"].retrieved_examples) == ("escalated", None, None)
    assert got["2"].analysis.intent == "billing_purchases" and got["3"].status == "escalated"
    assert [got[i].error for i in ("4", "5", "6")] == ["timeout", "empty answer", "malformed JSON"]
    assert all(got[i].status is None and got[i].analysis is None for i in ("4", "5", "6"))


def test_no_knowledge_base_means_zero_examples(spark):
    messages = spark.createDataFrame([(1, "which one to buy")], MESSAGES)
    given = answers(spark, [("1", reply(), None)])
    none = spark.createDataFrame([], "q bigint, n bigint, rk bigint")
    for near in (None, none):
        assert triage.triage_batch(messages, given, near).first().retrieved_examples == 0


def test_scoring_returns_one_row_per_request(spark):
    requests = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("prompt")).repartition(5)

    def scorer(prompts):
        assert len(prompts) <= 64
        if "500" in prompts:
            raise RuntimeError("whole batch failed")
        return [KeyError("odd") if int(p) % 2 else "even" for p in prompts]

    spread = triage.score_batches(requests, scorer, 64, partitions=3)
    assert spread.rdd.getNumPartitions() == 3 and spread.count() == 1000
    got = triage.score_batches(requests, scorer, 64).collect()
    assert len({r.id for r in got}) == len(got) == 1000
    assert all((r.answer is None) != (r.error is None) for r in got)
    failed = [r for r in got if r.error == "whole batch failed"]
    assert 1 <= len(failed) <= 64 and any(r.answer == "even" for r in got)


def test_scorer_with_too_few_answers(spark):
    requests = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, prompt string").coalesce(1)
    got = triage.score_batches(requests, lambda p: ["one"]).collect()
    assert [r.error for r in got] == ["1 answers to 2 requests"] * 2


def test_requests(spark):
    messages = spark.createDataFrame([(1, 'my "phone" {x} refund')], MESSAGES)
    row = triage.classification_requests(messages, TEMPLATES.classify).first()
    assert (row.id, row.kind) == ("1", "classify")
    assert row.prompt.startswith('Acme\nmy "phone" {x} refund\n{"physical_damage"')
    assert '"refund_or_charge":true' in row.prompt and all(i in row.prompt for i in terms.INTENTS)
    cases = spark.createDataFrame(
        [("1", [("q1", "a1"), ("q2", None)])], "q string, examples array<struct<customer_issue:string,agent_reply:string>>"
    )
    prompt = triage.reply_requests(messages, cases, TEMPLATES.reply).first().prompt
    assert "Case 1\nCustomer: q1\nAgent: a1\n\nCase 2\nCustomer: q2\nAgent: " in prompt
    assert triage.reply_requests(messages, None, TEMPLATES.reply).first().prompt == f'{terms.NO_EXAMPLES}\nTo: my "phone" {{x}} refund'
    judged = spark.createDataFrame([(1, "hi", "hello")], "thread_id bigint, customer_text string, drafted_reply string")
    assert triage.judge_requests(judged, TEMPLATES.judge).first().prompt == (
        'hi\n>> hello {"n": 1} score_tone, score_grounding, reasoning'
    )
    with pytest.raises(ValueError, match="reply"):
        triage.judge_requests(judged, "{message}")


def test_pending_append_and_judge(spark):
    golden = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], MESSAGES)
    done = spark.createDataFrame([("2", "x"), ("2", "x")], "thread_id string, pred_intent string")
    rest = triage.pending(golden, done)
    assert sorted(r.thread_id for r in rest.collect()) == ["1", "3"]
    assert triage.pending(golden, golden).count() == 0
    both = triage.append_results(done, rest)
    assert both.count() == 4 and set(schemas.JUDGE_COLUMNS) <= set(both.columns)

    results = spark.createDataFrame(
        [("1", "r", None, "old"), ("2", " ", None, None), ("3", None, None, None), ("4", "r", 3, None)],
        "thread_id string, drafted_reply string, judge_tone int, judge_reasoning string",
    )
    assert [r.thread_id for r in triage.judge_sample(results).collect()] == ["1"]
    scores = spark.createDataFrame([("1", 5, None), ("1", None, None), ("4", None, "why")], "thread_id string, judge_tone int, judge_reasoning string")
    got = {r.thread_id: (r.judge_tone, r.judge_reasoning) for r in triage.apply_judgements(results, scores).collect()}
    assert got == {"1": (5, "old"), "2": (None, None), "3": (None, None), "4": (3, "why")}


def test_unlabelled_truth_stays_null(spark):
    golden = spark.createDataFrame(
        [(1, "a", "other", 1.0), (2, "b", None, None)], "thread_id bigint, customer_text string, true_intent string, should_escalate double"
    )
    decided = triage.triage_batch(golden, answers(spark, [("1", reply(), None), ("2", reply(), None)]))
    got = {r.thread_id: r.true_escalate for r in triage.evaluation_rows(decided, golden).collect()}
    assert got == {"1": True, "2": None}


def test_preparation_and_evaluation(spark, tmp_path):
    tweets = spark.range(120).select(
        F.col("id").alias("tweet_id"),
        F.when(F.col("id") % 2 == 1, "Brand").otherwise("user").alias("author_id"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("answer "), "id")).otherwise(
            F.concat(F.lit("a long enough question number "), "id")
        ).alias("text"),
        F.when(F.col("id") % 2 == 1, F.col("id") - 1).alias("in_response_to_tweet_id"),
    )
    prepared = workflow.prepare(tweets, "Brand", str(tmp_path / "p"), golden=20)
    assert (prepared.golden.count(), prepared.knowledge_base.count()) == (20, 40)
    assert {r.kind: r.n for r in prepared.leaks.collect()} == {"id": 0, "text": 0}

    golden = prepared.golden.withColumns(
        {"true_intent": F.lit("general_inquiry"), "should_escalate": F.lit(0)}
    )
    vectors = F.array(*[(F.col("k").cast("bigint") % p).cast("float") for p in (2, 3, 5, 7)])
    searched = []

    def find(handled):
        searched.append(handled.count())
        return retrieve.similar_issues(
            handled.select(F.col("thread_id").alias("k")).withColumn("embedding", vectors),
            prepared.knowledge_base.select(F.col("id").alias("k")).withColumn("embedding", vectors), 5, "k", "k",
        )

    asked = tmp_path / "asked"
    asked.mkdir()

    def classifier(texts):
        out = []
        for t in texts:
            number = t.split("question number ")[1].split("\n")[0]
            (asked / number).touch()
            out.append(TimeoutError("quota") if number.endswith("4") else reply())
        return out

    def writer(texts):
        assert all("Case 5" in t for t in texts)
        return ["drafted"] * len(texts)

    def judge(texts):
        return ['{"score_tone":4,"score_grounding":5,"reasoning":"fine"}'] * len(texts)

    path = str(tmp_path / "e")
    first = workflow.evaluate(spark, golden, classifier, TEMPLATES, path, find, prepared.knowledge_base, writer, judge)
    failed = golden.filter(F.col("thread_id").cast("string").endswith("4")).count()
    assert 0 < failed < 20 and first.count() == 20 - failed and searched == [20 - failed]
    assert first.filter("judge_tone = 4 and judge_grounding = 5").count() == min(10, 20 - failed)
    assert first.filter("retrieved_examples = 5 and drafted_reply = 'drafted'").count() == 20 - failed

    # The failed rows are still pending; only they are asked again.
    for f in asked.iterdir():
        f.rename(tmp_path / f"seen-{f.name}")
    second = workflow.evaluate(spark, golden, lambda t: classifier(t) and [reply()] * len(t), TEMPLATES, path)
    assert second.count() == 20 and len(list(asked.iterdir())) == failed
    assert second.select("thread_id").distinct().count() == 20
    assert tables.read_table(spark, f"{path}/results", schemas.RESULTS).filter("pred_escalate").count() == 0


def test_repeated_threads_are_asked_once_and_never_multiplied(spark, tmp_path):
    # One thread holds half of the golden rows.
    golden = spark.range(40).select(
        F.when(F.col("id") < 20, 0).otherwise(F.col("id")).alias("thread_id"), F.lit("hello there").alias("customer_text"),
        F.lit("other").alias("true_intent"), F.lit(1).alias("should_escalate"),
    )
    asked = tmp_path / "asked"
    asked.mkdir()

    def classifier(texts):
        (asked / f"{id(texts)}-{len(texts)}").touch()
        return [reply()] * len(texts)

    done = workflow.evaluate(spark, golden, classifier, TEMPLATES, str(tmp_path / "e"))
    assert sum(int(f.name.split("-")[1]) for f in asked.iterdir()) == 21
    assert done.count() == 40 and done.filter("thread_id = '0'").count() == 20
    replied = done.withColumn("drafted_reply", F.lit("hi"))
    assert [r.n for r in triage.judge_sample(replied, 15).groupBy("thread_id").agg(F.count("*").alias("n")).collect()] == [1] * 15
    again = answers(spark, [("0", reply(), None)] * 30 + [("0", None, "timeout")] * 30)
    assert triage.triage_batch(triage.one_per_thread(golden), again).filter("thread_id = '0'").count() == 1


def test_a_broken_run_asks_again_only_what_has_no_usable_answer(spark, tmp_path):
    golden = spark.range(30).select(
        F.col("id").alias("thread_id"), F.format_string("message <%d>", "id").alias("customer_text"),
        F.lit("other").alias("true_intent"), F.lit(0).alias("should_escalate"),
    )
    asked = tmp_path / "asked"
    asked.mkdir()

    def classifier(texts):
        out = []
        for t in texts:
            number = int(t.split("message <")[1].split(">")[0])
            (asked / f"{number}-{len(list(asked.glob(f'{number}-*')))}").touch()
            first = not (asked / f"{number}-1").exists()
            out.append("not json" if first and number < 5 else reply())
        return out

    def broken(texts):
        raise SystemExit("the writer process dies")

    path = str(tmp_path / "e")
    with pytest.raises(Exception):
        workflow.evaluate(spark, golden, classifier, TEMPLATES, path, writer=broken)
    assert len(list(asked.iterdir())) == 30
    done = workflow.evaluate(spark, golden, classifier, TEMPLATES, path, writer=lambda texts: ["drafted"] * len(texts))
    assert sorted(f.name for f in asked.glob("*-1")) == [f"{i}-1" for i in range(5)]
    assert done.count() == 30 and done.filter("drafted_reply = 'drafted'").count() == 30


def test_no_row_of_an_evaluation_is_lost(spark, tmp_path):
    golden = spark.createDataFrame(
        [(1, "fine", "other", 0), (2, "x" * 1001, "other", 1), (3, " \n", "other", 0), (4, None, None, None)],
        "thread_id bigint, customer_text string, true_intent string, should_escalate int",
    )
    done = workflow.evaluate(spark, golden, lambda p: [reply()] * len(p), TEMPLATES, str(tmp_path / "e"))
    assert sorted(r.thread_id for r in done.collect()) == ["1", "2"]
    rejects = {r.thread_id: r.reason for r in spark.read.parquet(str(tmp_path / "e" / "rejects")).collect()}
    assert rejects == {"3": "empty", "4": "missing"}


def test_each_run_judges_other_replies(spark, tmp_path):
    golden = spark.range(30).select(
        F.col("id").alias("thread_id"), F.lit("hello there").alias("customer_text"), F.lit("other").alias("true_intent"),
        F.lit(0).alias("should_escalate"),
    )
    path = str(tmp_path / "e")

    def judge(prompts):
        return ["no scores" if i == 0 else '{"score_tone":4,"score_grounding":5}' for i, _ in enumerate(prompts)]

    def run(**more):
        return workflow.evaluate(
            spark, golden, lambda p: [reply()] * len(p), TEMPLATES, path, writer=lambda p: ["drafted"] * len(p), **more
        )

    for n in (10, 20, 30, 30):
        done = run(judge=judge)
        judged = tables.read_table(spark, f"{path}/judgements", schemas.JUDGEMENTS)
        assert judged.count() == judged.select("thread_id").distinct().count() == n
    # A run without a judge returns the scores too.
    assert run().filter("judge_grounding = 5").count() == done.filter("judge_grounding = 5").count() > 20


def test_the_audit_reads_the_stored_base(spark, tmp_path):
    tweets = spark.range(80).select(
        F.col("id").alias("tweet_id"), F.when(F.col("id") % 2 == 1, "Brand").otherwise("user").alias("author_id"),
        F.concat(F.lit("a long enough text number "), "id").alias("text"),
        F.when(F.col("id") % 2 == 1, F.col("id") - 1).alias("in_response_to_tweet_id"),
    )
    path = str(tmp_path / "p")
    assert {r.n for r in workflow.prepare(tweets, "Brand", path, golden=5).leaks.collect()} == {0}
    assert {r.n for r in workflow.prepare(tweets, "Brand", path, golden=12).leaks.collect()} == {7}
