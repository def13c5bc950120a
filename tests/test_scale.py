"""Plans on skewed input: hot keys are split or combined before the shuffle."""

import contextlib

import pytest
from pyspark.sql import functions as F

from casework.operators import metrics, seeded, threads, triage
from casework.plans import reports


@contextlib.contextmanager
def settings(spark, **values):
    names = {k: "spark.sql." + k.replace("__", ".") for k in values}
    old = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for k, n in names.items():
            spark.conf.unset(n) if old[k] is None else spark.conf.set(n, old[k])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    text = plan(df)
    return text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text


@pytest.fixture
def tweets(spark, tmp_path):
    """A third of all replies answer message 0."""
    n = 60_000
    rows = spark.range(n, numPartitions=12).select(
        F.col("id").alias("tweet_id"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("Brand").alias("author_id"),
        F.concat(F.lit("a text that is long enough "), F.sha2(F.col("id").cast("string"), 256)).alias("text"),
        F.when(F.col("id") % 2 == 1, F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - 1)).alias(
            "in_response_to_tweet_id"
        ),
    )
    rows.write.parquet(str(tmp_path / "tweets"))
    return spark.read.parquet(str(tmp_path / "tweets"))


def test_hot_parent_is_split_by_adaptive_execution(spark, tweets):
    with settings(
        spark, autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1", shuffle__partitions="8",
        adaptive__advisoryPartitionSizeInBytes="64KB", adaptive__skewJoin__skewedPartitionThresholdInBytes="128KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
    ):
        pairs = threads.pair_threads(tweets, threads.brand_replies(tweets, "Brand"))
        text = final(pairs)
        assert "skew=true" in text
        assert pairs.count() == 30_000
        parents = threads.reply_parents(tweets, threads.brand_replies(tweets, "Brand"))
        assert parents.count() == 20_000


def test_filters_and_columns_reach_the_scan(spark, tweets):
    pairs = threads.pair_threads(tweets, threads.brand_replies(tweets, "Brand"))
    text = plan(pairs)
    assert "EqualTo(author_id,Brand)" in text and "IsNotNull(in_response_to_tweet_id)" in text
    counted = plan(metrics.pair_counts(tweets, "author_id", "author_id"))
    assert "ReadSchema: struct<author_id:string>" in counted


def test_sampling_hands_one_task_little_more_than_n(spark, tweets):
    sample = seeded.seeded_sample(tweets, 50, "tweet_id", 42)
    assert sample.count() == 50
    near = [c for c in sample._jdf.queryExecution().optimizedPlan().toString().split("\n") if "scalar-subquery" in c]
    assert near, "the cutoff must filter before the top-n"


def test_metrics_combine_before_the_shuffle(spark, tweets):
    text = plan(metrics.pair_counts(tweets, "author_id", "author_id"))
    assert "partial_count" in text


def test_a_report_reads_the_results_once(spark, tmp_path):
    rows = spark.range(1000).select(
        F.col("id").cast("string").alias("thread_id"), F.lit("wifi").alias("customer_text"),
        F.when(F.col("id") % 3 == 0, "other").otherwise("general_inquiry").alias("true_intent"),
        F.lit("other").alias("pred_intent"), F.lit("true").alias("true_escalate"), F.lit("false").alias("pred_escalate"),
    )
    rows.write.parquet(str(tmp_path / "results"))
    results = spark.read.parquet(str(tmp_path / "results"))
    pairs = metrics.pair_counts(results, "true_intent", "pred_intent")
    single = [
        reports.executive_summary(results), reports.baseline_report(results), reports.diagnostics(results),
        reports.accuracy_comparison(results), reports.dataset_audit(results), metrics.classification_report(pairs),
        metrics.confusion_matrix(pairs),
        metrics.weighted_prf(metrics.class_metrics(pairs)),
    ]
    for df in single:
        assert final(df).count("FileScan") == 1, df.columns
    shares = metrics.label_distribution(results, "true_intent")
    shares.collect()
    assert "ReusedExchange" in plan(shares)
    for df in (reports.evaluation_report(results), reports.dashboard(results, ["class_wise", "executive_summary"])):
        assert f"{tmp_path}/results" not in plan(df)


def test_no_row_python_and_no_cross_join_in_the_rules(spark, tweets):
    messages = tweets.select(F.col("tweet_id").alias("thread_id"), F.col("text").alias("customer_text"))
    text = plan(triage.with_signals(triage.valid_messages(triage.checked_messages(messages))))
    for bad in ("Python", "Cartesian", "NestedLoop", "Exchange"):
        assert bad not in text
