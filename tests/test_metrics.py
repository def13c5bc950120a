import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from casework.operators import metrics
from casework.plans import reports


def escalations(spark, tp, fp, fn, tn):
    rows = [(True, True)] * tp + [(False, True)] * fp + [(True, False)] * fn + [(False, False)] * tn
    return spark.createDataFrame(rows, "t boolean, p boolean")


# The published ratios of two runs over 200 rows fix these counts.
@pytest.mark.parametrize(
    "counts, want",
    [((18, 5, 77, 100), (0.59, 0.7826, 0.1895, 0.3051)), ((23, 11, 72, 94), (0.585, 0.6765, 0.2421, 0.3566))],
)
def test_published_escalation_ratios(spark, counts, want):
    df = escalations(spark, *counts)
    row = metrics.binary_prf(metrics.binary_counts(df, F.col("t"), F.col("p"))).first()
    assert tuple(round(x, 4) for x in row) == want


def test_binary_without_positives_is_zero(spark):
    df = escalations(spark, 0, 0, 0, 5)
    row = metrics.binary_prf(metrics.binary_counts(df, F.col("t"), F.col("p"))).first()
    assert tuple(row) == (1.0, 0.0, 0.0, 0.0)


GOLDEN = {
    "general_inquiry": 120, "software_troubleshooting": 24, "hardware_repair": 22, "other": 17,
    "account_security": 8, "device_connectivity": 7, "billing_purchases": 2,
}


def golden(spark):
    rows = [(i,) for i, n in GOLDEN.items() for _ in range(n)] + [(None,)] * 5
    return spark.createDataFrame(rows, "true_intent string")


def test_published_distribution_and_majority(spark):
    df = metrics.label_distribution(golden(spark), "true_intent")
    assert [(r.label, r.n) for r in df.collect()] == list(GOLDEN.items())
    assert df.agg(F.sum("share")).first()[0] == pytest.approx(1)
    best = metrics.majority(df).first()
    assert (best.label, best.accuracy) == ("general_inquiry", 0.6)


def test_majority_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1)], "label string, n bigint")
    assert tuple(metrics.majority(df).first()) == ("a", 3 / 7)


def labelled(spark):
    rows = [("a", "a"), ("a", " A "), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a"), ("b", None), ("d", "e")]
    return spark.createDataFrame(rows, "t string, p string")


def test_class_metrics(spark):
    got = {r.intent: tuple(r)[1:] for r in metrics.class_metrics(metrics.pair_counts(labelled(spark), "t", "p")).collect()}
    assert got == {
        "a": (2 / 3, 2 / 3, 2 / 3, 3), "b": (0.5, 1.0, 2 / 3, 1), "c": (0.0, 0.0, 0.0, 1),
        "d": (0.0, 0.0, 0.0, 1), "e": (0.0, 0.0, 0.0, 0),
    }


def test_matrix_total_is_valid_rows_and_grid_is_full(spark):
    pairs = metrics.pair_counts(labelled(spark), "t", "p")
    matrix = metrics.confusion_matrix(pairs)
    assert matrix.count() == 25 and matrix.agg(F.sum("n")).first()[0] == 6
    wide = metrics.confusion_wide(matrix, ["a", "b"]).orderBy("true_label").collect()
    assert [tuple(r) for r in wide][:2] == [("a", 2, 1), ("b", 0, 1)]


def test_matrix_with_fixed_classes_ignores_others(spark):
    pairs = metrics.pair_counts(labelled(spark), "t", "p")
    got = {(r.true_label, r.pred_label): r.n for r in metrics.confusion_matrix(pairs, ["a", "z"]).collect()}
    assert got == {("a", "a"): 2, ("a", "z"): 0, ("z", "a"): 0, ("z", "z"): 0}


def test_matrix_of_many_labels(spark):
    df = spark.range(3000).select(F.concat(F.lit("l"), "id").alias("t"), F.concat(F.lit("l"), "id").alias("p"))
    matrix = metrics.confusion_matrix(metrics.pair_counts(df, "t", "p"))
    assert matrix.agg(F.count("*"), F.sum("n")).first() == (9_000_000, 3000)


def test_report_rows(spark):
    pairs = metrics.pair_counts(labelled(spark), "t", "p")
    got = {r.row: r for r in metrics.classification_report(pairs).collect()}
    assert got["accuracy"].f1 == 0.5 and got["accuracy"].support == 6
    assert got["macro avg"].rec == pytest.approx((2 / 3 + 1) / 5)
    assert got["weighted avg"].rec == pytest.approx(0.5)
    w = {r.label: r.recall for r in metrics.weighted_prf(metrics.class_metrics(pairs)).collect()}
    assert w.pop(None) == got["weighted avg"].rec and w == {k: got[k].rec for k in "abcde"}


def test_sums_are_the_same_in_any_partitioning(spark):
    """A million labels: no array of them, and the same bits however they lie."""
    values = spark.range(1_000_000).select(((F.col("id") * 7919 % 99991 + 1) / (F.col("id") % 1013 + 100000)).alias("v"))
    plan = values.agg(metrics.exact_sum(F.col("v")).alias("x"))
    assert "collect" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {values.repartition(n).agg(metrics.exact_sum(F.col("v")).alias("x")).first().x for n in (1, 3, 16)}
    exact = sum(Fraction((i * 7919 % 99991 + 1) / (i % 1013 + 100000)) for i in range(1_000_000))
    assert len(got) == 1 and abs(Fraction(got.pop()) - exact) <= exact / 2**51
    assert spark.range(0).agg(metrics.exact_sum(F.col("id") / 2).alias("x")).first().x is None


def test_raw_labels(spark):
    assert metrics.accuracy(labelled(spark), "t", "p").first().accuracy == 0.5
    assert metrics.accuracy(labelled(spark), "t", "p", normalize=False).first().accuracy == pytest.approx(2 / 6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_labels_against_plain_python(spark, seed):
    r = random.Random(seed)
    labels = ["a", "B ", " c", "d", None]
    rows = [(r.choice(labels), r.choice(labels)) for _ in range(r.randint(1, 300))]
    pairs = metrics.pair_counts(spark.createDataFrame(rows, "t string, p string"), "t", "p")
    clean = [(t.strip().lower(), p.strip().lower()) for t, p in rows if t is not None and p is not None]
    want = {}
    for c in {x for pair in clean for x in pair}:
        tp = sum(t == c == p for t, p in clean)
        predicted, support = sum(p == c for _, p in clean), sum(t == c for t, _ in clean)
        want[c] = (
            tp / predicted if predicted else 0.0, tp / support if support else 0.0,
            2 * tp / (predicted + support), support,
        )
    assert {x.intent: tuple(x)[1:] for x in metrics.class_metrics(pairs).collect()} == want
    assert sum(x.n for x in metrics.confusion_matrix(pairs).collect()) == len(clean) == sum(w[3] for w in want.values())
    report = {x.row: x for x in metrics.classification_report(pairs).collect()}
    hits = sum(t == p for t, p in clean)
    assert report["accuracy"].f1 == hits / len(clean)
    assert report["weighted avg"].rec == pytest.approx(hits / len(clean))
    assert report["macro avg"].f1 == pytest.approx(sum(w[2] for w in want.values()) / len(want))


def test_empty_input(spark):
    empty = spark.createDataFrame([], "t string, p string")
    pairs = metrics.pair_counts(empty, "t", "p")
    assert metrics.class_metrics(pairs).count() == 0
    assert metrics.confusion_matrix(pairs).count() == 0
    assert metrics.classification_report(pairs).count() == 0
    assert metrics.accuracy(empty, "t", "p").first().accuracy == 0.0


def test_scores(spark):
    df = spark.createDataFrame([("4", 2.0), ("bad", float("nan")), (None, 3.0)], "judge_tone string, judge_grounding double")
    got = {r.score: (r.mean, r.samples) for r in reports.judge_scores(df).collect()}
    assert got == {"tone": (4.0, 1), "grounding": (2.5, 2)}
    none = spark.createDataFrame([(None,)], "judge_tone string")
    assert [tuple(r) for r in reports.judge_scores(none).collect()] == [("tone", None, 0)]


RESULTS = (
    "thread_id string, customer_text string, true_intent string, pred_intent string, true_escalate string, "
    "pred_escalate string, escalation_reason string, drafted_reply string, judge_tone string, judge_helpfulness string"
)


@pytest.fixture
def results(spark):
    return spark.createDataFrame(
        [
            ("1", "refund me", "billing_purchases", "Billing_Purchases ", "True", "False", "money", "hi", "4", "2"),
            ("2", "wifi", "device_connectivity", "other", "1", None, None, " ", "x", None),
            ("3", "hello", "general_inquiry", "general_inquiry", "False", "True", None, None, None, None),
            ("4", None, None, None, None, "True", None, None, None, None),
        ],
        RESULTS,
    )


def test_missed_escalations_count_null_predictions(results):
    got = [tuple(r) for r in reports.safety_failures(results).collect()]
    assert got == [("1", "money", "refund me...", False, 2), ("2", "Escalation Required", "wifi...", True, 2)]
    assert [r.total for r in reports.safety_failures(results, 1).collect()] == [2]
    assert reports.safety_failures(results, None).count() == 2


def test_failure_cases(results):
    assert [r.thread_id for r in reports.failure_cases(results).collect()] == ["2", "4"]
    assert [(r.thread_id, r.total) for r in reports.failure_cases(results, n=1).collect()] == [("2", 2)]
    assert [r.thread_id for r in reports.failure_cases(results, normalize=False).collect()] == ["1", "2", "4"]
    assert reports.failure_cases(results, considered=1).count() == 0


def test_executive_summary(results):
    row = reports.executive_summary(results).first()
    assert (row.total, row.intent_valid, row.esc_valid) == (4, 3, 2)
    assert row.agent_accuracy == pytest.approx(2 / 3) and row.majority_accuracy == pytest.approx(1 / 3)


def test_optional_columns_may_be_absent(results):
    few = results.select("thread_id", "customer_text", "true_intent", "pred_intent", "true_escalate", "pred_escalate")
    sections = {r.section for r in reports.baseline_report(few).collect()}
    assert sections == {"DATASET", "INTENT", "ESCALATION"}
    with pytest.raises(ValueError, match="true_escalate"):
        reports.executive_summary(few.drop("true_escalate"))


def test_helpfulness_is_reported_if_present(results):
    lines = {(r.section, r.name): r.value for r in reports.baseline_report(results).collect()}
    assert lines["JUDGE", "helpfulness_mean"] == 2.0 and lines["REPLIES", "generated"] == 1.0


def test_dashboard(spark, results):
    got = {r.section: json.loads(r.payload_json) for r in reports.dashboard(results).collect()}
    assert tuple(sorted(got)) == tuple(sorted(reports.SECTIONS))
    assert got["executive_summary"]["agent_accuracy"] == 66.67
    assert got["safety_failures"]["total"] == 2
    assert got["safety_failures"]["false_negatives"][0]["case_id"] == "#FN-001"
    assert got["failure_cases"]["total"] == 2 and got["failure_cases"]["cases"][0]["case_id"] == "Case 1"
    assert got["rag_evidence"] == {"rag_examples": []}
    assert got["class_wise"]["total_classes"] == 4
    assert got["intent_distribution"]["values"] == [1, 1, 1]
    cells = {(c["true_label"], c["pred_label"]): c["n"] for c in got["confusion_matrices"]["cells"] if c["field"] == "escalation"}
    assert cells == {("escalate", "auto-reply"): 1, ("auto-reply", "escalate"): 1, ("escalate", "escalate"): 0, ("auto-reply", "auto-reply"): 0}


def test_dashboard_sections_can_be_chosen(results):
    got = reports.dashboard(results, ["judge_scores", "accuracy_comparison"]).collect()
    assert [r.section for r in got] == ["judge_scores", "accuracy_comparison"]
    with pytest.raises(ValueError, match="unknown"):
        reports.dashboard(results, ["nothing"])


def test_reports_on_an_empty_table(spark):
    empty = spark.createDataFrame([], RESULTS)
    row = reports.executive_summary(empty).first()
    assert (row.agent_accuracy, row.majority_accuracy, row.total) == (0.0, 0.0, 0)
    assert reports.safety_failures(empty).count() == 0
    assert reports.dashboard(empty).count() == len(reports.SECTIONS)
    assert reports.evaluation_report(empty).count() > 0


def test_results_are_the_same_for_any_partitioning(spark, results):
    big = results.join(spark.range(50).drop("id").withColumn("_", F.lit(1)), how="cross").drop("_")
    one = reports.evaluation_report(big.coalesce(1)).orderBy("section", "name").collect()
    many = reports.evaluation_report(big.repartition(7)).orderBy("section", "name").collect()
    assert one == many
