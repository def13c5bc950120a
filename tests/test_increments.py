"""Reports from counts kept per batch."""

import pytest
from pyspark.sql import functions as F

from casework.plans import increments, reports
from casework.streaming import batches
from checks.views import frame
from tests.conftest import SF


@pytest.fixture(scope="module")
def results(spark):
    return frame(spark, SF, "eval_v").withColumn("thread_id", F.col("thread_id").cast("string")).cache()


def lines(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_the_report_after_every_batch_is_that_of_all_rows(spark, results, tmp_path):
    table, cards, parts = f"{tmp_path}/results", f"{tmp_path}/cards", 4
    for i in range(parts):
        batches.write(results.filter(F.col("thread_id").cast("int") % parts == i), table, ("r", i), "thread_id")
        assert increments.refresh(spark, table, cards, results.schema) == [("r", i)]  # only the new one is read
        card = increments.card(spark, table, cards, results.schema)
        so_far = results.filter(F.col("thread_id").cast("int") % parts <= i)
        assert lines(reports.evaluation_report(None, card)) == lines(reports.evaluation_report(so_far))
    assert increments.refresh(spark, table, cards, results.schema) == []

    batches.merge(spark, table, results.schema, "thread_id")
    assert increments.refresh(spark, table, cards, results.schema) == []  # the sum of the cards it replaces
    batches.clean(spark, table)
    card = increments.card(spark, table, cards, results.schema)
    assert lines(reports.evaluation_report(None, card)) == lines(reports.evaluation_report(results))
    assert not any("/results/" in f for f in card.inputFiles())
    assert lines(reports.executive_summary(None, card)) == lines(reports.executive_summary(results))


def test_a_merge_of_batches_without_cards_is_read(spark, results, tmp_path):
    table, cards = f"{tmp_path}/results", f"{tmp_path}/cards"
    for i in range(3):
        batches.write(results.limit(20 * i), table, ("r", i), "thread_id")
    batches.merge(spark, table, results.schema, "thread_id")
    assert len(increments.refresh(spark, table, cards, results.schema)) == 2


def test_no_batches_give_an_empty_card(spark, results, tmp_path):
    card = increments.card(spark, f"{tmp_path}/a", f"{tmp_path}/b", results.schema)
    assert card.columns == reports.scorecard(results).columns and card.count() == 0
