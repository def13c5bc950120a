"""Reports over results that arrive in batches, from counts kept per batch.

Everything a scorecard holds can be added up, so each stored batch gets a card of its own once, and the
card of all results is the sum of the cards. A report reads the results of new batches only; a
merged directory gets the sum of the cards it replaces.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.plans.reports import scorecard
from casework.sources import files
from casework.streaming import batches

LABELS = ("true_label", "pred_label")


def added(cards: DataFrame) -> DataFrame:
    """One card from the rows of several."""
    sums = [F.sum(c).alias(c) for c in cards.columns if c not in LABELS]
    return cards.groupBy(*LABELS).agg(*sums)


def refresh(spark: SparkSession, results: str, cards: str, schema, normalize: bool = True) -> list:
    """Make the cards that the table of batches ``results`` lacks under ``cards``; returns the (run, batch id)
    whose rows were read. A card is written as its batch is, so a repeated or broken refresh does no harm."""
    known, read = set(_known(spark, cards)), []
    replaced = batches.merged(spark, results)
    for place in batches.live(spark, results):
        if place in known:
            continue
        parts = replaced.get(place[0], [])
        if parts and set(parts) <= known:
            card = added(_cards(spark, cards, parts))
        else:
            card = scorecard(batches.read(spark, results, schema, [place]), normalize)
            read.append(place)
        batches.write(card.coalesce(1), cards, place)
    return read


def _known(spark: SparkSession, cards: str) -> list:
    return [p for p in batches.listed(spark, cards) if files.exists(spark, f"{cards}/{batches.place_name(p)}/_SUCCESS")]


def _cards(spark: SparkSession, cards: str, places: list) -> DataFrame:
    paths = [f"{cards}/{batches.place_name(p)}" for p in places]
    return spark.read.parquet(*paths)


def card(spark: SparkSession, results: str, cards: str, schema, normalize: bool = True) -> DataFrame:
    """The scorecard of all results in a table of batches, for any report that takes one."""
    refresh(spark, results, cards, schema, normalize)
    places = batches.live(spark, results)
    if not places:
        return scorecard(spark.createDataFrame([], schema), normalize)
    return added(_cards(spark, cards, places))
