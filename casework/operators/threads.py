"""Messages and replies to question / answer threads, and the checks on their split."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions import terms
from casework.functions.text import min_length, normalize_label
from casework.operators.seeded import first_per_key, seeded_sample


def brand_replies(tweets: DataFrame, brand: str) -> DataFrame:
    """Messages the brand wrote in reply to something."""
    return tweets.filter(
        (F.col("author_id") == brand) & F.col("in_response_to_tweet_id").isNotNull()
    )


def reply_parents(tweets: DataFrame, replies: DataFrame) -> DataFrame:
    """Messages that at least one of the replies answers.

    A semi join cannot split a hot key of its right side; distinct ids, combined before the
    shuffle, have none.
    """
    answered = replies.select(F.col("in_response_to_tweet_id").alias("tweet_id")).distinct()
    return tweets.join(answered, "tweet_id", "left_semi")


def pair_threads(
    tweets: DataFrame, replies: DataFrame, min_chars: int = terms.MIN_TWEET_CHARS
) -> DataFrame:
    """One row per reply: customer message, its id as ``thread_id``, and the reply.

    Message ids are unique, so a much-answered message is skewed on the reply side only, which
    adaptive execution splits; the output needs no partitioning of its own.
    """
    return _pairs(tweets, replies, min_chars).drop("reply_id")


def _pairs(tweets: DataFrame, replies: DataFrame, min_chars: int) -> DataFrame:
    c = tweets.filter(min_length("text", min_chars)).select(
        F.col("tweet_id").alias("thread_id"), F.col("text").alias("customer_text")
    )
    r = replies.select(
        F.col("in_response_to_tweet_id").alias("thread_id"),
        F.col("text").alias("agent_text"),
        F.col("tweet_id").alias("reply_id"),
    )
    return c.join(r, "thread_id", "inner").select(
        "thread_id", "customer_text", "agent_text", "reply_id"
    )


def extract_threads(
    tweets: DataFrame,
    brand: str,
    replies: int | None = None,
    threads: int | None = None,
    seed: int = terms.EXTRACT_SEED,
) -> DataFrame:
    """Raw messages to threads: all of them, or seeded samples of replies and of threads.

    Both samples draw by reply id, which is unique: drawn by thread id a much-answered message
    would come in whole or not at all.
    """
    answers = brand_replies(tweets, brand)
    if replies is not None:
        answers = seeded_sample(answers, replies, "tweet_id", seed)
    paired = _pairs(tweets, answers, terms.MIN_TWEET_CHARS)
    if threads is not None:
        paired = seeded_sample(paired, threads, "reply_id", seed)
    return paired.drop("reply_id")


def leakage_audit(
    df: DataFrame, by: str = "thread_id", text: str = "customer_text", split: str = "split"
) -> DataFrame:
    """Number of golden rows whose id, or whose normalised text, also occurs outside golden.

    One aggregation finds both: counts per id and per text are combined before the shuffle, so
    a text with a third of all rows moves as one row per map task, and no rows are paired.
    """
    keys = F.array(
        F.struct(F.lit("id").alias("kind"), F.col(by).cast("string").alias("key")),
        F.struct(F.lit("text").alias("kind"), F.md5(normalize_label(text)).alias("key")),
    )
    golden = F.col(split) == "golden"
    sides = (
        df.select(golden.alias("golden"), F.explode(keys).alias("k"))
        .groupBy("k.kind", "k.key")
        .agg(F.count_if("golden").alias("inside"), F.count_if(~F.col("golden")).alias("outside"))
    )
    leaked = F.when((F.col("outside") > 0) & F.col("key").isNotNull(), F.col("inside"))
    return sides.groupBy("kind").agg(F.coalesce(F.sum(leaked), F.lit(0)).alias("n"))


def build_knowledge_base(threads: DataFrame) -> DataFrame:
    """One row per id: question as document (null becomes empty), answer kept as it is.

    Of several answers to one id the one with the lowest md5 stays, null last.
    """
    one = first_per_key(
        threads, ["thread_id"],
        [F.md5("agent_text").asc_nulls_last(), F.md5("customer_text").asc_nulls_last()],
    )
    return one.select(
        F.col("thread_id").cast("string").alias("id"),
        F.coalesce("customer_text", F.lit("")).alias("document"),
        F.col("agent_text").alias("agent_reply"),
    )

