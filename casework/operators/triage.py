"""From messages to decisions and replies, and the bookkeeping of an evaluation run."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions import prompts, rules, terms
from casework.functions.answers import parse_answers
from casework.functions.text import clip_reply, flag, has_reply, message_status, strip
from casework.operators.retrieve import retrieved_cases
from casework.operators.seeded import first_per_key, seeded_sample
from casework.sources.schemas import JUDGE_COLUMNS
from casework.sources.tables import add_missing, with_thread_id


def checked_messages(messages: DataFrame, limit: int | None = terms.MAX_MESSAGE_CHARS) -> DataFrame:
    """Add ``message_status`` and strip the text; nothing is dropped here.

    The limit of length is one of arriving messages; rows to evaluate have none.
    """
    return messages.withColumns(
        {"message_status": message_status("customer_text", limit), "customer_text": strip("customer_text")}
    )


def valid_messages(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("message_status") == "ok").drop("message_status")


def rejected_messages(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("message_status") != "ok")


def with_signals(messages: DataFrame) -> DataFrame:
    return messages.withColumn("signals", rules.signals("customer_text"))


def classification_requests(messages: DataFrame, template: str, signals: str | None = None) -> DataFrame:
    """Rows (id, kind, prompt), one per valid message; ``signals`` names a column that has its signals already."""
    prompt = prompts.classification_request("customer_text", signals or "signals", template)
    return (with_signals(messages) if signals is None else messages).select(
        F.col("thread_id").cast("string").alias("id"),
        F.lit("classify").alias("kind"),
        prompt.alias("prompt"),
    )


def reply_requests(handled: DataFrame, examples: DataFrame | None, template: str) -> DataFrame:
    """Rows (id, kind, prompt); ``examples`` has (q, examples) from ``retrieved_cases``."""
    rows = handled.withColumn("id", F.col("thread_id").cast("string"))
    if examples is None:
        rows = rows.withColumn(
            "examples",
            F.lit(None).cast("array<struct<customer_issue:string,agent_reply:string>>"),
        )
    else:
        rows = rows.join(
            examples.select(F.col("q").cast("string").alias("id"), "examples"), "id", "left"
        )
    prompt = prompts.reply_request("customer_text", "examples", template)
    return rows.select("id", F.lit("reply").alias("kind"), prompt.alias("prompt"))


def judge_requests(sampled: DataFrame, template: str) -> DataFrame:
    prompt = prompts.judge_request("customer_text", "drafted_reply", template)
    return sampled.select(
        F.col("thread_id").cast("string").alias("id"),
        F.lit("judge").alias("kind"),
        prompt.alias("prompt"),
    )


def score_batches(
    requests: DataFrame, scorer, batch_rows: int = 200, partitions: int | None = None
) -> DataFrame:
    """Answer request rows (id, prompt) with a caller's batch function.

    ``scorer`` maps a list of prompts to as many answers; an answer may be an exception. One
    answer row (id, answer, error) comes back per request, failures included, so nothing is
    lost. Retries and pacing belong to the scorer. A lost executor repeats its partitions:
    write the answers to a table before using them twice. ``partitions`` spreads the requests
    of a few input files over that many parallel callers. A request without a prompt is a failure
    of its own and is not sent.
    """
    requests = requests.select("id", "prompt")
    if partitions is not None:
        requests = requests.repartition(partitions)

    def answer(frames):
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                part = frame.iloc[at : at + batch_rows]
                sent = part["prompt"].notna()
                prompts = part["prompt"][sent].tolist()
                try:
                    found = list(scorer(prompts)) if prompts else []
                    if len(found) != len(prompts):
                        raise ValueError(f"{len(found)} answers to {len(prompts)} requests")
                except Exception as e:
                    found = [e] * len(prompts)
                rest = iter(found)
                given = [next(rest) if there else ValueError("no prompt") for there in sent]
                failed = [isinstance(g, Exception) for g in given]
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "answer": [None if bad else g for g, bad in zip(given, failed)],
                        "error": [str(g) if bad else None for g, bad in zip(given, failed)],
                    }
                )

    return requests.mapInPandas(answer, "id string, answer string, error string")


def decide(
    rows: DataFrame, threshold: float = terms.CONFIDENCE_THRESHOLD, signals: str | None = None
) -> DataFrame:
    """Rows with ``customer_text`` and a parsed ``analysis`` get overrides and ``status``.

    The signals are plain columns here: Catalyst would copy the fields of a struct, and with
    them all term tests, into every expression that reads one. ``signals`` names a stored column that has them.
    """
    found = rules.signal_columns("customer_text")
    if signals is not None:
        found = {name: F.col(signals)[name] for name in found}
    flat = rows.withColumns({f"_{name}": c for name, c in found.items()})
    signals = F.struct(*[F.col(f"_{name}").alias(name) for name in found])
    overridden = flat.withColumn("analysis", rules.apply_overrides("analysis", signals))
    return overridden.withColumn("status", rules.gate("analysis", threshold)).drop(
        *[f"_{name}" for name in found]
    )


def _one_answer(answers: DataFrame) -> DataFrame:
    """One answer per id, usable ones first, so that repeated ids never multiply in a join."""
    rows = answers.select(F.col("id").cast("string").alias("thread_id"), "answer", "error")
    return first_per_key(rows, ["thread_id"], [F.col("answer").isNull(), "answer", "error"])


def one_per_thread(messages: DataFrame) -> DataFrame:
    """One row per thread id: a thread with several replies is asked about once."""
    text = F.md5(F.coalesce("customer_text", F.lit("")))
    return first_per_key(with_thread_id(messages), ["thread_id"], [text])


def triage_batch(
    messages: DataFrame, answers: DataFrame, neighbours: DataFrame | None = None,
    replies: DataFrame | None = None, threshold: float = terms.CONFIDENCE_THRESHOLD, signals: str | None = None,
) -> DataFrame:
    """Decide a whole table: (thread_id, customer_text, status, analysis, reply,
    retrieved_examples, error).

    ``messages`` are valid messages, ``answers`` (id, answer, error) classifier answers,
    ``neighbours`` (q, n, rk) the past issues of auto-handled messages and ``replies`` (id,
    answer) their drafted texts. A message without a usable answer has an error and no status.
    Escalated messages have neither reply nor retrieved examples. ``signals`` names a column of
    ``messages`` that has their signals already.
    """
    messages = with_thread_id(messages)
    given = _one_answer(answers).withColumnRenamed("error", "failure")
    parsed = parse_answers(messages.join(given, "thread_id", "left"))
    reason = F.coalesce("failure", "error")
    rows = decide(
        parsed.withColumn("error", reason).withColumn(
            "analysis", F.when(reason.isNull(), F.col("analysis"))
        ),
        threshold, signals,
    )
    failed = F.col("error").isNotNull()
    rows = rows.withColumns(
        {
            "status": F.when(~failed, F.col("status")),
            "analysis": F.when(~failed, F.col("analysis")),
        }
    )
    handled = F.col("status") == terms.AUTO_HANDLED
    count, text = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    if neighbours is not None:
        found = neighbours.groupBy(F.col("q").cast("string").alias("thread_id")).agg(
            F.count("*").alias("_found")
        )
        rows, count = rows.join(found, "thread_id", "left"), F.coalesce("_found", count)
    if replies is not None:
        drafted = _one_answer(replies).select("thread_id", F.col("answer").alias("_reply"))
        rows, text = rows.join(drafted, "thread_id", "left"), clip_reply("_reply")
    return rows.select(
        "thread_id",
        "customer_text",
        "status",
        "analysis",
        F.when(handled, text).alias("reply"),
        F.when(handled, count).alias("retrieved_examples"),
        "error",
    )


def triage_replies(decided: DataFrame, neighbours: DataFrame, kb: DataFrame, template: str) -> DataFrame:
    """Reply requests of the auto-handled messages, grounded in their past cases."""
    handled = decided.filter(F.col("status") == terms.AUTO_HANDLED)
    return reply_requests(handled, retrieved_cases(neighbours, kb), template)


def pending(golden: DataFrame, done: DataFrame) -> DataFrame:
    """Golden rows whose id has no result yet."""
    finished = done.select(F.col("thread_id").cast("string").alias("thread_id")).distinct()
    return with_thread_id(golden).join(finished, "thread_id", "left_anti")


def append_results(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Results by column name; judge columns a side lacks are null."""
    both = previous.unionByName(new, allowMissingColumns=True)
    return add_missing(both, JUDGE_COLUMNS)


def evaluation_rows(decided: DataFrame, golden: DataFrame) -> DataFrame:
    """One result per golden row of each decided id; ids with an error stay pending.

    An unlabelled row keeps a null truth instead of counting as "no escalation".
    """
    labelled = F.col("should_escalate").isNotNull()
    truth = with_thread_id(golden).select(
        "thread_id", "true_intent",
        F.when(labelled, flag(golden, "should_escalate")).alias("true_escalate"),
    )
    a = F.col("analysis")
    # An inner join, so that a thread with very many golden rows can be split.
    rows = truth.join(decided.filter(F.col("error").isNull()), "thread_id", "inner")
    return add_missing(
        rows.select(
            "thread_id",
            "customer_text",
            strip("true_intent").alias("true_intent"),
            a["intent"].alias("pred_intent"),
            a["confidence_score"].alias("confidence_score"),
            "true_escalate",
            (F.col("status") == terms.ESCALATED).alias("pred_escalate"),
            F.col("status").alias("agent_status"),
            a["escalation_reason"].alias("escalation_reason"),
            F.col("reply").alias("drafted_reply"),
            F.coalesce("retrieved_examples", F.lit(0)).alias("retrieved_examples"),
        ),
        JUDGE_COLUMNS,
    )


def judge_sample(
    results: DataFrame, n: int = terms.JUDGE_ROWS, seed: int = terms.EXTRACT_SEED
) -> DataFrame:
    """Up to n threads with a reply that has no judge score yet, one row each."""
    results = add_missing(results, JUDGE_COLUMNS)
    open_rows = results.filter(has_reply("drafted_reply") & F.col("judge_tone").isNull())
    one = first_per_key(open_rows, ["thread_id"], [F.md5("drafted_reply")])
    return seeded_sample(one, n, "thread_id", seed)


def apply_judgements(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Write new scores (thread_id and any judge columns) over the old ones. Of several scores
    of one id the first non-null in column order counts, so no row is multiplied."""
    results = add_missing(results, JUDGE_COLUMNS)
    brought = [c for c in JUDGE_COLUMNS if c in scores.columns]
    one = first_per_key(scores, ["thread_id"], [F.col(c).asc_nulls_last() for c in brought])
    new = one.select("thread_id", *[F.col(c).alias(f"_{c}") for c in brought])
    merged = results.join(new, "thread_id", "left")
    return merged.select(
        *[
            F.coalesce(F.col(f"_{c}").cast(results.schema[c].dataType), F.col(c)).alias(c)
            if c in brought else c
            for c in results.columns
        ]
    )
