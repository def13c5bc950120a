"""The two end-to-end workflows. These functions write tables and therefore run jobs."""

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.functions import terms
from casework.functions.answers import parse_answers, parse_judgements
from casework.functions.prompts import Templates
from casework.functions.text import has_reply
from casework.operators import triage
from casework.operators.numbering import Placed
from casework.operators.seeded import golden_split
from casework.operators.threads import build_knowledge_base, extract_threads, leakage_audit
from casework.sources import schemas, versions
from casework.sources.tables import (
    add_missing, append_table, coverage, read_table, require_columns, shared_folder, stored, write_counted,
    write_knowledge_base, write_split, write_table,
)


#: Tasks of one job that asks; as many batches have a task each before any share one.
MAX_TASKS = 1_000
#: Requests of batches that share a task, as many as Spark hands to Python at once by default.
MAX_REQUESTS = 10_000
#: Batches share a task if the job before did them in that time.
TASK_SECONDS = 1.0


@dataclass(frozen=True)
class Prepared:
    golden: DataFrame
    knowledge_base: DataFrame
    leaks: DataFrame


def prepare(
    tweets: DataFrame, brand: str, path: str, replies: int | None = None,
    threads: int | None = None, golden: int = terms.GOLDEN_ROWS,
) -> Prepared:
    """Raw messages to stored threads, their split and the knowledge base, under ``path``.

    Threads and split are written anew; a knowledge base that is already there is kept, so
    ``leaks`` compares the golden rows with what the base really holds.
    """
    spark = tweets.sparkSession
    require_columns(tweets, schemas.TWEETS.names)
    write_table(extract_threads(tweets, brand, replies, threads), f"{path}/threads", "overwrite")
    write_split(golden_split(spark.read.parquet(f"{path}/threads"), golden), f"{path}/split")
    split = spark.read.parquet(f"{path}/split")
    kb = build_knowledge_base(split.filter(F.col("split") == "kb"))
    write_knowledge_base(kb, f"{path}/knowledge_base")
    rows = split.filter(F.col("split") == "golden").drop("split")
    base = spark.read.parquet(f"{path}/knowledge_base")
    return Prepared(add_missing(rows, schemas.LABEL_COLUMNS), base, base_leaks(rows, base))


def base_leaks(golden: DataFrame, kb: DataFrame) -> DataFrame:
    """Golden rows whose id or normalised text a knowledge base holds."""
    inside = golden.select(F.col("thread_id").cast("string").alias("thread_id"), "customer_text", F.lit("golden").alias("split"))
    outside = kb.select(F.col("id").alias("thread_id"), F.col("document").alias("customer_text"), F.lit("kb").alias("split"))
    return leakage_audit(inside.unionByName(outside))


def evaluate(
    spark: SparkSession, golden: DataFrame, classifier, templates: Templates, path: str, find=None,
    kb: DataFrame | None = None, writer=None, judge=None, batch_rows: int = 200, callers: int | None = None,
) -> DataFrame:
    """Score every golden row that has no result yet, append the results and return all of them.

    Texts of any length are scored. Rows without a text go to ``path/rejects`` with the reason
    and stay pending, rows without a usable answer to ``path/failures`` with the error; both tables are of the last run.
    ``path/runs`` gets a row with the numbers of each run, counted while the tables are written.

    ``classifier``, ``writer`` and ``judge`` are batch functions as for ``score_batches``;
    ``find`` maps the auto-handled rows to their past issues (q, n, rk) in ``kb``, so escalated
    messages are never searched for. Answers are appended to tables before they are used, a batch of
    ``batch_rows`` for each of ``callers`` tasks (by default as many as run at once) at a time, of quick batches as many
    as take a second (``Asking``): a run that breaks off, however, loses at most what each task was at, and the next
    one asks only what has no usable answer. Judgements are appended to a table of
    their own, so each run judges replies that no run has judged; results come back with all scores.
    """
    ask = Asking(batch_rows, callers or spark.sparkContext.defaultParallelism)
    require_columns(golden, schemas.REQUIRED["golden"])
    results, answers = f"{path}/results", f"{path}/answers"
    done = read_table(spark, results, schemas.RESULTS)
    open_rows = triage.one_per_thread(triage.pending(golden, done).select("thread_id", "customer_text"))
    checked = stored(triage.with_signals(triage.checked_messages(open_rows, limit=None)), "messages")
    messages = triage.valid_messages(checked)
    rejects = triage.rejected_messages(checked).select("thread_id", F.col("message_status").alias("reason"))
    rejected = write_counted(rejects, lambda df: write_table(df, f"{path}/rejects", "overwrite"))["rows"]

    requests = triage.classification_requests(messages, templates.classify, "signals")
    given = ask(requests, classifier, f"{answers}/classify", _parsed)
    decided, neighbours = triage.triage_batch(messages, given, signals="signals"), None
    handled = decided.filter(F.col("status") == terms.AUTO_HANDLED)
    if find is not None:
        write_table(find(handled), f"{answers}/neighbours", "overwrite")
        neighbours = spark.read.parquet(f"{answers}/neighbours")
    drafted = None
    if writer is not None:
        if neighbours is None or kb is None:
            requests = triage.reply_requests(handled, None, templates.reply)
        else:
            requests = triage.triage_replies(decided, neighbours, kb, templates.reply)
        drafted = ask(requests, writer, f"{answers}/reply", _written)
    decided = triage.triage_batch(messages, given, neighbours, drafted, signals="signals")
    errors = _one_error(read_table(spark, f"{answers}/classify", schemas.ANSWERS))
    failed = _unanswered(messages, given).join(errors, "thread_id", "left")
    failed = failed.select("thread_id", F.coalesce("_said", "error").alias("error"))
    failures = write_counted(failed, lambda df: write_table(df, f"{path}/failures", "overwrite"))["rows"]
    rows = triage.evaluation_rows(decided, golden).select(schemas.RESULTS.names)
    found = write_counted(rows, lambda df: append_table(df, results), **coverage())
    append_table(run_row(spark, found, rejected, failures), f"{path}/runs")
    if judge is not None:
        run_judge(read_table(spark, results, schemas.RESULTS), judge, templates.judge, path)
    return evaluated(spark, path)


def run_row(spark: SparkSession, found: dict, rejects: int, failures: int) -> DataFrame:
    """One row of ``schemas.RUNS``."""
    counts = {"results": found["rows"], **found, "rejects": rejects, "failures": failures}
    return spark.createDataFrame([tuple(counts[c] for c in schemas.RUNS.names)], schemas.RUNS)


def evaluated(spark: SparkSession, path: str) -> DataFrame:
    """All stored results with all stored judgements."""
    results = read_table(spark, f"{path}/results", schemas.RESULTS)
    return triage.apply_judgements(results, read_table(spark, f"{path}/judgements", schemas.JUDGEMENTS))


def publish(spark: SparkSession, path: str) -> int:
    """Make a version of the results with their judgements in ``path/judged``; returns its number.

    Readers (``versions.read``) see the table before or after, never half of it. Of two that publish at
    once the second raises ``versions.Outdated`` and leaves the table as it is.
    """
    table = f"{path}/judged"
    based_on = versions.latest(spark, table)
    return versions.replace(evaluated(spark, path), table, based_on)


def _parsed(answers: DataFrame) -> DataFrame:
    return parse_answers(answers.drop("error")).filter(F.col("error").isNull()).select("id", "answer", "error")


def _written(answers: DataFrame) -> DataFrame:
    return answers.filter(has_reply("answer"))


def _unanswered(messages: DataFrame, usable: DataFrame) -> DataFrame:
    """(thread_id, error) of the messages without a usable answer: what ``triage_batch`` says where there is none."""
    rest = messages.join(usable.select(F.col("id").alias("thread_id")), "thread_id", "left_anti")
    return triage.triage_batch(rest, usable.limit(0), signals="signals").select("thread_id", "error")


def _one_error(answers: DataFrame) -> DataFrame:
    """What was wrong with the unusable answers of each request; the greatest text of several."""
    parsed = parse_answers(answers.withColumnRenamed("error", "_failure")).filter(F.col("error").isNotNull())
    said = parsed.groupBy(F.col("id").alias("thread_id"))
    return said.agg(F.max(F.coalesce("_failure", "error")).alias("_said"))


@dataclass(frozen=True)
class Asking:
    """Puts requests to a batch function; what is answered is stored task by task.

    The open requests are written once and dealt into batches. Of the first ``MAX_TASKS`` batches each is a task of its
    own; after that a task has as many as one did in ``TASK_SECONDS`` in the job before, or one if that takes longer,
    but no more than ``MAX_REQUESTS`` requests. Where ``callers`` are no fewer than run at once, a job has up to
    ``MAX_TASKS`` tasks, whose answers take their place as soon as the task ends (version 2 of the file committer), also
    if the job fails later. Fewer callers get a job for every ``callers`` tasks. What was stored is never asked for
    again, whether an executor, the scorer or the driver dies.
    """

    batch_rows: int
    callers: int

    def __call__(self, requests: DataFrame, scorer, path: str, usable) -> DataFrame:
        """Usable answers to the requests; only those without one are asked for."""
        spark = requests.sparkSession
        have = usable(read_table(spark, path, schemas.ANSWERS)).select("id").distinct()
        open_ = Placed(requests.join(have, "id", "left_anti").select("id", "prompt"), lambda df: stored(df, "requests"))
        batches = -(-open_.rows // self.batch_rows)
        running = spark.sparkContext.defaultParallelism
        at_once, running = (MAX_TASKS, running) if self.callers >= running else (self.callers, self.callers)
        first, each = 0, 1
        while first < batches:
            # Job by job, the batches from ``first`` on, ``each`` to a task.
            tasks = min(at_once, -(-(batches - first) // each))
            some = open_.between(first * self.batch_rows, (first + tasks * each) * self.batch_rows)
            task = F.expr(f"(number - {first * self.batch_rows}) div {each * self.batch_rows}").cast("int")
            started = time.monotonic()
            self.save(some.repartitionById(tasks, task), scorer, path)
            took = (time.monotonic() - started) * min(running, tasks) / tasks / each
            first += tasks * each
            if first >= MAX_TASKS:
                most = min(MAX_REQUESTS // self.batch_rows, (batches - first) // running)
                each = max(1, min(int(TASK_SECONDS / took), most))
        return usable(read_table(spark, path, schemas.ANSWERS))

    def save(self, requests: DataFrame, scorer, path: str) -> None:
        answers = triage.score_batches(requests, scorer, self.batch_rows)
        answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def run_judge(results: DataFrame, judge, template: str, path: str, n: int = terms.JUDGE_ROWS) -> DataFrame:
    """Judge a seeded sample of the replies that have no judgement yet and append the judgements.

    A call that fails leaves its thread open; an answer without usable scores does not.
    """
    spark = results.sparkSession
    done = read_table(spark, f"{path}/judgements", schemas.JUDGEMENTS)
    open_rows = triage.pending(results, done)
    requests = triage.judge_requests(triage.judge_sample(open_rows, n), template)
    write_table(triage.score_batches(requests, judge), f"{path}/answers/judge", "overwrite")
    given = spark.read.schema(schemas.ANSWERS).parquet(f"{path}/answers/judge").filter(F.col("error").isNull())
    scored = parse_judgements(given).select(
        F.col("id").alias("thread_id"),
        F.col("judgement.score_tone").alias("judge_tone"),
        F.col("judgement.score_grounding").alias("judge_grounding"),
        F.col("judgement.reasoning").alias("judge_reasoning"),
    )
    append_table(scored, f"{path}/judgements")
    return read_table(spark, f"{path}/judgements", schemas.JUDGEMENTS)
