"""Triage, evaluation and knowledge-base loading over streams.

Each micro-batch writes its own ``run=.../batch_id=N`` directory with overwrite, so a batch
replayed after a failure replaces its earlier output: together with the source's checkpoint every
input row takes effect exactly once. ``run`` is the id Spark keeps in the checkpoint; a stream
started on a new checkpoint counts its batches anew and must not touch older output. ``batches`` says
which directories a batch has to open, and merges small ones.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.operators import triage
from casework.operators.threads import build_knowledge_base
from casework.plans.workflow import run_row
from casework.sources import schemas
from casework.sources.tables import add_missing, coverage, write_counted
from casework.streaming import batches

#: Read what is there and stop. Give for example {"processingTime": "1 minute"} to keep running.
ALL_THEN_STOP = {"availableNow": True}


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None):
    """File stream over a Parquet table; ``path`` may be a directory or a single file."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(as_pattern(path))


def as_pattern(path: str) -> str:
    """The path as a pattern that matches nothing else: a plain path of a stream must be a
    directory, what a pattern matches may be a file too."""
    path = path.rstrip("/")
    escaped = re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
    return escaped if escaped.endswith("\\" + path[-1]) else f"{escaped[:-1]}[{path[-1]}]"


def _start(stream: DataFrame, each, checkpoint: str, trigger: dict, mode: str = "append"):
    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def _place(batch: DataFrame, checkpoint: str, batch_id: int) -> tuple:
    """(run, batch id) of a micro-batch."""
    return batch.sparkSession.read.json(f"{checkpoint}/metadata").first().id, batch_id


def _write(batch: DataFrame, path: str, place: tuple, id_column: str | None = None, **counts) -> dict:
    """Write a batch and return its ``rows`` and other counts."""
    return write_counted(batch, lambda df: batches.write(df, path, place, id_column), **counts)


def _earlier(path: str, place: tuple, column: str, ids: DataFrame) -> DataFrame:
    """Ids stored by those other batches that may hold one of ``ids``, by the batches' filters. A
    replayed batch does not see its own first output."""
    spark = ids.sparkSession
    places = batches.holding(spark, path, ids.select(column), besides=place)
    return batches.read(spark, path, f"{column} string", places)


def _unseen(batch: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """Batch rows whose id is not stored. The stored ids are first reduced to those of the
    batch, so the large side is filtered where it lies instead of being shuffled to sort."""
    ids = batch.select(column).distinct()
    known = stored.join(ids, column, "left_semi").distinct()
    return batch.join(known, column, "left_anti")


def triage_stream(messages: DataFrame, answer, out: str, checkpoint: str, trigger: dict = ALL_THEN_STOP):
    """Decide arriving messages; returns the started query.

    ``answer`` turns valid messages (thread_id, customer_text) into answers (id, answer,
    error), natively or with ``score_batches``. Decisions go to ``out/decisions``, invalid
    messages with their reason to ``out/rejects``, unanswered ones to ``out/failures``.
    """

    def each(batch: DataFrame, batch_id: int):
        place = _place(batch, checkpoint, batch_id)
        checked = _spread(triage.checked_messages(batch)).persist()
        try:
            _write(triage.rejected_messages(checked), f"{out}/rejects", place)
            _write_decided(triage.valid_messages(checked), answer, out, "decisions", place, _decisions)
        finally:
            checked.unpersist()

    return _start(messages, each, checkpoint, trigger)


def _spread(batch: DataFrame) -> DataFrame:
    """Rows of a few input files over all tasks, before the rules read their texts."""
    return batch.repartition(F.xxhash64("thread_id", F.length("customer_text")))


def _decisions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "thread_id",
        "status",
        F.col("analysis.intent").alias("intent"),
        F.col("analysis.confidence_score").alias("confidence_score"),
        F.col("analysis.escalation_reason").alias("reason"),
    )


def evaluate_stream(
    golden: DataFrame, answer, out: str, checkpoint: str, event_time: str | None = None,
    horizon: str = "30 days", trigger: dict = ALL_THEN_STOP,
):
    """Evaluate each id once however often it is delivered; returns the started query.

    Results, with the truth the golden rows bring, go to ``out/results``, rows without a text to
    ``out/rejects`` and rows without a usable answer to ``out/failures``; both kinds count as not
    evaluated when they are delivered again. ``out/runs`` gets the numbers of each batch. With ``event_time`` repeats within the
    horizon are dropped from state; the check against the stored results is exact without it and
    also survives a lost checkpoint.
    """
    if event_time is not None:
        golden = golden.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["thread_id"])

    def each(batch: DataFrame, batch_id: int):
        place = _place(batch, checkpoint, batch_id)
        once = triage.one_per_thread(add_missing(batch, schemas.LABEL_COLUMNS)).persist()
        done = _earlier(f"{out}/results", place, "thread_id", once)
        open_rows = triage.checked_messages(_unseen(once, done, "thread_id"), limit=None).persist()
        try:
            rejects = triage.rejected_messages(open_rows)
            rejects = rejects.select("thread_id", F.col("message_status").alias("reason"))
            rejected = _write(rejects, f"{out}/rejects", place)["rows"]

            def results(rows):
                return triage.evaluation_rows(rows, open_rows).select(schemas.RESULTS.names)

            found, failures = _write_decided(
                triage.valid_messages(open_rows), answer, out, "results", place, results, "thread_id", **coverage()
            )
            _write(run_row(batch.sparkSession, found, rejected, failures), f"{out}/runs", place)
        finally:
            open_rows.unpersist()
            once.unpersist()

    return _start(golden, each, checkpoint, trigger)


def _write_decided(
    messages: DataFrame, answer, out: str, good: str, place: tuple, shape, id_column=None, **counts
) -> tuple:
    """Answer and decide one batch; returns the counts of the decided rows and the number of failures.

    Answers are stored before use, so that a lost executor asks
    nobody twice; decisions are kept while two tables are written from them."""
    given = answer(messages).select(F.col("id").cast("string").alias("id"), "answer", "error")
    _write(given, f"{out}/answers", place)
    path = f"{out}/answers/run={place[0]}/batch_id={place[1]}"
    given = messages.sparkSession.read.schema(schemas.ANSWERS).parquet(path)
    rows = triage.triage_batch(messages, given).persist()
    try:
        found = _write(shape(rows.filter(F.col("error").isNull())), f"{out}/{good}", place, id_column, **counts)
        failed = rows.filter(F.col("error").isNotNull()).select("thread_id", "error")
        return found, _write(failed, f"{out}/failures", place)["rows"]
    finally:
        rows.unpersist()


def kb_stream(threads: DataFrame, out: str, checkpoint: str, trigger: dict = ALL_THEN_STOP):
    """Load arriving threads into the knowledge base, first id wins; returns the started query."""

    def each(batch: DataFrame, batch_id: int):
        place = _place(batch, checkpoint, batch_id)
        kb = build_knowledge_base(batch).persist()
        try:
            _write(_unseen(kb, _earlier(out, place, "id", kb), "id"), out, place, "id")
        finally:
            kb.unpersist()

    return _start(threads, each, checkpoint, trigger)
