"""Hand labels that arrive as a stream, in any order.

The newest event of every thread is kept as state. An event changes a thread's label if its sequence number
is beyond that one, so late and repeated events do nothing. State of threads that nobody labels any
more expires; an event that comes after that is written once more and loses, by its number, to what is stored.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casework.operators import labels
from casework.sources.tables import require_columns
from casework.streaming import batches
from casework.streaming.streams import ALL_THEN_STOP, _place, _start

EVENT = ("seq", "code", "escalate", "reason")
EVENTS = "thread_id string, seq bigint, code string, escalate string, reason string"
STATE = "seq bigint, code string, escalate string, reason string"
#: What the query is started with: state that expires needs RocksDB, and while there is such state Spark would make
#: batches without data for ever, so a run over all there is would not end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _rank(event) -> tuple:
    """Order of events: by number, then as ``labels.latest_labels`` settles equal numbers."""
    return event[0], *[(v is not None, v or "") for v in event[1:]]


class LatestLabel(StatefulProcessor):
    """Keeps the newest valid event of a thread and gives it out when it changes."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        before = tuple(self.newest.get()) if self.newest.exists() else None
        best = before
        for frame in rows:
            # Plain lists: a frame holds the few rows of one thread, and operations on whole frames cost more than these.
            for values in zip(*[frame[c].tolist() for c in EVENT]):
                event = (int(values[0]), *[None if v is None or v != v else v for v in values[1:]])
                if best is None or _rank(event) > _rank(best):
                    best = event
        if best is not None and best != before:
            self.newest.update(best)
            yield pd.DataFrame([[key[0], *best]], columns=["thread_id", *EVENT])

    def close(self) -> None:
        pass


def label_stream(events: DataFrame, out: str, checkpoint: str, ttl: int | None = None, trigger: dict = ALL_THEN_STOP):
    """Write every change of a thread's newest label under ``out``; returns the started query.

    ``events`` has thread_id, seq, code, escalate and reason; those with an unknown code, without a number or
    without a thread are not labels. ``ttl`` is how many milliseconds a thread's state outlives its last change
    (None: for ever). State lies in RocksDB. ``current`` reads what is written.
    """
    require_columns(events, ["thread_id", *EVENT])
    typed = events.filter(labels.valid_label()).select(
        F.col("thread_id").cast("string").alias("thread_id"), F.col("seq").cast("bigint").alias("seq"), "code", "escalate", "reason"
    ).filter("thread_id IS NOT NULL AND seq IS NOT NULL")
    changes = typed.groupBy("thread_id").transformWithStateInPandas(
        LatestLabel(ttl), EVENTS, "Update", "ProcessingTime" if ttl is not None else "None"
    )

    def each(batch: DataFrame, batch_id: int):
        batches.write(batch, out, _place(batch, checkpoint, batch_id))

    with _settings(events.sparkSession):  # the started query has a copy of them
        return _start(changes, each, checkpoint, trigger, "update")


@contextmanager
def _settings(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    try:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest event of every thread, as a label log with one row each (see ``labels.apply_labels``)."""
    return labels.latest_labels(batches.read(spark, out, EVENTS))

