"""Labels from a stream in any order of delivery."""

import itertools
import random

import pytest

from casework.operators import labels
from casework.streaming import batches, streams
from casework.streaming import labels as label_streams

SCHEMA = "thread_id bigint, seq bigint, code string, escalate string, reason string"


def events(n=120):
    rng = random.Random(4)
    return [
        (rng.randint(1, 15), i, rng.choice(["1", "2", "7", "8", None]), rng.choice(["y", "N", None]), rng.choice(["a", None]))
        for i in range(n)
    ]


def deliver(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, folder, ttl=None):
    source = streams.read_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    started = label_streams.label_stream(source, f"{folder}/out", f"{folder}/state", ttl)
    started.awaitTermination()
    assert started.exception() is None


def labelled(spark, log):
    golden = spark.range(20).selectExpr("CAST(id AS STRING) AS thread_id")
    return sorted(map(str, labels.apply_labels(golden, log).collect()))


@pytest.mark.parametrize("order", ["as written", "backwards", "shuffled and repeated"])
def test_any_delivery_order_gives_the_same_labels(spark, tmp_path, order):
    log = events()
    sent = list(log)
    if order == "backwards":
        sent.reverse()
    elif order != "as written":
        random.Random(9).shuffle(sent)
        sent += sent[:40]
    for part in itertools.batched(sent, 45):
        deliver(spark, list(part), f"{tmp_path}/in")
        run(spark, tmp_path)
    want = labelled(spark, spark.createDataFrame(log, SCHEMA).selectExpr("CAST(thread_id AS STRING) AS thread_id", "seq", "code", "escalate", "reason"))
    assert labelled(spark, label_streams.current(spark, f"{tmp_path}/out")) == want
    run(spark, tmp_path)  # nothing new
    assert labelled(spark, label_streams.current(spark, f"{tmp_path}/out")) == want


def test_late_events_after_expiry_lose_by_their_number(spark, tmp_path):
    deliver(spark, [(1, 10, "1", "y", "new"), (2, 5, "2", "n", None)], f"{tmp_path}/in")
    run(spark, tmp_path, ttl=1)
    deliver(spark, [(1, 3, "2", "n", "old")], f"{tmp_path}/in")
    run(spark, tmp_path, ttl=1)
    got = {r.thread_id: (r.seq, r.code) for r in label_streams.current(spark, f"{tmp_path}/out").collect()}
    assert got == {"1": (10, "1"), "2": (5, "2")}
    assert batches.read(spark, f"{tmp_path}/out", label_streams.EVENTS).count() == 3  # the late one was written, and lost


def test_without_expiry_late_events_are_not_even_written(spark, tmp_path):
    deliver(spark, [(1, 10, "1", "y", "new"), (None, 1, "1", "y", "x"), (4, None, "1", "y", "x"), (5, 1, "9", "y", "x")], f"{tmp_path}/in")
    run(spark, tmp_path)
    deliver(spark, [(1, 3, "2", "n", "old"), (1, 10, "1", "y", "new")], f"{tmp_path}/in")
    run(spark, tmp_path)
    rows = batches.read(spark, f"{tmp_path}/out", label_streams.EVENTS).collect()
    assert [(r.thread_id, r.seq) for r in rows] == [("1", 10)]


def test_the_session_keeps_its_settings(spark, tmp_path):
    before = {key: spark.conf.get(key, None) for key in label_streams.SETTINGS}
    deliver(spark, [(1, 10, "1", "y", "new")], f"{tmp_path}/in")
    run(spark, tmp_path)
    assert {key: spark.conf.get(key, None) for key in label_streams.SETTINGS} == before


def test_events_are_read_without_operations_on_frames(monkeypatch):
    import pandas as pd

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    frame = pd.DataFrame([["t", 3, "1", None, "a"], ["t", 9, "2", float("nan"), None], ["t", 5, "7", "y", "b"]], columns=["thread_id", *label_streams.EVENT])
    for name in ("astype", "where", "itertuples"):
        monkeypatch.setattr(pd.DataFrame, name, lambda *a, **k: 1 / 0)
    latest = label_streams.LatestLabel(None)
    latest.newest = State()
    out = list(latest.handleInputRows(("t",), [frame], None))
    assert latest.newest.value == (9, "2", None, None) and len(out) == 1
    assert list(latest.handleInputRows(("t",), [frame], None)) == []
