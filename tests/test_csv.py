"""Files with quoted line breaks, cut at every possible place."""

import csv
import random

import pytest

from casework.sources.csv import read_csv
from casework.sources.tables import read_tweets

OPTIONS = {"header": True, "escape": '"', "multiLine": True}


def save(path, rows, end="\n", name="a.csv", header=("id", "text", "more")):
    path.mkdir(exist_ok=True)
    with open(path / name, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerows([header, *rows])


def awkward(n, seed=0):
    rng = random.Random(seed)
    texts = ["plain", 'a "quoted" word', "one\ntwo", "\n\n", 'ends with "', '"', "comma, and\n\"both\"\n", "é" * 9, "", " x ", "l\n" * 30]
    return [(str(i), rng.choice(texts), rng.choice(["", "z", "1\n2"])) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("split", [7, 64, 333, 10**6])
def test_same_rows_as_one_task_a_file(spark, tmp_path, split):
    for i in range(3):
        save(tmp_path / "in", awkward(25, i), name=f"{i}.csv")
    path = str(tmp_path / "in")
    want = rows(spark.read.options(**OPTIONS).csv(path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = read_csv(spark, path)
        assert rows(df) == want and df.columns == ["id", "text", "more"]
        # Several byte ranges: nearly every one begins or ends inside quotes.
        if split < 1000:
            assert spark.read.text(path).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_one_record_over_many_ranges(spark, tmp_path):
    save(tmp_path / "in", [("1", "line\n" * 500, "a"), ("2", "b", "c")])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
        got = rows(read_csv(spark, str(tmp_path / "in")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("1", "line\n" * 500, "a"), ("2", "b", "c")]


def test_carriage_returns_and_empty_files(spark, tmp_path):
    save(tmp_path / "in", [("1", "a", "b"), ("2", "c", "d")], end="\r\n")
    assert rows(read_csv(spark, str(tmp_path / "in"))) == [("1", "a", "b"), ("2", "c", "d")]
    save(tmp_path / "none", [])
    assert rows(read_csv(spark, str(tmp_path / "none"))) == []


def test_another_header_fails(spark, tmp_path):
    save(tmp_path / "in", [("1", "a", "b")])
    save(tmp_path / "in", [("1", "a", "b")], name="b.csv", header=("id", "other", "more"))
    with pytest.raises(Exception, match="another header"):
        read_csv(spark, str(tmp_path / "in")).collect()


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path):
    texts = ["hello\nworld"] * 400
    save(tmp_path / "in", [(f"{i}.0", "u", t, "") for i, t in enumerate(texts)], header=("tweet_id", "author_id", "text", "in_response_to_tweet_id"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
        df = read_tweets(spark, str(tmp_path / "in"))
        assert sorted(tuple(r) for r in df.select("tweet_id", "text").collect()) == list(enumerate(texts))
        assert df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
