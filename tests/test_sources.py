import json

import pytest
from pyspark.sql import functions as F

from casework.plans import reports
from casework.sources import schemas, tables


def write(path, text):
    path.write_text(text, encoding="utf8")
    return str(path)


def test_read_tweets_with_quoted_line_breaks(spark, tmp_path):
    path = write(
        tmp_path / "tweets.csv",
        'tweet_id,author_id,inbound,text,in_response_to_tweet_id\n'
        '1,u1,True,"first line\nsecond ""quoted"" line, with comma",\n'
        '9007199254740993,Brand,False,NA,1.0\n'
        '1.23e18,Brand,False,None,x\n',
    )
    got = [tuple(r) for r in tables.read_tweets(spark, path).collect()]
    assert got == [
        (1, "u1", 'first line\nsecond "quoted" line, with comma', None),
        (9007199254740993, "Brand", "NA", 1),
        (1230000000000000000, "Brand", "None", None),
    ]


def test_read_tweets_needs_its_columns(spark, tmp_path):
    path = write(tmp_path / "t.csv", "tweet_id,text\n1,a\n")
    with pytest.raises(ValueError, match="author_id"):
        tables.read_tweets(spark, path)


def test_absent_table_is_empty_and_typed(spark, tmp_path):
    df = tables.read_table(spark, str(tmp_path / "none"), schemas.RESULTS)
    assert df.schema == schemas.RESULTS and df.count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_read_table_formats_and_limit(spark, tmp_path, fmt):
    df = spark.createDataFrame([("1", "q", "a"), ("2", None, 'say "hi"\nthere')], schemas.THREADS)
    tables.write_table(df, str(tmp_path / "t"), fmt=fmt)
    got = tables.read_table(spark, str(tmp_path / "t"), schemas.THREADS, fmt)
    assert sorted(got.collect()) == sorted(df.collect())
    assert tables.read_table(spark, str(tmp_path / "t"), schemas.THREADS, fmt, limit=1).count() == 1


def test_null_tokens_only_touch_the_named_columns(spark):
    df = spark.createDataFrame([("NA", "NA"), (" nan ", "None"), ("ok", "x"), (None, None)], "a string, b string")
    got = [tuple(r) for r in tables.null_tokens(df, "a").collect()]
    assert got == [(None, "NA"), (None, "None"), ("ok", "x"), (None, None)]


def test_foreign_result_csv_feeds_the_reports(spark, tmp_path):
    header = ",".join(schemas.RESULTS.names)
    path = write(
        tmp_path / "results.csv",
        header + "\n"
        '1,"my ""phone""\nwifi",device_connectivity,Device_Connectivity ,0.9,True,False,escalated,,NA,3.0,4.0,nan,\n'
        "2,NA,nan,other,,1,1,auto_handled,x,a reply,,,5,fine\n"
        "3,hi,other,general_inquiry,0.5,0.0,yes,escalated,,,0,,,\n",
    )
    raw = tables.read_table(spark, path, schemas.as_text(schemas.RESULTS), "csv")
    df = tables.null_tokens(raw, "true_intent", "pred_intent", "drafted_reply", "judge_grounding")
    row = reports.executive_summary(df).first()
    assert (row.total, row.intent_valid, row.esc_valid) == (3, 2, 3)
    assert (row.agent_accuracy, row.esc_recall, row.esc_precision) == (0.5, 0.5, 0.5)
    lines = {(r.section, r.name): r.value for r in reports.evaluation_report(df).collect()}
    assert lines["REPLIES", "generated"] == 1.0 and lines["RETRIEVAL", "average"] == 1.5
    assert lines["JUDGE", "tone_mean"] == 4.0 and lines["JUDGE", "grounding_mean"] == 5.0
    assert df.filter("thread_id = '2'").first().customer_text == "NA"


def test_missing_columns_are_added_as_typed_nulls(spark):
    df = spark.createDataFrame([("1", 4)], "thread_id string, judge_tone int")
    full = tables.add_missing(df, schemas.JUDGE_COLUMNS)
    assert full.first() == ("1", 4, None, None)
    assert full.schema["judge_grounding"].dataType.typeName() == "integer"


def test_thread_ids(spark):
    df = spark.createDataFrame([(5, "a")], "thread_id bigint, customer_text string")
    assert tables.with_thread_id(df).first().thread_id == "5"
    bare = spark.createDataFrame([("a",), (None,)], "customer_text string")
    ids = [r.thread_id for r in tables.with_thread_id(bare).collect()]
    assert ids == [r.thread_id for r in tables.with_thread_id(bare.repartition(3)).orderBy(F.desc("customer_text")).collect()]
    assert all(i.startswith("golden_") for i in ids) and len(set(ids)) == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "q", "a", "golden"), ("2", "q", "a", "kb")], "thread_id string, customer_text string, agent_text string, split string")
    tables.write_split(df, str(tmp_path / "split"))
    assert (tmp_path / "split" / "split=golden").is_dir()
    kb = spark.createDataFrame([("1", "d", "r")], schemas.KNOWLEDGE_BASE)
    tables.write_knowledge_base(kb, str(tmp_path / "kb"))
    tables.write_knowledge_base(kb.union(kb), str(tmp_path / "kb"))
    assert spark.read.parquet(str(tmp_path / "kb")).count() == 1
    tables.append_table(kb, str(tmp_path / "log"))
    tables.append_table(kb, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


SUMMARY = [("INTENT", "accuracy", 0.6, None), ("INTENT", "majority", None, "other"), ("JUDGE", "tone", None, None),
           ("INTENT", "majority_accuracy", 0.5, "other")]


def test_summary(spark, tmp_path):
    df = spark.createDataFrame(SUMMARY, schemas.SUMMARY)
    assert [r.line for r in tables.summary_lines(df).collect()] == ["accuracy: 0.6000", "majority: other", "tone: none", "majority_accuracy: 0.5000 (other)"]
    tables.write_summary(df, str(tmp_path / "s"))
    assert sorted(spark.read.schema(schemas.SUMMARY).json(str(tmp_path / "s")).collect()) == sorted(df.collect())
    tables.write_summary(df, str(tmp_path / "t"), "text")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())[0] == "accuracy: 0.6000"
    tables.write_summary(df, str(tmp_path / "c"), "csv")
    assert tables.read_table(spark, str(tmp_path / "c"), schemas.SUMMARY, "csv").count() == 4


def test_payload(spark):
    df = spark.createDataFrame([("b", 0.125), ("a", 0.5)], "label string, share double")
    payload = tables.to_payload(df, "rows", {"share": 2}).first().payload_json
    assert json.loads(payload) == {"rows": [{"label": "a", "share": 0.5}, {"label": "b", "share": 0.12}]}


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = (tables.shared_folder(spark, "x") for _ in range(2))
    assert a.startswith(root) and a != b
    df = tables.stored(spark.range(3), "y")
    assert df.count() == 3 and f"{root}/casework-y-" in df.inputFiles()[0]
