from pyspark.sql import functions as F

from casework.operators.numbering import Placed, numbered


def test_numbers_follow_the_order_without_gaps(spark):
    df = spark.range(0, 5000, numPartitions=7).select(
        ((F.col("id") * 7919) % 5003).alias("k"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("g")
    )
    got = [tuple(r) for r in numbered(df, ["g", "k"], lambda d: d.checkpoint() if _ready(spark) else d, "n").collect()]
    order = sorted(got, key=lambda r: r[2])
    assert [r[2] for r in order] == list(range(5000))
    assert [r[:2] for r in order] == sorted((r[:2] for r in got), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))


def test_equal_rows_and_empty_tables(spark):
    _ready(spark)
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k int, v string")
    got = sorted(tuple(r) for r in numbered(df, ["k"], lambda d: d.checkpoint()).select("number", "v").collect())
    assert got == [(0, "b"), (1, "a"), (2, "a")]
    assert numbered(df.limit(0), ["k"], lambda d: d.checkpoint()).count() == 0


def test_no_single_task_gets_all_rows(spark):
    _ready(spark)
    df = numbered(spark.range(100), ["id"], lambda d: d.checkpoint())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("SinglePartition") == 1  # one row per part only


def test_numbers_of_stored_rows(spark, tmp_path):
    def store(df):
        df.write.parquet(str(tmp_path / "rows"), mode="overwrite")
        return spark.read.schema(df.schema).parquet(str(tmp_path / "rows"))

    # Parts of many sizes, one of them empty.
    df = spark.range(0, 100, numPartitions=5).filter("id % 7 < id div 20 AND id NOT BETWEEN 40 AND 59")
    placed = Placed(df, store)
    every = {r.number: r.id for r in placed.between(0, placed.rows).collect()}
    assert sorted(every) == list(range(df.count())) and sorted(every.values()) == sorted(r.id for r in df.collect())
    for first, end in ((0, 1), (3, 20), (10, placed.rows + 5), (placed.rows, placed.rows + 2)):
        some = {r.number: r.id for r in placed.between(first, end).collect()}
        assert some == {n: i for n, i in every.items() if first <= n < end}
    assert Placed(df.limit(0), store).rows == 0


def _ready(spark):
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir"))
    return True
