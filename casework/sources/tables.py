"""Scans, column guards and sinks."""

import uuid
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from casework.functions.text import half_even, normalize_id, numeric_or_null
from casework.sources import schemas
from casework.sources.csv import read_csv

# Quotes are doubled inside quoted text, as most writers do; Spark's own default is a backslash.
CSV_OPTIONS = {"header": True, "escape": '"'}


def read_tweets(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """Scan raw message CSV and convert the two id columns to bigint.

    Spark's own reader gives a file with quoted line breaks to one task; ``csv.read_csv`` cuts it
    at the true ends of records. An export known to have no line breaks in its texts is split by Spark as it is.
    """
    if line_breaks:
        raw = read_csv(spark, path)
    else:
        raw = spark.read.options(**CSV_OPTIONS, enforceSchema=False).csv(path)
    require_columns(raw, schemas.TWEETS.names)
    return raw.select(
        normalize_id("tweet_id").alias("tweet_id"),
        "author_id",
        "text",
        normalize_id("in_response_to_tweet_id").alias("in_response_to_tweet_id"),
    )


def read_table(spark, path, schema, fmt: str = "parquet", limit: int | None = None) -> DataFrame:
    """Read a table with its schema; an absent path gives an empty typed table.

    For CSV written elsewhere give ``as_text(schema)`` and see ``null_tokens``.
    """
    options = {**CSV_OPTIONS, "multiLine": True} if fmt == "csv" else {}
    try:
        df = spark.read.schema(schema).options(**options).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).limit(0)  # known to be empty when a join with it is planned
    return df if limit is None else df.limit(limit)


def null_tokens(df: DataFrame, *columns: str) -> DataFrame:
    """Map the null spellings of label columns to null. Never use it on message text."""
    return df.withColumns(
        {c: F.when(~F.trim(c).isin(*schemas.NULL_TOKENS), F.col(c)) for c in columns}
    )


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, available {df.columns}")
    return df


def add_missing(df: DataFrame, columns: dict) -> DataFrame:
    """Add the named columns as typed nulls where the table lacks them."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def with_thread_id(df: DataFrame) -> DataFrame:
    """String ``thread_id``; a table without ids gets one from its text, stable across runs."""
    if "thread_id" in df.columns:
        return df.withColumn("thread_id", F.col("thread_id").cast("string"))
    text = F.coalesce("customer_text", F.lit(""))
    return df.withColumn("thread_id", F.concat(F.lit("golden_"), F.md5(text)))


def write_table(
    df: DataFrame, path: str, mode: str = "errorifexists", by=(), fmt: str = "parquet"
) -> None:
    options = CSV_OPTIONS if fmt == "csv" else {}
    df.write.mode(mode).partitionBy(*by).options(**options).format(fmt).save(path)


def write_counted(df: DataFrame, write, **counts: Column) -> dict:
    """Write a frame with ``write`` and return its number of ``rows`` and the given aggregates, counted while it
    is written: no other pass over the data."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counts.items()]))
    return seen.get


def coverage() -> dict:
    """Aggregates of results: rows with both intents, with both escalation flags, and with a prediction."""
    def both(a, b):
        return F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())

    return {
        "intent_rows": both("true_intent", "pred_intent"), "escalation_rows": both("true_escalate", "pred_escalate"),
        "completed": F.count("pred_intent"),
    }


def write_split(df: DataFrame, path: str) -> None:
    """Golden and knowledge-base rows side by side, one directory per split."""
    write_table(df, path, "overwrite", by=["split"])


def append_table(df: DataFrame, path: str) -> None:
    """Append a batch of results; nothing already stored is rewritten."""
    write_table(df, path, "append")


def write_knowledge_base(kb: DataFrame, path: str) -> None:
    """Store the knowledge base unless one is already there."""
    write_table(kb, path, "ignore")


def summary_lines(summary: DataFrame) -> DataFrame:
    """``name: value`` text lines of a (section, name, value, label) report."""
    number = F.when(F.col("value").isNotNull(), F.format_string("%.4f", "value"))
    shown = F.when(F.col("value").isNull(), F.col("label")).otherwise(
        F.concat_ws(" ", number, F.concat(F.lit("("), "label", F.lit(")")))
    )
    line = F.concat_ws(": ", "name", F.coalesce(shown, F.lit("none")))
    return summary.select("section", "name", line.alias("line"))


def write_summary(summary: DataFrame, path: str, fmt: str = "json") -> None:
    """Report as ``json``, ``csv`` or ``text`` lines; a few rows per label, hence one file."""
    rows = summary_lines(summary).select("line") if fmt == "text" else summary
    write_table(rows.coalesce(1), path, "overwrite", fmt=fmt)


def to_payload(df: DataFrame, name: str, rounded: dict | None = None, **totals) -> DataFrame:
    """A small report as one JSON text: its rows become a sorted array under ``name``, beside
    further aggregates. Rounding, half to even, belongs here and nowhere else."""
    df = df.withColumns({c: half_even(c, digits) for c, digits in (rounded or {}).items()})
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    body = [rows.alias(name), *[c.alias(key) for key, c in totals.items()]]
    return df.agg(as_json(*body).alias("payload_json"))


def as_json(*fields) -> Column:
    """One JSON object of the fields; a null field stays in it as null."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def numeric_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: numeric_or_null(c) for c in columns})


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """New folder for intermediate tables, under the folder the session names.

    Only a local session without ``spark.checkpoint.dir`` gets a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="casework-")
    return f"{root.rstrip('/')}/casework-{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder (a job) and read it back."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
