"""From raw documents to token ids, in five stages that are written and read again.

A stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm import bpe, minhash, mixing, pii, quality
from casework.llm.queries import PII_KEY, WEIGHTS, domain
from casework.llm.shared import fresh, ready
from casework.sources import files

#: Documents of at least this score stay.
LEAST_SCORE = 0.7


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the length of their present texts in ``n_chars``, if they have that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labelled part, finds good enough."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "_score")
    return quality.scored(docs, model, score_col=score).filter(F.col(score) >= LEAST_SCORE).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id; rows without an id stay."""
    gone = minhash.grouped(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data, and the length of the new text."""
    return counted(pii.pseudonymised(docs, PII_KEY, count_col=None).select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens at the target weights; a document may come twice, and the last one of a
    source is cut where its budget ends."""
    levels = {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    epoch = fresh(docs, "_epoch")
    return counted(mixing.mixed(docs, levels, WEIGHTS, share=(9, 10), epochs=2, epoch_col=epoch).drop(epoch))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    done = bpe.tokenized(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL has no zstandard, no minimum hashes of this kind and no tokenizer; tests compare each stage
#: with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read from there, and deleted
    once its successor is written."""
    folder = f"{ready(spark).sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            files.delete(spark, f"{folder}/{before}")
        before = name
    return docs
