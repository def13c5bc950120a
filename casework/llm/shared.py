"""The folder that all executors share, and tables kept in it."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each that go to every executor at most.
SMALL = 50_000


def ready(spark: SparkSession) -> SparkSession:
    """Make sure that checkpoints have a folder: the one in ``spark.checkpoint.dir``. Only a local session
    that names none (as in tests) gets a new one; on a cluster executors would not share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="casework-"))
    return spark


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores as long as ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: its lineage ends there, and losing an executor costs nothing."""
    ready(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame) -> DataFrame:
    """A stored table, to be sent to every executor if it has at most SMALL rows (a job counts
    them); beyond that a join moves both sides."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
