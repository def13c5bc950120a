"""Hand labels: the queue of unlabelled rows and the merge of a label log."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions import terms
from casework.operators.seeded import first_per_key
from casework.sources.schemas import LABEL_COLUMNS
from casework.sources.tables import add_missing


def label_queue(golden: DataFrame) -> DataFrame:
    return golden.filter(F.col("true_intent").isNull())


def latest_labels(events: DataFrame, by: str = "thread_id") -> DataFrame:
    """The latest valid event of each id: id, ``seq``, ``code``, ``escalate``, ``reason``.

    Events with an unknown code are not answers. Of several with the same number the greatest (code, escalate, reason) counts.
    """
    order = [F.col(c).desc_nulls_last() for c in ("seq", "code", "escalate", "reason")]
    return first_per_key(events.filter(valid_label()), [by], order).select(by, "seq", "code", "escalate", "reason")


def valid_label(code: str = "code"):
    return F.coalesce(F.col(code).isin(list(terms.LABEL_CODES)), F.lit(False))


def apply_labels(golden: DataFrame, events: DataFrame, by: str = "thread_id") -> DataFrame:
    """Fill unlabelled golden rows from a log (id, seq, code, escalate, reason).

    Events with an unknown code are not answers; of the others the latest per id counts.
    Rows that already have an intent keep all their labels.
    """
    code = F.create_map(*[F.lit(x) for kv in terms.LABEL_CODES.items() for x in kv])
    latest = latest_labels(events, by).withColumn("_intent", F.element_at(code, F.col("code")))
    yes = F.coalesce(F.lower("escalate") == "y", F.lit(False))
    new = latest.select(
        by,
        "_intent",
        F.when(yes, 1).otherwise(0).alias("_escalate"),
        F.when(yes, F.col("reason")).otherwise(terms.REASON_SAFE).alias("_reason"),
    )
    golden = add_missing(golden, LABEL_COLUMNS)
    fill = F.col("true_intent").isNull() & F.col("_intent").isNotNull()
    pairs = {
        "true_intent": "_intent", "should_escalate": "_escalate", "escalation_reason": "_reason",
    }
    merged = golden.join(new, by, "left")
    return merged.select(
        *[
            F.when(fill, F.col(pairs[c])).otherwise(F.col(c)).alias(c) if c in pairs else c
            for c in golden.columns
        ]
    )
