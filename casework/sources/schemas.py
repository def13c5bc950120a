"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(),
}


def _table(spec: str) -> T.StructType:
    fields = (f.split() for f in spec.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in fields])


# Raw CSV columns are read as text and converted with try_cast, never inferred.
TWEETS = _table(
    "tweet_id string, author_id string, text string, in_response_to_tweet_id string"
)
THREADS = _table("thread_id string, customer_text string, agent_text string")
GOLDEN = _table(
    "thread_id string, customer_text string, agent_text string, true_intent string, "
    "should_escalate int, escalation_reason string"
)
KNOWLEDGE_BASE = _table("id string, document string, agent_reply string")
RESULTS = _table(
    "thread_id string, customer_text string, true_intent string, pred_intent string, "
    "confidence_score double, true_escalate boolean, pred_escalate boolean, "
    "agent_status string, escalation_reason string, drafted_reply string, "
    "retrieved_examples bigint, judge_tone int, judge_grounding int, judge_reasoning string"
)
ANSWERS = _table("id string, answer string, error string")
JUDGEMENTS = _table("thread_id string, judge_tone int, judge_grounding int, judge_reasoning string")
RUNS = _table(
    "results bigint, intent_rows bigint, escalation_rows bigint, completed bigint, rejects bigint, failures bigint"
)
SUMMARY = _table("section string, name string, value double, label string")


def as_text(schema: T.StructType) -> T.StructType:
    """The same columns as text, to read CSV whose flags and numbers come in many spellings.

    The reports read flags and numbers out of text columns.
    """
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


# Columns every caller must bring.
REQUIRED = {
    "knowledge_base": ("customer_text", "agent_text", "thread_id"),
    "golden": ("customer_text", "true_intent", "should_escalate"),
    "results": ("customer_text", "true_intent", "pred_intent", "true_escalate", "pred_escalate"),
}

# Columns a table may lack; they are added as null.
LABEL_COLUMNS = {"true_intent": "string", "should_escalate": "int", "escalation_reason": "string"}
JUDGE_COLUMNS = {"judge_tone": "int", "judge_grounding": "int", "judge_reasoning": "string"}

# Tokens a CSV label column may hold for null.
NULL_TOKENS = ("", "NA", "N/A", "n/a", "None", "nan", "NaN", "null", "NULL", "<NA>")
