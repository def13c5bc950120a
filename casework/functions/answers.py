"""Parse raw JSON answers of a classifier or judge.

JSON goes through the variant type because the answer rules depend on the JSON type of a
field: ``"false"`` is a non-empty text and counts as true, ``false`` does not.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions import terms
from casework.functions.text import NUMBER, strip

FENCE = r"```(json|JSON)?"


def unfenced(c) -> Column:
    """Answer text without blanks and, if it opens with one, without code fences."""
    text = strip(c)
    bare = strip(F.regexp_replace(text, FENCE, ""))
    return F.when(text.startswith("```"), bare).otherwise(text)


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get(F.col("_json")[name], "$", kind)


def _kind(name: str) -> Column:
    """JSON type of a field: null if absent, VOID for a JSON null."""
    return F.schema_of_variant(F.col("_json")[name])


def _with_json(df: DataFrame, answer: str, fields) -> DataFrame:
    """Parse once; ``_json`` has the fields of objects as variants, and each field's type is noted.

    Of a key that stands twice the last value counts, and ``NaN`` and ``Infinity`` are numbers, as
    Python reads them; a key that stands twice inside a field's value makes the answer malformed.
    """
    text = unfenced(answer)
    schema = ", ".join([*(f"{f} variant" for f in fields), "_bad string"])
    found = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    parsed = df.withColumn("_json", found)
    whole = F.col("_json").isNotNull() & F.col("_json._bad").isNull() & text.endswith("}")
    parsed = parsed.withColumn("_object", F.coalesce(whole, F.lit(False)))
    return parsed.withColumns({f"_kind_{f}": _kind(f) for f in fields})


#: Tokens of JSON: texts, marks, and what stands between them.
TOKENS = r'("(?:[^"\\]|\\.)*+"|[{}\[\],:]|[^{}\[\],:"]+)'


def python_text(raw: Column) -> Column:
    """Text that Python shows for a list or an object, from its JSON without blanks between the tokens."""

    def shown(t):
        body = F.replace(F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/"))
        single, double = F.contains(body, F.lit("'")), F.contains(body, F.lit('"'))
        quoted = F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        )
        words = {",": ", ", ":": ": ", "true": "True", "false": "False", "null": "None"}
        out = F.when(t.startswith('"'), quoted)
        for word, value in words.items():
            out = out.when(t == word, F.lit(value))
        return out.otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(TOKENS), F.lit(1)), shown), "")


def _truthy(name: str) -> Column:
    kind, text = F.col(f"_kind_{name}"), _field(name, "string")
    return (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", _field(name, "boolean"))
        .when(kind == "STRING", F.length(text) > 0)
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}"))
        .otherwise(F.coalesce(_field(name, "double") != 0, F.lit(True)))
    )


def _number(name: str) -> Column:
    """Python ``float()`` of a field: numbers, flags and numeric text, else null."""
    kind, text = F.col(f"_kind_{name}"), strip(_field(name, "string"))
    word = F.lower(F.ltrim(text, F.lit("+-")))
    special = F.when(word == "nan", float("nan")).when(
        word.isin("inf", "infinity"),
        F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")),
    )
    return F.when(
        kind == "STRING", F.when(text.rlike(NUMBER), text.try_cast("double")).otherwise(special)
    ).otherwise(_field(name, "double"))


def parse_answers(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``analysis`` (intent, confidence, escalate, reason) and ``error`` to each row.

    A malformed answer has a null analysis and an error; it is never dropped.
    """
    fields = ("intent", "confidence_score", "should_escalate", "escalation_reason")
    parsed = _with_json(df, answer, fields)
    intent = strip(_field("intent", "string"))
    number = _number("confidence_score")
    # greatest / least rank NaN highest, so a NaN confidence clamps to 1; they skip nulls,
    # so a missing confidence is set to 0 first.
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))
    kind, said = F.col("_kind_escalation_reason"), _field("escalation_reason", "string")
    raw = F.from_json(unfenced(answer), "escalation_reason string")["escalation_reason"]
    reason = F.when(
        _truthy("escalation_reason"),
        F.when(kind == "BOOLEAN", F.lit("True"))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), python_text(raw))
        .when((kind != "STRING") & said.isin("NaN", "Infinity", "-Infinity"), F.regexp_replace(F.lower(said), "infinity", "inf"))
        .otherwise(strip(said)),
    ).otherwise("")
    analysis = F.struct(
        F.when(intent.isin(*terms.INTENTS), intent).otherwise("other").alias("intent"),
        clamped.alias("confidence_score"),
        _truthy("should_escalate").alias("should_escalate"),
        reason.alias("escalation_reason"),
    )
    text = unfenced(answer)
    error = (
        F.when(F.col("_object"), None)
        .when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty answer")
        .when(F.try_parse_json(text).isNull(), "malformed JSON")
        .otherwise("not a JSON object")
    )
    return parsed.select(
        *df.columns, F.when(F.col("_object"), analysis).alias("analysis"), error.alias("error")
    )


def _score(name: str) -> Column:
    """Python ``int()`` of a field, kept only from 1 to 5: text must be whole, numbers truncate."""
    kind, text = F.col(f"_kind_{name}"), strip(_field(name, "string"))
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    value = F.when(kind == "STRING", whole).otherwise(_field(name, "double").try_cast("int"))
    return F.when(value.between(1, 5), value)


def parse_judgements(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``judgement`` (tone, grounding, reasoning); unusable parts are null."""
    parsed = _with_json(df, answer, ("score_tone", "score_grounding", "reasoning"))
    judgement = F.struct(
        _score("score_tone").alias("score_tone"),
        _score("score_grounding").alias("score_grounding"),
        _field("reasoning", "string").alias("reasoning"),
    )
    return parsed.select(*df.columns, judgement.alias("judgement"))
