"""Request texts for an external classifier, reply writer and judge.

All wording is the caller's. A template names in braces where data goes, and the library puts in
the message, the signals as JSON, the past cases, the intents and the keys an answer must have.
Braces around anything else are plain text, so templates may show JSON.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.functions import terms
from casework.functions.text import as_column

ANSWER_KEYS = ("intent", "confidence_score", "should_escalate", "escalation_reason")
JUDGE_KEYS = ("score_tone", "score_grounding", "reasoning")


@dataclass(frozen=True)
class Templates:
    """``classify`` must have {message} and may have {signals}, {intents} and {keys}; ``reply``
    {message}, and {cases}; ``judge`` {message} and {reply}, and {keys}."""

    classify: str
    reply: str | None = None
    judge: str | None = None


def filled(template: str, required, **parts) -> Column:
    """The template as a column, with ``parts`` (columns or texts) in the places named after them.

    A null part is an empty text, so that no request is ever null.
    """
    names = re.findall(r"\{(%s)\}" % "|".join(parts), template)
    missing = set(required) - set(names)
    if missing:
        raise ValueError(f"the template lacks {sorted(missing)}")
    texts = re.split(r"\{(?:%s)\}" % "|".join(parts), template)
    out = [F.lit(texts[0])]
    for name, text in zip(names, texts[1:]):
        part = parts[name]
        out += [F.lit(part) if isinstance(part, str) else F.coalesce(part, F.lit("")), F.lit(text)]
    return F.concat(*out)


def classification_request(text, found, template: str) -> Column:
    """``found`` is the signals struct of the message."""
    return filled(
        template, ["message"], message=as_column(text), signals=F.to_json(as_column(found)),
        intents=", ".join(terms.INTENTS), keys=", ".join(ANSWER_KEYS),
    )


def example_block(examples) -> Column:
    """Numbered past cases from an ordered array of (customer_issue, agent_reply)."""
    examples = as_column(examples)

    def case(x, i):
        return F.concat(
            F.lit("Case "),
            (i + 1).cast("string"),
            F.lit("\nCustomer: "),
            F.coalesce(x["customer_issue"], F.lit("")),
            F.lit("\nAgent: "),
            F.coalesce(x["agent_reply"], F.lit("")),
        )

    return F.when(
        F.coalesce(F.size(examples), F.lit(0)) > 0,
        F.array_join(F.transform(examples, case), "\n\n"),
    ).otherwise(terms.NO_EXAMPLES)


def reply_request(text, examples, template: str) -> Column:
    return filled(template, ["message"], message=as_column(text), cases=example_block(examples))


def judge_request(text, reply, template: str) -> Column:
    return filled(
        template, ["message", "reply"], message=as_column(text), reply=as_column(reply), keys=", ".join(JUDGE_KEYS)
    )
