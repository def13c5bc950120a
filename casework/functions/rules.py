"""Deterministic rules over message text, all as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.functions import terms
from casework.functions.text import any_term, as_column


def has_email(c) -> Column:
    """The cheap ``@`` test spares most rows the pattern. ``(?U)``: Unicode-aware classes."""
    c = F.coalesce(as_column(c), F.lit(""))
    return c.contains("@") & c.rlike("(?U)" + terms.EMAIL_PATTERN)


def has_phone(c) -> Column:
    return F.coalesce(as_column(c), F.lit("")).rlike("(?U)" + terms.PHONE_PATTERN)


def signal_columns(c) -> dict:
    """The four safety signals by name; null text raises none of them."""
    low = F.lower(F.coalesce(as_column(c), F.lit("")))
    return {
        "physical_damage": any_term(low, terms.DAMAGE_TERMS),
        "refund_or_charge": any_term(low, terms.CHARGE_TERMS),
        "pii": has_email(c) | has_phone(c),
        "toxic": any_term(low, terms.TOXIC_TERMS),
    }


def signals(c) -> Column:
    return F.struct(*[found.alias(name) for name, found in signal_columns(c).items()])


def keyword_intent(c) -> Column:
    """Intent of the first term list that hits, in the fixed list order."""
    low = F.lower(F.coalesce(as_column(c), F.lit("")))
    choice = F
    for intent, words in terms.INTENT_TERMS.items():
        choice = choice.when(any_term(low, words), intent)
    return choice.otherwise(terms.DEFAULT_INTENT)


def keyword_escalate(c) -> Column:
    return any_term(F.lower(F.coalesce(as_column(c), F.lit(""))), terms.ESCALATE_TERMS)


def apply_overrides(analysis, found) -> Column:
    """Let the first raised signal (damage, charge, PII, toxic) correct an analysis struct."""
    a, s = as_column(analysis), as_column(found)
    charge = s["refund_or_charge"]
    vague = a["intent"].isin("billing_purchases", "general_inquiry", "other")
    return F.struct(
        F.when(s["physical_damage"], "hardware_repair")
        .when(charge & vague, "billing_purchases")
        .otherwise(a["intent"])
        .alias("intent"),
        a["confidence_score"].alias("confidence_score"),
        (
            s["physical_damage"] | charge | s["pii"] | s["toxic"] | a["should_escalate"]
        ).alias("should_escalate"),
        F.when(s["physical_damage"], terms.REASON_DAMAGE)
        .when(charge, terms.REASON_BILLING)
        .when(s["pii"], terms.REASON_PII)
        .when(s["toxic"], terms.REASON_TOXIC)
        .otherwise(a["escalation_reason"])
        .alias("escalation_reason"),
    )


def gate(analysis, threshold: float = terms.CONFIDENCE_THRESHOLD) -> Column:
    """Final status: a human takes flagged and low-confidence messages."""
    a = as_column(analysis)
    human = a["should_escalate"] | (a["confidence_score"] < threshold)
    return F.when(human, terms.ESCALATED).otherwise(terms.AUTO_HANDLED)
