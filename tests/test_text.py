import pytest
from pyspark.sql import functions as F

from casework.functions import rules, terms, text


def agrees(column, kind, cases, **expressions):
    """``cases`` rows are (input, wanted value of each expression in order)."""
    inputs = [c[0] for c in cases]
    for at, (name, expr) in enumerate(expressions.items(), start=1):
        assert column(expr, kind, inputs) == [c[at] for c in cases], name


def test_strip_is_python_strip(column):
    cases = ["  a ", "\t\na\r\n", " a　", "", "   ", "a b", "\x1c a  "]
    agrees(column, "string", [(s, s.strip()) for s in cases], strip=text.strip("a"))


def test_blanks_are_all_of_pythons():
    assert set(text.BLANKS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_normalize_label(column):
    cases = [("\t Hardware_Repair ", "hardware_repair"), ("OTHER", "other"), (None, None)]
    agrees(column, "string", cases, label=text.normalize_label("a"))


def test_text_flags(column):
    cases = [
        ("True", True, True), ("YES", True, True), ("1", True, True), ("t", True, False),
        (" y ", True, False), ("y", True, True), ("1.0", False, False), ("False", False, False),
        ("0", False, False), ("maybe", False, False), ("", False, False), (None, False, None),
    ]
    agrees(
        column, "string", cases,
        harness=text.normalize_bool("a", "harness"), dashboard=text.normalize_bool("a", "dashboard"),
    )


def test_typed_flags(spark):
    df = spark.createDataFrame([(1.0, True, 1), (0.0, False, 0), (None, None, None)], "d double, b boolean, i int")
    for variant, null in (("harness", False), ("dashboard", None)):
        rows = df.select(*[text.flag(df, c, variant).alias(c) for c in df.columns]).collect()
        assert [tuple(r) for r in rows] == [(True,) * 3, (False,) * 3, (null,) * 3]


def test_normalize_id(column):
    cases = [
        ("1.23e18", 1230000000000000000), ("9007199254740993", 9007199254740993), ("12.0", 12),
        (" 7 ", 7), ("12.5", None), ("abc", None), ("", None), (None, None),
        ("999999999999999999999", None),
    ]
    agrees(column, "string", cases, id=text.normalize_id("a"))


def test_numeric_or_null(column):
    cases = [
        ("5", 5.0), (" 4.5 ", 4.5), ("1e1", 10.0), ("n/a", None), ("nan", None), ("5d", None), ("", None), (None, None),
    ]
    agrees(column, "string", cases, number=text.numeric_or_null("a"))
    agrees(column, "double", [(float("nan"), None), (2.5, 2.5)], number=text.numeric_or_null("a"))


def test_min_length_is_strict(column):
    agrees(column, "string", [("x" * 15, False), ("x" * 16, True), (None, None)], long=text.min_length("a"))


def reference_clip(r):
    """Plain statement of the rule, for comparison."""
    r = r.strip()
    if len(r) >= 2 and r[0] == r[-1] == '"':
        r = r[1:-1].strip()
    return r if len(r) <= 280 else r[:277].rstrip() + "..."


def test_clip_reply(column):
    replies = [
        "short", "x" * 280, "x" * 281, '"quoted"', '"', '""', '" in "', '"' + "y" * 300 + '"',
        "z" * 270 + " " * 7 + "w" * 20, "", "  padded  ", "ü" * 281,
    ]
    agrees(column, "string", [(r, reference_clip(r)) for r in replies], reply=text.clip_reply("a"))


def test_message_status(column):
    cases = [
        (None, "missing"), ("", "empty"), (" \t\n ", "empty"), ("x" * 1000, "ok"), ("x" * 1001, "too_long"),
        (" " * 50 + "x" * 1000, "ok"),
    ]
    agrees(column, "string", cases, status=text.message_status("a"))


def test_previews_ids_and_classes(column):
    cases = [("é" * 120, "é" * 100, "é" * 100 + "..."), ("x", "x", "x..."), (None, "", "...")]
    agrees(column, "string", cases, plain=text.preview("a"), dots=text.preview("a", ellipsis=True))
    cases = [(7, "#FN-007", "RAG-007"), (1234, "#FN-1234", "RAG-1234")]
    agrees(column, "int", cases, miss=text.case_id("#FN-", "a"), rag=text.case_id("RAG-", "a"))
    cases = [(True, "escalate"), (False, "auto-reply"), (None, None)]
    agrees(column, "boolean", cases, name=text.escalation_class("a"))


def test_rounding_is_half_even(column):
    values = [0.125, 0.375, 2.5, 0.285, 60.0, 28.499999]
    assert column(text.half_even("a", 2), "double", values) == pytest.approx([round(x, 2) for x in values])


def test_error_class(column):
    cases = [
        ("HTTP 429", "quota"), ("Rate limit reached", "quota"), ("model_unavailable", "model"),
        ("The model is currently unavailable", "model"), ("quota: model unavailable", "model"),
        ("100 RPM", "quota"), ("timeout", "other"),
    ]
    agrees(column, "string", cases, error=text.error_class("a"))


def test_shortest_terms_decide_the_same():
    for words in [*terms.INTENT_TERMS.values(), terms.ESCALATE_TERMS, terms.CHARGE_TERMS, terms.TOXIC_TERMS]:
        few = terms.shortest(words)
        assert all(any(f in w for f in few) for w in words)
        assert set(few) <= set(words)


def test_list_sizes():
    assert [len(x) for x in (terms.DAMAGE_TERMS, terms.CHARGE_TERMS, terms.TOXIC_TERMS)] == [10, 10, 9]
    assert [len(x) for x in terms.INTENT_TERMS.values()] == [13, 20, 19, 17, 18, 7]
    assert len(terms.ESCALATE_TERMS) == 38 and len(terms.INTENTS) == 7


def test_every_listed_term_hits(column):
    for intent, words in terms.INTENT_TERMS.items():
        assert all(column(rules.any_term(F.lower("a"), words), "string", [f"xx{w.upper()}yy" for w in words])), intent
    lists = {
        "physical_damage": terms.DAMAGE_TERMS, "refund_or_charge": terms.CHARGE_TERMS, "toxic": terms.TOXIC_TERMS,
    }
    for name, words in lists.items():
        assert all(column(rules.signals("a")[name], "string", words)), name
    assert all(column(rules.keyword_escalate("a"), "string", terms.ESCALATE_TERMS))


def test_messages(column):
    """Whole messages, with what the rules alone say about them."""
    none = (False, False, False, False)
    cases = [
        ("Sat on it, now there is water damage under the glass", "hardware_repair", True, (True, False, False, False)),
        ("Every song stops: frozen, then an ERROR MESSAGE", "software_troubleshooting", False, none),
        ("No Bluetooth in my car since Monday", "device_connectivity", False, none),
        ("Good morning, is the shop open?", "general_inquiry", False, none),
        ("The worst glitch so far", "software_troubleshooting", True, (False, False, False, True)),
        ("Two payments for one subscription, money back please", "billing_purchases", True, (False, True, False, False)),
    ]
    agrees(
        column, "string", cases, intent=rules.keyword_intent("a"), escalate=rules.keyword_escalate("a"),
        signals=rules.signals("a"),
    )


def test_terms_are_substrings_in_order(column):
    cases = [
        ("curiosity", "software_troubleshooting"), ("where is my charger", "billing_purchases"),
        ("forgot PASSWORD and got charged", "account_security"), ("press office", "other"),
        (None, "general_inquiry"), ("", "general_inquiry"),
    ]
    agrees(column, "string", cases, intent=rules.keyword_intent("a"))


def test_pii(column):
    cases = [
        ("me@x.com", True, False), ("a.b+c@mail.example.org!", True, False), ("me@x", False, False),
        ("+1 (743) 555-3824", False, True), ("1234567", False, False), ("123456789", False, True),
        ("éa.b@c.com", True, False), (None, False, False),
    ]
    agrees(column, "string", cases, email=rules.has_email("a"), phone=rules.has_phone("a"))


def test_overrides(spark):
    cases = [
        ((True, True, True, True), "other", "hardware_repair", True, terms.REASON_DAMAGE),
        ((False, True, True, True), "other", "billing_purchases", True, terms.REASON_BILLING),
        ((False, True, False, False), "account_security", "account_security", True, terms.REASON_BILLING),
        ((False, False, True, True), "other", "other", True, terms.REASON_PII),
        ((False, False, False, True), "other", "other", True, terms.REASON_TOXIC),
        ((False, False, False, False), "other", "other", False, "kept"),
    ]
    df = spark.createDataFrame(
        [((intent, 0.9, False, "kept"), signals) for signals, intent, *_ in cases],
        "a struct<intent:string,confidence_score:double,should_escalate:boolean,escalation_reason:string>,"
        "s struct<physical_damage:boolean,refund_or_charge:boolean,pii:boolean,toxic:boolean>",
    ).coalesce(1)
    got = [tuple(r.x) for r in df.select(rules.apply_overrides("a", "s").alias("x")).collect()]
    assert got == [(intent, 0.9, escalate, reason) for _, _, intent, escalate, reason in cases]


def test_gate(column):
    cases = [
        ((True, 1.0), "escalated"), ((False, 0.59), "escalated"), ((False, 0.60), "auto_handled"),
        ((False, 1.0), "auto_handled"),
    ]
    agrees(column, "struct<should_escalate:boolean,confidence_score:double>", cases, status=rules.gate("a"))
