"""The registered queries once more, as DuckDB SQL over the same tables."""

import numpy as np

from casework.functions import terms
from casework.functions.text import BLANKS
from checks.views import with_views


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c):
    return f"trim({c}, {quote(BLANKS)})"


def hit(c, words):
    return "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), {quote(w)})" for w in words) + ")"


def over(a, b):
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / ({b}) END"


def total(c):
    return f"CAST(sum({c}) AS BIGINT)"


def folded(c):
    """Sum of a fraction, in parts of 30 bits that are whole numbers, so that no order shows."""
    part, rest, sums = f"floor({c})", c, []
    for _ in range(5):
        sums.append(f"CAST(sum(CAST({part} AS BIGINT)) AS DOUBLE)")
        rest = f"(({rest}) - {part}) * 1073741824.0::DOUBLE"
        part = f"floor({rest})"
    out = sums.pop()
    while sums:
        out = f"({sums.pop()} + {out} / 1073741824.0::DOUBLE)"
    return out


def keyword_intent(c):
    whens = " ".join(f"WHEN {hit(c, w)} THEN '{i}'" for i, w in terms.INTENT_TERMS.items())
    return f"CASE {whens} ELSE 'general_inquiry' END"


def pii(c):
    return (
        f"(regexp_matches(coalesce({c}, ''), {quote(terms.EMAIL_PATTERN)}) "
        f"OR regexp_matches(coalesce({c}, ''), {quote(terms.PHONE_PATTERN)}))"
    )


def true_word(c, variant):
    words = ", ".join(quote(w) for w in terms.TRUE_WORDS[variant])
    inner = f"trim({c})" if variant == "harness" else c
    return f"(lower({inner}) IN ({words}))"


E_ROWS = "true_escalate IS NOT NULL AND pred_escalate IS NOT NULL"
KEYWORD_ESCALATE = hit("customer_text", terms.ESCALATE_TERMS)
SIGNALS = (
    f"{hit('customer_text', terms.DAMAGE_TERMS)} AS physical_damage, "
    f"{hit('customer_text', terms.CHARGE_TERMS)} AS refund_or_charge, "
    f"{pii('customer_text')} AS pii, {hit('customer_text', terms.TOXIC_TERMS)} AS toxic"
)
PAIRS = (
    "p AS (SELECT lower(trim(true_intent)) AS t, lower(trim(pred_intent)) AS q, count(*) AS n FROM eval_v "
    "WHERE true_intent IS NOT NULL AND pred_intent IS NOT NULL GROUP BY 1, 2), "
    "labels AS (SELECT t AS l FROM p UNION SELECT q FROM p), "
    "k AS (SELECT l, coalesce((SELECT sum(n) FROM p WHERE t = l AND q = l), 0) AS tp, "
    "coalesce((SELECT sum(n) FROM p WHERE q = l), 0) AS pr, "
    "coalesce((SELECT sum(n) FROM p WHERE t = l), 0) AS su FROM labels), "
    f"m AS (SELECT l, {over('tp', 'pr')} AS prec, {over('tp', 'su')} AS rec, "
    f"{over('2 * tp', 'pr + su')} AS f1, CAST(su AS BIGINT) AS support FROM k) "
)


def escalation(variant):
    t, q = true_word("true_escalate", variant), true_word("pred_escalate", variant)
    return (
        f"SELECT count(*) FILTER ({t} AND {q}) AS tp, count(*) FILTER (NOT {t} AND {q}) AS fp, "
        f"count(*) FILTER ({t} AND NOT {q}) AS fn, count(*) FILTER (NOT {t} AND NOT {q}) AS tn "
        f"FROM eval_v WHERE {E_ROWS}"
    )


PRF = {
    "accuracy": over("tp + tn", "tp + fp + fn + tn"),
    "precision": over("tp", "tp + fp"),
    "recall": over("tp", "tp + fn"),
    "f1": over("2 * tp", "2 * tp + fp + fn"),
}
COUNTS = (
    "c AS (SELECT count(*) AS n, count(*) FILTER (true_intent IS NOT NULL AND pred_intent IS NOT NULL) AS valid, "
    "count(*) FILTER (lower(trim(true_intent)) = lower(trim(pred_intent))) AS hits, "
    "count(*) FILTER (pred_intent IS NOT NULL) AS completed, "
    f"count(*) FILTER ({E_ROWS}) AS esc_valid, "
    "count(*) FILTER (true_intent IS NOT NULL) AS labelled, "
    f"count(*) FILTER (lower(trim(true_intent)) = {keyword_intent('customer_text')}) AS kw, "
    "count(*) FILTER (true_escalate IS NOT NULL) AS esc_known, "
    f"count(*) FILTER (true_escalate IS NOT NULL AND {true_word('true_escalate', 'harness')} = {KEYWORD_ESCALATE}) AS kwe, "
    "count(*) FILTER (length(trim(drafted_reply)) > 0) AS replies, "
    "avg(TRY_CAST(retrieved_examples AS DOUBLE)) AS retrieved, "
    "avg(TRY_CAST(judge_tone AS DOUBLE)) AS tone, count(TRY_CAST(judge_tone AS DOUBLE)) AS tone_n, "
    "avg(TRY_CAST(judge_grounding AS DOUBLE)) AS grounding, count(TRY_CAST(judge_grounding AS DOUBLE)) AS grounding_n "
    "FROM eval_v)"
)
MAJORITY = (
    "mj AS (SELECT t AS label, CAST(sum(n) AS DOUBLE) / (SELECT sum(n) FROM p) AS accuracy FROM p "
    "GROUP BY t ORDER BY sum(n) DESC, t LIMIT 1), "
    f"eh AS ({escalation('harness')}), "
    "me AS (SELECT CASE WHEN tp + fn > fp + tn THEN 'true' ELSE 'false' END AS label, "
    f"{over('greatest(tp + fn, fp + tn)', 'tp + fp + fn + tn')} AS accuracy FROM eh)"
)


def lines(source, section, values):
    prefix = f"{quote(section)} AS section, " if section else ""
    return " UNION ALL ".join(
        f"SELECT {prefix}{quote(name)} AS name, CAST({v} AS DOUBLE) AS value FROM {source}"
        for name, v in values.items()
    )


REPLY_JUDGE = lines("c", "REPLIES", {"generated": "replies", "rate": over("replies", "n")}) + " UNION ALL " + lines(
    "c", "JUDGE",
    {"tone_mean": "tone", "tone_samples": "tone_n", "grounding_mean": "grounding", "grounding_samples": "grounding_n"},
)
EVALUATION = " UNION ALL ".join([
    lines("c", "DATASET", {"rows": "n", "completed": "completed"}),
    lines("c", "INTENT", {"accuracy": over("hits", "valid")}),
    *[
        f"SELECT 'CLASSES' AS section, l || ' {c}' AS name, CAST({c} AS DOUBLE) AS value FROM m"
        for c in ("prec", "rec", "f1", "support")
    ],
    *[
        f"SELECT 'CLASSES', 'macro avg {c}', {folded(c)} / count(*) FROM m UNION ALL "
        f"SELECT 'CLASSES', 'weighted avg {c}', {folded(f'{c} * support')} / sum(support) FROM m"
        for c in ("prec", "rec", "f1")
    ],
    "SELECT 'CLASSES', 'macro avg support', CAST(sum(support) AS DOUBLE) FROM m",
    "SELECT 'CLASSES', 'weighted avg support', CAST(sum(support) AS DOUBLE) FROM m",
    "SELECT 'CONFUSION', a.l || ' -> ' || b.l, CAST(coalesce(p.n, 0) AS DOUBLE) FROM labels a CROSS JOIN labels b "
    "LEFT JOIN p ON p.t = a.l AND p.q = b.l",
    lines("eh", "ESCALATION", {**PRF, "tp": "tp", "fp": "fp", "fn": "fn", "tn": "tn"}),
    lines("c", "RETRIEVAL", {"average": "retrieved"}),
    REPLY_JUDGE,
])

GOLDEN = (
    "g AS (SELECT thread_id FROM (SELECT DISTINCT thread_id FROM threads_v) "
    "ORDER BY md5('101|' || CAST(thread_id AS VARCHAR)), thread_id LIMIT {n})"
)
GOLDEN, HALF = (GOLDEN.format(n=n) for n in (20, 10))


def kb_of(source):
    return (
        "SELECT CAST(thread_id AS VARCHAR) AS id, coalesce(customer_text, '') AS document, agent_text AS agent_reply "
        "FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY md5(agent_text) NULLS LAST, "
        f"md5(customer_text) NULLS LAST) AS rn FROM {source}) WHERE rn = 1"
    )


# Rows to evaluate may have any length.
GIVEN = (
    f"ok AS (SELECT thread_id, {strip('customer_text')} AS customer_text, true_intent, should_escalate AS truth FROM golden_v "
    f"WHERE length({strip('customer_text')}) > 0)"
)
UNGIVEN = (
    "SELECT CAST(thread_id AS VARCHAR) AS thread_id, CASE WHEN customer_text IS NULL THEN 'missing' ELSE 'empty' END AS status, "
    "NULL AS pred_intent, NULL AS true_intent, NULL AS true_escalate FROM golden_v WHERE thread_id NOT IN (SELECT thread_id FROM ok)"
)
EVALUATED = (
    "SELECT CAST(thread_id AS VARCHAR) AS thread_id, status, final_intent AS pred_intent, "
    f"{strip('true_intent')} AS true_intent, truth = 1 AS true_escalate FROM z UNION ALL {UNGIVEN}"
)

VALID = (
    f"ok AS (SELECT thread_id, {strip('customer_text')} AS customer_text FROM messages_v "
    f"WHERE length({strip('customer_text')}) BETWEEN 1 AND 1000)"
)


def decided(source):
    """Overrides and gate over (thread_id, customer_text, intent, confidence_score, should_escalate, escalation_reason)."""
    return (
        f"s AS (SELECT *, {SIGNALS} FROM {source}), "
        "d AS (SELECT *, CASE WHEN physical_damage THEN 'hardware_repair' WHEN refund_or_charge AND intent IN "
        "('billing_purchases', 'general_inquiry', 'other') THEN 'billing_purchases' ELSE intent END AS final_intent, "
        "should_escalate OR physical_damage OR refund_or_charge OR pii OR toxic AS final_escalate, "
        f"CASE WHEN physical_damage THEN {quote(terms.REASON_DAMAGE)} WHEN refund_or_charge THEN {quote(terms.REASON_BILLING)} "
        f"WHEN pii THEN {quote(terms.REASON_PII)} WHEN toxic THEN {quote(terms.REASON_TOXIC)} ELSE escalation_reason END AS final_reason "
        "FROM s), "
        "z AS (SELECT *, CASE WHEN final_escalate OR confidence_score < 0.6 THEN 'escalated' ELSE 'auto_handled' END AS status FROM d)"
    )


RULED = (
    f"ruled AS (SELECT thread_id, customer_text, {keyword_intent('customer_text')} AS intent, 0.9 AS confidence_score, "
    f"{KEYWORD_ESCALATE} AS should_escalate, '' AS escalation_reason FROM ok)"
)

BARE = (
    f"CASE WHEN starts_with({strip('answer')}, '```') THEN "
    + strip(f"regexp_replace({strip('answer')}, '```(json|JSON)?', '', 'g')")
    + f" ELSE {strip('answer')} END"
)


def truthy(name):
    text = f"json_extract_string(j, '$.{name}')"
    return (
        f"CASE coalesce(json_type(j, '$.{name}'), 'NULL') WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN {text} = 'true' "
        f"WHEN 'VARCHAR' THEN length({text}) > 0 WHEN 'ARRAY' THEN {text} <> '[]' WHEN 'OBJECT' THEN {text} <> '{{}}' "
        f"ELSE TRY_CAST({text} AS DOUBLE) <> 0 END"
    )


PARSED = (
    f"raw AS (SELECT thread_id, {BARE} AS bare FROM answers_v), "
    "js AS (SELECT *, TRY_CAST(bare AS JSON) AS j0 FROM raw), "
    "ob AS (SELECT *, CASE WHEN bare <> '' AND json_type(j0) = 'OBJECT' THEN j0 END AS j FROM js), "
    "pa AS (SELECT thread_id, CASE WHEN j IS NOT NULL THEN CASE WHEN json_extract_string(j, '$.intent') IN ("
    + ", ".join(quote(i) for i in terms.INTENTS)
    + ") THEN json_extract_string(j, '$.intent') ELSE 'other' END END AS intent, "
    "CASE WHEN j IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, "
    "coalesce(TRY_CAST(json_extract_string(j, '$.confidence_score') AS DOUBLE), 0.0::DOUBLE))) END AS confidence, "
    f"CASE WHEN j IS NOT NULL THEN {truthy('should_escalate')} END AS escalate, "
    f"CASE WHEN j IS NOT NULL THEN CASE WHEN {truthy('escalation_reason')} THEN trim(json_extract_string(j, '$.escalation_reason')) "
    "ELSE '' END END AS reason, "
    "CASE WHEN j IS NOT NULL THEN NULL WHEN bare = '' THEN 'empty answer' WHEN j0 IS NULL THEN 'malformed JSON' "
    "ELSE 'not a JSON object' END AS error FROM ob)"
)


def score(name):
    v = f"TRY_CAST(json_extract_string(j, '$.{name}') AS INTEGER)"
    return f"CASE WHEN {v} BETWEEN 1 AND 5 THEN {v} END"


def nearest(k, distance="list_distance", kb="embeddings"):
    return (
        "SELECT q, n, rk, round_even(d, 6) AS distance FROM (SELECT q, n, d, row_number() OVER (PARTITION BY q ORDER BY d, n) AS rk FROM ("
        f"SELECT a.vec_id AS q, b.vec_id AS n, min({distance}(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d "
        f"FROM embeddings a JOIN {kb} b ON a.vec_id <> b.vec_id GROUP BY ALL)) WHERE rk <= {k}"
    )


def bucketed(k, tables, bits, seed, width=64):
    """Neighbours that share the code of a table, the sides of its random planes."""
    normals = np.random.default_rng(seed).standard_normal((width, tables * bits)).T.tolist()
    planes = "[" + ", ".join("[" + ", ".join(str(normals[t * bits + b]) for b in range(bits)) + "]" for t in range(tables)) + "]"
    return (
        f"WITH p AS (SELECT unnest(range({tables})) AS t, unnest(CAST({planes} AS DOUBLE[][][])) AS normals), "
        "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
        "c AS (SELECT vec_id, t, list_transform(normals, lambda x: list_dot_product(v, x) > 0) AS code FROM e, p), "
        "x AS (SELECT DISTINCT a.vec_id AS q, b.vec_id AS n FROM c a JOIN c b ON a.t = b.t AND a.code = b.code AND a.vec_id <> b.vec_id) "
        "SELECT q, n, rk, round_even(d, 6) AS distance FROM (SELECT q, n, d, row_number() OVER (PARTITION BY q ORDER BY d, n) AS rk "
        f"FROM (SELECT q, n, list_distance(a.v, b.v) AS d FROM x JOIN e a ON a.vec_id = q JOIN e b ON b.vec_id = n)) WHERE rk <= {k}"
    )


SIGNAL_JSON = (
    "'{\"physical_damage\":' || CAST(physical_damage AS VARCHAR) || ',\"refund_or_charge\":' || "
    "CAST(refund_or_charge AS VARCHAR) || ',\"pii\":' || CAST(pii AS VARCHAR) || ',\"toxic\":' || CAST(toxic AS VARCHAR) || '}'"
)
JUDGED = (
    "SELECT * FROM eval_v WHERE length(trim(drafted_reply)) > 0 AND judge_tone IS NULL "
    "ORDER BY md5('42|' || CAST(thread_id AS VARCHAR)), thread_id LIMIT 10"
)
CLASSIFY = (
    f"'Kinds: {', '.join(terms.INTENTS)}' || chr(10) || 'Signs: ' || {SIGNAL_JSON} || chr(10) || 'Text: ' || customer_text || chr(10) || "
    "'Answer {\"a\": 1} with intent, confidence_score, should_escalate, escalation_reason'"
)


def reply_text(cases):
    return f"'Earlier:' || chr(10) || {cases} || chr(10) || '---' || chr(10) || customer_text"



def _payload(section, body, source):
    return f"SELECT {quote(section)} AS section, CAST(to_json({body}) AS VARCHAR) AS payload_json FROM {source}"


def _percent(v):
    return f"round_even(({v}) * 100, 2)"


DASHBOARD = " UNION ALL ".join([
    _payload(
        "executive_summary",
        f"{{'agent_accuracy': {_percent(over('hits', 'valid'))}, 'majority_accuracy': {_percent('mj.accuracy')}, "
        f"'gap': {_percent('mj.accuracy - ' + over('hits', 'valid'))}, "
        + ", ".join(f"'esc_{k}': {_percent(PRF[k])}" for k in ("accuracy", "precision", "recall"))
        + f", 'esc_f1': round_even({PRF['f1']}, 4), 'total': n, 'intent_valid': valid, 'esc_valid': esc_valid}}",
        "c, mj, ed",
    ),
    _payload(
        "class_wise",
        "{'classes': list({'intent': l, 'prec': prec, 'rec': rec, 'f1': f1, 'support': support} ORDER BY l), "
        "'total_classes': count(*)}", "m",
    ),
    _payload(
        "confusion_matrices",
        "{'cells': list({'field': f, 'true_label': t, 'pred_label': q, 'n': n} ORDER BY f, t, q)}", "cells",
    ),
    _payload(
        "safety_failures",
        "{'false_negatives': list({'case_id': printf('#FN-%03d', i), 'thread_id': thread_id, 'category': category, "
        "'context': context, 'pred_missing': pred_missing} ORDER BY i) FILTER (i <= 10), 'total': count(*)}", "missed",
    ),
    "SELECT 'rag_evidence', '{\"rag_examples\":[]}'",
    "SELECT 'judge_scores', CAST(to_json({'scores': [{'score': 'grounding', 'mean': round_even(grounding, 2), "
    "'samples': grounding_n}, {'score': 'tone', 'mean': round_even(tone, 2), 'samples': tone_n}]}) AS VARCHAR) FROM c",
    _payload(
        "failure_cases",
        "{'cases': list({'case_id': 'Case ' || i, 'thread_id': thread_id, 'predicted': pred_intent, 'actual': true_intent, "
        "'preview': substr(coalesce(customer_text, ''), 1, 100)} ORDER BY i) FILTER (i <= 5), 'total': count(*)}", "cases",
    ),
    _payload(
        "intent_distribution",
        "{'labels': list(label ORDER BY n DESC, label), 'values': list(n ORDER BY n DESC, label)}",
        "(SELECT lower(trim(true_intent)) AS label, count(*) AS n FROM eval_v WHERE true_intent IS NOT NULL GROUP BY 1)",
    ),
    "SELECT 'accuracy_comparison', CAST(to_json({'models': ["
    + ", ".join(
        f"{{'model': '{k}', 'accuracy': {_percent(v)}}}"
        for k, v in (("agent", over("hits", "valid")), ("keyword", over("kw", "labelled")), ("majority", "mj.accuracy"))
    )
    + "]}) AS VARCHAR) FROM c, mj",
])
DASHBOARD_PARTS = (
    f"ed AS ({escalation('dashboard')}), "
    "cells AS (SELECT 'intent' AS f, a.l AS t, b.l AS q, CAST(coalesce(p.n, 0) AS BIGINT) AS n FROM labels a CROSS JOIN labels b "
    "LEFT JOIN p ON p.t = a.l AND p.q = b.l UNION ALL SELECT 'escalation', 'escalate', 'escalate', tp FROM ed UNION ALL "
    "SELECT 'escalation', 'auto-reply', 'escalate', fp FROM ed UNION ALL SELECT 'escalation', 'escalate', 'auto-reply', fn FROM ed "
    "UNION ALL SELECT 'escalation', 'auto-reply', 'auto-reply', tn FROM ed), "
    "missed AS (SELECT row_number() OVER (ORDER BY thread_id) AS i, thread_id, coalesce(escalation_reason, 'Escalation Required') AS category, "
    "substr(coalesce(customer_text, ''), 1, 100) || '...' AS context, pred_escalate IS NULL AS pred_missing FROM eval_v "
    f"WHERE {true_word('true_escalate', 'dashboard')} AND NOT coalesce({true_word('pred_escalate', 'dashboard')}, false)), "
    "cases AS (SELECT row_number() OVER (ORDER BY thread_id) AS i, * FROM eval_v "
    "WHERE NOT coalesce(lower(trim(true_intent)) = lower(trim(pred_intent)), false))"
)


def _sql():
    def q(names, body, ctes=""):
        """Query over views, with further CTEs."""
        head = with_views(names, "")
        if ctes:
            head = f"{head.rstrip()}, {ctes} " if head else f"WITH {ctes} "
        return head + body

    ev, ms = ["eval_v"], ["messages_v"]
    return {
        "class_metrics": q(ev, "SELECT l AS intent, prec, rec, f1, support FROM m", PAIRS),
        "confusion_intent": q(
            ev, "SELECT a.l AS true_label, b.l AS pred_label, CAST(coalesce(p.n, 0) AS BIGINT) AS n "
            "FROM labels a CROSS JOIN labels b LEFT JOIN p ON p.t = a.l AND p.q = b.l", PAIRS),
        "confusion_escalation": q(
            ev, "SELECT 'escalate' AS true_label, 'escalate' AS pred_label, tp AS n FROM ed UNION ALL "
            "SELECT 'auto-reply', 'escalate', fp FROM ed UNION ALL SELECT 'escalate', 'auto-reply', fn FROM ed "
            "UNION ALL SELECT 'auto-reply', 'auto-reply', tn FROM ed", f"ed AS ({escalation('dashboard')})"),
        "executive_summary": q(
            ev, f"SELECT {over('hits', 'valid')} AS agent_accuracy, mj.accuracy AS majority_accuracy, "
            f"mj.accuracy - {over('hits', 'valid')} AS gap, "
            + ", ".join(f"{v} AS esc_{k}" for k, v in PRF.items())
            + ", n AS total, valid AS intent_valid, esc_valid FROM c, mj, ed",
            f"{PAIRS}, {COUNTS}, {MAJORITY}, ed AS ({escalation('dashboard')})"),
        "weighted_prf": q(
            ev, "SELECT l AS label, " + ", ".join(
                f"CASE WHEN sum(support) = 0 THEN 0.0::DOUBLE ELSE {folded(f'{c} * support')} / sum(support) END AS {n}"
                for c, n in (("prec", "precision"), ("rec", "recall"), ("f1", "f1"))) + " FROM m GROUP BY ROLLUP (l)", PAIRS),
        "mismatch_cases": q(
            ev, "SELECT '#MM-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') AS case_id, thread_id, pred_intent, true_intent "
            "FROM (SELECT *, row_number() OVER (ORDER BY thread_id) AS n FROM eval_v WHERE NOT coalesce(lower(trim(true_intent)) = lower(trim(pred_intent)), false))"),
        "classification_report": q(
            ev, "SELECT l AS row, prec, rec, f1, support FROM m UNION ALL SELECT 'macro avg', "
            + ", ".join(f"{folded(c)} / count(*)" for c in ("prec", "rec", "f1"))
            + ", CAST(sum(support) AS BIGINT) FROM m UNION ALL SELECT 'weighted avg', "
            + ", ".join(f"{folded(f'{c} * support')} / sum(support)" for c in ("prec", "rec", "f1"))
            + f", CAST(sum(support) AS BIGINT) FROM m UNION ALL SELECT 'accuracy', NULL, NULL, {over('hits', 'valid')}, valid FROM c",
            f"{PAIRS}, {COUNTS}"),
        "accuracy": q(ev, f"SELECT {over('hits', 'valid')} AS accuracy, valid AS total FROM c", COUNTS),
        "label_union": q(ev, "SELECT l AS label FROM labels", PAIRS),
        "label_distribution": q(
            ev, "SELECT lower(trim(true_intent)) AS label, count(*) AS n, CAST(count(*) AS DOUBLE) / "
            "(SELECT count(true_intent) FROM eval_v) AS share FROM eval_v WHERE true_intent IS NOT NULL GROUP BY 1"),
        "majority_label": q(
            ev, "SELECT 'intent' AS field, label, accuracy FROM mj UNION ALL SELECT 'escalation', label, accuracy FROM me",
            f"{PAIRS}, {MAJORITY}"),
        "accuracy_comparison": q(
            ev, "SELECT 'majority' AS model, accuracy FROM mj UNION ALL "
            f"SELECT 'keyword', {over('kw', 'labelled')} FROM c UNION ALL SELECT 'agent', {over('hits', 'valid')} FROM c",
            f"{PAIRS}, {COUNTS}, {MAJORITY}"),
        "baseline_report": q(
            ev, "SELECT section, name, value, CAST(NULL AS VARCHAR) AS label FROM ("
            + lines("c", "DATASET", {"rows": "n", "intent_rows": "valid", "escalation_rows": "esc_valid"}) + " UNION ALL "
            + lines("c", "INTENT", {"keyword_accuracy": over("kw", "labelled"), "agent_accuracy": over("hits", "valid")})
            + " UNION ALL " + lines("c", "ESCALATION", {"keyword_accuracy": over("kwe", "esc_known")}) + " UNION ALL "
            + lines("eh", "ESCALATION", {f"agent_{k}": v for k, v in PRF.items()}) + f" UNION ALL {REPLY_JUDGE}) UNION ALL "
            "SELECT 'INTENT', 'majority_accuracy', accuracy, label FROM mj UNION ALL "
            "SELECT 'ESCALATION', 'majority_accuracy', accuracy, label FROM me",
            f"{PAIRS}, {COUNTS}, {MAJORITY}"),
        "evaluation_report": q(ev, EVALUATION, f"{PAIRS}, {COUNTS}, {MAJORITY}"),
        "dashboard": q(ev, DASHBOARD, f"{PAIRS}, {COUNTS}, {MAJORITY}, {DASHBOARD_PARTS}"),
        "dataset_audit": q(
            ["eval_v", "threads_v"],
            lines("c", "COVERAGE", {"rows": "n", "intent_rows": "valid", "escalation_rows": "esc_valid", "completed": "completed"})
            + " UNION ALL SELECT 'LABELS', l, CAST(su AS DOUBLE) FROM k WHERE su > 0 UNION ALL "
            "SELECT 'LEAKAGE', 'id', CAST(count(*) AS DOUBLE) FROM threads_v WHERE thread_id IN (SELECT thread_id FROM g) AND thread_id IN "
            "(SELECT thread_id FROM threads_v WHERE thread_id NOT IN (SELECT thread_id FROM g)) UNION ALL SELECT 'LEAKAGE', 'text', CAST(count(*) AS DOUBLE) FROM threads_v "
            f"WHERE thread_id IN (SELECT thread_id FROM g) AND md5(lower({strip('customer_text')})) IN (SELECT "
            f"md5(lower({strip('customer_text')})) FROM threads_v WHERE thread_id NOT IN (SELECT thread_id FROM g))",
            f"{PAIRS}, {COUNTS}, {GOLDEN}"),
        "judge_scores": q(
            ev, "SELECT 'tone' AS score, tone AS mean, tone_n AS samples FROM c UNION ALL "
            "SELECT 'grounding', grounding, grounding_n FROM c", COUNTS),
        "safety_failures": q(
            ev, "SELECT thread_id, coalesce(escalation_reason, 'Escalation Required') AS category, "
            "substr(coalesce(customer_text, ''), 1, 100) || '...' AS context, pred_escalate IS NULL AS pred_missing, "
            "count(*) OVER () AS total "
            f"FROM eval_v WHERE {true_word('true_escalate', 'dashboard')} AND NOT coalesce({true_word('pred_escalate', 'dashboard')}, false) "
            "ORDER BY thread_id LIMIT 10"),
        "failure_cases": q(
            ev, "SELECT thread_id, pred_intent AS predicted, true_intent AS actual, substr(coalesce(customer_text, ''), 1, 100) AS preview, "
            "count(*) OVER () AS total FROM eval_v WHERE NOT coalesce(lower(trim(true_intent)) = lower(trim(pred_intent)), false) "
            "ORDER BY thread_id LIMIT 5"),
        "raw_mismatches": q(
            ev, "SELECT thread_id, pred_intent AS predicted, true_intent AS actual, substr(coalesce(customer_text, ''), 1, 100) AS preview, "
            "count(*) OVER () AS total FROM eval_v WHERE NOT coalesce(true_intent = pred_intent, false)"),
        "confusion_wide": q(
            ev, "SELECT a.l AS true_label, " + ", ".join(
                f"CAST(coalesce((SELECT sum(n) FROM p WHERE p.t = a.l AND p.q = '{i}'), 0) AS BIGINT) AS {i}" for i in terms.INTENTS)
            + " FROM (VALUES " + ", ".join(f"('{i}')" for i in terms.INTENTS) + ") a(l)", PAIRS),
        "evaluation_report_raw": q(
            ev, EVALUATION, f"{PAIRS}, {COUNTS}, {MAJORITY}".replace("lower(trim(true_intent))", "true_intent").replace(
                "lower(trim(pred_intent))", "pred_intent")),
        "judge_again": q(
            ev, "SELECT CAST(thread_id AS VARCHAR) AS thread_id, CAST(1 + (coalesce(length(CASE WHEN thread_id % 4 <> 0 THEN customer_text END), 0) + length(drafted_reply) + 45) % 5 AS INT) AS judge_tone, "
            "3 AS judge_grounding FROM (SELECT * FROM eval_v WHERE length(trim(drafted_reply)) > 0 "
            "ORDER BY md5('42|' || CAST(thread_id AS VARCHAR)), CAST(thread_id AS VARCHAR) LIMIT 20)"),
        "evaluate": q(
            ["golden_v"], EVALUATED,
            f"{GIVEN}, src AS (SELECT *, CASE length(customer_text) % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(terms.INTENTS))
            + " END AS intent, CAST(length(customer_text) % 10 AS DOUBLE) / 10 AS confidence_score, false AS should_escalate, '' AS escalation_reason "
            f"FROM ok), {decided('src')}"),
        "intent_mismatches": q(
            ev, "SELECT thread_id, pred_intent, true_intent FROM eval_v "
            "WHERE NOT coalesce(lower(trim(true_intent)) = lower(trim(pred_intent)), false)"),
        "diagnostics": q(
            ev, "SELECT 'majority_share' AS name, CAST(max(su) AS DOUBLE) / sum(su) AS value FROM k WHERE su > 0 UNION ALL "
            "SELECT 'rare_classes', CAST(count(*) AS DOUBLE) FROM k WHERE su > 0 AND su < 0.05 * (SELECT sum(su) FROM k) UNION ALL "
            "SELECT 'smallest_class', CAST(min(su) AS DOUBLE) FROM k WHERE su > 0 UNION ALL "
            f"SELECT 'escalation_precision', {PRF['precision']} FROM ed UNION ALL "
            f"SELECT 'escalation_miss_rate', {over('fn', 'tp + fn')} FROM ed",
            f"{PAIRS}, ed AS ({escalation('dashboard')})"),
        "toxic_rule_quality": (
            f"WITH x AS (SELECT toxic = 1 AS t, {hit('text', terms.TOXIC_TERMS)} AS r FROM documents JOIN labels USING (doc_id)), "
            "e AS (SELECT count(*) FILTER (t AND r) AS tp, count(*) FILTER (NOT t AND r) AS fp, count(*) FILTER (t AND NOT r) AS fn, "
            "count(*) FILTER (NOT t AND NOT r) AS tn FROM x) SELECT " + ", ".join(f"{v} AS {k}" for k, v in PRF.items()) + " FROM e"),
        "judge_sample": q(ev, "SELECT thread_id FROM js", f"js AS ({JUDGED})"),
        "apply_judgements": q(
            ev, "SELECT thread_id, CASE WHEN length(trim(drafted_reply)) > 0 AND judge_tone IS NULL THEN "
            "CAST(1 + length(drafted_reply) % 5 AS VARCHAR) ELSE judge_tone END AS judge_tone, "
            "CASE WHEN length(trim(drafted_reply)) > 0 AND judge_tone IS NULL THEN "
            "coalesce(CAST(1 + length(customer_text) % 5 AS VARCHAR), judge_grounding) ELSE judge_grounding END AS judge_grounding FROM eval_v"),
        "pending": q(
            ev + ms, "SELECT CAST(thread_id AS VARCHAR) AS thread_id FROM messages_v WHERE thread_id NOT IN "
            "(SELECT thread_id FROM eval_v WHERE pred_intent IS NOT NULL)"),
        "append_results": q(
            ev, "SELECT thread_id, pred_intent, CASE WHEN pred_escalate IS NOT NULL THEN judge_tone END AS judge_tone FROM eval_v"),
        "label_queue": q(ev, "SELECT thread_id FROM eval_v WHERE true_intent IS NULL"),
        "apply_labels": q(
            ["label_events_v"],
            "SELECT t.thread_id, i.intent AS true_intent, CASE WHEN code IS NULL THEN NULL WHEN lower(escalate) = 'y' THEN 1 ELSE 0 END AS should_escalate, "
            "CASE WHEN code IS NULL THEN NULL WHEN lower(escalate) = 'y' THEN reason ELSE 'Safe for auto-reply' END AS reason "
            "FROM (SELECT DISTINCT thread_id FROM label_events_v) t LEFT JOIN (SELECT * FROM label_events_v WHERE code <> '8' "
            "QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) = 1) e ON e.thread_id = t.thread_id "
            "LEFT JOIN (VALUES " + ", ".join(f"('{c}', '{i}')" for c, i in terms.LABEL_CODES.items()) + ") i(c, intent) ON i.c = e.code"),
        "error_class": q(
            ["errors_v"], "SELECT id, CASE WHEN lower(error) LIKE '%model\\_unavailable%' ESCAPE '\\' OR lower(error) LIKE '%model is currently unavailable%' "
            "OR lower(error) LIKE '%model unavailable%' THEN 'model' WHEN "
            + hit("error", terms.QUOTA_ERROR_TERMS) + " THEN 'quota' ELSE 'other' END AS error_class FROM errors_v"),
        "signals": q(ms, f"SELECT thread_id, {SIGNALS} FROM messages_v"),
        "pii_documents": (
            f"SELECT doc_id, regexp_matches(text, {quote(terms.EMAIL_PATTERN)}) AS has_email, "
            f"regexp_matches(text, {quote(terms.PHONE_PATTERN)}) AS has_phone FROM documents"),
        "document_rules": (
            f"SELECT doc_id, {SIGNALS.replace('customer_text', 'text')}, {keyword_intent('text')} AS intent, "
            f"{hit('text', terms.ESCALATE_TERMS)} AS escalate FROM documents"),
        "keyword_intent": q(ms, f"SELECT thread_id, {keyword_intent('customer_text')} AS intent FROM messages_v"),
        "keyword_escalate": q(ms, f"SELECT thread_id, {KEYWORD_ESCALATE} AS escalate FROM messages_v"),
        "valid_messages": q(
            ms, f"SELECT thread_id, CASE WHEN customer_text IS NULL THEN 'missing' WHEN length({strip('customer_text')}) = 0 THEN 'empty' "
            f"WHEN length({strip('customer_text')}) > 1000 THEN 'too_long' ELSE 'ok' END AS status, {strip('customer_text')} AS text FROM messages_v"),
        "triage_rules": q(
            ["messages_v", "analysis_v"],
            "SELECT thread_id, final_intent AS intent, final_escalate AS should_escalate, final_reason AS reason, status FROM z",
            f"{VALID}, src AS (SELECT * FROM ok JOIN analysis_v USING (thread_id)), {decided('src')}"),
        "clip_reply": q(
            ["threads_v"],
            f"SELECT thread_id, CASE WHEN length(r) > 280 THEN rtrim(substr(r, 1, 277), {quote(BLANKS)}) || '...' ELSE r END AS reply FROM u",
            f"s AS (SELECT thread_id, {strip('agent_text')} AS a FROM threads_v), "
            f"u AS (SELECT thread_id, CASE WHEN length(a) >= 2 AND a LIKE '\"%' AND a LIKE '%\"' THEN {strip('substr(a, 2, length(a) - 2)')} ELSE a END AS r FROM s)"),
        "parse_answer": q(
            ["answers_v"], "SELECT thread_id AS id, intent, confidence, escalate, reason, error FROM pa", PARSED),
        "lenient_answers": q(["lenient_v"], """
SELECT thread_id AS id, CASE WHEN k IN (4, 5) THEN NULL WHEN k = 1 THEN 'hardware_repair' ELSE 'other' END AS intent,
  CAST(CASE k WHEN 0 THEN '0.4' WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN '1' WHEN 6 THEN CAST(user_id % 100 AS VARCHAR) || 'e-2' END AS DOUBLE) AS confidence,
  CASE WHEN k NOT IN (4, 5) THEN k = 1 END AS escalate,
  CASE k WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN '[''a'', 1, True, None, {''b c'': ' || CAST(user_id AS VARCHAR) || '}]'
    WHEN 3 THEN 'NaN, Infinity' WHEN 6 THEN '{''' || event_type || ''': []}' END AS reason,
  CASE WHEN k = 4 THEN 'not a JSON object' WHEN k = 5 THEN 'malformed JSON' END AS error
FROM (SELECT *, thread_id % 7 AS k FROM lenient_v)"""),
        "parse_judgement": q(
            ["answers_v"], f"SELECT thread_id AS id, {score('score_tone')} AS tone, {score('score_grounding')} AS grounding FROM ob",
            PARSED.rsplit(", pa AS", 1)[0]),
        "requests": q(
            ev + ms, f"SELECT CAST(thread_id AS VARCHAR) AS id, 'classify' AS kind, {CLASSIFY} AS prompt FROM s UNION ALL "
            f"SELECT CAST(thread_id AS VARCHAR), 'reply', {reply_text(quote(terms.NO_EXAMPLES))} FROM s UNION ALL "
            "SELECT CAST(thread_id AS VARCHAR), 'judge', coalesce(customer_text, '') || chr(10) || '=>' || chr(10) || drafted_reply || chr(10) || "
            "'(score_tone, score_grounding, reasoning)' FROM jd",
            f"{VALID}, s AS (SELECT *, {SIGNALS} FROM ok), jd AS ({JUDGED})"),
        "score_batches": q(
            ms, "SELECT CAST(thread_id AS VARCHAR) AS id, CASE WHEN contains(lower(customer_text), 'crash') THEN NULL ELSE "
            "'{\"chars\":' || CAST(length(customer_text) AS VARCHAR) || '}' END AS answer, "
            "CASE WHEN contains(lower(customer_text), 'crash') THEN 'timeout' END AS error FROM ok", VALID),
        "triage_batch": q(
            ["messages_v", "answers_v", "drafts_v"],
            "SELECT CAST(z.thread_id AS VARCHAR) AS thread_id, CASE WHEN error IS NULL THEN status END AS status, "
            "CASE WHEN error IS NULL THEN final_intent END AS intent, CASE WHEN error IS NULL THEN final_reason END AS reason, "
            f"CASE WHEN error IS NULL AND status = 'auto_handled' THEN CASE WHEN length(r) > 280 THEN rtrim(substr(r, 1, 277), {quote(BLANKS)}) || '...' ELSE r END END AS reply, "
            "CASE WHEN error IS NULL AND status = 'auto_handled' THEN CAST(coalesce(found, 0) AS BIGINT) END AS retrieved_examples, error FROM z "
            f"LEFT JOIN (SELECT q, count(*) AS found FROM ({nearest(3)}) GROUP BY q) f ON f.q = z.thread_id "
            f"LEFT JOIN (SELECT thread_id, {strip('substr(answer, 2, length(answer) - 2)')} AS r FROM drafts_v) w ON w.thread_id = z.thread_id",
            f"{VALID}, {PARSED}, src AS (SELECT ok.thread_id, customer_text, intent, confidence AS confidence_score, "
            f"escalate AS should_escalate, reason AS escalation_reason, error FROM ok JOIN pa USING (thread_id)), {decided('src')}"),
        "pair_threads": q(["threads_v"], "SELECT * FROM threads_v"),
        "reply_parents": q(
            ["tweets_v"], "SELECT tweet_id FROM tweets_v WHERE tweet_id IN (SELECT in_response_to_tweet_id FROM tweets_v WHERE author_id = 'BrandSupport')"),
        "extract_threads": q(
            ["tweets_v"],
            "SELECT c.tweet_id AS thread_id, c.text AS customer_text, b.text AS agent_text FROM b JOIN tweets_v c ON c.tweet_id = b.in_response_to_tweet_id "
            "WHERE length(c.text) > 15 ORDER BY md5('42|' || CAST(b.tweet_id AS VARCHAR)), b.tweet_id LIMIT 20",
            "b AS (SELECT * FROM tweets_v WHERE author_id = 'BrandSupport' AND in_response_to_tweet_id IS NOT NULL "
            "ORDER BY md5('42|' || CAST(tweet_id AS VARCHAR)), tweet_id LIMIT 30)"),
        "all_threads": q(["threads_v"], "SELECT * FROM threads_v"),
        "seeded_sample": q(
            ["threads_v"], "SELECT thread_id FROM (SELECT DISTINCT thread_id FROM threads_v) ORDER BY md5('42|' || CAST(thread_id AS VARCHAR)), thread_id LIMIT 15"),
        "prepare": q(
            ["threads_v"],
            "SELECT 'id' AS kind, count(*) AS n FROM b WHERE thread_id IN (SELECT thread_id FROM o) UNION ALL "
            "SELECT 'text', count(*) FROM b WHERE k IN (SELECT k FROM o)",
            f"{GOLDEN}, {HALF.replace('g AS', 'first AS', 1)}, "
            f"b AS (SELECT thread_id, md5(lower({strip('customer_text')})) AS k FROM threads_v WHERE thread_id IN (SELECT thread_id FROM g)), "
            f"o AS (SELECT thread_id, md5(lower({strip('customer_text')})) AS k FROM threads_v WHERE thread_id NOT IN (SELECT thread_id FROM first))"),
        "read_tweets": q(
            ["tweets_v"], "SELECT tweet_id, author_id, text || chr(10) || '\"quoted\", and more' AS text, "
            "CASE WHEN tweet_id % 7 <> 0 THEN in_response_to_tweet_id END AS in_response_to_tweet_id FROM tweets_v"),
        "normalize_id": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id END AS id FROM events",
        "thread_table": q(["threads_v"], "SELECT CAST(thread_id AS VARCHAR) AS thread_id, customer_text, agent_text FROM threads_v"),
        "split_table": q(
            ["threads_v"], "SELECT thread_id, customer_text, CASE WHEN thread_id IN (SELECT thread_id FROM g) THEN 'golden' ELSE 'kb' END AS split "
            "FROM threads_v", GOLDEN),
        "result_table": q(
            ["golden_v"], "SELECT CAST(thread_id AS VARCHAR) AS thread_id, customer_text, true_intent, CAST(NULL AS INT) AS judge_tone FROM golden_v"),
        "message_chunks": q(ms, "SELECT * FROM messages_v"),
        "golden_split": q(
            ["threads_v"], "SELECT thread_id, CASE WHEN thread_id IN (SELECT thread_id FROM g) THEN 'golden' ELSE 'kb' END AS split FROM threads_v", GOLDEN),
        "leakage_audit": q(
            ["split_docs_v"],
            "SELECT 'id' AS kind, CAST(count(*) AS BIGINT) AS n FROM split_docs_v WHERE split = 'golden' AND doc_id IN (SELECT doc_id FROM split_docs_v WHERE split = 'kb') "
            "UNION ALL SELECT 'text', count(*) FROM h WHERE split = 'golden' AND k IN (SELECT k FROM h WHERE split = 'kb')",
            f"h AS (SELECT split, md5(lower({strip('text')})) AS k FROM split_docs_v)"),
        "knowledge_base": q(
            ["threads_v"], kb_of("(SELECT * FROM threads_v WHERE thread_id NOT IN (SELECT thread_id FROM g))"), GOLDEN),
        "similar_issues": nearest(5),
        "similar_issues_tiles": nearest(5),
        "similar_issues_buckets": bucketed(5, 12, 5, terms.EXTRACT_SEED),
        "similar_issues_cosine": nearest(3, "list_cosine_distance"),
        "similar_issues_repeated": nearest(
            4, kb="(SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1, embedding FROM embeddings WHERE vec_id % 3 = 0)"),
        "rag_evidence": q(
            ["cases_v"], "SELECT x.q, x.n, distance, CASE WHEN c.n IS NOT NULL THEN substr(coalesce(customer_text, ''), 1, 100) END AS original_customer, "
            f"CASE WHEN c.n IS NOT NULL THEN substr(coalesce(agent_text, ''), 1, 100) END AS retrieved_reply FROM ({nearest(1)}) x LEFT JOIN cases_v c ON c.n = x.n"),
        "reply_requests": q(
            ["cases_v", "messages_v"],
            "SELECT CAST(thread_id AS VARCHAR) AS id, 'reply' AS kind, "
            f"{reply_text('coalesce(cases, ' + quote(terms.NO_EXAMPLES) + ')')} AS prompt FROM messages_v LEFT JOIN ("
            "SELECT q, string_agg('Case ' || i || chr(10) || 'Customer: ' || coalesce(customer_text, '') || chr(10) || 'Agent: ' || "
            "coalesce(agent_text, ''), chr(10) || chr(10) ORDER BY i) AS cases FROM (SELECT x.q, c.*, "
            f"row_number() OVER (PARTITION BY x.q ORDER BY rk) AS i FROM ({nearest(5)}) x JOIN cases_v c ON c.n = x.n) GROUP BY q) ON q = thread_id "
            "WHERE customer_text IS NOT NULL"),
        "triage_stream": q(
            ms, "SELECT CAST(thread_id AS VARCHAR) AS thread_id, status FROM z UNION ALL "
            "SELECT CAST(thread_id AS VARCHAR), CASE WHEN customer_text IS NULL THEN 'missing' "
            f"WHEN length({strip('customer_text')}) = 0 THEN 'empty' ELSE 'too_long' END FROM messages_v WHERE thread_id NOT IN (SELECT thread_id FROM ok)",
            f"{VALID}, {RULED}, {decided('ruled')}"),
        "evaluate_stream": q(
            ["golden_v"], EVALUATED,
            f"{GIVEN}, {RULED.replace('SELECT thread_id, customer_text,', 'SELECT thread_id, customer_text, true_intent, truth,')}, {decided('ruled')}"),
        "kb_stream": q(["threads_v"], f"SELECT id, document FROM ({kb_of('threads_v')})"),
    }


ORACLE = _sql()
ORACLE["summary_table"] = ORACLE["baseline_report"]
# The same rows by another way.
ORACLE["kb_stream_merged"] = ORACLE["kb_stream"]
ORACLE["label_stream"] = ORACLE["apply_labels"]
ORACLE["growing_report"] = ORACLE["evaluation_report"]
ORACLE["result_versions"] = ORACLE["apply_judgements"]
