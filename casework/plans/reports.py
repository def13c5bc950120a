"""Reports over the result table.

``scorecard`` reads the results once and counts everything the metric reports need per
(true, predicted) label pair. It has a row per pair, so each report is a projection of a
small table; Catalyst drops the counts a report does not use before the scan.

Most reports are one chain on top of it and read the results once. Those that need the card in
several places (``evaluation_report``, ``dashboard``) store it first, which runs one job; give
them a stored card to build several reports from one pass.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions import rules, terms
from casework.functions.text import (
    case_id, escalation_class, flag, half_even, has_reply, normalize_label, numeric_or_null, percent, preview,
)
from casework.operators import metrics
from casework.operators.metrics import binary_columns, ratio
from casework.operators.numbering import numbered
from casework.operators.threads import leakage_audit
from casework.sources.schemas import REQUIRED
from casework.sources.tables import as_json, require_columns, stored, to_payload

JUDGES = {"tone": "judge_tone", "grounding": "judge_grounding", "helpfulness": "judge_helpfulness"}
RARE_SHARE = 0.05


def scorecard(results: DataFrame, normalize: bool = True) -> DataFrame:
    """Counts per (true_label, pred_label); either label may be null.

    Without ``normalize`` the labels are compared as they are, by every report on the card.
    """
    require_columns(results, REQUIRED["results"])
    both = F.col("true_escalate").isNotNull() & F.col("pred_escalate").isNotNull()
    known = F.col("true_escalate").isNotNull()
    clean = normalize_label if normalize else F.col
    truth, guess = clean("true_intent"), clean("pred_intent")
    sums = {
        "n": F.count("*"),
        "kw_hits": F.count_if(truth == rules.keyword_intent("customer_text")),
        "missed": F.count_if(_missed(results)),
        "esc_rows": F.count_if(both),
        "kwe_rows": F.count_if(known),
        "kwe_hits": F.count_if(
            known & (flag(results, "true_escalate") == rules.keyword_escalate("customer_text"))
        ),
    }
    for short, variant in (("h", "harness"), ("d", "dashboard")):
        t, p = flag(results, "true_escalate", variant), flag(results, "pred_escalate", variant)
        sums |= {
            f"{short}_tp": F.count_if(both & t & p),
            f"{short}_fp": F.count_if(both & ~t & p),
            f"{short}_fn": F.count_if(both & t & ~p),
            f"{short}_tn": F.count_if(both & ~t & ~p),
        }
    if "drafted_reply" in results.columns:
        sums["replies"] = F.count_if(has_reply("drafted_reply"))
    numbers = {"retrieved": "retrieved_examples", **JUDGES}
    for name, c in numbers.items():
        if c in results.columns:
            sums[f"{name}_sum"] = F.sum(numeric_or_null(c))
            sums[f"{name}_n"] = F.count(numeric_or_null(c))
    return results.groupBy(truth.alias("true_label"), guess.alias("pred_label")).agg(
        *[c.alias(name) for name, c in sums.items()]
    )


def card_pairs(card: DataFrame) -> DataFrame:
    """Pair counts of a scorecard, as ``metrics.pair_counts`` gives them."""
    return card.dropna(subset=["true_label", "pred_label"]).select("true_label", "pred_label", "n")


def _sum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _label_sums(card: DataFrame) -> list:
    """Sums of a scorecard's counts and of what follows from its labels."""
    t, p = F.col("true_label"), F.col("pred_label")
    return [
        *[_sum(c).alias(c) for c in card.columns if c not in ("true_label", "pred_label")],
        _sum(F.when(t.isNotNull() & p.isNotNull(), F.col("n"))).alias("intent_rows"),
        _sum(F.when(t == p, F.col("n"))).alias("intent_hits"),
        _sum(F.when(t.isNotNull(), F.col("n"))).alias("labelled"),
        _sum(F.when(p.isNotNull(), F.col("n"))).alias("completed"),
    ]


def _totals(card: DataFrame) -> DataFrame:
    """One row: all sums, and ``best`` (m: minus its count, label), the majority intent of the
    complete pairs. Going through per-label sums keeps it a single chain."""
    per_label = card.groupBy("true_label").agg(*_label_sums(card))
    counts = [c for c in per_label.columns if c != "true_label"]
    known = F.when(
        F.col("intent_rows") > 0,
        F.struct((-F.col("intent_rows")).alias("m"), F.col("true_label").alias("label")),
    )
    # The least of (minus count, label) settles ties on the smallest label.
    return per_label.agg(
        *[_sum(c).alias(c) for c in counts],
        F.min(F.when(F.col("true_label").isNotNull(), known)).alias("best"),
        F.sort_array(F.collect_list(_supported("intent_rows"))).alias("supports"),
    )


def _supported(c: str) -> Column:
    return F.when(F.col("true_label").isNotNull() & (F.col(c) > 0), F.col(c))


def _majority() -> Column:
    """Accuracy of always answering the majority intent, from a totals row."""
    return ratio(F.coalesce(-F.col("best.m"), F.lit(0)), "intent_rows")


def _escalation(prefix: str) -> dict:
    return binary_columns(*[f"{prefix}_{c}" for c in ("tp", "fp", "fn", "tn")])


def _line_structs(sections: dict, **more) -> list:
    """(section, name, value) structs of a totals row."""
    extra = [c.alias(name) for name, c in more.items()]
    return [
        F.struct(
            F.lit(section).alias("section"), F.lit(name).alias("name"),
            (F.col(v) if isinstance(v, str) else v).cast("double").alias("value"), *extra,
        )
        for section, values in sections.items()
        for name, v in values.items()
    ]


def _union(parts) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def executive_summary(results: DataFrame, card: DataFrame | None = None) -> DataFrame:
    card = scorecard(results) if card is None else card
    esc, agent = _escalation("d"), ratio("intent_hits", "intent_rows")
    return _totals(card).select(
        agent.alias("agent_accuracy"),
        _majority().alias("majority_accuracy"),
        (_majority() - agent).alias("gap"),
        *[esc[c].alias(f"esc_{c}") for c in ("accuracy", "precision", "recall", "f1")],
        F.col("n").alias("total"),
        F.col("intent_rows").alias("intent_valid"),
        F.col("esc_rows").alias("esc_valid"),
    )


def class_wise_performance(results: DataFrame, card: DataFrame | None = None) -> DataFrame:
    pairs = metrics.pair_counts(results, "true_intent", "pred_intent") if card is None else card_pairs(card)
    return metrics.class_metrics(pairs)


def escalation_pairs(results: DataFrame, variant: str = "dashboard") -> DataFrame:
    t, p = (escalation_class(flag(results, c, variant)) for c in ("true_escalate", "pred_escalate"))
    named = metrics.complete_pairs(results, "true_escalate", "pred_escalate").select(
        t.alias("true"), p.alias("pred")
    )
    return metrics.pair_counts(named, "true", "pred")


def confusion_matrices(results: DataFrame, card: DataFrame | None = None) -> dict:
    """``intent`` and ``escalation`` matrices, zero-filled."""
    yes, no = terms.ESCALATE_CLASS, terms.REPLY_CLASS
    if card is None:
        pairs = metrics.pair_counts(results, "true_intent", "pred_intent")
        escalation = metrics.confusion_matrix(escalation_pairs(results), (yes, no))
    else:
        pairs, places = card_pairs(card), {"tp": (yes, yes), "fp": (no, yes), "fn": (yes, no), "tn": (no, no)}
        cells = [
            F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"), F.col(f"d_{c}").alias("n"))
            for c, (t, p) in places.items()
        ]
        escalation = _totals(card).select(F.inline(F.array(*cells)))
    return {"intent": metrics.confusion_matrix(pairs), "escalation": escalation}


def _missed(results: DataFrame) -> Column:
    truth, guess = (flag(results, c, "dashboard") for c in ("true_escalate", "pred_escalate"))
    return truth & ~F.coalesce(guess, F.lit(False))


def missed_escalations(results: DataFrame) -> DataFrame:
    """All rows that needed a human and were not predicted so; a null prediction is a miss."""
    return results.filter(_missed(results))


def _first(rows: DataFrame, n: int | None) -> DataFrame:
    """First n rows by id (None: all), and in ``total`` how many there are."""
    counted = rows.agg(F.count("*").alias("total")).scalar()
    first = rows if n is None else rows.orderBy("thread_id").limit(n)
    return first.withColumn("total", counted)


def safety_failures(results: DataFrame, n: int | None = 10) -> DataFrame:
    """First n missed escalations by id (None: all), each with the ``total`` number."""
    return (
        _first(missed_escalations(results), n)
        .select(
            "thread_id",
            F.coalesce("escalation_reason", F.lit(terms.REASON_MISSING)).alias("category"),
            preview("customer_text", ellipsis=True).alias("context"),
            F.col("pred_escalate").isNull().alias("pred_missing"),
            "total",
        )
    )


def mismatches(results: DataFrame, considered: int | None = None, normalize: bool = True) -> DataFrame:
    """Rows whose intents differ, among all rows or the first ``considered`` ids.

    A null label equals nothing, not even null.
    """
    if considered is not None:
        results = results.orderBy("thread_id").limit(considered)
    clean = normalize_label if normalize else F.col
    same = clean("true_intent") == clean("pred_intent")
    return results.filter(~F.coalesce(same, F.lit(False)))


def failure_cases(
    results: DataFrame, n: int | None = 5, considered: int | None = None, normalize: bool = True
) -> DataFrame:
    """First n mismatches by id (None: all), each with the ``total`` number."""
    return _first(mismatches(results, considered, normalize), n).select(
        "thread_id",
        F.col("pred_intent").alias("predicted"),
        F.col("true_intent").alias("actual"),
        preview("customer_text").alias("preview"),
        "total",
    )


def judge_scores(results: DataFrame, card: DataFrame | None = None) -> DataFrame:
    """Rows (score, mean, samples) of the judge columns the results have."""
    names = [] if card is None else [n for n in JUDGES if f"{n}_sum" in card.columns]
    if not names:
        return metrics.score_summary(results, JUDGES)
    rows = [
        F.struct(F.lit(n).alias("score"), _mean(n).alias("mean"), F.col(f"{n}_n").alias("samples")) for n in names
    ]
    return _totals(card).select(F.inline(F.array(*rows)))


def intent_distribution(golden: DataFrame) -> DataFrame:
    return metrics.label_distribution(golden, "true_intent")


def _majority_rows() -> Column:
    """(field, label, accuracy) of both majority baselines, from a totals row."""
    yes, no = F.col("h_tp") + F.col("h_fn"), F.col("h_fp") + F.col("h_tn")
    return F.array(
        F.struct(
            F.lit("intent").alias("field"), F.col("best.label").alias("label"), _majority().alias("accuracy")
        ),
        F.struct(
            F.lit("escalation").alias("field"),
            F.when(yes > no, "true").otherwise("false").alias("label"),
            ratio(F.greatest(yes, no), yes + no).alias("accuracy"),
        ),
    )


def majority_labels(results: DataFrame, card: DataFrame | None = None) -> DataFrame:
    """Rows (field, label, accuracy) of the majority baselines."""
    card = scorecard(results) if card is None else card
    return _totals(card).select(F.inline(_majority_rows()))


def accuracy_comparison(results: DataFrame, card: DataFrame | None = None) -> DataFrame:
    """Rows (model, accuracy): majority, keyword, agent."""
    card = scorecard(results) if card is None else card
    models = {
        "majority": _majority(),
        "keyword": ratio("kw_hits", "labelled"),
        "agent": ratio("intent_hits", "intent_rows"),
    }
    rows = [F.struct(F.lit(m).alias("model"), a.alias("accuracy")) for m, a in models.items()]
    return _totals(card).select(F.inline(F.array(*rows)))


def baseline_report(results: DataFrame, card: DataFrame | None = None) -> DataFrame:
    """Lines (section, name, value, label): majority and keyword baselines beside the agent."""
    card = scorecard(results) if card is None else card
    esc, none = _escalation("h"), F.lit(None).cast("string")
    majority = F.transform(
        _majority_rows(),
        lambda x: F.struct(
            F.upper(x["field"]).alias("section"), F.lit("majority_accuracy").alias("name"),
            x["accuracy"].alias("value"), x["label"].alias("label"),
        ),
    )
    lines = _line_structs({
        "DATASET": {"rows": "n", "intent_rows": "intent_rows", "escalation_rows": "esc_rows"},
        "INTENT": {
            "keyword_accuracy": ratio("kw_hits", "labelled"),
            "agent_accuracy": ratio("intent_hits", "intent_rows"),
        },
        "ESCALATION": {
            "keyword_accuracy": ratio("kwe_hits", "kwe_rows"),
            **{f"agent_{c}": esc[c] for c in ("accuracy", "precision", "recall", "f1")},
        },
        **_reply_and_judge(card),
    }, label=none)
    return _totals(card).select(F.inline(F.concat(F.array(*lines), majority)))


def _reply_and_judge(card: DataFrame) -> dict:
    sections = {}
    if "replies" in card.columns:
        sections["REPLIES"] = {"generated": "replies", "rate": ratio("replies", "n")}
    judges = {}
    for name in JUDGES:
        if f"{name}_sum" in card.columns:
            judges |= {f"{name}_mean": _mean(name), f"{name}_samples": f"{name}_n"}
    return sections | ({"JUDGE": judges} if judges else {})


def _mean(name: str) -> Column:
    """Null where there is no score."""
    return F.when(F.col(f"{name}_n") > 0, F.col(f"{name}_sum") / F.col(f"{name}_n"))


def evaluation_report(results: DataFrame, card: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """Lines (section, name, value) of a finished evaluation."""
    card = stored(scorecard(results, normalize), "scorecard") if card is None else card
    pairs, esc = card_pairs(card), _escalation("h")
    report = metrics.classification_report(pairs).filter(F.col("row") != "accuracy")
    measures = [
        F.struct(
            F.lit("CLASSES").alias("section"), F.concat("row", F.lit(f" {c}")).alias("name"),
            F.col(c).cast("double").alias("value"),
        )
        for c in ("prec", "rec", "f1", "support")
    ]
    matrix = metrics.confusion_matrix(pairs).select(
        F.lit("CONFUSION").alias("section"),
        F.concat("true_label", F.lit(" -> "), "pred_label").alias("name"),
        F.col("n").cast("double").alias("value"),
    )
    sections = {
        "DATASET": {"rows": "n", "completed": "completed"},
        "INTENT": {"accuracy": ratio("intent_hits", "intent_rows")},
        "ESCALATION": {
            **{c: esc[c] for c in ("accuracy", "precision", "recall", "f1")},
            **{c: f"h_{c}" for c in ("tp", "fp", "fn", "tn")},
        },
    }
    if "retrieved_sum" in card.columns:
        sections["RETRIEVAL"] = {"average": _mean("retrieved")}
    lines = _line_structs(sections | _reply_and_judge(card))
    return _union([
        _totals(card).select(F.inline(F.array(*lines))),
        report.select(F.inline(F.array(*measures))),
        matrix,
    ])


def dataset_audit(results: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """Lines (section, name, value): coverage, label counts and, for a split, its leaks."""
    card = scorecard(results)
    # One rollup gives the label rows and, above them, the total row.
    levels = card.rollup("true_label").agg(*_label_sums(card), F.grouping("true_label").alias("all"))
    coverage = {
        "rows": "n", "intent_rows": "intent_rows", "escalation_rows": "esc_rows",
        "completed": "completed",
    }
    label = F.struct(
        F.lit("LABELS").alias("section"), F.col("true_label").alias("name"),
        F.col("intent_rows").cast("double").alias("value"),
    )
    lines = F.when(F.col("all") == 1, F.array(*_line_structs({"COVERAGE": coverage}))).when(
        _supported("intent_rows").isNotNull(), F.array(label)
    )
    parts = [levels.select(F.inline(lines))]
    if split is not None:
        parts.append(leakage_audit(split).select(
            F.lit("LEAKAGE").alias("section"), F.col("kind").alias("name"),
            F.col("n").cast("double").alias("value"),
        ))
    return _union(parts)


def diagnostics(results: DataFrame, card: DataFrame | None = None) -> DataFrame:
    """Lines (name, value) that put the headline accuracy in proportion."""
    card = scorecard(results) if card is None else card
    esc = _escalation("d")
    rare = F.filter("supports", lambda x: x < RARE_SHARE * F.col("intent_rows"))
    lines = _line_structs({
        "": {
            "majority_share": _majority(), "rare_classes": F.size(rare),
            "smallest_class": F.array_min("supports"),
            "escalation_precision": esc["precision"], "escalation_miss_rate": esc["miss_rate"],
        }
    })
    return _totals(card).select(F.inline(F.array(*lines))).select("name", "value")


SECTIONS = (
    "executive_summary", "class_wise", "confusion_matrices", "safety_failures", "rag_evidence",
    "judge_scores", "failure_cases", "intent_distribution", "accuracy_comparison",
)


def dashboard(
    results: DataFrame, sections=SECTIONS, evidence: DataFrame | None = None,
    golden: DataFrame | None = None, card: DataFrame | None = None, misses: int = 10, cases: int = 5,
    examples: int = 5, considered: int | None = None, normalize: bool = True,
) -> DataFrame:
    """Rows (section, payload_json) of the chosen sections.

    Numbers are shown as percentages and rounded half to even, here and nowhere else. ``evidence``
    comes from ``rag_evidence``; without it that section is empty. Without ``golden`` the label
    distribution is that of the results. ``misses``, ``cases`` and ``examples`` say how many rows the
    lists show; their totals count all rows, or mismatches among the first ``considered`` ids.
    """
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections {sorted(unknown)}, known are {SECTIONS}")
    card = stored(scorecard(results, normalize), "scorecard") if card is None else card

    def pct(c):
        return percent(c).alias(c)

    def summary():
        shown = [pct(c) for c in (
            "agent_accuracy", "majority_accuracy", "gap", "esc_accuracy", "esc_precision", "esc_recall",
        )]
        row = executive_summary(results, card).select(
            *shown, half_even("esc_f1", 4).alias("esc_f1"), "total", "intent_valid", "esc_valid"
        )
        return row.select(as_json(*row.columns).alias("payload_json"))

    def matrices():
        both = confusion_matrices(results, card)
        named = [m.select(F.lit(k).alias("field"), "true_label", "pred_label", "n") for k, m in both.items()]
        return to_payload(_union(named), "cells")

    def failures():
        total = card.agg(F.sum("missed")).scalar()
        return _numbered(safety_failures(results, misses).drop("total"), "#FN-", "false_negatives", total)

    def rag():
        if evidence is None:
            none = F.lit(None).cast("string")
            return to_payload(results.select(none.alias("q")).limit(0), "rag_examples")
        first = evidence.orderBy("q").limit(examples).withColumn("distance", half_even("distance", 4))
        return _numbered(first, "RAG-", "rag_examples", None, "q")

    def wrong():
        total = mismatches(results, considered, normalize).agg(F.count("*")).scalar()
        first = failure_cases(results, cases, considered, normalize).drop("total")
        return _numbered(first, "Case ", "cases", total, pad=False)

    def distribution():
        if golden is None:
            known = card.filter(F.col("true_label").isNotNull())
            counts = known.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("n"))
        else:
            counts = intent_distribution(golden)
        rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label")))
        body = as_json(
            F.transform(rows, lambda x: x["label"]).alias("labels"),
            F.transform(rows, lambda x: -x["m"]).alias("values"),
        )
        return counts.agg(body.alias("payload_json"))

    build = {
        "executive_summary": summary,
        "class_wise": lambda: to_payload(
            class_wise_performance(results, card), "classes", total_classes=F.count("*")
        ),
        "confusion_matrices": matrices,
        "safety_failures": failures,
        "rag_evidence": rag,
        "judge_scores": lambda: to_payload(judge_scores(results, card), "scores", {"mean": 2}),
        "failure_cases": wrong,
        "intent_distribution": distribution,
        "accuracy_comparison": lambda: to_payload(
            accuracy_comparison(results, card).select("model", pct("accuracy")), "models"
        ),
    }
    return _union(
        [build[s]().select(F.lit(s).alias("section"), "payload_json") for s in SECTIONS if s in sections]
    )


def numbered_cases(rows: DataFrame, prefix: str, by: str = "thread_id") -> DataFrame:
    """All rows with their case number in the order of ``by``, first column ``case_id``; any number of them.

    Rows are stored on the way (see ``numbering.numbered``); of rows equal in ``by`` any may come first.
    """
    placed = numbered(rows, [by], lambda df: stored(df, "cases"), "_number")
    return placed.select(case_id(prefix, F.col("_number") + 1).alias("case_id"), *rows.columns)


def _numbered(
    top: DataFrame, prefix: str, key: str, total=None, order: str = "thread_id", pad: bool = True,
) -> DataFrame:
    """JSON of a top-n report with case numbers in id order; a few rows, so one array."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in top.columns if c != order])))

    def with_case(x, i):
        number = case_id(prefix, i + 1) if pad else F.format_string(prefix + "%d", i + 1)
        return F.struct(number.alias("case_id"), *[x[c].alias(c) for c in top.columns])

    body = [F.transform("rows", with_case).alias(key)]
    if total is not None:
        body.append(total.alias("total"))
    return top.agg(rows.alias("rows")).select(as_json(*body).alias("payload_json"))
