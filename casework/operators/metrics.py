"""Classification metrics, all derived from one count per (true, predicted) pair.

The pair counts are the only shuffle over the data; everything after works on a table with a
row per label pair. Sums over labels are exact, so results are the same to the last
bit however the data is partitioned.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.text import as_column, normalize_label, numeric_or_null


def ratio(part, whole) -> Column:
    """One division of two counts; 0 where there is nothing to divide by."""
    part, whole = as_column(part), as_column(whole)
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def f1(tp, predicted, actual) -> Column:
    return ratio(2 * as_column(tp), as_column(predicted) + as_column(actual))


#: Bits of one part of a value in ``exact_sum``, and parts below the point.
_PART_BITS, _PARTS = 30, 4


def exact_sum(value) -> Column:
    """Aggregate: sum of a fractional value, the same to the last bit in any order and partitioning.

    A value is cut into whole numbers of 30 bits each, which is exact, and these are added up as such: the
    parts keep 120 bits below the point, more than a fraction of two counts has. Null without values.
    """
    part, rest = F.floor(value), value
    sums = []
    for i in range(_PARTS + 1):
        sums.append(F.sum(part.cast("long")).cast("double"))
        if i < _PARTS:
            rest = (rest - part.cast("double")) * F.lit(float(1 << _PART_BITS))
            part = F.floor(rest)
    out = sums[-1]
    for s in reversed(sums[:-1]):
        out = s + out / F.lit(float(1 << _PART_BITS))
    return out


def complete_pairs(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.dropna(subset=[true, pred])


def pair_counts(df: DataFrame, true: str, pred: str, normalize: bool = True) -> DataFrame:
    """Rows (true_label, pred_label, n) over the rows where both are known."""
    clean = normalize_label if normalize else (lambda c: F.col(c).cast("string"))
    return (
        complete_pairs(df, true, pred)
        .groupBy(clean(true).alias("true_label"), clean(pred).alias("pred_label"))
        .agg(F.count("*").alias("n"))
    )


def label_union(pairs: DataFrame) -> DataFrame:
    """Distinct labels seen on either side, one column ``label``.

    The filter keeps the counts in the plan, so that it shares its exchange with the other
    uses of ``pairs`` and the data is read once.
    """
    seen = class_counts(pairs).filter(F.col("predicted") + F.col("support") > 0)
    return seen.select(F.col("intent").alias("label"))


def confusion_matrix(pairs: DataFrame, classes=None) -> DataFrame:
    """Every (true_label, pred_label) with its count, zero where the pair never occurs.

    ``classes`` fixes the labels (others are ignored); else the labels seen are used.
    """
    if classes:
        grid = pairs.sparkSession.createDataFrame(
            [(t, p) for t in classes for p in classes], "true_label string, pred_label string"
        )
    else:
        found = label_union(pairs).agg(F.sort_array(F.collect_set("label")).alias("labels"))
        # The rows of a large grid are made by many tasks.
        grid = (
            found.select(F.explode("labels").alias("true_label"), "labels")
            .repartition("true_label")
            .select("true_label", F.explode("labels").alias("pred_label"))
        )
    # Null-safe on labels that are never null: a plain join would add its own null filter to
    # this use of ``pairs`` only, which could then not share the exchange.
    counted = pairs.select(F.col("true_label").alias("_t"), F.col("pred_label").alias("_p"), "n")
    same = F.col("true_label").eqNullSafe(F.col("_t")) & F.col("pred_label").eqNullSafe(F.col("_p"))
    return grid.join(counted, same, "left").select(
        "true_label", "pred_label", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def confusion_wide(matrix: DataFrame, classes) -> DataFrame:
    """One row per true label, one column per predicted label."""
    return matrix.groupBy("true_label").pivot("pred_label", list(classes)).agg(F.first("n"))


def class_counts(pairs: DataFrame) -> DataFrame:
    """Per label: tp, predicted and support; no join of the two sides is needed."""
    hit = F.col("true_label") == F.col("pred_label")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("true_label").alias("intent"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
            zero.alias("predicted"), F.col("n").alias("support"),
        ),
        F.struct(
            F.col("pred_label").alias("intent"), zero.alias("tp"),
            F.col("n").alias("predicted"), zero.alias("support"),
        ),
    )
    names = ("tp", "predicted", "support")
    return (
        pairs.select(F.inline(sides))
        .groupBy("intent")
        .agg(*[F.sum(c).alias(c) for c in names])
    )


def class_metrics(pairs: DataFrame) -> DataFrame:
    return class_counts(pairs).select(
        "intent",
        ratio("tp", "predicted").alias("prec"),
        ratio("tp", "support").alias("rec"),
        f1("tp", "predicted", "support").alias("f1"),
        "support",
    )


def weighted_prf(classes: DataFrame) -> DataFrame:
    """Rows label, ``precision``, ``recall``, ``f1``: those of each label of a ``class_metrics`` table and, under a
    null label, their support-weighted averages. There may be any number of labels; no row or task holds them all."""
    names = (("prec", "precision"), ("rec", "recall"), ("f1", "f1"))
    weighted = [ratio(exact_sum(F.col(c) * F.col("support")), F.sum("support")).alias(name) for c, name in names]
    return classes.rollup(F.col("intent").alias("label")).agg(*weighted)


def classification_report(pairs: DataFrame) -> DataFrame:
    """``class_metrics`` followed by accuracy, macro and support-weighted rows."""
    classes = class_metrics(pairs)
    total = F.sum("support")
    names = ("prec", "rec", "f1")
    averages = classes.agg(
        *[ratio(exact_sum(F.col(c)), F.count("*")).alias(f"m_{c}") for c in names],
        *[
            ratio(exact_sum(F.col(c) * F.col("support")), total).alias(f"w_{c}")
            for c in names
        ],
        total.alias("support"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("row"),
                        *[F.col(f"{p}_{c}").alias(c) for c in names],
                        "support",
                    )
                    for label, p in (("macro avg", "m"), ("weighted avg", "w"))
                ]
            )
        )
    )
    null = F.lit(None).cast("double")
    accuracy = pairs.agg(
        accuracy_of_pairs().alias("f1"), F.sum("n").alias("support")
    ).select(F.lit("accuracy").alias("row"), null.alias("prec"), null.alias("rec"), "f1", "support")
    return (
        classes.withColumnRenamed("intent", "row")
        .unionByName(averages.filter(F.col("support").isNotNull()))
        .unionByName(accuracy.filter(F.col("support").isNotNull()))
    )


def accuracy_of_pairs() -> Column:
    """Aggregate over pair counts."""
    same = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    total = F.coalesce(F.sum("n"), F.lit(0))
    return ratio(F.coalesce(F.sum(same), F.lit(0)), total)


def accuracy(df: DataFrame, true: str, pred: str, normalize: bool = True) -> DataFrame:
    """One row: accuracy, total. A single pass without a shuffle of rows."""
    clean = normalize_label if normalize else F.col
    return complete_pairs(df, true, pred).agg(
        ratio(F.count_if(clean(true) == clean(pred)), F.count("*")).alias("accuracy"),
        F.count("*").alias("total"),
    )


def binary_counts(df: DataFrame, true: Column, pred: Column) -> DataFrame:
    """One row tp, fp, fn, tn of two boolean columns; rows with a null side do not count."""
    return df.agg(
        F.count_if(true & pred).alias("tp"),
        F.count_if(~true & pred).alias("fp"),
        F.count_if(true & ~pred).alias("fn"),
        F.count_if(~true & ~pred).alias("tn"),
    )


def binary_columns(tp="tp", fp="fp", fn="fn", tn="tn") -> dict:
    """Accuracy, precision, recall, F1 and miss rate from four counts."""
    tp, fp, fn, tn = map(as_column, (tp, fp, fn, tn))
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": f1(tp, tp + fp, tp + fn),
        "miss_rate": ratio(fn, tp + fn),
    }


def binary_prf(counts: DataFrame) -> DataFrame:
    wanted = ("accuracy", "precision", "recall", "f1")
    columns = binary_columns()
    return counts.select(*[columns[c].alias(c) for c in wanted])


def label_distribution(df: DataFrame, label: str, normalize: bool = True) -> DataFrame:
    """Rows (label, n, share), nulls left out, most frequent first."""
    clean = normalize_label(label) if normalize else F.col(label)
    counts = (
        df.filter(F.col(label).isNotNull())
        .groupBy(clean.alias("label"))
        .agg(F.count("*").alias("n"))
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), "label")


def majority(counts: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """Most frequent label (smallest on a tie) and the accuracy of always answering it.

    ``counts`` holds one row per label.
    """
    # min_by over (-n, label) settles ties on the smallest label.
    best = F.min(F.struct((-F.col(n)).alias("m"), F.col(label).alias("label")))
    return counts.agg(best.alias("best"), F.sum(n).alias("total")).select(
        F.col("best.label").alias("label"),
        ratio(-F.col("best.m"), F.coalesce("total", F.lit(0))).alias("accuracy"),
    )


def score_summary(df: DataFrame, scores: dict) -> DataFrame:
    """Rows (score, mean, samples) of numeric columns; the mean of no scores is null."""
    present = {name: c for name, c in scores.items() if c in df.columns}
    aggregates = []
    for name, c in present.items():
        value = numeric_or_null(c)
        aggregates += [F.avg(value).alias(f"{name}_mean"), F.count(value).alias(f"{name}_n")]
    rows = [
        F.struct(
            F.lit(name).alias("score"),
            F.col(f"{name}_mean").alias("mean"),
            F.col(f"{name}_n").alias("samples"),
        )
        for name in present
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "score string, mean double, samples bigint")
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
