"""Quality rules: plain limits, then robust multivariate outliers of each language and source.

All of it is column work. Statistics of a text come from its words and lines; their transformed
vectors get a minimum-covariance-determinant estimate per group: C-steps, each of which takes the
share of rows nearest to the last estimate and estimates anew, from two starts, of which the
smaller determinant wins. A step is one aggregation per group and distance bin, whose running
sums hold the estimate of every possible subset, so no group is ever sorted or gathered.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.shared import kept as stored
from casework.llm.shared import small_side

#: Words are what stands between these.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Share of a group that an estimate rests on, rows a group needs, C-steps for each start.
SHARE, LEAST_ROWS, STEPS = 0.75, 60, 3
#: Coordinates of a row's vector. They are measured in units of the middle spread that the rows of its language
#: have; within a group a standard deviation counts as at least FLOOR of these, so that a group of very
#: similar texts does not make an outlier of every other one.
VECTOR = ("_v0", "_v1", "_v2", "_v3")
FLOOR, LEAST_SPREAD = 0.3, 1e-3
FLOORS = (FLOOR,) * len(VECTOR)
#: A text of few words measures its statistics badly: one of FEW words is given twice the variance of its group.
FEW = 250
#: Squared distances beyond this are outliers: of normal vectors with four coordinates one in 6 * 10 ** 7 is, by
#: the chi-square law.
CUTOFF = 42.0
#: Bins of squared distances for each power of two.
BINS = 16


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def repeated_words(parts: Column, size: int = WINDOW) -> Column:
    """How many words stand in windows of ``size`` words that a text holds twice or more."""
    hashes = F.transform(parts, lambda w: F.xxhash64(w))
    windows = _let(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(F.slice(h, i, size))
    ))

    def covered(found):
        pairs = F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = _let(pairs, lambda p: F.transform(
            F.filter(
                F.transform(p, lambda a, j: F.struct(
                    a["i"].alias("i"),
                    (F.coalesce(F.get(p, j - 1)["x"] == a["x"], F.lit(False))
                     | F.coalesce(F.get(p, j + 1)["x"] == a["x"], F.lit(False))).alias("twice"),
                )),
                lambda a: a["twice"],
            ),
            lambda a: a["i"],
        ))
        return _let(F.array_sort(twice), lambda at: F.aggregate(
            F.transform(at, lambda i, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - i, F.lit(size)))),
            F.lit(0), lambda total, n: total + n,
        ))

    count = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(F.size(parts) >= size, count).otherwise(0).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts replaced by counts; see ``judged``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("_words", words(text)).withColumn("_lines", lines)
        .select(
            *[c for c in docs.columns if c != text_col],
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("_words")).alias("n_repeat_words"),
            _only(r"[^\p{L}]+").alias("n_letters"), _only(r"[^\p{Lu}]+").alias("n_capitals"),
            F.size(F.array_distinct(F.transform("_words", lambda w: F.xxhash64(w)))).cast("long").alias("n_distinct"),
        )
    )


def _only(others: str) -> Column:
    """Characters of the words that are not of the pattern ``others``."""
    return F.length(F.regexp_replace(F.array_join("_words", ""), others, "")).cast("long")


def _vector(df: DataFrame) -> DataFrame:
    """Word length, other characters than letters, variety of words and capitals, each so transformed that clean
    texts of a language scatter about evenly around a middle value."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return (
        df.withColumn("_v0", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n))
        .withColumn("_v1", F.sqrt(1 - F.col("n_letters") / chars))
        .withColumn("_v2", F.log(F.greatest(F.col("n_distinct"), F.lit(1))) / F.log(n + 1))
        .withColumn("_v3", F.sqrt(F.col("n_capitals") / chars))
    )


def _scaled(rows: DataFrame, good: DataFrame) -> DataFrame:
    """``rows`` with VECTOR in units of the middle spread of their language, or of all rows where it has few."""
    middle = [F.percentile_approx(v, [0.1, 0.9], 2000).alias(v) for v in VECTOR]

    def spread(v):
        return F.greatest((F.col(v)[1] - F.col(v)[0]) / 2.56, F.lit(LEAST_SPREAD))

    whole = good.agg(F.lit(1).alias("_one"), *middle).select(F.struct(*[spread(v).alias(v) for v in VECTOR]).alias("_all"))
    own = good.groupBy("_k1").agg(F.count("*").alias("_rows"), *middle).select(
        "_k1", F.when(F.col("_rows") >= LEAST_ROWS, F.struct(*[spread(v).alias(v) for v in VECTOR])).alias("_own")
    )
    unit = F.coalesce(F.col("_own"), whole.scalar())
    return rows.join(small_side(stored(own)), "_k1", "left").withColumn("_unit", unit).withColumns(
        {v: F.col(v) / F.col("_unit")[v] for v in VECTOR}
    ).drop("_own", "_unit")


def _consistency(share: float, p: int) -> float:
    """What the covariance of the inner ``share`` of normal vectors is multiplied by; ``p`` is even."""
    def below(x, q):  # chi-square distribution with q degrees of freedom
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(q // 2))

    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid, p) < share else (low, mid)
    return share / below(low, p + 2)


def _whitened(moments: DataFrame, keys: list) -> DataFrame:
    """From the rows, sums and products of each group: mean, inverse Cholesky factor, determinant."""
    p, n = len(VECTOR), F.col("_n")
    factor = _consistency(SHARE, p)
    df = moments.select(*keys, *[(F.col(f"_s{i}") / n).alias(f"_m{i}") for i in range(p)], *[
        (factor * (F.col(f"_q{i}{j}") / n - F.col(f"_s{i}") / n * F.col(f"_s{j}") / n)
         + (FLOORS[i] ** 2 if i == j else 0)).alias(f"_c{i}{j}")
        for i in range(p) for j in range(i + 1)
    ])
    return _factored(df, keys)


def _factored(df: DataFrame, keys: list) -> DataFrame:
    """Group centres ``_m`` and covariances ``_c`` with the factors that distances need."""
    p, c = len(VECTOR), lambda i, j: F.col(f"_l{i}{j}")
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"_c{i}{j}") - sum((c(i, k) * c(j, k) for k in range(j)), F.lit(0.0))
            value = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 100))) if i == j else rest / c(j, j)
            df = df.withColumn(f"_l{i}{j}", value)
    for i in range(p):  # the inverse of a lower triangle
        for j in range(i, -1, -1):
            inner = sum((c(i, k) * F.col(f"_w{k}{j}") for k in range(j, i)), F.lit(0.0))
            df = df.withColumn(f"_w{i}{j}", (F.lit(1.0 if i == j else 0.0) - inner) / c(i, i))
    det = sum((F.log(c(i, i)) for i in range(p)), F.lit(0.0))
    return df.select(
        *keys, *[f"_m{i}" for i in range(p)], *[f"_w{i}{j}" for i in range(p) for j in range(i + 1)], det.alias("_det")
    )


def _distance() -> Column:
    rows = []
    for i in range(len(VECTOR)):
        part = sum((F.col(f"_w{i}{j}") * (F.col(VECTOR[j]) - F.col(f"_m{j}")) for j in range(i + 1)), F.lit(0.0))
        rows.append(part * part)
    return sum(rows[1:], rows[0])


def _sums() -> list:
    p = range(len(VECTOR))
    return [
        F.count("*").alias("_n"), *[F.sum(VECTOR[i]).alias(f"_s{i}") for i in p],
        *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"_q{i}{j}") for i in p for j in range(i + 1)],
    ]


def _c_step(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Estimates from the nearest SHARE of every group, by bins of distance."""
    keys = ["_key", "_start"]
    bin_ = F.floor(F.log2(_distance() + 1e-9) * BINS).cast("int").alias("_bin")
    bins = rows.join(estimate, "_key").groupBy(*keys, bin_).agg(*_sums())
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    names = [c for c in bins.columns if c[:2] in ("_n", "_s", "_q") and c != "_start"]
    running = bins.select(
        *keys, "_bin", F.sum("_n").over(whole).alias("_all"), *[F.sum(n).over(upto).alias(n) for n in names]
    ).filter(F.col("_n") >= F.col("_all") * SHARE)
    first = F.row_number().over(whole.orderBy("_bin"))
    return _whitened(running.withColumn("_r", first).filter("_r = 1"), keys)


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of every ``_key`` of rows that hold VECTOR."""
    p = range(len(VECTOR))
    middle = rows.groupBy("_key").agg(*[
        F.percentile_approx(VECTOR[i], [0.1, 0.5, 0.9], 2000).alias(f"_p{i}") for i in p
    ])
    # Start 0: medians and the middle spread of each statistic. Start 1: mean and covariance of all.
    spread = [((F.col(f"_p{i}")[2] - F.col(f"_p{i}")[0]) / 2.56) for i in p]
    robust = middle.select(
        "_key", F.lit(0).alias("_start"), *[F.col(f"_p{i}")[1].alias(f"_m{i}") for i in p],
        *[(spread[i] * spread[i] + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"_c{i}{j}") for i in p for j in range(i + 1)],
    )
    plain = rows.groupBy("_key").agg(*_sums()).withColumn("_start", F.lit(1))
    keys = ["_key", "_start"]
    found = _factored(robust, keys).unionByName(_whitened(plain, keys))
    for _ in range(STEPS):
        found = _c_step(rows, found)
    best = Window.partitionBy("_key").orderBy("_det", "_start")
    return found.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "_start", "_det")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Statistics and verdict of every row: id, language, source, the counts, ``base_failed``, ``distance``, ``kept``.

    Words are runs between blanks (space and the characters 9 to 13). A row fails the base rules
    with fewer than 20 words, or if more than 30 % of them stand in repeated windows; of the
    others those are kept whose squared Mahalanobis distance is at most CUTOFF (for rows that
    fail, ``distance`` is null), after the share of it that a text of so few words may have by chance. Null texts count as empty and fail. A null language or source is
    a group like any other. Groups of fewer than LEAST_ROWS rows share the estimate of their
    language, languages of fewer share one of all rows. Repeated rows count as often as they occur.
    """
    parts = docs.select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"),
        F.col(text_col).alias("_text"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))  # noqa: E731  keeps null apart
    rows = _vector(statistics(parts, "_text").withColumn("base_failed", failed)).select(
        "*", named(F.col("_lang")).alias("_k1"),
        F.concat(named(F.col("_lang")), F.lit("\x01"), named(F.col("_source"))).alias("_k2"),
    )
    rows = stored(rows)
    rows = _scaled(rows, rows.filter(~F.col("base_failed")))
    good = rows.filter(~F.col("base_failed"))
    sizes = good.groupBy("_k1", "_k2").agg(F.count("*").alias("_n2"))
    sizes = sizes.withColumn("_n1", F.sum("_n2").over(Window.partitionBy("_k1")))
    key = F.when(F.col("_n2") >= LEAST_ROWS, F.col("_k2")).when(F.col("_n1") >= LEAST_ROWS, F.col("_k1")).otherwise("")
    groups = stored(sizes.select("_k1", "_k2", key.alias("_key")))
    # A pooled estimate rests on all rows of its language, or of the table: each group says which
    # estimates its rows go into, so that no row is moved to find out.
    lands = groups.groupBy("_k1").agg(F.max(F.col("_key") == F.col("_k1")).alias("_land"))
    table = groups.agg(F.coalesce(F.max(F.col("_key") == ""), F.lit(False)).alias("_table"))
    into = groups.join(lands, "_k1").select("_k2", F.array_compact(F.array(
        F.when(F.col("_key") == F.col("_k2"), F.col("_k2")), F.when(F.col("_land"), F.col("_k1")),
        F.when(table.scalar(), F.lit("")),
    )).alias("_into"))
    pooled = good.join(into, "_k2").select(F.explode("_into").alias("_key"), *VECTOR)
    found = stored(estimates(pooled))
    result = rows.join(groups.drop("_k1"), "_k2", "left").join(found, "_key", "left")
    distance = F.when(~F.col("base_failed"), _distance() * F.col("n_words") / (F.col("n_words") + FEW))
    return result.select(
        F.col("_id").alias(id_col), F.col("_lang").alias(lang_col), F.col("_source").alias(source_col),
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals",
        "n_distinct", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"),
    )
