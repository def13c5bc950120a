"""Fingerprints by order MinHash: likeness of two texts that falls with their edit distance.

The letters of a text are its words (a word of more than LETTER code points is cut into several),
so edits are changes of words. Every k-mer of letters carries the number of its occurrence, which
makes repeats count. In each of REPEATS rounds the k-mers of a text are hashed anew, which puts them in a
random order; the minimal one of that order and the minimal one of its reverse are selected, the two are
put in the order they have in the text, and the hash of that pair is the round's entry. Two texts agree in an
entry if they share both k-mers and have them in the same order. The share of equal entries is their likeness.

All of it is column work: occurrence numbers follow from sorted arrays, and minima are one aggregation of the
k-mers of a text, in the part of the table where the text lies.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.rules import _let

LETTER = 8
K = 3
REPEATS = 32
#: Bits of the place of a k-mer in its text, beside those of its hash.
PLACE_BITS = 28
_PLACE = (1 << PLACE_BITS) - 1
#: A different value for every round.
_ROUNDS = [(0x9E3779B97F4A7C15 * (r + 1)) % (1 << 63) for r in range(REPEATS)]
#: Bytes of text in a part of the table, and parts at most.
PART_BYTES, PARTS = 1 << 20, 1 << 16


def _packed(hash_: Column, place: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_PLACE)))


def kmers(text: Column, k: int = K) -> Column:
    """Hashes of the occurrence-numbered k-mers of a text with their places, packed in one number each.

    A text of fewer letters than ``k`` is one k-mer, one without any has none.
    """
    letters = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]{1,%d})" % LETTER), F.lit(1))

    def windows(u):
        places = F.sequence(F.lit(0), F.greatest(F.size(u) - k, F.lit(0)))
        return F.transform(places, lambda i: _packed(F.xxhash64(*[F.get(u, i + j) for j in range(k)]), i))

    def counted(s):  # in the order of hash and place, equal k-mers are neighbours
        new = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (
            F.shiftrightunsigned(F.get(s, j).bitwiseXOR(F.get(s, j - 1)), PLACE_BITS) != 0
        ))

        def one(x, n):
            return _packed(F.xxhash64(F.shiftrightunsigned(x, PLACE_BITS), n), x)

        def runs(starts):
            return F.flatten(F.transform(starts, lambda a, r: F.transform(
                F.slice(s, a + 1, F.coalesce(F.get(starts, r + 1), F.size(s)) - a), one
            )))

        return _let(new, lambda starts: F.when(
            F.size(starts) == F.size(s), F.transform(s, lambda x: one(x, F.lit(0)))
        ).otherwise(runs(starts)))

    none = F.array().cast("array<bigint>")
    hashes = _let(F.transform(letters, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(letters) > 0, _let(F.sort_array(hashes), counted)).otherwise(none)


def signatures(rows: DataFrame, keys: list, kmers_col: str, repeats: int = REPEATS) -> DataFrame:
    """``keys`` and ``_sig``, the entries of every row of packed k-mers; null where it has none."""
    one = rows.select(*keys, F.explode_outer(kmers_col).alias("_e"))
    base, place = F.shiftrightunsigned("_e", PLACE_BITS), F.col("_e")
    minima = []
    for r in range(repeats):
        ordered = _packed(F.xxhash64(base.bitwiseXOR(F.lit(_ROUNDS[r]))), place)
        minima += [F.min(ordered).alias(f"_a{r}"), F.max(ordered).alias(f"_b{r}")]
    found = one.groupBy(*keys).agg(*minima)
    at = lambda c: c.bitwiseAND(F.lit(_PLACE))
    what = lambda c: F.shiftrightunsigned(c, PLACE_BITS)
    entries = []
    for r in range(repeats):
        a, b = F.col(f"_a{r}"), F.col(f"_b{r}")
        pair = F.when(at(a) < at(b), F.xxhash64(what(a), what(b))).otherwise(F.xxhash64(what(b), what(a)))
        entries.append(pair.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return found.select(*keys, F.when(F.col("_a0").isNotNull(), F.array(*entries)).alias("_sig"))


def shown(sig: Column) -> Column:
    """A signature as text, eight hexadecimal digits an entry; empty for a text without letters."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries; texts without letters are like one another and unlike all others."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() & b.isNull(), 1.0).otherwise(F.coalesce(same / F.size(a), F.lit(0.0)))


def _part(splits: list) -> Column:
    """Number of the part of an id: how many of the ascending splits it reaches, found in two steps."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits)) + 1
    coarse = F.array(*[F.lit(v) for v in splits[::step]])
    groups = F.array(*[F.array(*[F.lit(v) for v in splits[i : i + step]]) for i in range(0, len(splits), step)])

    def reached(values):
        return F.size(F.filter(values, lambda v: v <= F.col("_id")))

    within = _let(reached(coarse), lambda n: F.when(n == 0, 0).otherwise(
        (n - 1) * step + reached(F.get(groups, n - 1))
    ))
    return F.when(F.col("_id").isNull(), 0).otherwise(within)


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS) -> DataFrame:
    """Fingerprint of every text and of its edited one, and how like they are: id, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text has the last half of its code points (rounded down) replaced by the first as many
    of the next text, by ascending id; the first text follows the last one. ``near_next`` is
    the likeness to that next text itself. A null text counts as empty. Rows without an id come
    first; rows that repeat an id follow one another by the hash of their text. Texts without words have an empty
    fingerprint. An only row is its own next one, an empty table gives an empty one.

    Ids must be whole numbers. Parts of about PART_BYTES lie between quantiles of the ids, so no task
    orders the whole table; each text is moved once, and the first text of a part also to the part before. Runs jobs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    parts = min(PARTS, -(-total // PART_BYTES))
    splits = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        splits = sorted(set(rows.agg(F.percentile_approx("_id", shares, max(10000, 4 * parts))).first()[0] or []))
    rows = rows.withColumn("_part", _part(splits)).withColumn("_hash", F.xxhash64("_text"))
    order = Window.partitionBy("_part").orderBy(F.col("_id").asc_nulls_first(), "_hash", "_text")
    ranked = rows.withColumn("_row", F.row_number().over(order)).withColumn("_next", F.lead("_text").over(order))
    # What follows the last row of a part: the first one of the next part, of the first part after the last.
    leads = rows.groupBy("_part").agg(F.min(F.struct(F.col("_id").isNotNull().alias("n"), "_id", "_hash", "_text")).alias("_lead"))
    numbers = Window.orderBy("_part")
    after = rows.select("_part").distinct().select(
        F.col("_part").alias("_before"), F.coalesce(F.lead("_part").over(numbers), F.min("_part").over(
            numbers.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_part"),
    )
    leads = leads.select("_part", F.col("_lead._text").alias("_lead")).join(after, "_part")
    lead_sigs = signatures(leads.select(F.col("_before").alias("_part"), kmers(F.col("_lead")).alias("_kmers")), ["_part"], "_kmers", repeats)
    leads = leads.select(F.col("_before").alias("_part"), "_lead").join(lead_sigs.withColumnRenamed("_sig", "_lead_sig"), "_part")

    n, half = F.length("_text").cast("long"), F.expr("length(_text) div 2").cast("int")
    both = ranked.join(leads.select("_part", "_lead"), "_part").withColumn("_next", F.coalesce("_next", "_lead")).select(
        "_part", "_row", "_id", n.alias("n_chars"), "_text",
        F.concat(F.left("_text", (n - half).cast("int")), F.left("_next", half)).alias("_edited"),
    )
    keys = ["_part", "_row", "_which", "_id", "n_chars", "edited_sha256"]
    each = both.select(
        "_part", "_row", "_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        F.posexplode(F.array("_text", "_edited")).alias("_which", "_t"),
    ).select(*keys, kmers(F.col("_t")).alias("_kmers"))
    found = signatures(each, keys, "_kmers", repeats)
    seen = Window.partitionBy("_part").orderBy("_row", "_which")
    last = Window.partitionBy("_part")
    pairs = found.select(
        "*", F.lead("_sig").over(seen).alias("_edited_sig"), F.lead("_sig", 2).over(seen).alias("_next_sig"),
        F.max("_row").over(last).alias("_last"),
    ).filter("_which = 0").join(leads.select("_part", "_lead_sig"), "_part")
    following = F.when(F.col("_row") == F.col("_last"), F.col("_lead_sig")).otherwise(F.col("_next_sig"))
    return pairs.withColumn("_next_sig", following).select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", shown(F.col("_sig")).alias("fingerprint"),
        shown(F.col("_edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_edited_sig")).alias("near_edited"),
        likeness(F.col("_sig"), F.col("_next_sig")).alias("near_next"),
    )
