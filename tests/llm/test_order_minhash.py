"""Order MinHash: the edited texts and neighbours by definition, occurrence numbers and minima by a plain version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casework.llm import order_minhash as om


def edited(rows):
    """(id, n_chars, sha256) of rows in their order."""
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest()))
    return out


def digits(found):
    return [found[i : i + 8] for i in range(0, len(found), 8)]


def share(a, b):
    if not a or not b:
        return float(a == b)
    return sum(x == y for x, y in zip(digits(a), digits(b))) / len(digits(a))


@pytest.mark.parametrize("part", [1 << 20, 3000])
def test_edited_texts_and_neighbours(spark, prose, monkeypatch, part):
    monkeypatch.setattr(om, "PART_BYTES", part)  # small parts put neighbours into different ones
    rows = [(3 * i, t) for i, t in prose] + [(1000, None), (1001, ""), (1002, "é" * 7), (1003, " \n\t "), (1004, "\U0001f600" * 9 + " a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in om.compared(df).collect()}
    assert [(i, got[i].n_chars, got[i].edited_sha256) for i, _ in rows] == edited(rows)
    texts = dict(rows)
    for i, (own, _) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][0]
        r = got[own]
        assert r.near_next == share(r.fingerprint, got[after].fingerprint)
        assert r.near_edited == share(r.fingerprint, r.edited_fingerprint)
        assert len(r.fingerprint) == (8 * om.REPEATS if (texts[own] or "").split() else 0)
    # The fingerprint of an edited text is that of any text like it.
    other = spark.createDataFrame([(1, (rows[0][1])[: len(rows[0][1]) - len(rows[0][1]) // 2] + rows[1][1][: len(rows[0][1]) // 2])], "doc_id long, text string")
    assert om.compared(other).first().fingerprint == got[0].edited_fingerprint


def test_occurrences_are_numbered(spark):
    """Packed k-mers: as many as windows, each with its own hash, in spite of repeats."""
    text = "a b a b a b a b c d c d averyverylongword"
    n = len(text.split()) + 2  # the long word is three letters
    got = spark.createDataFrame([(text,)], "t string").select(om.kmers(F.col("t"), 2).alias("k")).first().k
    places = sorted(x & ((1 << om.PLACE_BITS) - 1) for x in got)
    assert places == list(range(n - 1)) and len({x >> om.PLACE_BITS for x in got}) == n - 1
    # The first "a b" has the hash of any first "a b", the second that of any second one.
    more = spark.createDataFrame([("x a b y a b",)], "t string").select(om.kmers(F.col("t"), 2).alias("k")).first().k
    at = lambda k, p: next(x >> om.PLACE_BITS for x in k if x & ((1 << om.PLACE_BITS) - 1) == p)
    assert at(more, 1) == at(got, 0) and at(more, 4) == at(got, 2) != at(got, 0)


def test_entries_are_pairs_of_minima_in_text_order(spark, prose):
    texts = [t for _, t in prose if t][:20]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    kmers = df.select("i", om.kmers(F.col("t")).alias("k"))
    got = {r.i: r["_sig"] for r in om.signatures(kmers, ["i"], "k", 5).collect()}
    mask = (1 << om.PLACE_BITS) - 1
    packed = {r.i: r.k for r in kmers.collect()}
    for r in range(5):
        flat = spark.createDataFrame([(i, x & mask, (x % (1 << 64)) >> om.PLACE_BITS) for i, k in packed.items() for x in k], "i int, p long, b long")
        rows = flat.select("i", "p", F.xxhash64(F.col("b").bitwiseXOR(F.lit(om._ROUNDS[r]))).alias("h")).collect()
        pairs = []
        for i in packed:
            own = [((x.h & ~mask) | x.p) for x in rows if x.i == i]
            low, high = min(own), max(own)
            first, second = sorted((low, high), key=lambda v: v & mask)
            if low & mask == high & mask:
                first, second = high, low
            pairs.append((i, (first % (1 << 64)) >> om.PLACE_BITS, (second % (1 << 64)) >> om.PLACE_BITS))
        want = spark.createDataFrame(pairs, "i int, a long, b long").select("i", F.xxhash64("a", "b").alias("x")).collect()
        assert {x.i: x.x & 0xFFFFFFFF for x in want} == {i: s[r] for i, s in got.items()}


def test_likeness_falls_with_edits_and_sees_order(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(600)]

    def changed(n):
        out = list(words)
        for i in rng.sample(range(600), n):
            out[i] = f"v{i}"
        return " ".join(out)

    blocks = [words[i : i + 60] for i in range(0, 600, 60)]
    turned = " ".join(w for b in reversed(blocks) for w in b)
    texts = [" ".join(words), " ".join(words), changed(6), changed(40), changed(200), turned]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    sig = {r.i: r["_sig"] for r in om.signatures(df.select("i", om.kmers(F.col("t")).alias("k")), ["i"], "k").collect()}
    near = [sum(a == b for a, b in zip(sig[0], sig[i])) / om.REPEATS for i in range(6)]
    assert near[1] == 1 and 1 > near[2] > near[3] > near[4] >= 0 and near[2] > 0.8
    # The same passages in another order: nearly all k-mers are shared, half of the pairs or more turn round.
    assert near[5] < 0.65


def test_awkward_rows(spark, messy, empty):
    got = om.compared(messy).collect()
    given = messy.collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in given)))
    by_text = {}
    for r in got:
        by_text.setdefault(r.fingerprint, set()).add(r.doc_id)
    long = [r for r in got if r.doc_id in (103, 104)]
    assert long[0].fingerprint == long[1].fingerprint and {r.near_next for r in long if r.doc_id == 103} == {1.0}
    assert {r.fingerprint for r in got if r.doc_id in (100, 101, 102)} == {""}
    assert om.compared(empty).collect() == [] and om.compared(empty).dtypes == om.compared(messy).dtypes
    one = om.compared(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert (one.near_next, one.n_chars) == (1.0, 7)
