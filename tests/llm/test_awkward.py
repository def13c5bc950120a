"""Awkward rows and empty tables through every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from casework.llm import ann, bpe, lm, minhash, mixing, pii, quality, rules, sharding, suffix

TOKENS = public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "suffix": suffix.without_repeats,
    "quality": lambda d: quality.scored(d, quality.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")))),
    "bpe": lambda d: bpe.tokenized(d, TOKENS),
    "mixing": lambda d: mixing.mixed(d, {"lang": F.col("lang"), "source": F.col("source")}, {}, share=(1, 1), epochs=1),
    "lm": lambda d: lm.scored(d, F.col("doc_id") % 3 != 0),
    "rules": rules.judged,
    "pii": lambda d: pii.pseudonymised(d, "key"),
    "sharding": lambda d: sharding.sharded(d, [1.0, 2.0, 1.0], grown_weight=1.0),
    "minhash": minhash.grouped,
}
PASS_THROUGH = {"quality": "score", "bpe": "ids", "mixing": "epoch", "pii": "n_pseudonyms"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(messy, name):
    rows = OPERATORS[name](messy).collect()
    given = [r.doc_id for r in messy.collect() if name != "mixing" or (r.text or "").split()]
    order = lambda ids: sorted(ids, key=lambda i: (i is None, i))
    assert order(r.doc_id for r in rows) == order(given)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(messy, empty, name):
    full, none = OPERATORS[name](messy), OPERATORS[name](empty)
    assert none.count() == 0 and none.dtypes == full.dtypes


@pytest.mark.parametrize("name", PASS_THROUGH)
def test_foreign_columns_stay(messy, name):
    done = OPERATORS[name](messy)
    kept = [c for c in messy.columns if c not in (PASS_THROUGH[name], "text")]
    assert set(kept) < set(done.columns)
    first = done.filter("doc_id = 1").first()
    for c in kept:
        assert first[c] == messy.filter("doc_id = 1").first()[c], c


def test_what_awkward_rows_get(messy):
    def found(df, doc_id):
        return df.filter(F.col("doc_id").eqNullSafe(F.lit(doc_id)))

    tokens = OPERATORS["bpe"](messy).select("doc_id", "ids", "decoded")
    for doc_id in (100, 101, 102):
        assert found(tokens, doc_id).first()[1:] == ([], "")
    groups = minhash.grouped(messy)
    for doc_id in (100, 101, 102):
        assert found(groups, doc_id).first()[1:] == (0, doc_id, True)
    assert [r[1:] for r in found(groups, 105).collect()] == [(1, 105, True)] * 2
    assert found(groups, 104).first().component_id == 103
    assert {r.kept for r in found(groups, None).collect()} == {True}
    left = suffix.without_repeats(messy)
    assert found(left, 104).first().kept == b"" and found(left, 100).first().n_bytes == 0
    assert [r.n_removed for r in found(left, 105).collect()] == [0, 0]
    scores = lm.scored(messy, F.col("doc_id") % 3 != 0)
    assert found(scores, 100).first().n_tokens == 1
    verdicts = rules.judged(messy)
    assert found(verdicts, 100).first().base_failed and not found(verdicts, 100).first().kept
    assert found(verdicts, 103).first().n_words == 30001
    shards = sharding.sharded(messy, [1.0] * 3)
    assert found(shards, 100).first()[1:3] == (8, 0)
    assert len({r.shard for r in found(shards, 105).collect()}) == 1
    assert len({(r.shard, r.slot) for r in shards.collect()}) == messy.count()
    assert {r.score for r in found(OPERATORS["quality"](messy), 100).collect()} == {
        r.score for r in found(OPERATORS["quality"](messy), 101).collect()
    }
    assert found(pii.pseudonymised(messy, "k"), 100).first().text is None


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5 + 1), 1.0, -float(i)]) for i in range(40)]
    rows += [(40, None), (60, [0.0, 0.0, 0.0]), (61, [nan, 1.0, 1.0]), (62, [inf, 0.0, 1.0]), (63, [None, 1.0, 1.0]),
             (64, []), (65, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (20, [1.0, 1.0, -20.0]), (80, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(vectors, vectors.filter("vec_id % 20 = 0"), 50).collect()
    assert {r.query_id for r in found} == {0, 20, 80}
    for q in (0, 20, 80):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 41))
        assert {r.vec_id for r in own} == {*range(40), 80} - {q}
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
    none = vectors.limit(0)
    assert ann.search(none, none).count() == 0
    one = vectors.filter("vec_id = 0")
    assert ann.search(one, one).count() == 0
