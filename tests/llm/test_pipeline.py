"""The pipeline's stages against the operators they apply."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from casework.llm import quality
from checks.compare import difference, duck
from casework.llm.queries import ORACLE, QUERIES
from tests.conftest import SF
from tests.llm.test_brute import luhn, plain_groups


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), ORACLE[name]) is None


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "pii", "mixing", "encoding"]

    good = stages["quality"](spark, docs, SF).cache()
    scores = quality.scored(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert good.columns == columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scores if r.score >= 0.7)

    single = stages["near_duplicates"](spark, good, SF).cache()
    groups = plain_groups([(r.doc_id, r.text) for r in good.collect()])
    assert single.columns == columns and single.count() < good.count()
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, g in groups.items() if g[2])

    named = stages["pii"](spark, single, SF).cache()
    assert named.columns == columns and named.dtypes == docs.dtypes and named.count() == single.count()
    before = {r.doc_id: r.text for r in single.collect()}
    changed = [r for r in named.collect() if r.text != before[r.doc_id]]
    assert changed and all(r.n_chars == len(r.text) for r in changed)

    chosen = stages["mixing"](spark, named, SF).cache()
    assert chosen.columns == columns
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert 0.899 * words(named) <= words(chosen) <= 0.9 * words(named)
    whole = {r.doc_id: r.text for r in named.collect()}
    assert all(whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in chosen.collect())
    cut = [r.source for r in chosen.collect() if r.text.split() != whole[r.doc_id].split()]
    assert len(cut) <= named.select("lang", "source").distinct().count()  # the last document of each leaf at most

    last = stages["encoding"](spark, chosen, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in chosen.collect()]
    assert sorted((r.doc_id, r.ids) for r in last) == sorted(want)


def test_awkward_rows_through_the_stages(spark, messy, tmp_path):
    docs = messy.select(
        "doc_id", "text", "lang", "source", "n_chars", F.lit("own").alias("_id"), F.lit(1).alias("epoch"),
        F.lit(2).alias("_epoch"), F.lit(0.5).alias("_score"), F.lit(3).alias("_EPOCH_"),
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 5 > 0).cast("int").alias("quality"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0), docs.drop("n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, rows, str(tmp_path))
            assert done.count() <= rows.count() * 2, name
            if name != "encoding":
                assert done.columns == rows.columns, name


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and rows.count() > 50
    assert luhn("4111111111111111")
