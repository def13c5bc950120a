import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.operators import retrieve


def frame(spark, vectors, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>")


def brute(queries, kb, k, exclude_self=False, metric="l2"):
    q = np.array([r.embedding for r in queries], dtype=np.float64)
    n = np.array([r.embedding for r in kb], dtype=np.float64)
    if metric == "cosine":
        q, n = retrieve._unit(q), retrieve._unit(n)
    out = {}
    for a, va in zip(queries, q):
        d = np.sqrt(((n - va) ** 2).sum(axis=1))
        ranked = sorted((x, b.id) for x, b in zip(d, kb) if not (exclude_self and b.id == a.id))
        out[a.id] = [i for _, i in ranked[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("q", "rk").collect():
        out.setdefault(r.q, []).append(r.n)
    return out


def clustered(seed, n, dim=6, centres=5, spread=0.05):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    return (c[r.integers(centres, size=n)] + spread * r.normal(size=(n, dim))).astype(np.float32)


def search(f, queries, kb, k, **more):
    return f(queries, kb, k, query_id="id", kb_id="id", **more)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("pivots", [1, 4, 30, 1000])
def test_exact_equals_brute_force(spark, metric, pivots):
    queries, kb = frame(spark, clustered(1, 40), 1000), frame(spark, clustered(2, 300))
    got = search(retrieve.similar_issues, queries, kb, 5, metric=metric, pivots=pivots)
    assert found(got) == brute(queries.collect(), kb.collect(), 5, metric=metric)


def test_copies_ties_and_tiles(spark, monkeypatch):
    # A third of all vectors are one copy; small tiles force every cell into several.
    monkeypatch.setattr(retrieve, "TILE_ROWS", 16)
    vectors = clustered(3, 240)
    vectors[::3] = vectors[0]
    kb = frame(spark, vectors)
    got = found(search(retrieve.similar_issues, kb, kb, 4, exclude_self=True))
    assert got == brute(kb.collect(), kb.collect(), 4, exclude_self=True)
    assert got[0] == [3, 6, 9, 12] and got[3] == [0, 6, 9, 12]


def test_equal_distances_break_on_id(spark):
    kb = frame(spark, [[1, 0], [-1, 0], [0, 1], [0, -1]])
    got = found(search(retrieve.similar_issues, frame(spark, [[0, 0]], 9), kb, 3))
    assert got == {9: [0, 1, 2]}


def test_fewer_issues_than_k_and_none_at_all(spark):
    q, kb = frame(spark, [[0, 0], [1, 1]], 9), frame(spark, [[1, 0], [2, 0]])
    assert found(search(retrieve.similar_issues, q, kb, 5)) == {9: [0, 1], 10: [0, 1]}
    assert search(retrieve.similar_issues, q, kb.limit(0), 5).count() == 0
    assert search(retrieve.similar_issues, q.limit(0), kb, 5).count() == 0
    assert search(retrieve.similar_issues_lsh, q, kb.limit(0), 5).count() == 0


def test_far_cells_are_not_visited(spark):
    # With tight clusters most cells are proven irrelevant; count what reaches the tiles.
    kb = frame(spark, clustered(4, 400, centres=8, spread=0.01))
    seen = []
    tiled = retrieve._tiled_top

    def spy(queries, *rest):
        seen.append(queries.count())
        return tiled(queries, *rest)

    retrieve._tiled_top = spy
    try:
        got = found(search(retrieve.similar_issues, kb, kb, 3, exclude_self=True, pivots=64))
    finally:
        retrieve._tiled_top = tiled
    assert got == brute(kb.collect(), kb.collect(), 3, exclude_self=True)
    assert seen[0] < 400 * 64 / 4


def test_string_ids_and_distances(spark):
    kb = frame(spark, [[0, 0], [3, 4]]).withColumn("id", F.format_string("k%d", "id"))
    got = search(retrieve.similar_issues, frame(spark, [[0, 0]], 7), kb, 2).orderBy("rk").collect()
    assert [(r.q, r.n, r.distance, r.rk) for r in got] == [(7, "k0", 0.0, 1), (7, "k1", 5.0, 2)]


def test_lsh_recall(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "TILE_ROWS", 64)
    kb = frame(spark, clustered(5, 500, dim=16, centres=20))
    exact = brute(kb.collect(), kb.collect(), 5, exclude_self=True)
    got = found(search(retrieve.similar_issues_lsh, kb, kb, 5, exclude_self=True))
    hits = sum(len(set(got.get(q, [])) & set(n)) for q, n in exact.items())
    assert hits / (5 * len(exact)) > 0.95
    assert all(len(n) == len(set(n)) for n in got.values())


def test_evidence_and_cases(spark):
    kb = frame(spark, [[0, 0], [3, 4]])
    near = search(retrieve.similar_issues, frame(spark, [[0, 1]], 7), kb, 2)
    texts = spark.createDataFrame([(0, "q" * 120, None), (1, "b", "c")], "n bigint, customer_text string, agent_text string")
    row = retrieve.rag_evidence(near, texts).first()
    assert (row.q, row.n, row.distance, row.original_customer, row.retrieved_reply) == (7, 0, 1.0, "q" * 100, "")
    stored = spark.createDataFrame([("0", "d0", "r0"), ("1", "d1", None)], "id string, document string, agent_reply string")
    cases = retrieve.retrieved_cases(near, stored).first()
    assert [tuple(e) for e in cases.examples] == [("d0", "r0"), ("d1", None)]


def test_stored_index(spark, tmp_path):
    vectors = clustered(6, 200)
    vectors[50:120] = vectors[50]
    kb, queries = frame(spark, vectors), frame(spark, clustered(7, 30), 1000)
    retrieve.write_issue_index(retrieve.issue_index(kb, "id", pivots=20), str(tmp_path / "index"))
    index = retrieve.read_issue_index(spark, str(tmp_path / "index"))
    assert index.table.count() == 200 - 70 + 6
    got = retrieve.search_issue_index(queries, index, 5, "id")
    assert found(got) == brute(queries.collect(), kb.collect(), 5)
    with pytest.raises(ValueError, match="copies"):
        retrieve.search_issue_index(queries, index, 7, "id")
    empty = retrieve.issue_index(kb.limit(0), "id")
    retrieve.write_issue_index(empty, str(tmp_path / "none"))
    assert retrieve.search_issue_index(queries, retrieve.read_issue_index(spark, str(tmp_path / "none")), 5, "id").count() == 0


def test_repeated_query_ids_are_answered_once(spark):
    kb = frame(spark, clustered(8, 60))
    queries = frame(spark, clustered(9, 10), 1000)
    again = queries.union(queries).union(queries)
    for f in (retrieve.similar_issues, retrieve.similar_issues_lsh):
        assert found(search(f, again, kb, 4)) == found(search(f, queries, kb, 4))


@pytest.mark.parametrize("f", [retrieve.similar_issues, retrieve.similar_issues_lsh])
def test_repeated_issues_take_one_place(spark, f, monkeypatch):
    near = [1.0, 0.0]
    kb = spark.createDataFrame([(1, near)] * 7 + [(2, near), (3, near), (4, [1.0, 0.1])], "id bigint, embedding array<float>")
    assert found(search(f, frame(spark, [near], 9), kb, 3)) == {9: [1, 2, 3]}


def test_an_issue_with_several_vectors_counts_by_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "TILE_ROWS", 8)
    vectors = clustered(11, 60)
    rows = [(i % 20, [float(x) for x in v]) for i, v in enumerate(vectors)]
    kb, queries = spark.createDataFrame(rows, "id bigint, embedding array<float>"), frame(spark, clustered(12, 10), 1000)
    least = {}
    for q in queries.collect():
        d = {}
        for i, v in rows:
            d[i] = min(d.get(i, 9e9), float(np.linalg.norm(np.float32(v).astype(float) - np.float64(q.embedding))))
        least[q.id] = [i for _, i in sorted((x, i) for i, x in d.items())][:5]
    for pivots in (1, 12):
        assert found(search(retrieve.similar_issues, queries, kb, 5, pivots=pivots)) == least


def test_lsh_recall_without_structure(spark):
    vectors = np.random.default_rng(13).normal(size=(1500, 24)).astype(np.float32)
    kb = frame(spark, vectors)
    exact = brute(kb.collect(), kb.collect(), 5, exclude_self=True)
    got = found(search(retrieve.similar_issues_lsh, kb, kb, 5, exclude_self=True))
    assert sum(len(set(got.get(q, [])) & set(n)) for q, n in exact.items()) > 0.95 * 5 * len(exact)


def test_rows_are_sent_by_groups_not_by_tiles(spark, monkeypatch):
    kb = frame(spark, clustered(14, 300))
    monkeypatch.setattr(retrieve, "MIN_GROUP_ROWS", 100)
    got = search(retrieve.similar_issues, kb, kb, 4, exclude_self=True, pivots=1, tile_rows=7)
    assert found(got) == brute(kb.collect(), kb.collect(), 4, exclude_self=True)
    groups = {(r.blocks, r.slices) for r in retrieve._cell_groups(*[kb.selectExpr("0 AS cell")] * 2).collect()}
    assert groups == {(3, 3)}
    monkeypatch.setattr(retrieve, "MAX_GROUP_ROWS", 20)
    assert retrieve._cell_groups(*[kb.selectExpr("0 AS cell")] * 2).first().blocks == 15


def test_a_large_cell_is_not_dealt_by_its_number(spark):
    queries, kb = (frame(spark, clustered(15, 50)).selectExpr(f"id AS {c}", "embedding AS vec", "0 AS cell") for c in "qn")
    plan = retrieve._tiled_top(queries, kb, 3, "l2")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_rows_sent_many_times_are_spread_first(spark, monkeypatch):
    side = frame(spark, clustered(18, 64)).selectExpr("id AS q", "embedding AS vec").coalesce(1)
    assert retrieve._spread(side, "q", 10).rdd.getNumPartitions() == 1
    monkeypatch.setattr(retrieve, "SENT_BYTES", 64 * 88)
    assert retrieve._spread(side, "q", 10).rdd.getNumPartitions() == 10


def test_vectors_meet_pivots_some_at_a_time(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(retrieve, "PIVOT_ROWS", 8)
    vectors = clustered(16, 30).astype(float)
    parts = list(retrieve._by_pivots(pd.Series(list(vectors)), vectors[:5], False))
    assert [len(p) for p in parts] == [8, 8, 8, 6]
    assert np.allclose(np.concatenate(parts), np.linalg.norm(vectors[:, None] - vectors[None, :5], axis=2), atol=1e-6)


def test_hash_tables_do_not_grow_without_structure(spark, monkeypatch):
    kb = frame(spark, np.random.default_rng(17).normal(size=(600, 24))).selectExpr("id AS n", "embedding AS vec")
    monkeypatch.setattr(retrieve, "TILE_ROWS", 64)
    bits, tables = retrieve._hash_plan(kb, 6, 0.97, None)
    assert 1 <= bits < 7 and tables <= retrieve.MAX_TABLES
    assert retrieve._hash_plan(kb, 6, 0.97, 7)[0] == 7  # what is given stays
