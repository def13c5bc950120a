"""Two-tree search against scores of all pairs."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from casework.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    """(item row, rank, id, score) by definition."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            if c:
                m = 75 + 25 * sum(c.values()) * n // words
                score = sum(
                    math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms(text) if t in c
                )
                if score > 0:
                    scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


def found(spark, docs, items, k, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), k, **more).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("k", [1, 5])
def test_equal_to_all_pairs(spark, prose, k):
    items = [(i, t[: 30 + 7 * i]) for i, t in prose[::3]] + [(90, "zebra"), (91, ""), (92, None), (93, "The THE the the lorem")]
    docs = [(i, t) for i, t in prose] + [(200, None), (201, ""), (202, " .,;\n"), (203, "lorem " * 3), (204, "lorem " * 3)]
    assert found(spark, docs, items, k) == sorted(plain(docs, items, k), key=str)


def test_blocks_of_items_give_the_same(spark, prose):
    items = [(i, t) for i, t in prose]
    whole = found(spark, prose, items, 4)
    assert found(spark, prose, items, 4, block_bytes=2000) == whole == sorted(plain(prose, items, 4), key=str)


def test_ids_and_empty_tables(spark):
    docs = [(None, "a b"), (7, "a b"), (7, "a b"), (3, "a c d e"), (None, None)]
    rows = found(spark, docs, [(None, "a b"), (1, "c"), (1, "c")], 9)
    assert [r[1:] for r in rows if r[0] is None] == sorted([r[1:] for r in plain(docs, [(None, "a b")], 9)], key=str)
    assert [r[:3] for r in rows if r[0] == 1] == [(1, 1, 3)] * 2
    assert found(spark, [], [(1, "a")], 3) == found(spark, [(1, "a")], [], 3) == found(spark, [(1, "")], [(1, "a")], 3) == []


def test_awkward_documents(spark, messy, prose):
    items = spark.createDataFrame(prose[::9], "item_id long, text string")
    got = sorted(map(tuple, lexical.search(messy, items, 7).collect()), key=str)
    assert got == sorted(plain([(r.doc_id, r.text) for r in messy.collect()], prose[::9], 7), key=str)


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 10)
    text = "Éa bb-CC dddddddddddddddddddd 1x" * 20
    assert [t.decode() for part in lexical.terms(text.encode()) for t in part] == terms(text)


def test_whole_parts_of_the_trees_are_passed_over():
    """Documents of different topics: items of one topic never get to those of another."""
    rng = np.random.default_rng(5)
    topics, each, width = 16, 128, 400
    row, term = [], []
    for d in range(topics * each):
        for t in rng.choice(width // topics, 12, replace=False) + d % topics * (width // topics):
            row.append(d)
            term.append(t)
    row, term = np.array(row), np.array(term)
    value = rng.integers(1, 1000, len(row))
    n = 512
    mine = row < n  # the first documents are the items as well
    items = lexical.Items(n, row[mine], term[mine], value[mine], width)
    best = lexical.Search(items, np.zeros(n, np.int64), 3)
    best.add(lexical.Documents(np.arange(topics * each), row, term, value, np.ones(width, np.int64)))
    assert best.pairs < n * topics * each / 4
    dense = np.zeros((topics * each, width), np.int64)
    dense[row, term] = value
    scores = dense[:n] @ dense.T
    at, ids, got = best.found()
    for i in range(n):
        want = sorted(zip(-scores[i], range(topics * each)))[:3]
        assert sorted(zip(-got[at == i], ids[at == i])) == want


def test_sums_are_exact_beyond_doubles():
    big = np.array([2**53, 1, 2**53, 2], np.int64)
    assert lexical._sums(np.array([0, 0, 1, 1]), big, 2).tolist() == [2**53 + 1, 2**53 + 2]
