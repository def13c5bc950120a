"""Ranked lexical search: the best documents for each of many items, by two trees.

Items and documents are vectors over terms, their product is the score. Either side is put into a binary
tree whose nodes hold, for every term, the greatest value below them; the product of two such nodes is at
least the score of every pair below them. Both trees are gone down together, and a pair of nodes whose
product is below the weakest k-th score so far of the node's items is left with everything under it. That
is exact: nothing that could be among an item's k best is passed over.

Items are searched in blocks of bounded size, which every executor gets as a whole. Documents lie in stored
batches of sparse vectors, each a tree. A first wave over one batch in WAVE finds k-th scores
that all tasks of the second start from, so what they send grows with items and k, not with the documents.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm import blocks
from casework.llm.shared import kept as stored
from casework.operators.numbering import numbered

#: Bytes of item texts searched for at once.
BLOCK_BYTES = 8 << 20
#: Documents and vector entries of a batch, at most (a single document may have more entries).
BATCH_ROWS, BATCH_ENTRIES = 2048, 1 << 19
#: Documents or items below the last nodes of a tree; values in a tree of documents.
LEAF, TREE_VALUES = 32, 1 << 21
WAVE = 64
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 22
NO_ID = np.iinfo(np.int64).max

_TERM = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
TABLE = _TERM.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def terms(text: bytes):
    """Lists of the terms of a text, A-Z as a-z; a long text gives several."""
    data, start = (text or b"").translate(TABLE), 0
    while start < len(data):
        stop = data.find(b" ", start + PIECE) if len(data) - start > PIECE else -1
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def counted(text: bytes, number: dict):
    """How many terms a text has, and how often those with a number."""
    n, found = 0, {}
    for part in terms(text):
        n += len(part)
        for t in map(number.get, part):
            if t is not None:
                found[t] = found.get(t, 0) + 1
    return n, found


# ---- trees

class Node(NamedTuple):
    level: int
    number: int


def _spread_out(n, row, term, value, rounds=4):
    """Place of every row on the line along which the rows, scaled to length 1, differ most (by power iteration)."""
    own, term = np.unique(term, return_inverse=True)
    if not len(own):
        return np.zeros(n)
    value = value / np.sqrt(np.bincount(row, value * value, n))[row]
    mean = np.bincount(term, value, len(own)) / n
    line = np.random.default_rng(0).standard_normal(len(own))
    for _ in range(rounds):
        place = np.bincount(row, value * line[term], n) - mean @ line
        line = np.bincount(term, value * place[row], len(own)) - mean * place.sum()
        line /= np.sqrt(line @ line) or 1.0
    return np.bincount(row, value * line[term], n)


def _bisected(n, row, term, value, depth):
    """Rows in tree order: the rows of a node are halved along the line on which they differ most."""
    order, edges = np.arange(n), np.array([0, n])
    some = value > 0
    row, term, value = row[some], term[some], value[some].astype(float)
    for _ in range(depth):
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        by = np.argsort(place[row], kind="stable")
        at = place[row][by]
        cuts, new, bounds = np.searchsorted(at, edges), [], [0]
        for i in range(len(edges) - 1):
            a, b, rows = cuts[i], cuts[i + 1], order[edges[i] : edges[i + 1]]
            line = _spread_out(len(rows), at[a:b] - edges[i], term[by[a:b]], value[by[a:b]])
            new.append(rows[np.argsort(-line, kind="stable")])
            bounds += [edges[i] + (len(rows) + 1) // 2, edges[i + 1]]
        order, edges = np.concatenate(new), np.array(bounds)
    return order, edges


def _depth(n, values=None):
    nodes = max(1, n // LEAF)
    if values is not None:
        nodes = min(nodes, max(1, TREE_VALUES // max(1, values)))
    return nodes.bit_length() - 1


class Items:
    """Tree of items; levels are kept term by term: which nodes have the term, and their greatest value."""

    def __init__(self, n, row, term, value, width):
        depth = _depth(n)
        self.order, edges = _bisected(n, row, term, value, depth)
        self.n, self.width, self.depth = n, width, depth
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        spot = place[row]
        leaf = np.searchsorted(edges, spot, side="right") - 1
        self.edges = edges
        self.levels = []
        for level in range(depth + 1):
            node = leaf >> (depth - level)
            self.levels.append(_by_term(node, term, value, width, 1 << level, np.maximum))
        self.rows = _by_term(spot, term, value, width, n, np.add)

    def weakest(self, least):
        """For every level the smallest of ``least`` (in tree order) below each node."""
        out = [np.minimum.reduceat(least, self.edges[:-1])]
        for _ in range(self.depth):
            out.append(np.minimum(out[-1][0::2], out[-1][1::2]))
        return out[::-1]


def _by_term(node, term, value, width, nodes, combined):
    key = term * nodes + node
    by = np.argsort(key, kind="stable")
    key, value = key[by], value[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    value = combined.reduceat(value, first) if len(first) else value
    key = key[first]
    return np.searchsorted(key, np.arange(width + 1) * nodes), (key % nodes), value


def _spread(index, term):
    """For lists kept by term: entry numbers of the lists of ``term`` one after the other, and whose they are."""
    lows, counts = index[0][term], index[0][term + 1] - index[0][term]
    whose = np.repeat(np.arange(len(term)), counts)
    within = np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)
    return lows[whose] + within, whose


def _sums(at, products, n):
    """Exact sums of whole numbers by place; in doubles only while these are exact."""
    if not len(products) or float(products.max()) * len(products) < 2**53:
        return np.bincount(at, products, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, at, products)
    return out


class Documents:
    """Tree of a batch of documents over the terms that occur in it."""

    def __init__(self, ids, row, term, value, weight):
        own, local = np.unique(term, return_inverse=True)
        n, depth = len(ids), _depth(len(ids), len(own))
        order, edges = _bisected(n, row, local, value * weight[term], depth)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        by = np.argsort(place[row], kind="stable")
        self.ids, self.own, self.edges, self.depth = ids[order], own, edges, depth
        self.row, self.term, self.value = place[row][by], local[by], value[by]
        top = np.zeros((1 << depth, len(own)), np.int64)
        np.maximum.at(top, (np.searchsorted(edges, self.row, side="right") - 1, self.term), self.value)
        self.levels = [top]
        for _ in range(depth):
            self.levels.append(np.maximum(self.levels[-1][0::2], self.levels[-1][1::2]))
        self.levels.reverse()
        self.cuts = np.searchsorted(self.row, edges)


class Search:
    """The k best documents so far of every item; ``least`` are scores that k documents are known to reach."""

    def __init__(self, items: Items, least, k):
        self.items, self.k, self.base = items, k, np.maximum(least[items.order], 1)
        self.scores = np.zeros((items.n, k), np.int64)
        self.ids = np.full((items.n, k), NO_ID)
        self.weakest = items.weakest(self.base)
        self.pairs = 0  # of an item and a document that were scored

    def add(self, docs: Documents):
        pending = [(Node(0, 0), 0, np.zeros(1, np.int64))]
        while pending:
            node, level, alive = pending.pop()
            alive = self._alive(docs, node, level, alive)
            if not len(alive):
                continue
            if node.level == docs.depth and level == self.items.depth:
                self._score(docs, node.number, alive)
                continue
            if level < self.items.depth:
                level, alive = level + 1, np.sort(np.r_[2 * alive, 2 * alive + 1])
            if node.level < docs.depth:
                pending += [(Node(node.level + 1, 2 * node.number + side), level, alive) for side in (1, 0)]
            else:
                pending.append((node, level, alive))

    def _alive(self, docs, node, level, alive):
        """Which nodes of items may have a document below the node of documents."""
        top = docs.levels[node.level][node.number]
        there = np.flatnonzero(top)
        index = self.items.levels[level]
        entry, whose = _spread(index, docs.own[there])
        bound = _sums(index[1][entry], index[2][entry] * top[there][whose], 1 << level)
        return alive[bound[alive] >= self.weakest[level][alive]]

    def _score(self, docs, leaf, alive):
        items = self.items
        low, high = docs.edges[leaf], docs.edges[leaf + 1]
        a, b = docs.cuts[leaf], docs.cuts[leaf + 1]
        sizes = items.edges[alive + 1] - items.edges[alive]
        spots = np.repeat(items.edges[alive], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        short = np.full(items.n, -1)
        short[spots] = np.arange(len(spots))
        entry, whose = _spread(items.rows, docs.own[docs.term[a:b]])
        at = short[items.rows[1][entry]]
        mine = at >= 0
        entry, whose, at = entry[mine], whose[mine], at[mine]
        n = high - low
        scores = _sums(
            at * n + docs.row[a:b][whose] - low, items.rows[2][entry] * docs.value[a:b][whose], len(spots) * n
        ).reshape(len(spots), n)
        self.pairs += scores.size
        better = np.flatnonzero((scores >= np.maximum(self.base[spots], 1)[:, None]).any(1))
        if not len(better):
            return
        spots = spots[better]
        both = np.concatenate([self.scores[spots], scores[better]], 1)
        ids = np.concatenate([self.ids[spots], np.broadcast_to(docs.ids[low:high], (len(spots), n))], 1)
        by = np.lexsort((ids, -both))[:, : self.k]
        self.scores[spots] = np.take_along_axis(both, by, 1)
        self.ids[spots] = np.take_along_axis(ids, by, 1)
        self.base[spots] = np.maximum(self.base[spots], self.scores[spots, -1])
        self.weakest = items.weakest(self.base)

    def found(self):
        """(item, id, score) of what is worth reporting."""
        worth = (self.scores > 0) & (self.scores >= self.base[:, None])
        spot, _ = np.nonzero(worth)
        return self.items.order[spot], self.ids[worth], self.scores[worth]


# ---- on Spark

_VECTORS = "wave boolean, documents long, words long, terms array<int>, counts array<long>, ids binary, lengths binary, rows binary, entries binary, times binary"


def _vectors(docs: DataFrame, number: dict) -> DataFrame:
    """Batches of the documents' vectors over the numbered terms, and what they add to the statistics."""
    given = docs.sparkSession.sparkContext.broadcast(number)

    def batches(parts):
        ids, lengths, rows, entries, times, documents, words, n = [], [], [], [], [], 0, 0, 0

        def row():
            term, count = np.unique(np.array(entries, np.int32), return_counts=True)
            key = np.array(ids, np.int64)
            columns = {
                "wave": [int(blocks.distinct(key)[0].sum() if len(key) else 0) % WAVE == 0], "documents": [documents], "words": [words],
                "terms": [term.tolist()], "counts": [count.tolist()], "ids": [blocks.pack(key)], "lengths": [blocks.pack(np.array(lengths, np.int64))],
                "rows": [blocks.pack(np.array(rows, np.int32))], "entries": [blocks.pack(np.array(entries, np.int32))], "times": [blocks.pack(np.array(times, np.int64))],
            }
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds)], list(columns))

        for part in parts:
            for id_, text in zip(part.column(0).to_pylist(), part.column(1)):
                size, found = counted(text.as_py(), given.value)
                documents += size > 0
                words += size
                if not found:
                    continue
                if len(ids) == BATCH_ROWS or len(entries) + len(found) > BATCH_ENTRIES:
                    yield row()
                    ids, lengths, rows, entries, times, documents, words = [], [], [], [], [], 0, 0
                rows += [len(ids)] * len(found)
                entries += found.keys()
                times += found.values()
                ids.append(NO_ID if id_ is None else id_)
                lengths.append(size)
        if ids or documents:
            yield row()

    return docs.mapInArrow(batches, _VECTORS)


def _searched(vectors: DataFrame, index, least, k: int) -> DataFrame:
    """``item, id, score`` of documents that may be among an item's k best."""
    context = vectors.sparkSession.sparkContext
    given = context.broadcast((*index, least))

    def search(parts):
        items, weight, documents, words, least = given.value
        best = Search(items, least, k)
        for part in parts:
            for r in part.to_pylist():
                ids, lengths = blocks.unpack(r["ids"]), blocks.unpack(r["lengths"]).astype(np.int64)
                row, term, tf = (blocks.unpack(r[c]).astype(np.int64) for c in ("rows", "entries", "times"))
                m = 75 + (25 * lengths * documents) // words
                value = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
                best.add(Documents(ids.astype(np.int64), row, term, value, weight))
        found = best.found()
        for a in range(0, len(found[0]), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 8192], pa.int64()) for c in found], ["item", "id", "score"])

    some = vectors.filter(F.size("terms") > 0).select("ids", "lengths", "rows", "entries", "times")
    return some.mapInArrow(search, "item long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _indexed(rows, number, statistics):
    """The tree of a block of items, and the weights of its terms."""
    documents, words, holding = statistics
    weight = np.zeros(max(1, len(number)), np.int64)
    for t, n in holding:
        weight[t] = int(np.floor(1000 * np.log((2 * documents + 2) / (2 * n + 1))))
    row, term, value = [], [], []
    for i, (_, text) in enumerate(rows):
        for t, times in counted(text, number)[1].items():
            row.append(i)
            term.append(t)
            value.append(times * int(weight[t]))
    arrays = [np.array(x, np.int64) for x in (row, term, value)]
    return Items(len(rows), *arrays, max(1, len(number))), weight, documents, words


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of every item: the item's id, ``rank`` from 1, the document's id, ``score``.

    Terms are runs of digits, letters A-Z (as a-z) and all characters beyond ASCII. A term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))) among N documents with a term; a document adds for each of an
    item's terms, repeats included, the weight times (10^9 tf) div (1000 tf + 12 m), where m is
    75 + (25 n N) div L for a document of n of all L terms. Only scores above 0 count, equal ones go
    by ascending id, documents without an id last. Null texts have no terms. Every row of ``items`` is an
    item, also if its id is null or repeated; rows of ``docs`` that repeat an id are ranked each. Empty tables
    give an empty one. Ids of documents are whole numbers below 2 ** 63 - 1.

    Items are searched for in blocks of about ``block_bytes`` of text (a job per block collects them). Texts of
    any length are read in pieces. Runs jobs.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    wanted = stored(items.select(F.col(item_col).alias("_item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("_text")))
    wanted = stored(numbered(wanted, ["_item", "_text"], stored, "_n"))
    size = wanted.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    out = None
    for part in range(parts):
        chosen = wanted.filter(F.pmod(F.xxhash64("_n"), F.lit(parts)) == part)
        rows = [(r[0], r[1].encode()) for r in chosen.select("_n", "_text").orderBy("_n").collect()]
        number = {}
        for _, text in rows:
            for found in terms(text):
                for t in found:
                    number.setdefault(t, len(number))
        if not number:
            continue
        vectors = stored(_vectors(texts, number))
        documents, words = vectors.agg(F.sum("documents"), F.sum("words")).first()
        if not words:
            continue
        holding = (
            vectors.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms")
            .agg(F.sum("t.counts").alias("n")).collect()
        )
        index = _indexed(rows, number, (documents, words, holding))
        least = np.zeros(len(rows), np.int64)
        first = stored(_best(_searched(vectors.filter("wave"), index, least, k), k))
        for r in first.filter(F.col("rank") == k).select("item", "score").collect():
            least[r[0]] = r[1]
        found = _best(first.drop("rank").unionByName(_searched(vectors.filter("NOT wave"), index, least, k)), k)
        numbers = np.array([r[0] for r in rows], np.int64)
        found = stored(found)
        place = spark.createDataFrame([(i, int(n)) for i, n in enumerate(numbers)], "item long, _n long")
        found = found.join(place, "item").select("_n", "rank", "id", "score")
        out = found if out is None else out.unionByName(found)
    id_type = docs.schema[id_col].dataType
    if out is None:
        out = spark.createDataFrame([], "_n long, rank int, id long, score long")
    id_ = F.when(F.col("id") != int(NO_ID), F.col("id")).cast(id_type)
    return out.join(wanted.select("_n", "_item"), "_n").select(
        F.col("_item").alias(item_col), F.col("rank").cast("int").alias("rank"), id_.alias(id_col), "score"
    )
