"""Language-model scores with deleted interpolation.

The model mixes maximum-likelihood estimates of n-grams of every order up to ``order`` and a
uniform one. How they are mixed depends on how often the context of an n-gram was seen: contexts
fall into buckets by the power of two of their count. The weights of a bucket are learned by
expectation-maximisation on the n-grams of a fold of the training texts, with the counts of the
other folds; scores then use the counts of all training texts.

Counts are exchanged in packed form (see ``blocks``) and cover all texts. For the weights every
held-out n-gram is entered in a table of its bucket and its estimates, each rounded to half a
power of two, whose size doesn't depend on the number of texts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm import blocks, words
from casework.llm.arrow import flat

#: Of how many training texts one is in the fold that weights are learned on; iterations.
FOLDS, ITERATIONS = 8, 60
#: Buckets of contexts, and levels of an estimate (the last one is zero).
BUCKETS, LEVELS, STEP = 40, 96, 2
END, START = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0x57A457A457A457A5)


def _ngrams(table, order):
    """Keys of every order for all tokens, the text of each token, and token offsets."""
    data, offsets = flat(table.column("_text"))
    parts, counts = [], []
    for a, b in words.pieces(offsets):
        h, at = words.hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = np.diff(at)
        tokens = np.full(len(h) + len(n), END, np.uint64)
        tokens[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        parts.append(tokens)
        counts.append(n + 1)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    ends = np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    keys, before = [tokens], tokens
    for k in range(1, order):
        shifted = np.r_[np.full(min(k, len(tokens)), START, np.uint64), tokens[:-k]] if len(tokens) else tokens
        shifted = np.where(np.arange(len(tokens)) - ends[owner] < k, START, shifted)
        before = words.mixed(before * np.uint64(0xD6E8FEB86659FD93) + shifted)
        keys.append(before)
    return keys, owner, ends


def _flags(table, name):
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)


def _send(order, n):
    """Distinct n-grams of a block for every range: how often in training texts, and in all but the fold."""
    kinds = {"_block": pa.int32(), "_range": pa.int32(), "_keys": pa.list_(pa.binary()), "_all": pa.list_(pa.binary()), "_base": pa.list_(pa.binary())}

    def run(table):
        out = {k: [] for k in kinds}
        if table.num_rows:
            keys, owner, _ = _ngrams(table, order)
            train, tuned = _flags(table, "_train"), _flags(table, "_tuned")
            rows = [([], [], []) for _ in range(n)]
            for k in keys:
                known, _, (all_, base) = blocks.distinct(k, train[owner], (train & ~tuned)[owner])
                edges = blocks.ranges(known, n)
                for r in range(n):
                    a, b = edges[r], edges[r + 1]
                    rows[r][0].append(blocks.pack_sorted(known[a:b]))
                    rows[r][1].append(blocks.pack(all_[a:b]))
                    rows[r][2].append(blocks.pack(base[a:b]))
            out["_block"] = [table.column("_block")[0].as_py()] * n
            out["_range"] = list(range(n))
            out["_keys"], out["_all"], out["_base"] = ([r[i] for r in rows] for i in range(3))
        return blocks.table(out, kinds)

    return run


def _answer(order):
    """Total counts for every block of a range, and the range's share of the totals."""
    kinds = {"_block": pa.int32(), "_range": pa.int32(), "_all": pa.list_(pa.binary()), "_base": pa.list_(pa.binary()), "_sums": pa.list_(pa.int64())}

    def run(table):
        out = {k: [] for k in kinds}
        senders = table.column("_block").to_pylist()
        out["_block"], out["_range"] = senders, table.column("_range").to_pylist()
        out["_all"], out["_base"] = ([[] for _ in senders] for _ in range(2))
        sums = []
        keys, all_, base = (table.column(c).combine_chunks() for c in ("_keys", "_all", "_base"))
        for o in range(order):
            parts = [blocks.unpack_sorted(row[o].as_py()) for row in keys]
            known, place, totals = blocks.distinct(
                np.concatenate(parts), *[np.concatenate([blocks.unpack(row[o].as_py()) for row in c]) for c in (all_, base)]
            )
            if o == 0:
                sums = [int(totals[0].sum()), int((totals[0] > 0).sum()), int(totals[1].sum())]
            at = 0
            for i, p in enumerate(parts):
                own = place[at : at + len(p)]
                at += len(p)
                out["_all"][i].append(blocks.pack(totals[0][own]))
                out["_base"][i].append(blocks.pack(totals[1][own]))
        out["_sums"] = [sums] * len(senders)
        return blocks.table(out, kinds)

    return run


class _Counts:
    """What a block knows once the ranges have answered."""

    def __init__(self, table, answers, order, column):
        self.keys, self.owner, self.ends = _ngrams(table, order)
        answers = answers.sort_by("_range")
        rows = answers.column(column).combine_chunks()
        self.counts = []
        for o, k in enumerate(self.keys):
            known, place, _ = blocks.distinct(k)
            total = np.concatenate([blocks.unpack(r[o].as_py()) for r in rows]).astype(np.int64)
            assert len(total) == len(known)
            self.counts.append(total[place])
        n, v, base = np.array(answers.column("_sums").to_pylist(), np.int64).sum(axis=0)
        self.n, self.v = int(n if column == "_all" else base), int(v)
        self.total = int(n)

    def estimates(self, of=slice(None)):
        """Estimates of every order for chosen tokens (0 where the context is unknown), and context buckets."""
        first = np.zeros(len(self.keys[0]), bool)
        first[self.ends[:-1]] = True
        context = np.full(len(first), self.n, np.int64)
        shares = []
        starts = None
        for o, count in enumerate(self.counts):
            if o:
                # A context is the n-gram before the token; at the start of a text it is as
                # frequent as texts are, which every text's end is too.
                context = np.r_[0, self.counts[o - 1][:-1]] if len(count) else count
                ends = self.counts[0][self.ends[1:] - 1]
                context[self.ends[:-1]] = ends if len(ends) else 0
            c = context[of]
            shares.append(np.where(c > 0, count[of] / np.maximum(c, 1), 0.0))
        c = context[of] if len(self.counts) > 1 else np.full(len(shares[0]), self.n)
        bucket = np.where(c > 0, np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)
        return shares, bucket


def _level(p):
    """Rounded estimates as whole numbers."""
    return np.where(p > 0, np.minimum(np.round(-np.log2(np.maximum(p, 1e-30)) * STEP), LEVELS - 2), LEVELS - 1).astype(np.int64)


def _observe(order):
    """Held-out n-grams of a block by bucket and levels."""
    kinds = {"_cell": pa.int64(), "_seen": pa.int64(), "_v": pa.int64()}

    def run(left, right):
        out = {"_cell": [], "_seen": [], "_v": []}
        if left.num_rows and right.num_rows:
            tuned = _flags(left, "_tuned") & _flags(left, "_train")
            if tuned.any():
                known = _Counts(left, right, order, "_base")
                of = np.flatnonzero(tuned[known.owner])
                shares, cell = known.estimates(of)
                for p in shares:
                    cell = cell * LEVELS + _level(p)
                cell, seen = np.unique(cell, return_counts=True)
                out = {"_cell": cell, "_seen": seen, "_v": np.full(len(cell), known.v)}
        return blocks.table(out, kinds)

    return run


def expectation_maximisation(seen, bucket, estimates):
    """Weights of each bucket (rows) for its estimates (columns of ``estimates``), from how often each was seen."""
    orders = estimates.shape[1]
    weights = np.full((BUCKETS + 1, orders), 1 / orders)
    for b in [BUCKETS, *range(BUCKETS)]:  # BUCKETS: all together, for buckets that were not seen
        own = np.arange(len(seen)) if b == BUCKETS else np.flatnonzero(bucket == b)
        w = weights[BUCKETS].copy()
        if len(own):
            p, n = estimates[own], seen[own]
            for _ in range(ITERATIONS):
                part = p * w
                part /= part.sum(axis=1, keepdims=True)
                w = (part * n[:, None]).sum(axis=0) / n.sum()
        weights[b] = w
    return weights


def _learn(order):
    def run(table):
        cell = table.column("_cell").to_numpy().copy()
        seen = table.column("_seen").to_numpy().astype(np.float64)
        columns = []
        for _ in range(order):
            level = cell % LEVELS
            columns.append(np.where(level == LEVELS - 1, 0.0, 2.0 ** (-level / STEP)))
            cell //= LEVELS
        v = int(table.column("_v").to_numpy().max())
        estimates = np.stack([np.full(len(seen), 1 / (v + 1)), *columns[::-1]], axis=1)
        w = expectation_maximisation(seen, cell, estimates)
        return pa.table({"_weights": pa.array([w.ravel()], pa.list_(pa.float64()))})

    return run


def _score(order):
    kinds = {
        "_id": pa.int64(), "_train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(),
        "base_score": pa.float64(), "score": pa.float64(),
    }

    def run(left, right):
        out = {k: [] for k in kinds}
        if left.num_rows and right.num_rows:
            known = _Counts(left, right, order, "_all")
            given = right.column("_weights")[0].as_py()
            w = np.array(given).reshape(BUCKETS + 1, order + 1) if given else np.full((BUCKETS + 1, order + 1), 1 / (order + 1))
            shares, bucket = known.estimates()
            p = w[bucket, 0] / (known.v + 1)
            whole = w[bucket, 0].copy()
            for o, share in enumerate(shares):
                # An unknown context says nothing: what it would weigh goes to the others.
                usable = bucket > 0 if o == len(shares) - 1 and o else np.ones(len(bucket), bool)
                p = p + np.where(usable, w[bucket, o + 1] * share, 0)
                whole = whole + np.where(usable, w[bucket, o + 1], 0)
            c = known.counts[0]
            starts = known.ends[:-1]
            sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
            out = {
                "_id": left.column("_id").combine_chunks(), "_train": left.column("_train").combine_chunks(),
                "n_tokens": np.diff(known.ends), "n_known": sums((c > 0).astype(np.int64)),
                "train_tokens": np.full(len(starts), known.total),
                "base_score": sums(np.log10((c + 1) / (known.total + known.v + 1))),
                "score": sums(np.log10(np.maximum(p / whole, 1e-300))),
            }
        return blocks.table(out, kinds)

    return run


def scored(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Scores of all texts by a model of those where the column ``train`` holds.

    Returns id, ``train``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (one order, one added to every count) and ``score``, the log10 probability.
    Tokens are the words, A-Z as a-z, and one end; null and empty texts are just an end. Words are
    told apart by 64-bit hashes. Rows without an id or with a repeated one are scored like all
    others. Without training texts all estimates but the uniform one are nothing.
    """
    tuned = F.pmod(F.xxhash64(F.lit(11), id_col, F.octet_length(text_col)), F.lit(FOLDS)) == 0
    rows, n = blocks.dealt(
        docs, id_col, text_col, F.coalesce(train, F.lit(False)).alias("_train"), tuned.alias("_tuned"),
        block_bytes=blocks.BLOCK_BYTES,
    )
    packed = "array<binary>"
    sent = rows.groupBy("_block").applyInArrow(
        _send(order, n), f"_block int, _range int, _keys {packed}, _all {packed}, _base {packed}"
    )
    answers = (
        sent.groupBy("_range").applyInArrow(_answer(order), f"_block int, _range int, _all {packed}, _base {packed}, _sums array<long>")
        .repartition(n, "_block")
    )
    own = rows.groupBy("_block")
    cells = own.cogroup(answers.groupBy("_block")).applyInArrow(_observe(order), "_cell long, _seen long, _v long")
    cells = cells.groupBy("_cell").agg(F.sum("_seen").alias("_seen"), F.max("_v").alias("_v"))
    weights = cells.groupBy().applyInArrow(_learn(order), "_weights array<double>")
    weighed = answers.withColumn("_weights", weights.scalar())
    found = own.cogroup(weighed.groupBy("_block")).applyInArrow(
        _score(order),
        "_id long, _train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return found.select(F.col("_id").alias(id_col), F.col("_train").alias("train"), *found.columns[2:])
