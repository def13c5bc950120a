"""Nearest past issues by vector distance.

Both searches give every vector one or more cell keys and compare vectors only within a cell.
Cells are dealt into groups: the knowledge-base side into blocks, the query side into slices, each
of bounded size, and one task call compares one block with one slice, tile by tile. A cell with a third of all
rows therefore becomes many tasks, and a group returns k rows per query, never its pairs.

* ``similar_issues`` is exact. Cells are the Voronoi cells of sampled vectors; a query visits a
  cell unless the triangle inequality proves that no member can be among its k nearest. The
  cells of a knowledge base can be stored once (``write_issue_index``) and searched often.
* ``similar_issues_lsh`` is approximate. Cells are random-hyperplane buckets of several tables.

Planning them runs small jobs: a seeded sample of at most ``MAX_PIVOTS`` vectors comes to the
driver, and for the exact search a few figures of each of as many cells; nothing that grows with the
data. How cells are dealt into groups is joined, not collected.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.functions import terms
from casework.functions.text import preview
from casework.operators.seeded import first_per_key, seeded_sample
from casework.sources.tables import write_table

MAX_PIVOTS = 1024
# Rows of the knowledge base that are compared at once at most, and queries; and so many that distances stay in a
# processor's cache. Pairs that are measured exactly at once.
TILE_ROWS, QUERY_ROWS, CACHED_ROWS, MEASURED_ROWS = 8192, 512, 1024, 65_536
# Either side of a cell is dealt into SIDE_GROUPS groups, but into fewer if they had fewer rows than the first figure and
# into more if they had more than the second.
SIDE_GROUPS, MIN_GROUP_ROWS, MAX_GROUP_ROWS = 10, 8192, 65_536
# Cells whose numbers of groups go to every executor at most.
SMALL_CELLS = 50_000
# Vectors measured against all pivots at once.
PIVOT_ROWS = 1024
# Work of sending a query to one more cell, in distances it costs as much as.
CELL_COST = 500
# Distances one task computes, what a tile costs beside its distances, and the most tasks.
PARTITION_WORK = 5_000_000
TILE_COST = 200_000
MAX_PARTITIONS = 100_000
# Bytes a task sends, about.
SENT_BYTES = 64 << 20
# Hash tables of a search whose bits are not given.
MAX_TABLES = 40


def _matrix(vectors) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _typed(df: DataFrame, by: str, vector: str, name: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull()).select(
        F.col(by).alias(name), F.col(vector).cast("array<float>").alias("vec")
    )


def _issues(kb: DataFrame, by: str, vector: str) -> DataFrame:
    """One row per id and vector: rows that repeat both must not take places in a ranking."""
    return _typed(kb, by, vector, "n").withColumn("_h", F.xxhash64("vec")).dropDuplicates(["n", "_h", "vec"]).drop("_h")


def _few_copies(kb: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` ids of each distinct vector, lowest first; ``kb`` has a pair once.

    Ties break on id, so further copies can never be among the ``keep`` nearest of anything.
    """
    hashed = kb.withColumn("_h", F.xxhash64("vec"))
    return first_per_key(hashed, ["_h", "vec"], ["n"], keep).drop("_h")


def _spread(side: DataFrame, by: str, copies: int) -> DataFrame:
    """``side`` in so many parts that none sends much more than SENT_BYTES, every row ``copies`` times: what a
    task sends it collects first, and few files or merged partitions would make few tasks. Runs a job."""
    rows, width = side.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    parts = math.ceil(rows * copies * (4 * width + 64) / SENT_BYTES)
    return side.repartition(max(1, min(parts, MAX_PARTITIONS)), by, F.xxhash64("vec"))


def _distinct_rows(copies: int):
    """Aggregate: rows left when at most ``copies`` of each vector are kept, roughly."""
    return F.least(F.count("*"), copies * F.approx_count_distinct(F.xxhash64("vec")))


def _cell_groups(queries: DataFrame, kb: DataFrame) -> DataFrame:
    """Cells with rows on both sides: their row counts, and how many groups each side is dealt into."""
    issues = kb.groupBy("cell").agg(F.count("*").alias("issues"))
    asked = queries.groupBy("cell").agg(F.count("*").alias("asked"))

    def groups(rows: str):
        small, large = F.ceil(F.col(rows) / MIN_GROUP_ROWS), F.ceil(F.col(rows) / MAX_GROUP_ROWS)
        return F.greatest(F.least(small, F.lit(SIDE_GROUPS)), large).cast("int")

    return issues.join(asked, "cell").select(
        "cell", "issues", "asked", groups("issues").alias("blocks"), groups("asked").alias("slices")
    )


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix; null components are NaN."""
    lists = column.combine_chunks()
    lengths = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError(f"vectors of {lengths.tolist()} components")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class _Nearest:
    """The ``k`` nearest of ``m`` to each of some query vectors ``part``; rows of equal ``codes``, which
    ascend, are one issue that counts by its nearest vector."""

    def __init__(self, part: np.ndarray, m: np.ndarray, codes: np.ndarray, k: int):
        self.part, self.m, self.codes, self.k = part, m, codes, k
        self.square = (part * part).sum(axis=1)
        self.row, self.code, self.distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bound = np.full(len(part), np.inf)  # squared distance of the k-th
        self.open, self.waiting = [], 0

    def see(self, start: int, stop: int, square: np.ndarray) -> None:
        """Take in the rows from ``start`` to ``stop``, whose squared lengths are ``square``."""
        # a.a + b.b - 2 a.b is the squared distance; this is (b.b - 2 a.b) / -2.
        near = self.part @ self.m[start:stop].T
        near -= square / 2
        bound, some = self.bound, np.isinf(self.bound).any()
        if some:
            codes = self.codes[start:stop]
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            if len(first) >= self.k:
                best = near if len(first) == len(codes) else np.maximum.reduceat(near, first, axis=1)
                kth = np.partition(best, len(first) - self.k, axis=1)[:, len(first) - self.k]
                bound = np.minimum(bound, self.square - 2.0 * kth)
        # The product form is inexact: take all within rounding of the k-th, then measure those again.
        slack = 1e-9 * (1.0 + self.square + square.max())
        i, j = np.nonzero(near >= ((self.square - bound - slack) / 2)[:, None])
        self.open.append((i, start + j))
        self.waiting += len(i)
        if some or self.waiting > 4 * self.k * len(self.part):
            self.settle()

    def settle(self) -> None:
        """Rank what waits by (distance, code) with what was nearest before."""
        if not self.open:
            return
        i, j = (np.concatenate(c) for c in zip(*self.open))
        self.open, self.waiting = [], 0
        exact = np.empty(len(i))
        for at in range(0, len(i), MEASURED_ROWS):
            some = slice(at, at + MEASURED_ROWS)
            exact[some] = np.sqrt(((self.part[i[some]] - self.m[j[some]]) ** 2).sum(axis=1))
        row, code = np.r_[self.row, i], np.r_[self.code, self.codes[j]]
        distance = np.r_[self.distance, exact]
        order = np.lexsort((distance, code, row))
        row, code, distance = row[order], code[order], distance[order]
        once = np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])][: len(row)]
        row, code, distance = row[once], code[once], distance[once]
        order = np.lexsort((code, distance, row))
        row, code, distance = row[order], code[order], distance[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        last = rank == self.k - 1
        self.bound[row[last]] = distance[last] ** 2
        keep = rank < self.k
        self.row, self.code, self.distance = row[keep], code[keep], distance[keep]


def _tiled_top(queries, kb, k: int, metric: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """k nearest (q, n, distance) of every query within its cells, ids counting once.

    ``queries`` has (q, vec, cell), ``kb`` has (n, vec, cell). Rows are sent once per group of the other
    side, and a task compares its two groups tile by tile, so how often a row is sent does not depend on
    ``tile_rows``. The number of partitions follows the distances to compute, of which a job finds the sum, and is
    set outright: adaptive execution would merge partitions that are small in bytes but long in work.
    """
    cut = _cell_groups(queries, kb)
    effort = cut.agg(
        F.sum(F.col("issues").cast("double") * F.col("asked")), F.sum(F.col("blocks").cast("double") * F.col("slices")),
        F.count("*"),
    ).first()
    groups = int(effort[1] or 1)
    work = (effort[0] or 0) + groups * TILE_COST
    partitions = max(1, min(groups, math.ceil(work / PARTITION_WORK), MAX_PARTITIONS))
    cut = cut.select("cell", "blocks", "slices")
    if effort[2] <= SMALL_CELLS:  # else the rows of a large cell would meet in one task
        cut = F.broadcast(cut)
    kb = (
        kb.join(cut, "cell").withColumn("block", F.pmod(F.xxhash64("n"), "blocks").cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("blocks", "slices")
    )
    queries = (
        queries.join(cut, "cell").withColumn("slice", F.pmod(F.xxhash64("q"), "slices").cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "slices")
    )
    q_type, n_type = queries.schema["q"].dataType, kb.schema["n"].dataType
    out = T.StructType(
        [T.StructField("q", q_type), T.StructField("n", n_type), T.StructField("distance", T.DoubleType())]
    )
    unit = metric == "cosine"
    at_once, tile_rows = min(QUERY_ROWS, tile_rows), min(CACHED_ROWS, tile_rows)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qs = right.column("n").combine_chunks(), left.column("q").combine_chunks()
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            asked, m = _rows(left.column("vec")), _rows(right.column("vec")).astype(np.float64)
            code = pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            order = np.argsort(code, kind="stable")
            code, m = code[order], m[order]
            place = order[np.searchsorted(code, np.arange(code[-1] + 1))]  # where a code's id stands
            m = _unit(m) if unit else m
            square = (m * m).sum(axis=1)
            for at in range(0, len(asked), at_once):
                part = asked[at : at + at_once].astype(np.float64)
                best = _Nearest(_unit(part) if unit else part, m, code, k)
                for x in range(0, len(m), tile_rows):
                    best.see(x, x + tile_rows, square[x : x + tile_rows])
                best.settle()
                for column, values in zip(found, (at + best.row, place[best.code], best.distance)):
                    column.append(values)
        row, issue, d = (np.concatenate(c) if c else np.zeros(0) for c in found)
        return pa.table({
            "q": qs.take(pa.array(row, pa.int64())), "n": ids.take(pa.array(issue, pa.int64())),
            "distance": pa.array(d * d / 2 if unit else d, pa.float64()),
        })

    keys = ["cell", "block", "slice"]
    queries, kb = (side.repartition(partitions, *keys) for side in (queries, kb))
    return queries.groupBy(*keys).cogroup(kb.groupBy(*keys)).applyInArrow(nearest, out)


def _ranked(found: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """k nearest ids over all cells. A pair may have been found in several cells, for a repeated
    query id or for several vectors of an issue: its least distance counts."""
    if exclude_self:
        found = found.filter(F.col("q") != F.col("n"))
    pairs = found.groupBy("q", "n").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(W.partitionBy("q").orderBy("distance", "n"))
    return pairs.withColumn("rk", rank.cast("bigint")).filter(F.col("rk") <= k)


@dataclass(frozen=True)
class IssueIndex:
    """Knowledge-base vectors by cell: ``table`` (n, vec, cell, radius), and per cell that has
    members its number, least and greatest member distance, row count and ``copies`` least
    distances."""

    table: DataFrame
    pivots: np.ndarray
    cells: list
    metric: str
    copies: int


CELLS = "cell int, pivot array<double>, low double, high double, rows bigint, near array<double>"


def _to_pivots(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to all pivots; centred, since the product form loses digits far from zero."""
    centre = pivots.mean(axis=0)
    m, p = m - centre, pivots - centre
    square = (m * m).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2.0 * m @ p.T
    return np.sqrt(np.maximum(square, 0.0))


def _by_pivots(vectors: pd.Series, pivots: np.ndarray, unit: bool):
    """Distances of vectors to all pivots, some rows at a time: a whole Arrow batch by all pivots would be large."""
    for at in range(0, max(1, len(vectors)), PIVOT_ROWS):
        m = _matrix(vectors.iloc[at : at + PIVOT_ROWS])
        yield _to_pivots(_unit(m) if unit else m, pivots)


def _between(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))


def _visited(d, between, cells, low, high, near, need: int) -> np.ndarray:
    """Which cells (columns) queries with pivot distances ``d`` must visit."""
    dc = d[:, cells]
    # A member is no farther than its pivot is, plus its own distance to it; the need-th least
    # such sum, here over the closest cells, bounds the distance of the need-th nearest issue.
    few = min(8, dc.shape[1])
    close = np.argpartition(dc, few - 1, axis=1)[:, :few]
    sums = np.take_along_axis(dc, close, axis=1)[:, :, None] + near[close][:, :, :need]
    sums = sums.reshape(len(d), -1)
    reach = np.full(len(d), np.inf)
    if sums.shape[1] >= need:
        reach = np.partition(sums, need - 1, axis=1)[:, need - 1]
    bound = np.maximum(dc - high[None, :], low[None, :] - dc)
    # A cell lies beyond the bisector of its pivot and the query's own pivot.
    own = d.argmin(axis=1)
    gap = between[own][:, cells]
    over = dc**2 - d[np.arange(len(d)), own][:, None] ** 2
    bisector = np.divide(over, 2.0 * gap, out=np.zeros_like(over), where=gap > 0)
    # Distances of the product form err by about 1e-7 of the largest.
    slack = 1e-6 * (1.0 + d.max(axis=1))
    return np.maximum(bound, bisector) <= (reach + slack)[:, None]


def _padded(near: list, size: int) -> np.ndarray:
    return np.array([(list(x) + [np.inf] * size)[:size] for x in near])


def _pivot_count(sample: np.ndarray, rows: int, need: int) -> int:
    """Number of pivots with the least work, estimated on the sample.

    Many small cells pay where vectors cluster; where nothing can be ruled out, every cell is
    one more copy of every query in the shuffle.
    """
    best, choice, m = np.inf, 1, 1
    queries, share = sample[-256:], rows / len(sample)
    while m <= max(1, len(sample) * 3 // 4):
        p = np.unique(sample[:m], axis=0)
        inside = _to_pivots(sample, p)
        home, radius = inside.argmin(axis=1), inside.min(axis=1)
        members = [np.sort(radius[home == c]) for c in range(len(p))]
        cells = np.array([c for c, r in enumerate(members) if len(r)])
        low, high = (np.array([members[c][i] for c in cells]) for i in (0, -1))
        counts = np.array([len(members[c]) for c in cells])
        seen = _visited(
            _to_pivots(queries, p), _between(p), cells, low, high,
            _padded([members[c] for c in cells], need), need,
        )
        work = (seen * (counts * share + CELL_COST)[None, :]).sum(axis=1).mean()
        if work < best:
            best, choice = work, m
        m *= 2
    return choice


def issue_index(
    kb: DataFrame, kb_id: str = "n", vector: str = "embedding", metric: str = "l2",
    copies: int = terms.NEIGHBOURS + 1, pivots: int | None = None,
) -> IssueIndex:
    """Cells of a knowledge base. A search for k neighbours needs ``copies`` of at least k, or
    k + 1 if a query may be its own neighbour; further copies of a vector are left out.
    Without ``pivots`` their number is chosen by the structure of a sample."""
    kb = _issues(kb, kb_id, vector)
    drawn = seeded_sample(kb, MAX_PIVOTS, "n", terms.EXTRACT_SEED).collect()
    if not drawn:
        placed = kb.withColumns({"cell": F.lit(0), "radius": F.lit(0.0)})
        return IssueIndex(placed, np.zeros((0, 0)), [], metric, copies)
    unit = metric == "cosine"
    sample = np.array([r.vec for r in drawn], dtype=np.float64)
    sample = _unit(sample) if unit else sample
    if pivots is None:
        pivots = _pivot_count(sample, kb.count(), copies)
    p = np.unique(sample[:pivots], axis=0)

    @F.pandas_udf("struct<cell:int,radius:double>")
    def home(vectors: pd.Series) -> pd.DataFrame:
        found = [(d.argmin(axis=1).astype("int32"), d.min(axis=1)) for d in _by_pivots(vectors, p, unit)]
        cell, radius = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"cell": cell, "radius": radius})

    placed = kb.withColumn("_p", home("vec")).select("n", "vec", "_p.cell", "_p.radius")
    ring = placed.groupBy("cell").agg(
        F.min("radius").alias("low"), F.max("radius").alias("high"),
        _distinct_rows(copies).alias("rows"),
    )
    least = first_per_key(placed.select("cell", "radius"), ["cell"], ["radius"], copies)
    near = least.groupBy("cell").agg(F.sort_array(F.collect_list("radius")).alias("near"))
    found = sorted(ring.join(near, "cell").collect(), key=lambda r: r.cell)
    cells = [(r.cell, r.low, r.high, r.rows, r.near) for r in found]
    return IssueIndex(_few_copies(placed, copies), p, cells, metric, copies)


def write_issue_index(index: IssueIndex, path: str) -> None:
    """Store an index: the vectors, and one small row per pivot."""
    spark, known = index.table.sparkSession, {c[0]: c[1:] for c in index.cells}
    rows = [(i, [float(x) for x in v], *known.get(i, (None, None, 0, []))) for i, v in enumerate(index.pivots)]
    about = spark.createDataFrame(rows, CELLS).withColumns(
        {"metric": F.lit(index.metric), "copies": F.lit(index.copies)}
    )
    write_table(index.table, f"{path}/issues", "overwrite")
    write_table(about.coalesce(1), f"{path}/cells", "overwrite")


def read_issue_index(spark, path: str) -> IssueIndex:
    about = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    table = spark.read.parquet(f"{path}/issues")
    cells = [(r.cell, r.low, r.high, r.rows, r.near) for r in about if r.rows]
    pivots = np.array([r.pivot for r in about], dtype=np.float64)
    if not about:
        return IssueIndex(table, np.zeros((0, 0)), [], "l2", 0)
    return IssueIndex(table, pivots, cells, about[0].metric, about[0].copies)


def search_issue_index(
    queries: DataFrame, index: IssueIndex, k: int = terms.NEIGHBOURS, query_id: str = "q",
    vector: str = "embedding", exclude_self: bool = False, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Exact k nearest in an index: rows (q, n, distance, rk), ties broken on the lower id.

    ``tile_rows`` bounds the rows of either side that are compared at once, groups of at most about
    MAX_GROUP_ROWS rows those that a task gets.
    """
    queries = _typed(queries, query_id, vector, "q")
    need = k + 1 if exclude_self else k
    if not index.cells:
        none = {
            "n": F.lit(None).cast(index.table.schema["n"].dataType), "distance": F.lit(0.0),
            "rk": F.lit(0).cast("bigint"),
        }
        return queries.select("q").withColumns(none).filter(F.lit(False))
    if need > index.copies:
        raise ValueError(f"the index keeps {index.copies} copies of a vector, {need} are needed")
    p, unit = index.pivots, index.metric == "cosine"
    between, near = _between(p), _padded([c[4] for c in index.cells], index.copies)
    cells = np.array([c[0] for c in index.cells], dtype=np.int32)
    low, high = (np.array([c[i] for c in index.cells]) for i in (1, 2))

    @F.pandas_udf("array<int>")
    def visits(vectors: pd.Series) -> pd.Series:
        return pd.Series([
            cells[row] for d in _by_pivots(vectors, p, unit) for row in _visited(d, between, cells, low, high, near, need)
        ])

    visiting = _spread(queries, "q", SIDE_GROUPS).withColumn("cell", F.explode(visits("vec")))
    issues = _spread(index.table.select("n", "vec", "cell"), "n", SIDE_GROUPS)
    found = _tiled_top(visiting, issues, need, index.metric, tile_rows)
    return _ranked(found, k, exclude_self)


def similar_issues(
    queries: DataFrame, kb: DataFrame, k: int = terms.NEIGHBOURS, query_id: str = "q",
    kb_id: str = "n", vector: str = "embedding", metric: str = "l2",
    exclude_self: bool = False, pivots: int | None = None, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Exact k nearest without a stored index.

    ``metric`` is ``l2`` or ``cosine``; fewer than k past issues give fewer rows.
    """
    copies = k + 1 if exclude_self else k
    index = issue_index(kb, kb_id, vector, metric, copies, pivots)
    return search_issue_index(queries, index, k, query_id, vector, exclude_self, tile_rows)


def similar_issues_lsh(
    queries: DataFrame, kb: DataFrame, k: int = terms.NEIGHBOURS, query_id: str = "q",
    kb_id: str = "n", vector: str = "embedding", metric: str = "l2",
    exclude_self: bool = False, tables: int | None = None, bits: int | None = None,
    recall: float = 0.97, seed: int = terms.EXTRACT_SEED,
) -> DataFrame:
    """Approximate k nearest: only issues that share a bucket in at least one table are seen.

    More bits make buckets smaller, more tables raise the recall. Bits not given follow from the
    number of issues, and tables from how far the k-th issue is likely to be, so that ``recall`` of
    the issues should be found. Rows as in ``similar_issues``.
    """
    queries, kb = _typed(queries, query_id, vector, "q"), _issues(kb, kb_id, vector)
    need = k + 1 if exclude_self else k
    if tables is None or bits is None:
        planned = _hash_plan(kb, need, recall, bits)
        bits, tables = planned[0], planned[1] if tables is None else tables

    @F.pandas_udf("array<bigint>")
    def buckets(vectors: pd.Series) -> pd.Series:
        m = _matrix(vectors)
        planes = np.random.default_rng(seed).standard_normal((m.shape[1], tables * bits))
        side = (m @ planes > 0).reshape(len(m), tables, bits)
        code = (side * (1 << np.arange(bits))).sum(axis=2) + np.arange(tables) * (1 << bits)
        return pd.Series(list(code.astype("int64")))

    found = _tiled_top(
        _spread(queries, "q", tables).withColumn("cell", F.explode(buckets("vec"))),
        _spread(_few_copies(kb, need), "n", tables).withColumn("cell", F.explode(buckets("vec"))), need, metric,
    )
    return _ranked(found, k, exclude_self)


def _hash_plan(kb: DataFrame, k: int, recall: float, bits: int | None) -> tuple:
    """Bits so that a bucket of a table holds about a tile, and tables for the recall.

    Every table is one more copy of all vectors, so bits that nobody gave are fewer where they would take
    more than MAX_TABLES tables: without structure buckets grow, and not the copies.
    """
    rows, given = kb.count(), bits is not None
    bits = bits if given else max(1, min(40, round(math.log2(max(2, rows / (TILE_ROWS // 16))))))
    drawn = seeded_sample(kb, MAX_PIVOTS, "n", terms.EXTRACT_SEED).collect()
    if len(drawn) < 2:
        return bits, 1
    m = np.array([r.vec for r in drawn], dtype=np.float64)
    d = _to_pivots(m[:256], m)
    # The k-th of all issues is about as far as the issue of the same rank, by share, in the sample.
    place = min(len(m) - 1, max(1, round(k * len(m) / rows)))
    near = np.argsort(d, axis=1)[:, place]
    cosine = np.clip((_unit(m[:256]) * _unit(m[near])).sum(axis=1), -1, 1)

    def needed(bits: int) -> int:
        together = (1 - np.arccos(cosine) / np.pi) ** bits
        # The distant quarter of queries is found as often as asked for.
        chance = min(1 - 1e-9, max(1e-6, float(np.quantile(together, 0.25))))
        return max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))

    while not given and bits > 1 and needed(bits) > MAX_TABLES:
        bits -= 1
    return bits, needed(bits)


def rag_evidence(
    neighbours: DataFrame, kb: DataFrame, kb_id: str = "n",
    document: str = "customer_text", reply: str = "agent_text", chars: int = 100,
) -> DataFrame:
    """Nearest issue of each query with previews of the past case and its real distance."""
    cases = kb.select(
        F.col(kb_id).alias("n"),
        preview(document, chars).alias("original_customer"),
        preview(reply, chars).alias("retrieved_reply"),
    )
    return (
        neighbours.filter(F.col("rk") == 1)
        .select("q", "n", "distance")
        .join(cases, "n", "left")
        .select("q", "n", "distance", "original_customer", "retrieved_reply")
    )


def retrieved_cases(neighbours: DataFrame, kb: DataFrame) -> DataFrame:
    """Rows (q, examples): past cases in rank order, from ``kb`` (id, document, agent_reply)."""
    cases = kb.select(
        F.col("id").alias("n"),
        F.col("document").alias("customer_issue"),
        "agent_reply",
    )
    found = neighbours.withColumn("n", F.col("n").cast("string")).join(cases, "n", "inner")
    ordered = F.array_sort(F.collect_list(F.struct("rk", "customer_issue", "agent_reply")))
    strip = F.transform(
        ordered,
        lambda x: F.struct(x["customer_issue"].alias("customer_issue"), x["agent_reply"].alias("agent_reply")),
    )
    return found.groupBy("q").agg(strip.alias("examples"))
