"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Inner products become distances: vectors are scaled by the largest norm and get one more
coordinate that makes them all of length 1, queries are normalised and get a 0 there. A table
hashes a vector to a bucket of slots, ``floor((a . x + b) / w)`` for some Gaussian directions
``a``. How likely a neighbour of a query lies in a slot follows from the query's place within its
own slot and the distance expected of its neighbours, so a query visits buckets in the order of
their estimated success until these add up to what each table should find. There are no more
directions than let queries get there; a query that doesn't is compared with all rows. The candidates of all
tables are scored exactly, on the original vectors in double precision, and merged.
"""

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.shared import kept as stored

#: Tables; the share of a query's neighbours each of them should find; rows a bucket should hold.
TABLES, SUCCESS, BUCKET_ROWS = 2, 0.86, 256
#: Rows the index is fitted on, partial buckets followed per query, rows and queries compared at once.
SAMPLE_ROWS, BEAM, TILE, QUERIES = 4096, 8192, 16384, 128
#: Queries of a cell compared in one task, about.
SLICE = 8192
#: Share of sampled queries whose followed buckets must add up to SUCCESS; the others meet all rows.
REACHED = 0.99
#: Cells there are at least, if each gets as many rows: a query's best of every cell are merged, so
#: cells should be few, but not fewer than tasks.
LEAST_CELLS, LEAST_ROWS = 8, 1024


@dataclass
class Index:
    """Directions (tables, functions, dimensions + 1), offsets, slot width, scale, neighbour distance."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    norm: float
    near: float
    dimensions: int
    cells: int

    def slots(self, x):
        """Real-valued slot of every table, row and function."""
        return (np.einsum("nd,tfd->tnf", x, self.directions) + self.offsets[:, None, :]) / self.width

    def buckets(self, slots):
        """One number for each bucket."""
        code = np.full(slots.shape[:-1], 1469598103934665603, np.uint64)
        for f in range(slots.shape[-1]):
            code = (code ^ slots[..., f].astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return code.view(np.int64)

    def rows(self, vectors):
        """Vectors as points of the unit sphere."""
        x = vectors.astype(np.float64) / self.norm
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def followed(self, place):
        """Before the first and after every function: chances and slots of the partial buckets that each
        query (a row of ``place``) follows, at most BEAM."""
        spread = self.near / self.width
        n = len(place)
        own = np.floor(place)
        reach = max(1, math.ceil(3 * spread))
        steps = np.arange(-reach, reach + 1)
        chance = np.ones((n, 1))
        taken = np.zeros((n, 1, 0))
        yield chance, taken
        for f in range(place.shape[1]):
            low = own[:, f, None] + steps - place[:, f, None]
            share = _normal((low + 1) / spread) - _normal(low / spread)
            joint = (chance[:, :, None] * share[:, None, :]).reshape(n, -1)
            keep = np.argsort(-joint, axis=1)[:, :BEAM]
            chance = np.take_along_axis(joint, keep, axis=1)
            before = np.take_along_axis(taken, (keep // len(steps))[:, :, None], axis=1)
            slot = own[:, f, None] + steps[keep % len(steps)]
            taken = np.concatenate([before, slot[:, :, None]], axis=2)
            yield chance, taken

    def asked(self, vectors):
        """Slots of queries, as ``slots`` gives them."""
        x = vectors.astype(np.float64)
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        return self.slots(np.concatenate([x, np.zeros((len(x), 1))], axis=1))

    def probes(self, vectors):
        """For every table, the buckets each query visits: (row of the query, bucket) pairs.

        A query whose buckets don't add up to SUCCESS in every table has none at all: it must be
        compared with all rows.
        """
        out, whole = [], np.ones(len(vectors), bool)
        for place in self.asked(vectors):
            for chance, taken in self.followed(place):
                pass
            order = np.argsort(-chance, axis=1)
            chance = np.take_along_axis(chance, order, axis=1)
            whole &= chance.sum(axis=1) >= SUCCESS
            visited = np.cumsum(chance, axis=1) - chance < SUCCESS
            codes = np.take_along_axis(self.buckets(taken), order, axis=1)
            row, at = np.nonzero(visited)
            out.append((row, codes[row, at]))
        return [(row[whole[row]], code[whole[row]]) for row, code in out]

    def bounded(self, vectors):
        """This index with no more functions than let REACHED of these queries add up to SUCCESS."""
        least = []
        for a in range(0, len(vectors), 32):
            mass = [[c.sum(axis=1) for c, _ in self.followed(place)] for place in self.asked(vectors[a : a + 32])]
            least.append(np.min(mass, axis=0))
        reached = (np.concatenate(least, axis=1) >= SUCCESS).mean(axis=1)
        functions = int(np.flatnonzero(reached >= REACHED).max())
        return replace(self, directions=self.directions[:, :functions], offsets=self.offsets[:, :functions])


def _cells(n):
    """Cells that buckets are dealt into."""
    return max(1, math.ceil(n / TILE), min(LEAST_CELLS, n // LEAST_ROWS))


def _normal(x):
    """Distribution function of the normal law, to five digits."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    return np.where(x > 0, 1 - tail, tail)


def usable(vectors: DataFrame, vector_col: str):
    """Whether a vector takes part: no null, no NaN or infinity, not all zero."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def fit(rows: DataFrame, k: int, seed: int = 42) -> Index | None:
    """Index for usable rows (``_id``, ``_v``); runs jobs over all rows for their number, dimension and norm.

    The neighbour distance comes from the SAMPLE_ROWS first rows in a seeded order. Vectors of
    another dimension than most take no part. None for an empty table.
    """
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sizes = rows.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("m"))
    top = sizes.orderBy(F.desc("n"), "d").first()
    if top is None:
        return None
    n, d = top.n, top.d
    order = F.xxhash64(F.lit(seed), "_id")
    sample = rows.filter(F.size("_v") == d).orderBy(order, "_id").limit(SAMPLE_ROWS).select("_v").collect()
    x = np.array([r[0] for r in sample], np.float64)
    rng = np.random.default_rng(seed)
    index = Index(None, None, 1.0, float(top.m) * (1 + 1e-12), 1.0, d, _cells(n))
    points = index.rows(x)
    q = x[:256] / np.sqrt((x[:256] ** 2).sum(axis=1))[:, None]
    products = np.sort(q @ (x / index.norm).T, axis=1)[:, ::-1]
    # The k-th neighbour among all rows is about as far as the one of the same share in the sample.
    place = min(len(x) - 1, max(1, round(k * len(x) / max(1, n))))
    index.near = float(np.sqrt(np.maximum(1e-6, 2 - 2 * np.median(products[:, place])))) if len(x) > 1 else 1.0
    index.near = max(index.near, 1e-3)
    functions = max(0, round(math.log(max(1, n / BUCKET_ROWS)) / math.log(3.6)))
    a = rng.standard_normal((TABLES, functions, d + 1))
    index.directions = a
    # Distances along a direction are as the distances of the points, on the scale of its slots.
    scale = float((points @ a.reshape(-1, d + 1).T).std()) if functions else 1.0
    index.width = 1.25 * max(scale, 1e-6)
    index.offsets = rng.uniform(0, index.width, (TABLES, functions))
    return index.bounded(x[:QUERIES])


def _matrix(table, d):
    flat = table.column("_v").combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _nearest(k: int):
    """Best k of a tile's vectors for each of its queries, among the buckets the query visits."""
    def run(left, right):
        names = ("query_id", "vec_id", "score")
        done = [pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()))})]
        if left.num_rows and right.num_rows:
            d = len(left.column("_v")[0])
            ids = left.column("_id").to_numpy()
            # Equal vectors are compared once; those with the smallest ids can win.
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], np.ascontiguousarray(_matrix(left, d)[order])
            codes = left.column("_bucket").to_numpy()[order]
            row = v.view([("", v.dtype)] * d).ravel()
            _, first, member = np.unique(row, return_index=True, return_inverse=True)
            by_vector = np.argsort(member, kind="stable")
            starts = np.searchsorted(member[by_vector], np.arange(len(first) + 1))
            vectors = v[first].astype(np.float64)
            known, bucket = np.unique(codes[first], return_inverse=True)
            q_ids = right.column("_id").to_numpy()
            q = _matrix(right, d)
            lists = right.column("_buckets").combine_chunks()
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for a in range(0, len(q), QUERIES):
                b = min(len(q), a + QUERIES)
                part = flat[ends[a] : ends[b]]
                owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                hit = known[at] == part
                visits = np.zeros((b - a, len(known)), bool)
                visits[owner[hit], at[hit]] = True
                visits[np.diff(ends[a : b + 1]) == 0] = True  # no list: all buckets
                asked, out = q[a:b].astype(np.float64), {n: [] for n in names}
                score = np.where(visits[:, bucket], asked @ vectors.T, -np.inf)
                keep = min(k + 1, len(vectors))  # one of them may be the query's own
                least = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
                for i, j in zip(*np.nonzero((score >= (least - 1e-9)[:, None]) & (score > -np.inf))):
                    mine = ids[by_vector[starts[j] : starts[j + 1]][: k + 1]]
                    mine = mine[mine != q_ids[a + i]][:k]
                    out["query_id"] += [q_ids[a + i]] * len(mine)
                    out["vec_id"] += mine.tolist()
                    out["score"] += [float((asked[i] * vectors[j]).sum())] * len(mine)
                done.append(pa.table({n: pa.array(out[n], done[0].schema.field(n).type) for n in names}))
        return pa.concat_tables(done)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """The ``k`` nearest rows found for every query but its own: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Nearest first, ties to the smaller id; fewer than ``k`` only if there are no more rows. Vectors
    that are null, all zero, or hold a null or a value that isn't finite take no part, on either
    side; neither do rows without an id. Rows that repeat an id count with their best score.

    Rows are dealt out by bucket, in cells of at most about TILE rows; a cell that holds more (copies of a
    vector share a bucket) is cut into tiles. The queries of a cell are cut into slices, each of which
    meets every tile of it. A query goes to a tile once, with the buckets it visits there. Every tile returns its ``k`` best. Queries that found too little, or whose buckets
    would be too many to follow, are compared with all rows.
    """
    def clean(df):
        return df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v")).filter(
            F.col("_id").isNotNull() & usable(df, "_v")
        )

    rows, asked = clean(vectors), clean(queries)
    index = fit(rows, k, seed)
    shape = "query_id long, vec_id long, score double"
    if index is None:
        empty = asked.limit(0).select(F.col("_id").alias("query_id"), F.lit(1).alias("rank"), F.col("_id").alias("vec_id"), F.lit(0.0).alias("score"))
        return empty
    rows, asked = (x.filter(F.size("_v") == index.dimensions) for x in (rows, asked))
    d, cells, kind = index.dimensions, index.cells, rows.schema["_v"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            v = _matrix(batch_table(batch), d)
            if not len(v):
                continue
            codes = index.buckets(np.floor(index.slots(index.rows(v))))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), t, np.int32)), pa.array((codes[t].view(np.uint64) % np.uint64(cells)).astype(np.int64)),
                     pa.array(codes[t]), batch.column(0), batch.column(1)],
                    names=["_table", "_cell", "_bucket", "_id", "_v"],
                )

    def batch_table(batch):
        return pa.Table.from_batches([batch])

    def visit(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(start, QUERIES)
                v = _matrix(batch_table(batch), d)
                found = index.probes(v)
                rest = pa.array(np.setdiff1d(np.arange(len(v)), found[0][0]))
                # An empty list of buckets stands for all; one table holds every row.
                for c in range(cells if len(rest) else 0):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.zeros(len(rest), np.int32)), pa.array(np.full(len(rest), c)), batch.column(0).take(rest),
                         batch.column(1).take(rest), pa.array([[]] * len(rest), pa.list_(pa.int64()))],
                        names=["_table", "_cell", "_id", "_v", "_buckets"],
                    )
                for t, (row, code) in enumerate(found):
                    if not len(row):
                        continue
                    cell = (code.view(np.uint64) % np.uint64(cells)).astype(np.int64)
                    order = np.lexsort((cell, row))
                    row, code, cell = row[order], code[order], cell[order]
                    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])
                    ends = np.r_[new, len(row)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(new), t, np.int32)), pa.array(cell[new]), batch.column(0).take(pa.array(row[new])),
                         batch.column(1).take(pa.array(row[new])), pa.ListArray.from_arrays(pa.array(ends), pa.array(code))],
                        names=["_table", "_cell", "_id", "_v", "_buckets"],
                    )

    placed = rows.mapInArrow(place, f"_table int, _cell long, _bucket long, _id long, _v {kind}")
    visits = asked.mapInArrow(visit, f"_table int, _cell long, _id long, _v {kind}, _buckets array<long>")
    cell = ["_table", "_cell"]
    tiles = placed.groupBy(*cell).agg(F.ceil(F.count("*") / (2 * TILE)).cast("int").alias("_tiles"))
    tile = [*cell, "_tile"]
    tiled = placed.join(tiles, cell).withColumn("_tile", F.pmod(F.xxhash64("_id"), F.col("_tiles")).cast("int")).drop("_tiles")

    def compare(visits, n):
        """Best of every tile for the queries of ``visits``, which come from ``n`` queries."""
        to = visits.join(tiles, cell).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).drop("_tiles")
        among, keys = tiled, tile
        if n > SLICE:  # no cell has more queries than there are; only then are they counted
            slices = visits.groupBy(*cell).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("_slices"))
            among = among.join(slices, cell).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
            to = to.join(slices, cell).withColumn("_slice", F.pmod(F.xxhash64("_id"), F.col("_slices")).cast("int")).drop("_slices")
            keys = [*tile, "_slice"]
        return among.groupBy(*keys).cogroup(to.groupBy(*keys)).applyInArrow(_nearest(k), shape)

    def ranked(found):
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (
            found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )

    first = stored(ranked(compare(visits, asked.count())))
    there = min(k, max(0, rows.select("_id").distinct().limit(k + 1).count() - 1))
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= there)
    short = asked.join(enough.select(F.col("query_id").alias("_id")), "_id", "left_anti")
    lacking = short.count() if there else 0
    if not lacking:
        return first
    everywhere = short.select(
        F.lit(0).alias("_table"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("_cell"), "_id", "_v",
        F.array().cast("array<long>").alias("_buckets"),
    )
    again = ranked(compare(everywhere, lacking))
    return first.join(short.select(F.col("_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
