"""Near-duplicate documents by min-max hashing.

A document is the set of its shingles (runs of words). Every hash function gives two values, the
least and the greatest hash of the set, so a signature takes half as many evaluations; either is
equal in two documents as often as their sets overlap. Bands of these values are bucket keys,
documents that share a bucket are candidates, and a pair becomes a link only when the whole sets
confirm it. Components of links are the groups.

Documents of equal sets are one node. Every document is first compared with one other only, the
bucket centre it shares most buckets with. Where components still differ within a bucket, documents
are compared in groups that send out no pairs, just the links that connect components.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm import words
from casework.llm.arrow import flat, integers
from casework.llm.components import connected
from casework.llm.shared import kept as stored

#: Bands and values of a band: a pair of similarity 0.75 shares none of them in one case of 400,000.
BANDS, ROWS = 48, 5
#: Documents compared with a centre at once, and documents on each side of a group; and bytes of their texts.
GROUP, SLICE, GROUP_BYTES = 128, 512, 8 << 20
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS // 2, np.uint64).astype(np.uint32)
_ODD = (_rng.integers(0, 1 << 31, BANDS * ROWS // 2, np.uint64) * 2 + 1).astype(np.uint32)
_PLACE = words.mixed(_rng.integers(1, 1 << 62, 64, np.uint64) | np.uint64(1)) | np.uint64(1)


def shingle_sets(data, offsets, size=5):
    """Sorted shingle hashes of every text without repeats: (hashes, offsets)."""
    h, at = words.hashed(data, offsets)
    count = np.diff(at)
    out, ends = [], [0]
    if len(h) >= size:
        runs = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            runs += h[k : len(h) - size + 1 + k] * _PLACE[k]
        runs = words.mixed(runs)
    for i, n in enumerate(count.tolist()):
        if n >= size:
            s = np.sort(runs[at[i] : at[i + 1] - size + 1])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        elif n:  # too short: the whole sequence is one
            part = (h[at[i] : at[i + 1]] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True)
            s = words.mixed(part + _PLACE[32 + n : 33 + n])
        else:
            s = h[:0]
        out.append(s)
        ends.append(ends[-1] + len(s))
    return (np.concatenate(out) if out else h[:0]), np.array(ends, np.int64)


def signatures(hashes, starts):
    """Least and greatest value of every hash function for sets that begin at ``starts``: one row each."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), 2 * len(_XOR)), np.uint32)
    for p in range(len(_XOR)):
        v = (low ^ _XOR[p]) * _ODD[p]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[:, p] = np.minimum.reduceat(v, starts)
        out[:, len(_XOR) + p] = np.maximum.reduceat(v, starts)
    return out


def bands(values):
    """Bucket keys of signatures."""
    parts = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for k in range(ROWS):
        key = words.mixed((key + parts[:, :, k]) * _PLACE[40 + k])
    return key.view(np.int64)


def _sign(batches):
    for batch in batches:
        ids, (data, offsets) = integers(batch.column(0)), flat(batch.column(1))
        for a, b in words.pieces(offsets):
            own = offsets[a : b + 1] - offsets[a]
            hashes, at = shingle_sets(data[offsets[a] : offsets[b]], own)
            count = np.diff(at)
            some = np.flatnonzero(count)
            keys = bands(signatures(hashes, at[:-1][some])) if len(some) else np.zeros((0, BANDS), np.int64)
            # Two sums over the set tell sets apart.
            one, two = (np.zeros(b - a, np.uint64) for _ in range(2))
            if len(some):
                one[some] = np.add.reduceat(hashes, at[:-1][some])
                two[some] = np.add.reduceat(words.mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][some])
            ends = np.zeros(b - a + 1, np.int32)
            ends[1:] = np.cumsum((count > 0) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(count.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                names=["_id", "_n", "_f", "_g", "_bands"],
            )


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array([pack(t) for t in raw], pa.binary()), pa.array([len(t) for t in raw], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "_z", "_size"])


def _confirm(share):
    """Whether a centre, by any of its texts, is linked with each text of its group."""
    def run(table):
        table = table.combine_chunks()
        unpack = zstandard.ZstdDecompressor().decompress
        raw = [unpack(z) for z in table.column("_z").to_pylist()]
        centre = table.column("_centre").to_numpy()
        ids = table.column("_id").to_numpy()
        firsts = np.flatnonzero(centre)  # the texts of the centre
        offsets = np.cumsum([0, *map(len, raw)])
        whole = np.frombuffer(b"".join(raw), np.uint8)
        linked = np.zeros(len(raw), bool)
        owns = [shingle_sets(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]))[0] for i in firsts]
        for x, y in words.pieces(offsets):
            hashes, at = shingle_sets(whole[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            for own in owns:
                if not len(own):
                    continue
                place = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
                hit = np.r_[0, np.cumsum(own[place] == hashes)]
                both = hit[at[1:]] - hit[at[:-1]]
                linked[x:y] |= 100 * both >= share * (len(own) + np.diff(at) - both)
        b = np.flatnonzero(~centre)
        return pa.table({
            "a": pa.array(np.full(len(b), ids[firsts[0]]), pa.int64()), "b": pa.array(ids[b], pa.int64()), "linked": pa.array(linked[b], pa.bool_()),
        })

    return run


def sizes(texts):
    """Bytes of the texts of every id."""
    return texts.groupBy("_id").agg(F.sum("_size").alias("_size"))


def parts(rows, most_rows, size):
    """In how many parts rows and bytes are cut."""
    return F.ceil(F.greatest(rows / most_rows, size / GROUP_BYTES)).cast("int")


def confirmed(pairs, texts, share=75):
    """``a, b, linked`` for pairs of ids; ``texts`` holds packed texts. A centre's pairs are cut into groups
    of so many texts and bytes (a single text may have more)."""
    sized = pairs.join(sizes(texts).withColumnRenamed("_id", "b"), "b")
    groups = sized.groupBy("a").agg(parts(F.count("*"), GROUP, F.sum("_size")).alias("_groups"))
    dealt = pairs.join(groups, "a").withColumn("_part", F.pmod(F.xxhash64("b"), F.col("_groups")).cast("int"))
    needed = dealt.select(F.col("b").alias("_id"), "a", "_part", F.lit(False).alias("_centre")).unionByName(
        dealt.select(F.col("a").alias("_id"), "a", "_part", F.lit(True).alias("_centre")).distinct()
    )
    return needed.join(texts.drop("_size"), "_id").groupBy("a", "_part").applyInArrow(_confirm(share), "a long, b long, linked boolean")


def _centred(buckets):
    """Of every document the pair with the bucket centre that it shares most buckets with."""
    centres = buckets.groupBy("key").agg(F.min("id").alias("z"))
    pairs = buckets.join(centres, "key").filter("id <> z").groupBy("z", "id").agg(F.count("*").alias("w"))
    best = pairs.groupBy("id").agg(F.max_by("z", F.struct("w", -F.col("z"))).alias("a"))
    return best.select("a", F.col("id").alias("b"))


def _compare(share):
    """Links between some documents of a cluster and some of its outsiders, as far as they connect components."""
    def run(table):
        table = table.combine_chunks()
        unpack = zstandard.ZstdDecompressor().decompress
        outside = table.column("_outside").to_numpy()
        ids, comps = table.column("_id").to_numpy(), table.column("c").to_numpy()
        raw = [unpack(z) for z in table.column("_z").to_pylist()]
        sides = []
        for part in (np.flatnonzero(outside), np.flatnonzero(~outside)):
            texts = [raw[i] for i in part]
            sides.append((part, *shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))))
        (own, hashes, at), (rest, others, ends) = sides
        owner = np.repeat(np.arange(len(own)), np.diff(at))
        order = np.argsort(hashes, kind="stable")
        hashes, owner, size = hashes[order], owner[order], np.diff(at)
        root, a, b = {}, [], []

        def find(c):
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        for j, i in enumerate(rest.tolist()):
            mine = others[ends[j] : ends[j + 1]]
            low, high = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
            span = high - low
            total = int(span.sum())
            if not total:
                continue
            places = np.repeat(low - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(total)
            both = np.bincount(owner[places], minlength=len(own))
            for k in np.flatnonzero(100 * both >= share * (size + len(mine) - both)).tolist():
                one, two = find(comps[i]), find(comps[own[k]])
                if one != two:
                    root[max(one, two)] = min(one, two)
                    a.append(ids[own[k]])
                    b.append(ids[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _crossing(buckets, labels, texts, share):
    """Links that connect components which share a bucket.

    Buckets of more than one component tie their documents into clusters. In a cluster, all
    documents outside its largest component are compared with all others of it, in groups of at
    most about 2 * SLICE; what comes out of a group is no more than what connects components.
    """
    labelled = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("c")
    )
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("id").alias("z"))
    inside = labelled.join(mixed.filter("lo <> hi").select("key", "z"), "key").groupBy("z", "id").agg(F.first("c").alias("c"))
    inside = stored(inside)
    clusters = connected(inside.select(F.col("z").alias("a"), F.col("id").alias("b")))
    docs = stored(
        inside.select("id", "c").distinct().join(clusters.withColumnRenamed("component", "k"), F.col("id") == F.col("node"))
        .select("id", "c", "k")
    )
    sized = docs.join(sizes(texts).withColumnRenamed("_id", "id"), "id")
    split = sized.groupBy("k", "c").agg(F.count("*").alias("m"), F.sum("_size").alias("_size"))
    size = split.groupBy("k").agg(
        F.max_by("c", F.struct("m", "c")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"),
        F.sum("_size").alias("bytes"), F.max_by("_size", F.struct("m", "c")).alias("own"),
    )
    size = size.filter(F.col("all") > F.col("most")).select(
        "k", "main", parts(F.col("all"), SLICE, F.col("bytes")).alias("tiles"),
        parts(F.col("all") - F.col("most"), SLICE, F.col("bytes") - F.col("own")).alias("slices"),
    )
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = docs.join(size, "k")
    rows = (
        both.filter("c <> main").select("k", F.col("id").alias("_id"), "c", place("slices").alias("slice"), every("tiles").alias("tile"), F.lit(True).alias("_outside"))
        .unionByName(both.select("k", F.col("id").alias("_id"), "c", every("slices").alias("slice"), place("tiles").alias("tile"), F.lit(False).alias("_outside")))
    )
    return rows.join(texts.drop("_size"), "_id").groupBy("k", "slice", "tile").applyInArrow(_compare(share), "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 75) -> DataFrame:
    """Size of the shingle set, component and verdict of every row: id, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked if they share at least ``share`` percent of the union of their sets.
    The component is the smallest id that links lead to. Null texts and texts without words have no
    shingles, are linked with nothing and kept; a text of fewer words than a shingle is one
    shingle. Rows that repeat an id are taken as one document with the sets of each (the copies
    share a component, and are kept or not together). Rows without an id are compared with
    nothing: their component is null and they are kept.

    Texts of any length are read whole, in pieces; groups are cut by rows and bytes.

    Runs jobs. What is large moves once: texts of candidates, packed. Bucket keys are counted
    before they are joined, so buckets of one document go at once, and a bucket of many is never
    gathered.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signed = stored(source.mapInArrow(_sign, "_id long, _n long, _f long, _g long, _bands array<long>"))
    sets = signed.filter("_n > 0 AND _id IS NOT NULL")
    # Stored, so that joins with it have two plain sides and a set of very many copies can be split.
    node = stored(sets.groupBy("_f", "_g", "_n").agg(F.min("_id").alias("_node")))
    keys = (
        sets.join(node.select(F.col("_node").alias("_id"), "_f", "_g", "_n"), ["_id", "_f", "_g", "_n"], "left_semi")
        .select("_id", F.explode("_bands").alias("key"))
    )
    shared = keys.groupBy("key").agg(F.count("*").alias("_c")).filter("_c > 1").select("key")
    buckets = stored(keys.join(shared, "key").select("key", F.col("_id").alias("id")))
    candidates = buckets.select(F.col("id").alias("_id")).distinct()
    # An id with several texts is compared by each of them.
    texts = stored(source.mapInArrow(_packed, "_id long, _z binary, _size long").join(candidates, "_id", "left_semi").dropDuplicates(["_id", "_z"]))

    # Rows that repeat an id with another text link their nodes from the start.
    members = sets.join(node, ["_f", "_g", "_n"]).select("_id", "_node")
    links = members.filter("_id <> _node").join(candidates, "_id", "left_semi").select(F.col("_node").alias("a"), F.col("_id").alias("b"))
    judged = stored(confirmed(_centred(buckets), texts, share))
    links = stored(links.unionByName(judged.filter("linked").select("a", "b")))
    labels = stored(connected(links))
    more = stored(_crossing(buckets, labels, texts, share))
    if not more.isEmpty():
        labels = stored(connected(links.unionByName(more)))
    joined = (
        signed.join(node, ["_f", "_g", "_n"], "left")
        .join(labels.select(F.col("node").alias("_node"), "component"), "_node", "left")
    )
    component = F.when(F.col("_n") > 0, F.coalesce("component", F.col("_node"))).otherwise(F.col("_id"))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
        F.when(F.col("_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
