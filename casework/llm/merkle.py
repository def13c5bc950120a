"""A Merkle manifest of a table: one digest for all rows, and for each the siblings that prove it.

Rows are leaves, numbered within their group. A node's parent has its number divided by the fanout,
the remainder is its slot: conditional aggregates over the children of a parent spread their digests
into as many columns as there are slots. The columns one after the other hash to the parent; without the own
slot's they are a node's siblings. One aggregation spreads the nodes below LEVELS levels at once, so a tree
takes a shuffle for every LEVELS levels, and on the way back a join of every node with its columns.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.shared import SMALL
from casework.llm.shared import kept as stored
from casework.operators.numbering import numbered

#: Levels that one aggregation climbs; it has ``fanout ** LEVELS`` columns.
LEVELS = 4


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values: each is ``-`` if null, else its bytes in UTF-8, a colon and itself."""
    parts = [c.cast("string") for c in values]
    framed = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts]
    return F.sha2(F.concat(*framed), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, e: F.sha2(F.concat(e["left"], h, e["right"]), 256))


def proof_text(proof: Column) -> Column:
    """The siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda e: F.concat(e["left"], e["right"])), "")


def _spread(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """From nodes (_g, _i, _size, _h) a row for every ``fanout ** levels`` of them: ``_up``, their digests
    ``_n0`` and those of the levels above them, up to ``_n{levels}``, which has one."""
    width = fanout ** levels
    slots = [F.max(F.when(F.expr(f"_i % {width} = {s}"), F.col("_h"))).alias(f"_c{s}") for s in range(width)]
    df = nodes.groupBy("_g", F.expr(f"_i div {width}").alias("_up")).agg(F.max("_size").alias("_size"), *slots)
    df = df.select("_g", "_up", "_size", F.array(*[f"_c{s}" for s in range(width)]).alias("_n0"))
    for level in range(levels):
        below = [F.get(f"_n{level}", F.lit(s)) for s in range(fanout ** (levels - level))]
        above = []
        for p in range(0, len(below), fanout):
            joint = F.sha2(F.concat(*[F.coalesce(c, F.lit("")) for c in below[p : p + fanout]]), 256)
            above.append(F.when(_several(fanout ** level), F.when(below[p].isNotNull(), joint)).otherwise(below[p]))
        df = df.withColumn(f"_n{level + 1}", F.array(*above))
    return df


def _several(width: int) -> Column:
    """Whether a group has more than one node of ``width`` leaves each; a single one is its subroot."""
    return F.expr(f"(_size + {width - 1}) div {width} > 1")


def _siblings(fanout: int, levels: int) -> Column:
    """Siblings of the node in ``_slot``, level by level: all columns of its parent but its own."""
    steps = []
    for level in range(levels):
        at = F.expr(f"_slot div {fanout ** level}").cast("int")
        own = at % fanout
        left = F.concat_ws("", F.slice(f"_n{level}", at - own + 1, own))
        right = F.concat_ws("", F.slice(f"_n{level}", at + 2, F.lit(fanout - 1) - own))
        steps.append(F.when(_several(fanout ** level), F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*steps))


def _trees(nodes: DataFrame, largest: int, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with the ``_root`` of their group and the ``_proof`` up to it."""
    if largest <= 1:
        none = F.array().cast("array<struct<left:string,right:string>>")
        return nodes.withColumns({"_root": F.col("_h"), "_proof": none})
    width = fanout ** levels
    wide = stored(_spread(nodes.select("_g", "_i", "_size", "_h"), fanout, levels))
    parents = wide.select(
        "_g", F.col("_up").alias("_i"), F.expr(f"(_size + {width - 1}) div {width}").alias("_size"),
        F.get(f"_n{levels}", F.lit(0)).alias("_h"),
    )
    high = _trees(parents, -(-largest // width), fanout, levels).select(
        "_g", F.col("_i").alias("_up"), "_root", F.col("_proof").alias("_more")
    )
    wide = wide.drop("_size", f"_n{levels}").join(high, ["_g", "_up"])
    found = nodes.withColumns({"_up": F.expr(f"_i div {width}"), "_slot": F.expr(f"_i % {width}")}).join(wide, ["_g", "_up"])
    return found.withColumn("_proof", F.concat(_siblings(fanout, levels), "_more")).select(*nodes.columns, "_root", "_proof")


def manifest(rows: DataFrame, leaf_col: str, id_col: str, group_col: str, fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``subroot`` of their group, ``root`` and ``proof``, the siblings from the leaf to the root.

    Leaves ascend by id within a group, then by their digest; while a group has several nodes, every
    ``fanout`` consecutive ones (the last ones may be fewer, even one) become the digest of theirs, and
    what remains is the group's subroot. Subroots, a null group first and then by their bytes, give the root in the same
    way. ``proof`` has a struct of the siblings' digests to the ``left`` and to the ``right``
    for every such step; ``folded`` takes it. Rows without an id come first in their group, rows that
    repeat one are leaves of their own, an empty table gives an empty one. ``rows`` is stored, so let it
    have digests in place of long texts, and has no columns ``subroot``, ``root`` or ``proof``. Runs jobs.
    """
    # Ascending keys: null first, then bytewise.
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    packed = stored(rows.select(
        F.struct("*").alias("_row"), key.alias("_g"), F.col(id_col).alias("_id"), F.col(leaf_col).alias("_h")
    ))
    placed = stored(numbered(packed, ["_g", "_id", "_h"], stored, "_n"))
    groups = stored(placed.groupBy("_g").agg(F.min("_n").alias("_first"), F.count("*").alias("_size")))
    counts = groups.agg(F.max("_size"), F.count("*")).first()
    # A language may hold most rows: its few values go to the rows as long as there are few groups.
    sent = F.broadcast if counts[1] <= SMALL else lambda side: side
    leaves = placed.join(sent(groups), "_g").select("_row", "_g", (F.col("_n") - F.col("_first")).alias("_i"), "_size", "_h")
    trees = _trees(leaves, counts[0] or 0, fanout, levels)
    subroots = trees.filter("_i = 0").select(F.col("_g").alias("_key"), F.col("_root").alias("_h"))
    subroots = numbered(stored(subroots), ["_key"], stored, "_i").select(
        F.lit("").alias("_g"), "_i", F.lit(counts[1]).cast("long").alias("_size"), "_h", "_key"
    )
    tops = _trees(subroots, counts[1], fanout, levels).select(
        F.col("_key").alias("_g"), F.col("_root").alias("_whole"), F.col("_proof").alias("_more")
    )
    return trees.join(sent(stored(tops)), "_g").select(
        "_row.*", F.col("_root").alias("subroot"), F.col("_whole").alias("root"), F.concat("_proof", "_more").alias("proof")
    )
