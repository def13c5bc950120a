"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves of a tree such as domain, language, source. A budget of tokens goes down
the tree by weight. A node that can't use its share, because its documents give less in the
allowed number of epochs, leaves the rest to its siblings by their weights; only what all of them
together can't use goes to the siblings of their parent, and so on. All of this is whole-number
arithmetic on one row per node.

A leaf spends its budget on epochs: all of its documents as often as they fit, then the first tokens
of one more epoch. Every epoch has an order of its own, by a seeded hash.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.shared import kept as stored
from casework.llm.shared import small_side

WORDS = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash that part a leaf, so that no task has to order a whole leaf.
DIGITS = 3


def token_count(text_col: str) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")


def _weight(keys: list, weights: dict) -> Column:
    """Weight of a node by its path; 1 where none is given."""
    out = F.lit(1)
    for path, weight in weights.items():
        if len(path) == len(keys):
            same = F.lit(True)
            for key, value in zip(keys, path):
                same = same & F.col(key).eqNullSafe(F.lit(value))
            out = F.when(same, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parents: list, key: str) -> DataFrame:
    """Budgets ``_got`` of nodes ``key`` from their parents' budget ``_budget``, capacities ``_cap`` and weights ``_w``."""
    siblings = Window.partitionBy(*parents)
    order = siblings.orderBy(F.col("_cap") / F.col("_w"), key)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # In the order of capacity for weight, a node is full if its share of what is left is at least its capacity.
    nodes = (
        nodes.withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_heavy", F.sum("_w").over(siblings) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_full", F.col("_cap") * F.col("_heavy") <= F.col("_left") * F.col("_w"))
        .withColumn("_open", F.when(F.col("_full"), 0).otherwise(F.col("_w")))
        .withColumn("_rest", F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(siblings))
        .withColumn("_all", F.sum("_open").over(siblings))
        .withColumn("_upto", F.sum("_open").over(siblings.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))
    )
    part = F.expr("(_rest * _upto) div _all - (_rest * (_upto - _open)) div _all")
    return nodes.withColumn("_got", F.when(F.col("_full"), F.col("_cap")).otherwise(part)).drop(
        "_left", "_heavy", "_full", "_open", "_rest", "_all", "_upto", "_budget", "_cap", "_w"
    )


def budgets(leaves: DataFrame, levels: list, weights: dict, budget: Column, epochs: int) -> DataFrame:
    """Budget of every leaf (``_got``) from the tokens of each (``_tokens``)."""
    whole = leaves.agg(F.sum("_tokens").alias("_total"))
    given = None
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        nodes = leaves.groupBy(*path).agg((F.sum("_tokens") * epochs).alias("_cap")).withColumn("_w", _weight(path, weights)).filter("_w > 0")
        if given is None:
            nodes = nodes.withColumn("_budget", whole.select(budget).scalar().cast("long")).withColumn("_root", F.lit(0))
            given = _share(nodes, ["_root"], path[-1]).drop("_root")
        else:
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"g.{c}")) for c in path[:-1]]
            condition = same[0]
            for c in same[1:]:
                condition = condition & c
            nodes = nodes.alias("n").join(given.alias("g"), condition).select(
                *[F.col(f"n.{c}") for c in path], "_cap", "_w", F.col("g._got").alias("_budget")
            )
            given = _share(nodes, path[:-1], path[-1])
    return given


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), key))


def _key(id_col: Column, text: Column) -> Column:
    """What gives a row its place: its id, or its text where it has none."""
    return F.coalesce(id_col.cast("string"), F.concat(F.lit("t"), F.md5(text)))


def first_tokens(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th token."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mixed(docs: DataFrame, levels: dict, weights: dict, share: tuple = (1, 2), epochs: int = 2, id_col: str = "doc_id",
          text_col: str = "text", seed: int = 42, epoch_col: str = "epoch") -> DataFrame:
    """The chosen rows of ``docs``, a row for every epoch it is chosen in, numbered in ``epoch_col``.

    ``levels`` names the levels from the root and says how to read them from a row; ``weights`` has
    whole numbers for paths of their values, such as ``("web",)`` or ``("web", "en")``. The budget
    is ``share`` (numerator, denominator) of all tokens of ``docs``; tokens are words. The part epoch of a leaf is
    the prefix of its tokens, document after document, that its budget leaves room for: the text in which it
    ends is cut there, so all of the budget is spent as far as the epochs allow. Documents without tokens are not
    chosen. A null level is a value like any other. Rows that repeat an id (of rows without one: a text) stand in the
    same place; where the prefix ends among them they share what is left, and a remainder stays unspent. Texts of any
    length are counted whole.

    Texts are read twice and not moved, unless there are more than some ten thousand leaves: where a leaf's
    prefix ends is found from counts per part of its hashes, and every row compares its own with it.
    Runs jobs.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    key = _key(F.col(id_col), F.col(text_col))
    own = [e.alias(n) for e, n in zip(levels.values(), names)]
    small = stored(docs.select(key.alias("_key"), *own, token_count(text_col).alias("_tokens")).filter("_tokens > 0"))
    leaves = stored(small.groupBy(*names).agg(F.sum("_tokens").alias("_tokens")))
    budget = F.expr(f"(coalesce(_total, 0) * {int(share[0])}) div {int(share[1])}")
    given = budgets(leaves, names, weights, budget, epochs)

    def on(a, b, more=()):
        out = F.lit(True)
        for n in (*names, *more):
            out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
        return out

    plan = leaves.alias("a").join(given.alias("b"), on("a", "b")).select(
        *[F.col(f"a.{n}") for n in names], F.expr("_got div _tokens").alias("_whole"), F.expr("_got % _tokens").alias("_part")
    )
    plan = stored(plan)
    ordered = small.alias("a").join(plan.filter("_part > 0").alias("b"), on("a", "b")).select(
        *[F.col(f"a.{n}") for n in names], "_key", "_tokens", "_part", _order(seed, F.col("_whole") + 1, F.col("_key")).alias("_hash"),
    ).withColumn("_bin", F.substring("_hash", 1, DIGITS))
    upto = Window.partitionBy(*names).orderBy("_bin")
    bins = ordered.groupBy(*names, "_bin").agg(F.sum("_tokens").alias("_sum"), F.max("_part").alias("_part"))
    bins = bins.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum")).filter(
        (F.col("_before") < F.col("_part")) & (F.col("_before") + F.col("_sum") >= F.col("_part"))
    ).select(*names, "_bin", "_before")
    # Within the part where the prefix ends, one place after the other.
    places = (
        ordered.alias("a").join(bins.alias("b"), on("a", "b", ["_bin"]))
        .groupBy(*[F.col(f"a.{n}") for n in names], "_hash", "_key")
        .agg(F.sum("_tokens").alias("_sum"), F.count("*").alias("_peers"), F.max("_part").alias("_part"), F.max("_before").alias("_before"))
    )
    inside = Window.partitionBy(*names).orderBy("_hash", "_key")
    reached = places.withColumn("_upto", F.col("_before") + F.sum("_sum").over(inside)).filter(F.col("_upto") >= F.col("_part"))
    last = reached.groupBy(*names).agg(F.min(F.struct(
        F.col("_hash").alias("h"), F.col("_key").alias("k"),
        # Tokens that each row in the place has room for; null where there is room for all.
        F.when(F.col("_upto") > F.col("_part"), F.expr("(_part - (_upto - _sum)) div _peers")).alias("room"),
    )).alias("_last"))
    limits = plan.alias("a").join(last.alias("b"), on("a", "b"), "left").select(
        *[F.col(f"a.{n}") for n in names], "_whole", "_part", "_last"
    )
    limits = stored(limits)
    columns = [c for c in docs.columns if c.lower() != epoch_col.lower()]
    rows = docs.select(F.struct("*").alias("_row"), *own, key.alias("_key"), token_count(text_col).alias("_tokens")).filter("_tokens > 0")
    hash_ = _order(seed, F.col("_whole") + 1, F.col("_key"))
    place, end = F.struct(hash_.alias("h"), F.col("_key").alias("k")), F.struct(F.col("_last.h"), F.col("_last.k"))
    room = F.when(place == end, F.least("_tokens", F.coalesce("_last.room", "_tokens"))).when(place < end, F.col("_tokens")).otherwise(0)
    times = F.col("_whole") + F.when(F.col("_room") > 0, 1).otherwise(0)
    text = F.col("_row")[text_col]
    cut = F.when((F.col("_epoch") > F.col("_whole")) & (F.col("_room") < F.col("_tokens")), first_tokens(text, F.col("_room"))).otherwise(text)
    return (
        rows.alias("a").join(small_side(limits).alias("b"), on("a", "b"))
        .withColumn("_room", F.when(F.col("_part") > 0, room).otherwise(F.lit(0))).withColumn("_times", times).filter("_times > 0")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
        .select(*[(cut if c == text_col else F.col("_row")[c]).alias(c) for c in columns], F.col("_epoch").alias(epoch_col))
    )
