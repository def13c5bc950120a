"""CSV with line breaks inside quotes, read by many tasks a file.

A byte range of a file doesn't tell whether its first line stands inside quotes; the number of quotes before it
does. One pass counts the quotes of every range, a running sum over the ranges of a file (two numbers each)
gives the state at its start, and in a second pass every task cuts its ranges at the true ends of records.
What a record has in several ranges, at most two pieces a range, is put together afterwards.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, TAIL = 0, 1, 2
_PIECES = "_path string, _start bigint, _kind int, _first boolean, _text string"


def _cut(batches):
    """Records of the lines of one task, which come range by range in order.

    A line that begins and ends outside quotes is a record; the others are joined until one does.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    path = start = None
    inside, first, open_lines, head = False, False, [], False

    def piece(kind):
        return [path, start, kind, first, "\n".join(open_lines)]

    for batch in batches:
        out = [[], [], [], [], []]
        values = batch.column("value")
        odd = pc.count_substring(values, pattern='"').to_numpy(zero_copy_only=False) % 2
        paths, starts = batch.column("_path").to_pylist(), batch.column("_start").to_numpy(zero_copy_only=False)
        opens = batch.column("_open").to_pylist()
        changes = [i for i in range(batch.num_rows) if i == 0 or starts[i] != starts[i - 1] or paths[i] != paths[i - 1]]
        for a, b in zip(changes, [*changes[1:], batch.num_rows]):
            if (paths[a], starts[a]) != (path, start):
                if open_lines:
                    for column, v in zip(out, piece(HEAD if head else TAIL)):
                        column.append(v)
                path, start, inside, open_lines = paths[a], int(starts[a]), bool(opens[a]), []
                head, first = inside, start == 0
            after = (np.cumsum(odd[a:b]) + inside) % 2
            before = np.r_[int(inside), after[:-1]]
            lines = values.slice(a, b - a)
            whole = (before == 0) & (after == 0)
            if not first and whole.all():
                n = b - a
                for column, v in zip(out, ([path] * n, [start] * n, [WHOLE] * n, [False] * n, lines.to_pylist())):
                    column.extend(v)
            else:
                for line, one, end in zip(lines.to_pylist(), whole, after):
                    open_lines.append(line)
                    if one or not end:
                        for column, v in zip(out, piece(HEAD if head else WHOLE)):
                            column.append(v)
                        open_lines, head, first = [], False, False
            inside = bool(after[-1])
        yield _table(pa, out)
    if open_lines:
        yield _table(pa, [[v] for v in piece(HEAD if head else TAIL)])


def _table(pa, columns):
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_path", "_start", "_kind", "_first", "_text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as they stand: ``record`` text and whether it is the ``first`` of its file.

    Every quote must belong to a quoted field, quotes in it being doubled, as most writers do; records
    without a character are left out.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    ranges = lines.groupBy("_path", "_start").agg((F.sum(quotes) % 2).alias("_odd"))
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_path", "_start", (F.sum("_odd").over(before) % 2 == 1).alias("_open")).filter("_open")
    # Sent to every task, so that lines stay in their order: a row for each range of some 100 MB that begins inside quotes.
    opened = lines.join(F.broadcast(ranges), ["_path", "_start"], "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
    pieces = opened.select("value", "_path", "_start", "_open").mapInArrow(_cut, _PIECES)
    # A record in several ranges: a tail, whole ranges inside it, and the head of the range in which it ends.
    order = Window.partitionBy("_path").orderBy("_start", "_kind")
    number = F.sum(F.when(F.col("_kind") == TAIL, 1).otherwise(0)).over(order)
    parts = pieces.filter(F.col("_kind") != WHOLE).withColumn("_record", number).groupBy("_path", "_record").agg(
        F.array_sort(F.collect_list(F.struct("_start", "_kind", "_text"))).alias("_parts"), F.max("_first").alias("first")
    )
    joined = parts.select(F.array_join(F.col("_parts._text"), "\n").alias("record"), "first")
    whole = pieces.filter(F.col("_kind") == WHOLE).select(F.col("_text").alias("record"), F.col("_first").alias("first"))
    every = whole.unionByName(joined).select(F.regexp_replace("record", r"\r$", "").alias("record"), "first")
    return every.filter(F.col("record") != "")


def read_csv(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    """CSV files with a header as text columns, like ``spark.read.csv`` with ``multiLine``, by many tasks a file.

    The columns are those of the header that Spark finds first; a file whose header has others fails.
    """
    options = {"escape": '"', **(options or {})}
    header = spark.read.options(**options, header=True).csv(path).columns
    names = ", ".join(f"`{name}` string" for name in header)
    rows = records(spark, path).select("first", F.from_csv("record", names, {**options, "multiLine": "true"}).alias("row"))
    same = F.lit(True)
    for name in header:
        same = same & F.col("row")[name].eqNullSafe(F.lit(name))
    wrong = F.raise_error(F.concat(F.lit("another header: "), F.to_json("row")))
    # Headers are dropped, one that differs ends the query.
    keep = F.when(~F.col("first"), True).when(same, False).otherwise(wrong.cast("boolean"))
    return rows.filter(keep).select("row.*")
