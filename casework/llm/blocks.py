"""Counting keys over all texts without a row for every key.

Texts are dealt into blocks of a bounded number of bytes. A block sends its distinct keys, sorted,
as one packed row to each range of keys; the range adds up what all blocks sent and answers every
block with one packed row, in the order of the keys it got, so that keys never travel back. Hot
keys are one entry of each block, whatever their number.
"""

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20


def dealt(docs: DataFrame, id_col: str, text_col: str, *more, block_bytes: int = BLOCK_BYTES):
    """Rows ``_block, _id, _text, ...`` dealt into blocks, and the number of blocks; sums up the bytes.

    ``more`` are further columns. A text longer than a block is a block's only large one.
    """
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64(id_col, F.octet_length(text_col)), F.lit(n)).cast("int")
    rows = docs.select(block.alias("_block"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *more)
    return rows.repartition(n, "_block"), n


def ranges(keys, n):
    """Where each of ``n`` equal ranges of 64-bit keys begins among sorted keys (n + 1 places)."""
    edges = [(i << 64) // n for i in range(1, n)]
    return np.r_[0, np.searchsorted(keys, np.array(edges, np.uint64)), len(keys)].astype(np.int64)


def pack(array) -> bytes:
    """Packed numbers; small ones take little room."""
    a = np.ascontiguousarray(array)
    if a.dtype.itemsize > 1 and a.dtype.kind in "iu" and len(a):
        a = a.astype(np.min_scalar_type(int(a.max()))) if a.dtype.kind == "u" else a
    return a.dtype.str[1:].encode() + b"|" + zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpack(raw: bytes):
    kind, _, rest = raw.partition(b"|")
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(rest), kind.decode())


def pack_sorted(keys) -> bytes:
    """Packed 64-bit numbers in ascending order: their steps, byte by byte, as small steps leave bytes empty."""
    steps = np.r_[keys[:1], np.diff(keys)]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(raw: bytes):
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def distinct(keys, *weights):
    """Sorted distinct keys, the place of every key among them, and the sums of the weights."""
    order = np.argsort(keys, kind="stable").astype(np.int32 if len(keys) < 1 << 31 else np.int64)
    s = keys[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.empty(len(keys), order.dtype)
    place[order] = np.cumsum(new, dtype=order.dtype) - 1
    del order, new
    sums = [np.bincount(place, w, len(first)).astype(np.uint64) if len(s) else np.zeros(0, np.uint64) for w in weights]
    return s[first], place, sums


def binary(column):
    """Values of a binary column."""
    return [bytes(v) for v in column.to_pylist()]


def table(columns: dict, kinds: dict):
    return pa.table({name: pa.array(columns[name], kinds[name]) for name in kinds})
