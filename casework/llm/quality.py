"""Quality scores from compression with dictionaries of good and of bad text.

A zstandard dictionary is built from each class of labelled text. A text is compressed with
both, block by block, so that a dictionary counts as much at the end of a long text as at its
start. The difference of the two sizes per byte is turned into a probability by a logistic
calibration, fitted on labelled texts that did not go into the dictionaries they are measured with; next to
the difference it reads the smaller size per byte, and how short the text is.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes compressed at a time, bytes of a dictionary, zstandard's level.
BLOCK, DICTIONARY, LEVEL = 512, 32768, 3
#: Bound of the sample the model is fitted on: labelled rows of a class, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16 << 20


@dataclass
class Model:
    """Dictionaries of good and of bad text from either half of the sample, and the calibration:
    weights of (1, difference, size, shortness)."""

    good: list
    bad: list
    weights: list


def held_out(id_col: str, folds: int = 4, fold: int = 2):
    """Whether a row belongs to the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def _blocks(data: bytes):
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(texts: list) -> bytes:
    """Dictionary of some texts; of too few for training, their own bytes."""
    parts = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-DICTIONARY:]


def _compressor(content: bytes):
    d = zstandard.ZstdCompressionDict(content) if content else None
    if d is not None:
        d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
    ).compress


def _features(texts: list, model_good: bytes, model_bad: bytes):
    good, bad = _compressor(model_good), _compressor(model_bad)
    out = np.zeros((len(texts), 4))
    for i, data in enumerate(texts):
        parts = _blocks(data)
        g = sum(len(good(p)) for p in parts)
        b = sum(len(bad(p)) for p in parts)
        size = len(data) + 16
        out[i] = 1, (b - g) / size, (min(g, b) - 8 * len(parts)) / size, size**-0.5
    return out


def _logistic(x, y, weight):
    """Weights of a logistic regression, by Newton's method with a slight ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], spread[0] = 0, 1
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        w = w + np.clip(np.linalg.solve(hessian, z.T @ (weight * (y - p)) - ridge @ w), -5, 5)
    w = w / spread
    w[0] -= (w[1:] * mean[1:]).sum()
    return w.tolist()


def _dictionaries(texts: list, label):
    """Dictionaries of the good and the bad texts, learnt from as many bytes of each."""
    parts = [[t for t, k in zip(texts, label) if k == c] for c in (0, 1)]
    least = max(min(sum(map(len, p)) for p in parts), DICTIONARY)
    for p in parts:
        while len(p) > 1 and sum(map(len, p)) - len(p[-1]) > least:
            p.pop()
    return _dictionary(parts[1]), _dictionary(parts[0])


def learn(texts: list, label, count) -> Model:
    """Model of a sample: its texts (bytes), their labels, and of how many rows each class stands.

    Every text of the sample is measured with dictionaries of the other half; these measures fit
    the calibration. Texts to score are measured with the dictionaries of both halves.
    """
    label = np.asarray(label)
    total = np.array([int((label == c).sum()) for c in (0, 1)])
    if min(total) < 2:
        share = count[1] / max(1, count[0] + count[1]) if len(label) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model([], [], [float(np.log(share / (1 - share))), 0.0, 0.0, 0.0])
    half = np.zeros(len(label), int)  # the texts come in a random order
    for c in (0, 1):
        half[label == c] = np.arange(total[c]) % 2
    x, pairs = np.zeros((len(label), 4)), []
    for h in (0, 1):
        other, own = np.flatnonzero(half != h), np.flatnonzero(half == h)
        pairs.append(_dictionaries([texts[i] for i in other], label[other]))
        x[own] = _features([texts[i] for i in own], *pairs[-1])
    weight = (np.array(count) / total)[label]
    return Model([g for g, _ in pairs], [b for _, b in pairs], _logistic(x, label, weight / weight.mean()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, seed: int = 42) -> Model:
    """Model from the labelled rows outside the held-out fold; runs a job.

    It is fitted on a bounded sample: of each class the first ``sample_rows`` rows in a seeded
    order, without texts that are longer than what is left of ``sample_bytes``. A row
    that repeats id and text counts once. Null labels, labels other than 0 and 1
    and rows labelled both ways are not learnt from; without one of the classes every text gets
    the share of label 1 as its score, without any label 0.5.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z"))
        .filter("_y = _z").drop("_z")
        .withColumn("_h", F.xxhash64(F.lit(seed), "_id"))
    )
    first = [known.filter(F.col("_y") == c).orderBy("_h", "_id").limit(sample_rows) for c in (0, 1)]
    chosen = first[0].unionByName(first[1])
    counts = known.groupBy("_y").agg(F.count("*").alias("_n"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    listed = texts.join(F.broadcast(chosen), "_id").join(F.broadcast(counts), "_y").withColumn("_key", F.xxhash64("_text"))

    def fitting(rows):
        """Of each class, the rows that fit into the bytes left by those before; the first if none does."""
        rows = rows.sort_values(["_y", "_h", "_id", "_key"])
        some = []
        for _, own in rows.groupby("_y"):
            left, taken = sample_bytes, []
            for i, size in zip(own.index, own["_size"]):
                if size <= left and len(taken) < sample_rows:
                    left -= size
                    taken.append(i)
            some += taken or list(own.index[:1])
        return rows.loc[some, ["_id", "_key"]]

    # Ids and sizes of at most 2 * sample_rows ids, before their texts.
    sizes = listed.select("_y", "_h", "_id", "_key", F.octet_length("_text").cast("long").alias("_size")).distinct()
    fits = sizes.groupBy().applyInPandas(fitting, T.StructType([sizes.schema["_id"], sizes.schema["_key"]]))
    sample = listed.join(F.broadcast(fits), ["_id", "_key"]).dropDuplicates(["_id", "_key"]).select("_y", "_h", "_id", "_n", "_text")

    def run(rows):
        rows = rows.sort_values(["_y", "_h", "_id", "_text"])
        count = [int(rows["_n"][rows["_y"] == c].max()) if (rows["_y"] == c).any() else 0 for c in (0, 1)]
        m = learn([t.encode() for t in rows["_text"]], rows["_y"].to_numpy(), count)
        import pandas as pd

        return pd.DataFrame({"good": [m.good], "bad": [m.bad], "weights": [m.weights]})

    found = sample.groupBy().applyInPandas(run, "good array<binary>, bad array<binary>, weights array<double>").collect()
    if not found:
        return Model([], [], [0.0, 0.0, 0.0, 0.0])
    return Model(list(map(bytes, found[0].good)), list(map(bytes, found[0].bad)), list(found[0].weights))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is good, in place of a column of that name.

    Whole texts count. A null text counts as empty; an empty one has a score too. Scores depend
    on the text alone: rows with the same text score the same.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() != score_col.lower()])
    shipped = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))

    def run(batches):
        good, bad, weights = shipped.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            data = [(t or "").encode() for t in texts.to_pylist()]
            x = [_features(data, g, b) for g, b in zip(good, bad)]
            z = (sum(x) / len(x) if x else np.eye(1, 4).repeat(len(data), axis=0)) @ np.array(weights)
            score = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
