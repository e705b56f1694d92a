"""Quality classifier with supervised subword embeddings.

A text's features are its words, its byte n-grams and its repeated words, hashed into ``BUCKETS``; each bucket has a
learned vector; a text is the mean of its features' vectors; a softmax over two outputs gives the
score. Vectors and softmax are trained together by numpy stochastic gradient descent on a bounded
sample of labelled rows. As the output is linear in the vectors, a trained model is one number
for each bucket (the vector times the difference of the two output rows), and scoring a text is a
mean of looked-up numbers.

Defined results: a null or empty text has no features and gets the bias's score; without labelled
rows every score is 0.5; rows labelled twice are used twice; repeated rows are scored one by one; very long texts are taken whole;
an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .runtime import free_name, read, remainder, small_batches

BUCKETS, DIMS, GRAMS, LAGS = 1 << 17, 16, (1, 2, 4), (1, 2, 3, 4)
#: Rows of the training sample: those with the least hash of the id. Documented bound, the same at every input size.
SAMPLE_ROWS = 8000


def _features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature."""
    data, offs = T.text_bytes(col)
    h, row, _, _ = T.word_hashes(data, offs)
    out, rows = [(h & np.uint64(BUCKETS - 1)).astype(np.int32)], [row]
    for lag in LAGS:  # the pair of a word and itself some words on has a bucket of its own, whichever the word
        again = (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
        rows.append(row[lag:][again])
        out.append(np.full(len(rows[-1]), BUCKETS - lag, np.int32))
    at = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for n in GRAMS:
        g = np.full(max(len(data) - n + 1, 0), n, np.uint64)
        for k in range(n):
            g |= data[k : len(data) - n + 1 + k].astype(np.uint64) << np.uint64(8 * k + 8)
        same = at[: len(g)] == at[n - 1 : n - 1 + len(g)]
        out.append((T.mix64(g) & np.uint64(BUCKETS - 1)).astype(np.int32)[same])
        rows.append(at[: len(g)][same])
    return np.concatenate(out), np.concatenate(rows)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in T.slices(batch, "text"):
            f, row = _features(b.column("text"))
            key, c = np.unique(row.astype(np.int64) * BUCKETS + f, return_counts=True)
            bounds = np.searchsorted(key // BUCKETS, np.arange(b.num_rows + 1))
            own = [slice(i, j) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            ids, c = (key % BUCKETS).astype(np.int32), c.astype(np.float32)
            yield pa.record_batch([b.column("place"), b.column("label"), pa.array([ids[s].tobytes() for s in own], pa.binary()), pa.array([c[s].tobytes() for s in own], pa.binary())], ["place", "label", "ids", "counts"])


def descend(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 1.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """(label, buckets, counts) -> a number for each bucket, and the bias."""
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    W, bias = np.zeros((2, DIMS), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, ids, share = rows[i]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            hidden = share @ E[ids] if len(ids) else np.zeros(DIMS, np.float32)
            z = W @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = (p @ W) * lr
            W -= lr * np.outer(p, hidden)
            bias -= lr * np.float32(0.1) * p
            if len(ids):
                E[ids] -= np.outer(share, back)
    return E @ (W[1] - W[0]), float(bias[1] - bias[0])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 8, seed: int = 5) -> tuple[np.ndarray, float]:
    """``labelled``: doc_id, text, label (0 or 1). Learns from the ``sample_rows`` rows with the least hash of the id, in one task."""
    small_batches(labelled.sparkSession)
    place = F.xxhash64(F.col("doc_id"), F.lit(seed))
    ids = labelled.select("doc_id").where("doc_id is not null").select("doc_id", place.alias("place")).orderBy("place", "doc_id").limit(sample_rows)
    last = ids.agg(F.max("place")).first()[0]
    if last is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    few = labelled.select(place.alias("place"), F.col("label").cast("int").alias("label"), "text").where(F.col("place") <= last)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for label, x, c in zip(b.column("label").to_pylist(), b.column("ids"), b.column("counts"), strict=True):
                c = np.frombuffer(c.as_buffer(), np.float32)
                rows.append((label, np.frombuffer(x.as_buffer(), np.int32).copy(), c / max(c.sum(), 1)))
        w, bias = descend(rows, epochs, seed=seed)
        yield pa.record_batch([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])

    sparse = few.mapInArrow(_sparse, "place long, label int, ids binary, counts binary")
    one = sparse.repartition(1).sortWithinPartitions("place", "label", "ids").mapInArrow(fit, "w binary, bias double").first()
    return np.frombuffer(one["w"], np.float32), one["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and score (0 to 1) for every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = free_name("_text", keep)
    d = docs.select(*keep, F.col(text_col).alias(own))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in batches:
            for b in T.slices(batch, own):
                f, row = _features(b.column(own))
                n = np.bincount(row, minlength=b.num_rows)
                z = np.bincount(row, w[f], b.num_rows) / np.maximum(n, 1) + bias
                yield pa.record_batch([*[b.column(i) for i in range(len(keep))], pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], [*keep, "score"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in d.schema[:-1])
    return d.mapInArrow(judge, f"{fields}, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of the labelled documents that may be learned from (crc32(doc_id) mod 3 is not 1)."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label")).where(remainder(F.col("doc_id"), 3) != 1)
    return docs.select("doc_id", "text").join(known.where("label in (0, 1)"), "doc_id")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = train(labelled_rows(docs, read(spark, sf_dir, "labels")))
    return score(docs, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
