"""Quality classifier by supervised subword embeddings.

Hashed words and hashed character n-grams (of the raw bytes, so that case and punctuation count)
have learned vectors; a document is the sum of its average word vector and its average n-gram
vectors; a softmax layer on it gives the class (after Joulin et al., "Bag of Tricks for Efficient
Text Classification", 2016). Trained by numpy stochastic gradient descent with per-row AdaGrad steps.

Classes: good; low (labels.quality = 0); toxic (labels.toxic = 1). For scoring, vectors and output
layer fold into one number per feature and class, so a document costs a few table lookups a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import _common as c

CLASSES = ("good", "low", "toxic")
#: Bounds of the labelled sample: rows of each class, by hash of doc_id; bytes of a text that may be in it (the sample is
#: drawn among such documents, so longer ones use up none of it). Scoring reads every text whole.
SAMPLE, MAX_TRAIN_BYTES = 2000, 20_000
BITS, DIM, EPOCHS, RATE = 17, 8, 5, 0.5
#: Training documents that a feature must occur in; rarer ones would only memorise single documents and score nothing.
MIN_DOCS = 5
#: A document is kept from this probability of being good.
KEEP = 0.7
GRAMS = (3, 5)
_SIZE = 1 << BITS


def feature_sets(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, row offsets) for words and for each n-gram length."""
    base = int(offsets[0])
    raw, at = data[base : int(offsets[-1])], offsets - base
    low = c.Words(np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw), at)
    out = [((low.hash >> np.uint64(64 - BITS)).astype(np.int64), low.at)]
    n = len(raw)
    up, down = c._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    for k, g in enumerate(GRAMS):
        m = max(0, n - g + 1)
        h = (total[g:] - total[:m]) * down[:m] if m else np.zeros(0, np.uint64)
        b = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64) + (k + 1) * _SIZE
        size = np.maximum(np.diff(at) - g + 1, 0)
        if int(size.sum()) != m:  # windows across rows go
            end = np.repeat(at[1:], np.diff(at))[:m]
            b = b[np.arange(m) + g <= end]
        out.append((b, np.concatenate([[0], np.cumsum(size)])))
    return out


def _sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    idx, wgt = [], []
    for b, _ in feature_sets(raw, np.array([0, len(raw)])):
        if len(b):
            u, n = np.unique(b, return_counts=True)
            idx.append(u.astype(np.int32))
            wgt.append((n / len(b)).astype(np.float32))
    return (np.concatenate(idx), np.concatenate(wgt)) if idx else (np.zeros(0, np.int32), np.zeros(0, np.float32))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> np.ndarray:
    """Scores per class, feature: float32 of shape (classes, features + 1); the last column is the bias."""
    rng = np.random.default_rng(seed)
    k = len(CLASSES)
    e = (rng.random(((1 + len(GRAMS)) * _SIZE, DIM), np.float32) - 0.5) / DIM
    w = rng.normal(0, 0.5, (DIM, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    ge, gw, gb = np.full(len(e), 1e-8, np.float32), np.full(w.shape, 1e-2, np.float32), np.full(k, 1e-2, np.float32)
    data = [_sparse(t) for t in texts]
    seen = np.zeros(len(e), np.int32)
    for idx, _ in data:
        seen[idx] += 1
    common = seen >= MIN_DOCS
    e[~common] = 0
    for i, (idx, wgt) in enumerate(data):  # in place: the driver never holds two copies
        data[i] = idx[common[idx]], wgt[common[idx]]
    for epoch in range(epochs):
        step = rate * (1 - 0.8 * epoch / max(1, epochs))
        for i in rng.permutation(len(data)):
            idx, wgt = data[i]
            if not len(idx):
                continue
            rows = e[idx]
            h = wgt @ rows
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            gh = w @ p
            gw2 = np.outer(h, p)
            gw += gw2 * gw2
            gb += p * p
            ge[idx] += wgt * wgt * (gh @ gh)
            e[idx] = rows - np.outer(step * wgt / np.sqrt(ge[idx]), gh)
            w -= step * gw2 / np.sqrt(gw)
            bias -= step * p / np.sqrt(gb)
    return np.ascontiguousarray(np.concatenate([e @ w, bias[None]]).T.astype(np.float32))


def predict(model: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class probabilities of each row."""
    z = np.repeat(model[:, -1:].T.astype(np.float64), len(offsets) - 1, 0)
    for b, at in feature_sets(data, offsets):
        n = np.maximum(np.diff(at), 1)
        for k in range(len(CLASSES)):
            z[:, k] += c.reduce_rows(np.add, model[k].take(b), at, np.float32(0)) / n
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """A model from at most ``sample`` labelled documents of each class; None if there are none. The classes'
    shares among all labelled documents of at most MAX_TRAIN_BYTES go into the bias, as the sample has other shares.

    Labels with a NULL doc_id or neither flag are not used; a document with several labels is low or
    toxic if any of them says so; of rows that repeat a doc_id the least text is taken.
    """
    given = labels.select(labels["doc_id"].cast("bigint").alias("__lx_l"), labels["quality"].alias("__lx_q"), labels["toxic"].alias("__lx_t")).where("__lx_l is not null and (__lx_q is not null or __lx_t is not null)")
    given = _classes(given)
    texts = c.id_text(docs).where("doc_id is not null").where(F.octet_length("text").between(1, MAX_TRAIN_BYTES))
    given = c.materialize(spark, given.join(texts.select(F.col("doc_id").alias("__lx_d")), F.col("__lx_l") == F.col("__lx_d"), "left_semi"))
    share = {r[0]: r[1] for r in given.groupBy("__lx_y").count().collect()}
    order = Window.partitionBy("__lx_y").orderBy(F.xxhash64("__lx_l"), "__lx_l")
    chosen = given.withColumn("__lx_n", F.row_number().over(order)).where(F.col("__lx_n") <= sample).select("__lx_l", "__lx_y")
    # at most classes x sample ids are broadcast
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__lx_l")).select("doc_id", "text", "__lx_y").toPandas().sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    if not len(rows):
        return None
    model = train(rows["text"].tolist(), rows["__lx_y"].tolist())
    for y in range(len(CLASSES)):
        model[y, -1] += np.log(share.get(y, 0.5) / sum(share.values())) - np.log(max(0.5, (rows["__lx_y"] == y).sum()) / len(rows))
    return model


def _classes(given: DataFrame) -> DataFrame:
    """One class per labelled document."""
    return given.groupBy("__lx_l").agg(F.when(F.max("__lx_t") == 1, 2).when(F.min("__lx_q") == 0, 1).otherwise(0).alias("__lx_y"))


def _probabilities(model: np.ndarray | None, column: pa.Array) -> np.ndarray:
    data, offsets = c.utf8(column, lower=False)
    good = lambda i, j: np.repeat([[1.0, 0.0, 0.0]], j - i, 0)
    parts = [good(i, j) if model is None else predict(model, data, offsets[i : j + 1]) for i, j in c.chunks(offsets)]
    p = np.concatenate(parts) if parts else np.zeros((0, len(CLASSES)))
    p[np.diff(offsets) == 0] = (0.0, 1.0, 0.0)  # nothing to read is of low quality
    return p


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_good, p_low, p_toxic, label, keep) of every row of ``docs``.

    A NULL or empty text is low with certainty; a NULL doc_id stays NULL; rows that repeat are scored
    each; ties go to the earlier class of (good, low, toxic). Long texts are read whole. Without any labelled
    document all that have a text are good; an empty table gives no rows; other columns, whatever their
    names, are ignored. keep: p_good is at least KEEP.
    """
    model = spark.sparkContext.broadcast(fit(spark, docs, labels))

    def run(batches):
        for batch in batches:
            p = _probabilities(model.value, batch.column("text"))
            names = pa.array(np.array(CLASSES, object)[p.argmax(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(3)), names, pa.array(p[:, 0] >= KEEP)], ["doc_id", "p_good", "p_low", "p_toxic", "label", "keep"])

    return c.id_text(docs).mapInArrow(run, "doc_id bigint, p_good double, p_low double, p_toxic double, label string, keep boolean")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged and with every column whatever its name, that :func:`classify` would keep: NULL and empty
    texts go, a NULL doc_id or a repeated row is judged like any other, long texts are read whole; without any
    labelled document all that have a text stay; an empty table gives no rows."""
    model = spark.sparkContext.broadcast(fit(spark, docs, labels))
    return c.keep_rows(docs, lambda texts: _probabilities(model.value, texts)[:, 0] >= KEEP)
