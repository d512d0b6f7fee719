"""Language identification by error-correcting output codes.

Each language has a codeword; one binary logistic classifier per bit, on hashed character n-grams,
predicts whether the bit is set. Decoding sums, for each language, the logistic losses of the bits'
margins against its codeword, weighted by how reliable each bit was on held-out rows (after Allwein,
Schapire and Singer, "Reducing Multiclass to Binary", 2000). A small gap between the best and the
second-best language is flagged as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import _common as c

#: Bounds of the labelled sample, by hash of doc_id: rows of each language; bytes of a text that may be in it (the
#: sample is drawn among such rows, so longer ones use up none of it); rows and languages in all.
SAMPLE, MAX_TRAIN_BYTES, MAX_ROWS, MAX_LANGUAGES = 400, 20_000, 8_000, 4_000
#: Bits of a codeword at least, and for each doubling of the number of languages; so many bits differ between any two.
CODE_BITS, BITS_A_DOUBLING, LEAST_DISTANCE = 15, 5, 5
BUCKET_BITS, GRAMS, EPOCHS = 13, (1, 2, 3), 30
#: Gap of the mean loss a bit below which the decision is ambiguous.
AMBIGUOUS = 0.5
_NORMAL = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _NORMAL[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def code_bits(n: int) -> int:
    """Bits of the codewords of n languages."""
    return max(CODE_BITS, BITS_A_DOUBLING * max(1, n - 1).bit_length())


def _distances(m: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return (m.shape[1] - rows.astype(np.float32) @ m.T.astype(np.float32)).astype(int) // 2


def codewords(n: int, bits: int | None = None, seed: int = 11) -> np.ndarray:
    """n rows of +1/-1, any two of which differ in LEAST_DISTANCE bits or more. Of many random codes of few languages, the
    one with the largest least distance; of many languages, one after the other that is far enough from those before.
    No bit is constant."""
    rng = np.random.default_rng(seed)
    bits = bits or code_bits(n)
    if n == 1:
        return np.ones((1, bits), np.float32)
    best, far = None, -1
    for _ in range(400 if n <= 64 else 0):
        m = np.where(rng.random((n, bits)) < 0.5, -1, 1)
        m[rng.integers(n), np.abs(m.sum(0)) == n] *= -1
        d = _distances(m, m)
        least = int(d[~np.eye(n, dtype=bool)].min())
        if least > far:
            best, far = m, least
    while far < LEAST_DISTANCE:
        best, k = np.empty((n, bits), int), 0
        for _ in range(1000 * n):
            row = np.where(rng.random(bits) < 0.5, -1, 1)
            if k == 0 or _distances(best[:k], row[None]).min() >= LEAST_DISTANCE:
                best[k] = row
                k += 1
                if k == n:
                    break
        if k == n and (np.abs(best.sum(0)) < n).all():
            far = LEAST_DISTANCE
        else:
            bits += 1
    return best.astype(np.float32)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams of each row, scaled to unit length. Letters are folded to lower case (ASCII);
    anything else is a space. Rows without letters are zero."""
    base = int(offsets[0])
    raw, at = _NORMAL[data[base : int(offsets[-1])]], offsets - base
    n, rows = len(raw), len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    end = at[1:][row]
    out = np.zeros(rows << BUCKET_BITS)
    wide = raw.astype(np.uint32)
    letter = raw != 32
    for g in GRAMS:
        m = n - g + 1
        if m <= 0:
            continue
        h, some = np.full(m, g, np.uint32), np.zeros(m, bool)
        for j in range(g):
            h = (h * np.uint32(0x01000193)) ^ wide[j : j + m]
            some |= letter[j : j + m]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        ok = some & (np.arange(m) + g <= end[:m])
        out += np.bincount((row[:m][ok] << BUCKET_BITS) + h[ok], minlength=len(out))
    out = out.reshape(rows, -1)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


class Model:
    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs))
        data, offsets = c.utf8(pa.array(texts, pa.string()), lower=False)
        x = np.concatenate([vectors(data, offsets[i : j + 1]) for i, j in c.chunks(offsets)])
        at = {z: i for i, z in enumerate(self.langs)}
        y = self.code[[at[z] for z in langs]]
        rng = np.random.default_rng(3)
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        self.w = np.zeros((x.shape[1], self.code.shape[1]), np.float32)
        self.b = np.zeros(self.code.shape[1], np.float32)
        ada = np.full(self.w.shape, 1e-4, np.float32)
        for _ in range(EPOCHS):
            for k in range(0, len(used), 32):
                pick = used[k : k + 32] if k + 32 <= len(used) else used[k:]
                z = x[pick] @ self.w + self.b
                g = -y[pick] / (1 + np.exp(y[pick] * z)) / len(pick)
                gw = x[pick].T @ g
                ada += gw * gw
                self.w -= 0.5 * gw / np.sqrt(ada)
                self.b -= 0.5 * g.sum(0)
            rng.shuffle(used)
        right = ((x[held] @ self.w + self.b) * y[held] > 0).mean(0) if len(held) else np.ones(self.code.shape[1])
        weight = np.log((right + 0.01) / (1.01 - right)).clip(0.01)
        self.weight = weight / weight.sum()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best language, gap to the second) of each row; the gap is 0 for rows without letters."""
        z = (x @ self.w + self.b).astype(np.float64)
        # a bit's loss is log(1 + e^-z) where it is set, z more where it is not
        loss = (np.logaddexp(0, -z) * self.weight).sum(1)[:, None] + (z * self.weight) @ (self.code < 0).T.astype(np.float64)
        best = loss.argmin(1)
        two = np.sort(loss, 1)
        gap = two[:, 1] - two[:, 0] if loss.shape[1] > 1 else np.ones(len(x))
        return best, np.where(x.any(1), gap, 0.0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` rows of each language that the column lang names, fewer if there are so many
    languages that they would be over MAX_ROWS; None if it names none. Of more than MAX_LANGUAGES names, which no set of
    languages has, it is an error."""
    label = F.col("__lx_y")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("__lx_l"), docs["lang"].cast("string").alias("__lx_y"), docs["text"].cast("string").alias("__lx_t"))
    rows = rows.where("__lx_l is not null and __lx_y is not null and __lx_y <> ''").where(F.octet_length("__lx_t").between(1, MAX_TRAIN_BYTES))
    given = rows.select("__lx_l", "__lx_y")
    names = given.select("__lx_y").distinct().limit(MAX_LANGUAGES + 1).count()
    if not names:
        return None
    if names > MAX_LANGUAGES:
        raise ValueError(f"the column lang has more than {MAX_LANGUAGES} different values")
    order = Window.partitionBy("__lx_y").orderBy(F.xxhash64("__lx_l"), "__lx_l")
    chosen = given.distinct().withColumn("__lx_n", F.row_number().over(order)).where(F.col("__lx_n") <= min(sample, max(2, MAX_ROWS // names)))
    chosen = chosen.select(F.col("__lx_l").alias("__lx_c"), label.alias("__lx_z"))
    # MAX_ROWS bounds the ids that are broadcast and the texts that the driver gets
    got = rows.join(F.broadcast(chosen), (F.col("__lx_l") == F.col("__lx_c")) & (label == F.col("__lx_z"))).groupBy("__lx_l", "__lx_y").agg(F.min("__lx_t").alias("__lx_t"))
    data = got.toPandas().sort_values(["__lx_l", "__lx_y"])
    return Model(data["__lx_t"].tolist(), data["__lx_y"].tolist())


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, language, gap, ambiguous) of every row of ``docs``.

    NULL and empty texts, texts without letters, and all texts where no row names a language, have a
    NULL language, gap 0 and are ambiguous. Long texts are read whole. A NULL doc_id stays NULL; rows that repeat
    are judged each; ties go to the language first in the alphabet; an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    shared = spark.sparkContext.broadcast(model or fit(docs))

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, None], object) if m else np.array([None], object)
        for batch in batches:
            data, offsets = c.utf8(batch.column("text"), lower=False)
            best, gap = np.zeros(len(batch), int), np.zeros(len(batch))
            if m:
                for i, j in c.chunks(offsets):
                    best[i:j], gap[i:j] = m.decode(vectors(data, offsets[i : j + 1]))
            best[gap == 0] = len(names) - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(gap), pa.array(gap < AMBIGUOUS)], ["doc_id", "language", "gap", "ambiguous"])

    return c.id_text(docs).mapInArrow(run, "doc_id bigint, language string, gap double, ambiguous boolean")
