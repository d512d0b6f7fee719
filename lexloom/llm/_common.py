"""Shared pieces of the training-data operators.

Numpy kernels that turn an Arrow string column into word and shingle hashes without creating a
Python object per word, and what the operators do with rows and ids. Lineage is cut by :mod:`lexloom.sources.scratch`.

Words are maximal runs of ASCII letters, ASCII digits and non-ASCII characters of
the lower-cased UTF-8 text; everything else separates, and so do non-ASCII spaces and
punctuation. In scripts that put no spaces between words (Chinese, Japanese, Thai, Lao, Khmer,
Burmese and the like) each character, with the combining marks after it, is a word of its own.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources import tables
from lexloom.sources.scratch import discard, materialize  # noqa: F401

#: Rows of ids (8 bytes each) up to which a set of ids is broadcast; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
#: Bytes of text that one pass of the numpy kernels takes (a longer document is a pass of its own).
CHUNK_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tables.read(spark, sf_dir, table)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text), whatever else the table has; a NULL text is an empty one."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def keep_rows(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` for which ``keep(texts)``, a boolean array for an Arrow column of texts, holds. Columns go
    by position, so that any names will do."""
    at = docs.columns.index(text_col)
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at))))

    return flat.mapInArrow(run, flat.schema).toDF(*docs.columns)


def by_ids(docs: DataFrame, ids: DataFrame, how: str, n_ids: int | None = None, key: str = "doc_id") -> DataFrame:
    """Semi- or anti-join of ``docs`` on a table of distinct ids. The ids are broadcast only when
    they are counted to be few; beyond that Spark shuffles both sides."""
    ids = ids.select(F.col(ids.columns[0]).alias("__lx_id"))
    n = ids.count() if n_ids is None else n_ids
    right = F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("shuffle_merge")
    return docs.join(right, docs[key] == F.col("__lx_id"), how)


# ---------------------------------------------------------------- kernels

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[ord("0") : ord("9") + 1] = True
_WORD[128:] = True
#: Ranges of characters that are words of their own.
_ALONE = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
_JOINED, _SEPARATES, _OWN, _MARK = range(4)
_KINDS: list[np.ndarray] = []
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for name, base in (("up", _MULT), ("down", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; bijective."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (i, j) of rows whose bytes fit one pass."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _kinds() -> np.ndarray:
    """For each code point, whether it is joined to its neighbours, separates, is a word of its own, or is a mark of such a one."""
    if not _KINDS:
        kind = np.full(0x110000, _JOINED, np.uint8)
        for a, b in _ALONE:
            kind[a : b + 1] = _OWN
        for x in range(0x80, 0x20000):
            category = unicodedata.category(chr(x))
            if category[0] in "PZ" or x == 0x85:
                kind[x] = _SEPARATES
            elif category[0] == "M" and kind[x] == _OWN:
                kind[x] = _MARK
        _KINDS.append(kind)
    return _KINDS[0]


def _beyond_ascii(data: np.ndarray, inside: np.ndarray, begins: np.ndarray) -> None:
    """Take separators out of ``inside`` and set ``begins`` around characters that are words of their own."""
    # two-byte characters that matter are those of U+0080-00BF; no script of own words lies below U+0800
    lead = np.flatnonzero((data >= 0xE0) | (data == 0xC2))
    if not len(lead):
        return
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    first = pad[lead].astype(np.int64)
    size = np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2))
    low = [(pad[lead + i] & 0x3F).astype(np.int64) for i in (1, 2, 3)]
    point = np.where(size == 2, (first & 0x1F) << 6 | low[0], np.where(size == 3, (first & 0x0F) << 12 | low[0] << 6 | low[1], (first & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2]))
    kind = _kinds()[np.minimum(point, 0x10FFFF)]
    n = len(data)
    off = kind == _SEPARATES
    for i in range(4):
        at = lead[off & (size > i)] + i
        inside[at[at < n]] = False
    own, mark = kind == _OWN, kind == _MARK
    alone = own | mark
    begins[lead[own]] = True
    end = np.minimum((lead + size)[alone], n)
    begins[end] = True
    begins[np.intersect1d(lead[mark], end)] = False  # a mark stays with what it follows


class Words:
    """Word hashes of rows i..j: ``hash``, byte ``start`` and ``end`` within ``data``, and ``at``,
    the n + 1 offsets of rows into them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0]) if len(offsets) else 0
        self.data = data[base : int(offsets[-1])]
        self.offsets = offsets - base
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = _WORD[self.data]
        begins = np.zeros(n + 1, bool)
        _beyond_ascii(self.data, inside[1:-1], begins)
        begins[self.offsets] = True
        here, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(here & (~before | begins))
        self.end = np.flatnonzero(before & (~here | begins))
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.at = np.searchsorted(self.start, self.offsets)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words, never across rows, and their n + 1 row offsets. A row of
    1 to k - 1 words has one shingle, of all its words; a row without words has none."""
    w, at = words.hash, words.at
    counts = np.diff(at)
    n = len(w)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    full = np.zeros(n, np.uint64)
    reach = max(0, n - k + 1)
    for j in range(k):
        full[:reach] = full[:reach] * np.uint64(_MULT) + w[j : j + reach]
    row = np.repeat(np.arange(len(counts)), counts)
    ok = np.arange(n) + k <= at[1:][row]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        s = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in w[at[r] : at[r + 1]]:
                s = s * np.uint64(_MULT) + x
        full[at[r]] = s + np.uint64(counts[r])
        ok[at[r]] = True
    size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return mix(full[ok]), np.concatenate([[0], np.cumsum(size)])


def distinct_sorted(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the distinct values in ascending order, and the new offsets."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.searchsorted(r[keep], np.arange(len(at)))


def seeds(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of (xor, odd multiplier), the same in every process."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(_MULT) + np.uint64(salt))
    return x[:n], x[n:] | np.uint64(1)


def reduce_rows(ufunc: np.ufunc, values: np.ndarray, at: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over the values of each row; ``empty`` for rows without values."""
    out = np.full((len(at) - 1,) + values.shape[1:], empty, values.dtype)
    has = np.flatnonzero(np.diff(at) > 0)
    if len(has):
        out[has] = ufunc.reduceat(values, at[:-1][has], axis=0)
    return out


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column out of flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
