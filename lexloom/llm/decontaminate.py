"""Benchmark decontamination by size-partitioned MinHash containment search.

MinHash sees Jaccard similarity, which is tiny between a short item and a long document. So sizes are
partitioned on both sides (after Zhu et al., "LSH Ensemble", 2016): items by the power of two that
holds their shingles, and for each such size every document, whole, into overlapping segments of two
blocks of that size. An item then lies wholly within one segment less than five times its size, and
the containment threshold bounds the Jaccard similarity from below; one-row bands of FUNCTIONS minima
find it with probability over 0.99. A candidate is verified by exact containment: the share of the
item's distinct shingles that the whole document has.

An item of fewer words than a shingle has too little to sketch: it is looked up exactly, as a run of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import _common as c

#: Production parameters: share of an item's shingles, words of a shingle, minima per segment.
THRESHOLD, SHINGLE, FUNCTIONS = 0.6, 5, 36
#: Items that one pass over the documents holds in memory; more items take more passes.
ITEMS_PER_PASS = 50_000
_SALT, _LEAST = 0xB36C, 0


def _runs(words: c.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run of k words from each word on, and its row; -1 where the row ends before."""
    n = len(words.hash)
    h, row = np.zeros(n, np.uint64), np.repeat(np.arange(len(words.at) - 1), np.diff(words.at))
    reach = max(0, n - k + 1)
    for j in range(k):
        h[:reach] = h[:reach] * np.uint64(c._MULT) + words.hash[j : j + reach]
    return h, np.where(np.arange(n) + k <= words.at[1:][row], row, -1)


class Index:
    """Minima of the items of one pass by size class, and their shingles."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, offsets = c.utf8(pa.array(texts, pa.string()))
        words = c.Words(data, offsets)
        s, at = c.shingles(words, SHINGLE)
        u, uat = c.distinct_sorted(s, at)
        length = np.diff(words.at)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, SHINGLE):
            who = np.flatnonzero(length == k)
            if len(who):
                h = _runs(words, k)[0][words.at[who]]
                order = np.argsort(h, kind="stable")
                self.short[k] = (h[order], np.array([ids[i] for i in who], np.int64)[order])
        keep = np.flatnonzero(length >= SHINGLE)
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.sets = [u[uat[i] : uat[i + 1]] for i in keep]
        level = np.array([max(_LEAST, int(np.ceil(np.log2(at[i + 1] - at[i])))) for i in keep], int)
        xor, mul = c.seeds(FUNCTIONS, _SALT)
        self.levels: dict[int, tuple] = {}
        for lv in np.unique(level):
            who = np.flatnonzero(level == lv)
            size = 1 << int(np.ceil(np.log2(len(who) * FUNCTIONS * 32)))
            table = np.zeros(size, bool)
            per = []
            for f in range(FUNCTIONS):
                low = np.array([((self.sets[i] ^ xor[f]) * mul[f]).min() for i in who], np.uint64)
                table[(low & np.uint64(size - 1)).astype(np.int64)] = True
                order = np.argsort(low, kind="stable")
                per.append((low[order], who[order]))
            self.levels[int(lv)] = (table, np.uint64(size - 1), per)

    def matches(self, words: c.Words, threshold: float):
        """(row, item id, containment) of the verified pairs."""
        out = []
        for k, (values, short_ids) in self.short.items():
            h, row = _runs(words, k)
            at = np.searchsorted(values, h)
            ok = (row >= 0) & (values[np.minimum(at, len(values) - 1)] == h)
            ends = np.searchsorted(values, h[ok], "right")
            out += sorted({(int(r), int(i), 1.0) for r, a, b in zip(row[ok], at[ok], ends) for i in short_ids[a:b]})
        s, at = c.shingles(words, SHINGLE)
        if not len(s) or not len(self.ids):
            return out
        xor, mul = c.seeds(FUNCTIONS, _SALT)
        grid = {}
        size = np.diff(at)
        for lv in self.levels:
            blocks = (size + (1 << lv) - 1) >> lv
            first = np.concatenate([[0], np.cumsum(blocks)])
            row = np.repeat(np.arange(len(size)), blocks)
            start = at[row] + ((np.arange(len(row)) - first[row]) << lv)
            paired = np.zeros(len(row), bool)
            paired[:-1] = row[1:] == row[:-1]
            grid[lv] = (row, start, np.flatnonzero(paired))
        found = set()
        for f in range(FUNCTIONS):
            v = (s ^ xor[f]) * mul[f]
            for lv, (table, mask, per) in self.levels.items():
                row, start, paired = grid[lv]
                low = np.minimum.reduceat(v, start)
                seg = low.copy()
                seg[paired] = np.minimum(low[paired], low[paired + 1])
                maybe = np.flatnonzero(table[(seg & mask).astype(np.int64)])
                if len(maybe):
                    values, who = per[f]
                    a, b = np.searchsorted(values, seg[maybe]), np.searchsorted(values, seg[maybe], "right")
                    for g in np.flatnonzero(b > a):
                        r = int(row[maybe[g]])
                        found.update((r, int(i)) for i in who[a[g] : b[g]])
        sets: dict[int, np.ndarray] = {}
        for r, i in sorted(found):
            if r not in sets:
                sets = {r: np.unique(s[at[r] : at[r + 1]])}
            share = np.isin(self.sets[i], sets[r], assume_unique=True).mean()
            if share >= threshold:
                out.append((r, int(self.ids[i]), float(share)))
        return out


def _indexes(spark: SparkSession, benchmark: DataFrame, per_pass: int):
    """A broadcast index for each pass; every item is in one of them."""
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    passes = max(1, -(-items.count() // per_pass))
    for p in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).orderBy("item_id", "text").collect()
        if rows:
            yield spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows]))


def _pair_batches(index, threshold):
    def run(batches):
        for batch in batches:
            data, offsets = c.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            doc, item, share = [], [], []
            for i, j in c.chunks(offsets):
                for r, k, s in index.value.matches(c.Words(data, offsets[i : j + 1]), threshold):
                    doc.append(int(ids[i + r]))
                    item.append(k)
                    share.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "containment"])

    return run


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(doc_id, item_id, containment) of every document that holds an item.

    Items and documents with NULL id or NULL or wordless text match nothing; long texts are searched whole; an item
    of fewer words than a shingle is in a document (with containment 1) if its words follow each other there; equal
    items are each found; rows that repeat an id are one document or item, with the largest containment of
    any of its texts; with no items or no documents there are no rows; other columns are ignored.
    """
    out = None
    for index in _indexes(spark, benchmark, per_pass):
        part = c.id_text(docs).where("doc_id is not null").mapInArrow(_pair_batches(index, threshold), "doc_id bigint, item_id bigint, containment double")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, containment double")
    return out.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of ``docs``, unchanged and with every column whatever its name, that hold no item as :func:`contaminated` has it.

    Judged row by row, so a NULL doc_id is no escape and rows that repeat share their fate; NULL, empty and wordless
    texts stay; long texts are searched whole; items with a NULL id or text count for nothing; without
    items all rows stay; an empty table gives no rows.
    """

    def keep(index):
        def judge(texts):
            data, offsets = c.utf8(texts)
            ok = np.ones(len(texts), bool)
            for i, j in c.chunks(offsets):
                for r, _, _ in index.value.matches(c.Words(data, offsets[i : j + 1]), threshold):
                    ok[i + r] = False
            return ok

        return judge

    for index in _indexes(spark, benchmark, per_pass):
        docs = c.keep_rows(docs, keep(index))
    return docs
