"""Packing documents into windows of a fixed number of tokens by best-fit decreasing.

What best-fit decreasing does depends on the lengths alone, and there are at most CAPACITY of
them. So the driver runs it on the histogram of lengths, whose size is bounded by the capacity and
not by the data: runs of equal pieces go at once where one after the other would have put them. A
segment tree over remaining capacities finds the tightest open window. The plan maps (length, rank
among pieces of that length) to windows; ranks are assigned in parallel, by length and hash bucket.

Overlong documents are first cut into full windows; what is left of them is packed with the others.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import _common as c

#: Production parameters: tokens of a window; hash buckets by which ranks are assigned in parallel.
CAPACITY, BUCKETS = 2048, 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class SegmentTree:
    """Over 0..capacity: which remaining capacities have an open window."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, i: int, value: bool) -> None:
        i += self.size
        self.any[i] = value
        while i > 1:
            i //= 2
            value = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == value:
                return
            self.any[i] = value

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that is open."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing of ``counts[length]`` pieces: runs (length, first rank, first window, pieces
    per window), in order, and the number of windows."""
    tree, open_ = SegmentTree(capacity), {r: deque() for r in range(capacity + 1)}
    runs, windows = [], 0

    def put(first: int, n: int, left: int) -> None:
        if n and left:
            open_[left].append((first, n))
            tree.set(left, True)

    for length in sorted((x for x in counts if x > 0), reverse=True):
        todo, rank = counts[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                first, n, left = windows, -(-todo // (capacity // length)), capacity
                windows += n
            else:
                first, n = open_[left].popleft()
                if not open_[left]:
                    tree.set(left, False)
            per = left // length
            used = min(n, -(-todo // per))
            put(first + used, n - used, left)
            placed = min(todo, used * per)
            full, rest = divmod(placed, per)
            put(first, full, left - per * length)
            put(first + full, 1 if rest else 0, left - rest * length)
            runs.append((length, rank, first, per))
            rank += placed
            todo -= placed
    return runs, windows


def _tokens(column: pa.Array):
    """Byte data, and for each range (i, j) of rows of a pass: first byte, starts and ends of tokens, offsets of rows into them.
    Tokens are runs of non-space characters."""
    data, offsets = c.utf8(column, lower=False)
    for i, j in c.chunks(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        solid = np.zeros(b - a + 2, bool)
        solid[1:-1] = ~_SPACE[data[a:b]]
        edge = np.zeros(b - a + 1, bool)
        edge[offsets[i : j + 1] - a] = True
        here, before = solid[1:], solid[:-1]
        start, end = np.flatnonzero(here & (~before | edge)), np.flatnonzero(before & (~here | edge))
        yield i, j, data[a:b], start, end, np.searchsorted(start, offsets[i : j + 1] - a)


def _encoding(vocabulary: bytes):
    """The encoder of a byte-pair vocabulary file."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count_batches(vocabulary):
    """(doc_id, h, n): tokens of each text."""

    def run(batches):
        enc = _encoding(vocabulary.value) if vocabulary else None
        for batch in batches:
            n = np.zeros(len(batch), np.int64)
            if enc:
                n[:] = [len(enc.encode_ordinary(t or "")) for t in batch.column("text").to_pylist()]
            else:
                for i, j, _, _, _, at in _tokens(batch.column("text")):
                    n[i:j] = np.diff(at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n)], ["doc_id", "h", "n"])

    return run


def _content_batches(vocabulary, capacity: int):
    """(doc_id, h, piece, content): the text, or the ids of tokens, of each piece."""

    def run(batches):
        enc = _encoding(vocabulary.value) if vocabulary else None
        for batch in batches:
            row, piece, content = [], [], []
            if enc:
                for r, t in enumerate(batch.column("text").to_pylist()):
                    ids = enc.encode_ordinary(t or "")
                    for k in range(0, len(ids), capacity):
                        row.append(r)
                        piece.append(k // capacity)
                        content.append(ids[k : k + capacity])
            else:
                for i, j, data, start, end, at in _tokens(batch.column("text")):
                    raw = data.tobytes()
                    for r in range(i, j):
                        first, last = at[r - i], at[r - i + 1]
                        for k in range(first, last, capacity):
                            row.append(r)
                            piece.append((k - first) // capacity)
                            content.append(raw[start[k] : end[min(k + capacity, last) - 1]].decode("utf-8"))
            take = pa.array(row, pa.int64())
            kind = pa.list_(pa.int32()) if enc else pa.string()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(piece, pa.int64()), pa.array(content, kind)], ["doc_id", "h", "piece", "content"])

    return run


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(window_id, n_tokens, n_pieces, doc_ids, pieces): every window, with the documents in it and
    the pieces [(doc_id, piece, start, length, text)], in tokens of the document, longest first.

    Tokens are runs of non-space characters, and a piece's text is what stands from its first to its last one; with a
    byte-pair vocabulary file ``tokenizer``, which the driver reads, they are its tokens, and a piece has their ids as
    ``tokens`` instead of a text. Texts without tokens and NULL texts are in no window; long texts are cut into full
    windows and a rest, nothing is lost; a NULL doc_id is packed as NULL; every row is packed, also one that repeats
    another; equal lengths go by bucket and doc_id. An empty table gives no windows; other columns,
    whatever their names, are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    vocabulary = None
    if tokenizer:
        with open(tokenizer, "rb") as f:
            vocabulary = spark.sparkContext.broadcast(f.read())
    texts = c.id_text(docs).withColumn("h", F.xxhash64("text"))
    lengths = texts.mapInArrow(_count_batches(vocabulary), "doc_id bigint, h bigint, n bigint").where("n > 0")
    piece = F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("bigint"))).alias("piece")
    start = F.col("piece") * capacity
    pieces = lengths.select("doc_id", "h", "n", piece).select("doc_id", "h", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("bigint").alias("length"))
    pieces = c.materialize(spark, pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(buckets)).cast("int")))
    hist = pieces.groupBy("length", "bucket").count().collect()  # at most capacity x buckets rows
    counts: dict[int, int] = {}
    offset: dict[tuple[int, int], int] = {}
    for r in sorted(hist):
        offset[r[0], r[1]] = counts.get(r[0], 0)
        counts[r[0]] = counts.get(r[0], 0) + r[2]
    runs, _ = plan(counts, capacity)
    # one sorted axis: pieces of each length lie one after the other in the order of the runs
    base, total = {}, 0
    for length in sorted(counts, reverse=True):
        base[length] = total
        total += counts[length]
    begin = np.array([base[x[0]] + x[1] for x in runs], np.int64)
    first, per = np.array([x[2] for x in runs], np.int64), np.array([x[3] for x in runs], np.int64)
    shift = np.zeros((capacity + 1, buckets), np.int64)
    for (length, bucket), n in offset.items():
        shift[length, bucket] = base[length] + n
    shared = spark.sparkContext.broadcast((begin, first, per, shift))

    def place(batches):
        begin, first, per, shift = shared.value
        for batch in batches:
            length, bucket, rank = (batch.column(x).to_numpy() for x in ("length", "bucket", "rank"))
            at = shift[length, bucket] + rank - 1
            run = np.searchsorted(begin, at, "right") - 1
            window = first[run] + (at - begin[run]) // per[run]
            yield pa.RecordBatch.from_arrays([pa.array(window), *(batch.column(x) for x in ("doc_id", "h", "piece", "start", "length"))], ["window_id", "doc_id", "h", "piece", "start", "length"])

    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "h", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(order).cast("bigint"))
    placed = ranked.mapInArrow(place, "window_id bigint, doc_id bigint, h bigint, piece bigint, start bigint, length bigint")
    # a piece's content is found by a hash of document and piece and one of the text; rows that repeat share it
    name, kind = ("tokens", "array<int>") if vocabulary else ("text", "string")
    content = texts.mapInArrow(_content_batches(vocabulary, capacity), f"doc_id bigint, h bigint, piece bigint, content {kind}")
    content = content.select(F.xxhash64("doc_id", "piece").alias("__k"), F.col("h").alias("__h"), "content").dropDuplicates(["__k", "__h"])
    full = placed.withColumn("k", F.xxhash64("doc_id", "piece")).join(content, (F.col("k") == F.col("__k")) & (F.col("h") == F.col("__h")))
    item = F.struct((-F.col("length")).alias("o"), "doc_id", "piece", "start", "length", F.col("content").alias(name))
    packed = full.groupBy("window_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), F.sort_array(F.collect_list(item)).alias("p"))
    inner = F.transform("p", lambda x: F.struct(*(x[f].alias(f) for f in ("doc_id", "piece", "start", "length", name))))
    return packed.select("window_id", "n_tokens", "n_pieces", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), inner.alias("pieces"))
