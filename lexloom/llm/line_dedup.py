"""Line dedup by pairwise alignment.

A "line" is a maximal run of words with no newline or sentence ender between them, cut also after
content-defined words, so that a passage keeps its lines when it is re-flowed or set into the
middle of other text.

1. Every block of MIN_BLOCK words names the first document (smallest doc_id) that holds it; a document
   and a first holder of any of its blocks are an overlapping pair. So a block that a million
   documents share makes a million pairs and not a million squared, and each block that is deleted
   anywhere stays in its first holder. Only blocks that can be shared are shuffled: each block has a
   mark, the least hash of its windows of half the words (winnowing, Schleimer et al. 2003), equal
   blocks have equal marks, and blocks whose mark only one document has are left out.
2. The two documents are aligned by patience diff: lines that are unique in both are anchors, their
   longest increasing chain is kept, each anchor grows to a block of equal words; this is
   repeated for what is not yet covered, so that moved blocks are found too. Equal blocks that no
   anchor lies in (few line ends, repeated lines) are found by their hashes.
3. Aligned common blocks of enough words are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import _common as c

#: Production parameter: words of a block that is deleted.
MIN_BLOCK = 40
#: To find marks that many documents have: one in so many documents is looked at, so many of these have it at least, so many
#: marks are kept at most. Groups of the documents with a hot block.
HOT_SAMPLE, HOT_LEAST, HOT_MOST, SALTS = 128, 64, 200_000, 64
_CUT = np.uint64(15)
_BREAK = np.zeros(256, bool)
for _ch in b"\n\r.!?":
    _BREAK[_ch] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[ord("A") : ord("Z") + 1] += 32


class Lower(c.Words):
    """Words of the text with its ASCII letters in lower case, which moves no byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(_ASCII_LOWER[data[int(offsets[0]) : int(offsets[-1])]], offsets - offsets[0])


class Lines(Lower):
    """Words plus ``first``, the index of each line's first word, and ``line``, its hash; ``line_at``: row offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets)
        n = len(self.hash)
        ends = np.concatenate([[0], np.cumsum(_BREAK[self.data])])
        begins = np.zeros(n + 1, bool)
        begins[self.at] = True
        if n:
            begins[1:n] |= (ends[self.start[1:]] > ends[self.end[:-1]]) | ((self.hash[:-1] & _CUT) == 0)
        self.first = np.flatnonzero(begins[:n])
        stop = np.append(self.first[1:], n)
        up, down = c._powers(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * up[:n])])
        self.size = stop - self.first
        self.line = c.mix((total[stop] - total[self.first]) * down[self.first] + self.size.astype(np.uint64))
        self.line_at = np.searchsorted(self.first, self.at)


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every window of k words, across rows too."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = c._powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n])])
    return c.mix((total[k:] - total[:-k]) * down[: n - k + 1])


def _marks(hashes: np.ndarray, block: int) -> np.ndarray:
    """The mark of every window of ``block`` words: the least hash of its windows of half as many."""
    half = max(1, block // 2)
    low, size, span = _grams(hashes, half), 1, block - half + 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = span - size
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def _block_rows(x: c.Words, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of ``block`` words that lie within a row, and their rows."""
    n = max(0, len(x.hash) - block + 1)
    row = np.repeat(np.arange(len(x.at) - 1), np.diff(x.at))[:n]
    at = np.flatnonzero(np.arange(n) + block <= x.at[1:][row])
    return at, row[at]


def _distinct(h: np.ndarray, doc: np.ndarray, hot: np.ndarray, name: str) -> pa.RecordBatch:
    order = np.lexsort((doc, h))
    h, doc, hot = h[order], doc[order], hot[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(doc[new], pa.int64()), pa.array(hot[new])], [name, "doc_id", "hot"])


def _mark_batches(block: int, hot=None):
    def run(batches):
        often = hot.value if hot else np.zeros(0, np.uint64)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = c.utf8(batch.column("text"), lower=False)
            for i, j in c.chunks(offsets):
                x = Lower(data, offsets[i : j + 1])
                at, row = _block_rows(x, block)
                if len(at):
                    h = _marks(x.hash, block)[at]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    yield _distinct(h[new], ids[i:j][row[new]], np.isin(h[new], often), "mark")

    return run


def _shared_windows(x: c.Words, marks: pa.Array, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, rows and marks of the windows whose mark is among the marks that their own row shares."""
    at, row = _block_rows(x, block)
    if not len(at):
        return at, row, np.zeros(0, np.uint64)
    salt = c.mix(np.arange(1, len(marks) + 1, dtype=np.uint64))  # a mark counts for its own document
    theirs = np.repeat(salt, pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
    own = _marks(x.hash, block)[at]
    ok = np.isin(own ^ salt[row], marks.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ theirs)
    return at[ok], row[ok], own[ok]


def _block_batches(block: int, hot):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = c.utf8(batch.column("text"), lower=False)
            for i, j in c.chunks(offsets):
                x = Lower(data, offsets[i : j + 1])
                at, row, own = _shared_windows(x, batch.column("marks").slice(i, j - i), block)
                if len(at):
                    yield _distinct(_grams(x.hash, block)[at], ids[i:j][row], np.isin(own, hot.value), "block")

    return run


def _hot_marks(spark: SparkSession, docs: DataFrame, block: int):
    """Marks that some ten-thousandth of all documents or more have, as one in HOT_SAMPLE of the documents shows: a sorted
    array, whose size the documents' mean length bounds, for all tasks. It decides where rows go and never what is found."""
    some = c.id_text(docs).where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)
    n = some.count()
    found = some.mapInArrow(_mark_batches(block), "mark bigint, doc_id bigint, hot boolean").groupBy("mark").count().where(F.col("count") >= max(HOT_LEAST, n // 10_000))
    marks = np.array([r[0] for r in found.orderBy(F.desc("count"), "mark").limit(HOT_MOST).select("mark").collect()], np.int64)
    return spark.sparkContext.broadcast(np.sort(marks.view(np.uint64)))


def _shared_marks(spark: SparkSession, docs: DataFrame, block: int, hot) -> DataFrame:
    """(doc_id, marks): the marks of each document that another one has too."""
    marks = c.id_text(docs).where("doc_id is not null").mapInArrow(_mark_batches(block, hot), "mark bigint, doc_id bigint, hot boolean")
    # a hot mark is known to be shared: its rows need not meet, and are spread
    one = Window.partitionBy("mark", F.when(F.col("hot"), F.col("doc_id")))
    shared = marks.select("doc_id", "mark", "hot", F.min("doc_id").over(one).alias("v"), F.max("doc_id").over(one).alias("last")).where("hot or v < last")
    return c.materialize(spark, shared.groupBy(F.col("doc_id").alias("__lx_u")).agg(F.collect_set("mark").alias("marks")))


def _with_marks(docs: DataFrame, shared: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, marks) of the documents, or of ``ids`` among them, that share any."""
    texts = c.id_text(docs).where("doc_id is not null")
    texts = texts if ids is None else c.by_ids(texts, ids, "left_semi")
    return texts.join(shared.hint("shuffle_hash"), F.col("doc_id") == F.col("__lx_u")).select("doc_id", "text", "marks")


def overlapping_pairs(spark: SparkSession, docs: DataFrame, min_block: int, shared: DataFrame, hot) -> DataFrame:
    """(u, v): a document u and an earlier one v that is the first holder of a block of ``min_block`` of its words.

    Of a hot block each of SALTS groups of documents has a first holder, and these are paired with the first of all.
    """
    blocks = _with_marks(docs, shared).mapInArrow(_block_batches(min_block, hot), "block bigint, doc_id bigint, hot boolean")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    first = blocks.withColumn("salt", salt).select("block", "hot", F.col("doc_id").alias("u"), F.min("doc_id").over(Window.partitionBy("block", "salt")).alias("v"))
    if not len(hot.value):
        return first.where("v < u").select("u", "v").distinct()
    # pairs, and of hot blocks the groups' first holders with themselves, which are few
    near = c.materialize(spark, first.where("v < u or hot").select("u", "v", F.when(F.col("u") == F.col("v"), F.col("block")).alias("block")).distinct())
    tops = near.where("u = v").select("u", F.min("u").over(Window.partitionBy("block")).alias("v")).where("v < u")
    return near.where("v < u").select("u", "v").union(tops).distinct()


#: Stands between two parts of a document.
_GAP = np.int32(-(2**31))


def _words_batches(block: int):
    """Lines, their first words, and words of each document, of its parts that can lie in a shared block only: what is sent
    to every document that shares a paragraph with a long one is the paragraph."""

    def run(batches):
        for batch in batches:
            data, offsets = c.utf8(batch.column("text"), lower=False)
            for i, j in c.chunks(offsets):
                x = Lines(data, offsets[i : j + 1])
                at, _, _ = _shared_windows(x, batch.column("marks").slice(i, j - i), block)
                n = len(x.hash)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + block, -1)
                keep = np.cumsum(edge[:n]) > 0
                begins = keep.copy()
                begins[1:] &= ~keep[:-1]
                heads = x.at[:-1][np.diff(x.at) > 0]
                begins[heads] = keep[heads]
                kept, parts = np.concatenate([[0], np.cumsum(keep)]), np.concatenate([[0], np.cumsum(begins)])
                words = np.full(kept[-1] + parts[-1], _GAP, np.int32)
                place = kept[:-1] + parts[1:]  # a gap before each part
                words[place[keep]] = _low(x.hash)[keep]
                word_at = kept[x.at] + parts[x.at]
                whole = kept[x.first + x.size] - kept[x.first] == x.size
                line_at = np.concatenate([[0], np.cumsum(whole)])[x.line_at]
                first = place[x.first[whole]] - np.repeat(word_at[:-1], np.diff(line_at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), c.lists(_low(x.line)[whole], line_at, pa.int32()), c.lists(first.astype(np.int32), line_at, pa.int32()), c.lists(words, word_at, pa.int32())],
                    ["v", "lines", "firsts", "words"],
                )

    return run


def _low(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix; looks at a few words first."""
    n = min(len(a), len(b))
    step, at = 64, 0
    while at < n:
        d = np.flatnonzero(a[at : at + step][: n - at] != b[at : at + step][: n - at])
        if len(d):
            return at + int(d[0])
        at += step
        step *= 4
    return n


def _longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience sorting)."""
    tops, piles, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
        back[i] = piles[k - 1] if k else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _cover(words, other_words, a: int, last: int, shift: int, covered, min_block: int) -> None:
    """Mark the blocks of equal words that anchors at the words ``a`` to ``last`` grow to, all ``shift`` words further on in
    the other document: what lies between the anchors is compared once."""
    low = a - _run(words[:a][::-1], other_words[: a + shift][::-1])
    high = last + _run(words[last:], other_words[last + shift :])
    if high - low < min_block:
        return
    unlike = np.flatnonzero(words[a:last] != other_words[a + shift : last + shift]) + a
    edge = np.concatenate([[low - 1], unlike, [high]])
    for k in np.flatnonzero(np.diff(edge) > min_block):
        covered[edge[k] + 1 : edge[k + 1]] = True


def align(lines, firsts, words, other_lines, other_firsts, other_words, covered, min_block: int = MIN_BLOCK) -> None:
    """Mark in ``covered`` (a flag per word) the words of blocks of ``min_block`` or more equal words."""
    if len(words) >= min_block and len(other_words) in (len(words), len(words) + 1) and (words == other_words[-len(words) :]).all():
        covered[:] = True  # a copy: one block
        return
    theirs = other_lines.tolist()
    times = Counter(theirs)
    place = dict(zip(reversed(theirs), range(len(theirs) - 1, -1, -1)))  # where each is first
    todo = [(i, h) for i, h in enumerate(lines.tolist()) if h in place]
    while todo:
        done = covered[firsts].tolist()
        todo = [(i, h) for i, h in todo if not done[i]]
        count = Counter([h for _, h in todo])
        # lines that are unique on both sides; where there are none, the first of each
        anchors = [(i, h) for i, h in todo if count[h] == 1 and times[h] == 1]
        if not anchors:
            head: dict[int, int] = {}
            for i, h in todo:
                head.setdefault(h, i)
            anchors = [(i, h) for h, i in head.items()]
        if not anchors:
            break
        chain = [anchors[k] for k in _longest_increasing([place[h] for _, h in anchors])]
        spent = {i for i, _ in chain}
        at = firsts[[i for i, _ in chain]]
        shift = other_firsts[[place[h] for _, h in chain]] - at
        ends = np.append(np.flatnonzero(shift[1:] != shift[:-1]), len(at) - 1)  # of anchors in a row with one shift
        begin = 0
        for end in ends.tolist():
            _cover(words, other_words, int(at[begin]), int(at[end]), int(shift[begin]), covered, min_block)
            begin = end + 1
        todo = [(i, h) for i, h in todo if i not in spent]
    if covered.all():
        return
    mine, theirs = (_grams(x.view(np.uint32).astype(np.uint64), min_block) for x in (words, other_words))
    if not len(mine) or not len(theirs):
        return
    theirs.sort()
    edge = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine)
    edge[hit] += 1
    edge[hit + min_block] -= 1
    covered |= np.cumsum(edge[:-1]) > 0


def _cut_batches(min_block: int):
    def run(batches):
        for batch in batches:
            text, parts = batch.column("text").cast(pa.string()), batch.column("parts")
            gone = np.zeros(len(batch), np.int64)
            paired = parts.is_valid()  # only their words are looked for
            rows = np.flatnonzero(paired.to_numpy(zero_copy_only=False))
            if len(rows):
                data, offsets = c.utf8(text.filter(paired), lower=False)
                # the flat arrays of all parts, of which each row has a stretch
                part_at, all_parts = parts.offsets.to_numpy(), parts.values
                fields = [all_parts.field(n) for n in ("lines", "firsts", "words")]
                flat = [(f.offsets.to_numpy(), f.values.to_numpy()) for f in fields]
                cut = []
                for i, j in c.chunks(offsets):
                    x = Lines(data, offsets[i : j + 1])
                    for k, r in enumerate(rows[i:j]):
                        w0, w1, l0, l1 = x.at[k], x.at[k + 1], x.line_at[k], x.line_at[k + 1]
                        covered = np.zeros(w1 - w0, bool)
                        lines, firsts, words = _low(x.line[l0:l1]), x.first[l0:l1] - w0, _low(x.hash[w0:w1])
                        for p in range(part_at[r], part_at[r + 1]):  # ordered by the earlier document's id
                            if not covered.all():
                                align(lines, firsts, words, *(v[o[p] : o[p + 1]] for o, v in flat), covered, min_block)
                        gone[r] = covered.sum()
                        raw = data[offsets[i + k] : offsets[i + k + 1]].tobytes()
                        base = x.offsets[k]
                        cut.append(_without(raw, x.start[w0:w1] - base, x.end[w0:w1] - base, covered))
                text = pc.replace_with_mask(text, paired, pa.array(cut, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), text, pa.array(gone)], ["row", "text", "removed_words"])

    return run


def _without(raw: bytes, start: np.ndarray, end: np.ndarray, covered: np.ndarray) -> str:
    """The text without the covered words and what follows each run of them up to the next word; a
    line break in what goes stays, if text precedes it. A text of which no word is left is empty."""
    if not covered.any():
        return raw.decode("utf-8")
    if covered.all():
        return ""
    edge = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        out.append(raw[at : start[a]])
        at = start[b] if b < len(start) else len(raw)
        if b"\n" in raw[end[b - 1] : at] and any(out) and at < len(raw) and not out[-1].endswith(b"\n"):
            out.append(b"\n")
    out.append(raw[at:])
    return b"".join(out).decode("utf-8").strip()


def dedup_lines(spark: SparkSession, docs: DataFrame, min_block: int = MIN_BLOCK, count: str | None = "removed_words") -> DataFrame:
    """``docs`` (every column, plus ``count``) with aligned common blocks deleted from the later document.

    ``count`` names the column that counts deleted words; one of this name that ``docs`` has is replaced, None adds no
    column. n_chars, if there, is counted anew for a changed text. A document that loses every word is
    dropped; one that was empty or NULL before stays as it was. Long texts are aligned whole. Rows with a NULL doc_id stay
    unchanged. Rows that repeat a doc_id are one document, not compared with each other. Of
    documents with equal texts the smallest doc_id keeps it. An empty table gives no rows; other columns, whatever
    their names, stay.
    """
    hot = _hot_marks(spark, docs, min_block)
    shared = _shared_marks(spark, docs, min_block, hot)
    pairs = c.materialize(spark, overlapping_pairs(spark, docs, min_block, shared, hot))
    firsts = c.materialize(spark, pairs.select("v").distinct())
    words = _with_marks(docs, shared, firsts).mapInArrow(_words_batches(min_block), "v bigint, lines array<int>, firsts array<int>, words array<int>").dropDuplicates(["v"])
    parts = pairs.join(words, "v").groupBy(F.col("u").alias("__lx_u")).agg(F.sort_array(F.collect_list(F.struct("v", "lines", "firsts", "words"))).alias("parts"))
    # columns go by position, so that any names will do
    names = docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    whole = flat.select(F.struct(*(x for x in flat.columns if x != f"c{names.index('text')}")).alias("row"), doc_id.cast("bigint").alias("__lx_id"), text.cast("string").alias("text"))
    joined = whole.join(parts.hint("shuffle_hash"), F.col("__lx_id") == F.col("__lx_u"), "left").select("row", "text", "parts")
    kind = next(f for f in joined.schema.fields if f.name == "row").dataType
    out = joined.mapInArrow(_cut_batches(min_block), T.StructType([T.StructField("row", kind), T.StructField("text", T.StringType()), T.StructField("removed_words", T.LongType())]))
    out = out.where("removed_words = 0 or text <> ''")
    cols = []
    for i, n in enumerate(names):
        old = F.col(f"row.c{i}") if n != "text" else F.col("text")
        if n == "n_chars":
            old = F.when(F.col("removed_words") > 0, F.length("text")).otherwise(old)
        if n != count:
            cols.append(old.cast(flat.schema[i].dataType).alias(n))
    return out.select(*cols, *([F.col("removed_words").alias(count)] if count else []))
