"""Near-duplicate groups by SetSketch registers.

Each document becomes the set of its word 3-grams. A register holds the smallest of exponentially
distributed hashes of the set, on an exponential scale and truncated (Ertl, "SetSketch: Filling
the Gap between MinHash and HyperLogLog", 2021): K = clip(floor(1 - log_b(min h)), 0, q + 1).
Registers of two sets merge by maximum and agree more often the more the sets overlap.

1. Documents with the same shingle set collapse by a 128-bit set hash.
2. Bands of registers are bucketed. No bucket is capped, and none sends all its pairs on: within it the
   maximum spanning forest by equal registers is kept, and pairs that step 3 keeps between its trees. A
   bucket too large for one task is never gathered: see ``_hot_buckets``.
3. The Jaccard similarity of each edge is estimated jointly from all registers and both set sizes by
   maximum likelihood; edges clearly below the threshold are dropped.
4. The others are verified on the whole shingle sets; verified edges are joined into groups.
5. Where an edge of a tree fails, all pairs of the tree's documents that verified edges do not join yet
   are verified too, so that a near-duplicate is not lost to a closer-looking document that is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import _common as c
from lexloom.llm.graph import components

#: Production parameters: similarity from which two documents are near-duplicates, words of a shingle.
THRESHOLD, SHINGLE = 0.55, 3
#: Bands times rows = registers.
BANDS, ROWS = 40, 3
#: Base, rate and truncation of the registers.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: A pair whose estimate is so far below the threshold is not verified; 3 standard errors of 120 registers.
SLACK = 0.14
#: Documents of a bucket that one task compares.
BLOCK = 4096
#: Documents, with their shingle sets, of a block of a tree that is verified pair by pair; of a side of a rectangle.
SET_BLOCK, RECTANGLE = 256, 1024
_SALT = 0x5E75


def registers(hashes: np.ndarray, at: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """The m registers (uint16) of each row's set of hashes; 0 for an empty set."""
    xor, mul = c.seeds(m, _SALT)
    out = np.empty((len(at) - 1, m), np.uint16)
    for i in range(m):
        top = c.reduce_rows(np.maximum, (hashes ^ xor[i]) * mul[i], at, np.uint64(0))
        out[:, i] = _register(top)
    return out


def _register(top: np.ndarray) -> np.ndarray:
    u = (top.astype(np.float64) + 0.5) / 2.0**64
    least = np.maximum(-np.log(u), 1e-18) / RATE  # the smallest of Exp(RATE) variables
    k = np.floor(1 - np.log(least) / np.log(BASE)) + _OFFSET
    return np.where(top == 0, 0, np.clip(k, 0, TOP + 1)).astype(np.uint16)


#: Shifts the scale so that sets from 1 to 1e18 elements stay within the truncation.
_OFFSET = 8000


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float = BASE) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows with set sizes na, nb, by
    golden-section search of the concave log-likelihood of (greater, equal, smaller) counts."""
    if not len(a):
        return np.zeros(0)
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    u, v = na / (na + nb), nb / (na + nb)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    def likelihood(j):
        p1, p2 = p(u - v * j), p(v - u * j)
        return more * np.log(p1 + 1e-12) + less * np.log(p2 + 1e-12) + same * np.log(np.maximum(1 - p1 - p2, 0) + 1e-12)

    lo, hi = np.zeros(len(a)), np.minimum(na, nb) / np.maximum(na, nb)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(24):
        x1, x2 = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(x1) > likelihood(x2)
        lo, hi = np.where(left, lo, x1), np.where(left, x2, hi)
    return (lo + hi) / 2


def _sketch_batches(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        data, offsets = c.utf8(batch.column("text"))
        for i, j in c.chunks(offsets):
            hashes, at = c.distinct_sorted(*c.shingles(c.Words(data, offsets[i : j + 1]), SHINGLE))
            n = np.diff(at)
            k = registers(hashes, at)
            s1 = c.reduce_rows(np.add, c.mix(hashes), at, np.uint64(0))
            s2 = c.reduce_rows(np.add, c.mix(hashes ^ np.uint64(0xABCDEF)), at, np.uint64(0))
            raw = pa.array([row.tobytes() for row in k], pa.binary())
            keep = pa.array(n > 0)
            out = pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), raw], ["doc_id", "n", "s1", "s2", "regs"])
            yield out.filter(keep)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, regs): size, 128-bit hash and registers of each non-empty shingle set."""
    return c.id_text(docs).where("doc_id is not null").mapInArrow(_sketch_batches, "doc_id bigint, n bigint, s1 bigint, s2 bigint, regs binary")


def _band_batches(batches):
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS).astype(np.uint64)
        keys = np.empty((len(regs), BANDS), np.uint64)
        for b in range(BANDS):
            h = np.full(len(regs), b + 1, np.uint64)
            for r in range(ROWS):
                h = c.mix(h ^ (regs[:, b * ROWS + r] + np.uint64(0x10000 * (r + 1))))
            keys[:, b] = h
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), BANDS))], ["key", "doc_id"])


def _forest(k: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum spanning forest (Prim) by the number of equal registers, of edges with at least ``least``."""
    n = len(k)
    best, via = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    out = np.zeros(n, bool)
    at, child, parent = 0, [], []
    for _ in range(n - 1):
        out[at] = True
        same = (k == k[at]).sum(1)
        closer = (same > best) & ~out
        best[closer], via[closer] = same[closer], at
        at = int(np.where(out, -2, best).argmax())
        if best[at] >= least:
            child.append(at)
            parent.append(int(via[at]))
    return np.array(child, int), np.array(parent, int)


def _trees(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each of n vertices' tree."""
    root = np.arange(n)
    for a, b in zip(x.tolist(), y.tolist()):
        a, b = root[a], root[b]
        if a != b:
            root[root == max(a, b)] = min(a, b)
    return root


def _spanning(k: np.ndarray, n: np.ndarray, least: int, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges x, y whose estimate is ``enough`` and the trees of all vertices. No pair between two trees has an
    estimate of ``enough`` (pairs of fewer than ``least`` equal registers, far below it, aside)."""
    x, y = _forest(k, least) if len(k) > 2 else (np.array([1]), np.array([0]))
    ok = estimate(k[x], k[y], n[x], n[y]) >= enough
    x, y = x[ok], y[ok]
    root = _trees(len(k), x, y)
    if len(k) > 2 and (root != root[0]).any():
        more = [(x, y)]
        for i in range(len(k) - 1):
            z = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            z = z[(k[z] == k[i]).sum(1) >= least]
            z = z[estimate(np.broadcast_to(k[i], (len(z), k.shape[1])), k[z], np.full(len(z), n[i]), n[z]) >= enough]
            more.append((z, np.full(len(z), i)))
        x, y = (np.concatenate(e) for e in zip(*more))
        root = _trees(len(k), x, y)
    return x, y, root


def _bucket_batches(threshold: float):
    least = max(1, int((threshold - 2 * SLACK) * BANDS * ROWS))

    def run(batches):
        for batch in batches:
            x, y, tree = [], [], []
            members, cell = batch.column("members"), batch.column("cell").to_numpy().view(np.uint64)
            ids, ns, regs = members.values.field("doc_id").to_numpy(), members.values.field("n").to_numpy(), members.values.field("regs")
            k = np.frombuffer(b"".join(regs.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
            at = members.offsets.to_numpy()
            for i in range(len(batch)):
                a, b = at[i], at[i + 1]
                child, parent, root = _spanning(k[a:b], ns[a:b], least, threshold - SLACK)
                x.append(child + a)
                y.append(parent + a)
                tree.append(c.mix(cell[i] ^ c.mix((root[child] + 1).astype(np.uint64))))
            if not x:
                continue
            x, y, tree = np.concatenate(x), np.concatenate(y), np.concatenate(tree)
            u, v = np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])
            yield pa.RecordBatch.from_arrays([pa.array(tree.view(np.int64)), pa.array(u), pa.array(v)], ["tree", "u", "v"])

    return run


def _rest_batches(threshold: float):
    """Edges (u, v, j) that join the groups among the members (doc_id, root, s) of each row: every pair is compared."""

    def run(batches):
        for batch in batches:
            u, v, j = [], [], []
            members = batch.column("members")
            ids, roots, sets = members.values.field("doc_id").to_numpy(), members.values.field("root").to_numpy(), members.values.field("s")
            flat, ends, at = sets.values.to_numpy(), sets.offsets.to_numpy(), members.offsets.to_numpy()
            for i in range(len(batch)):
                a, b = at[i], at[i + 1]
                off = ends[a : b + 1] - ends[a]
                values, code = np.unique(flat[ends[a] : ends[b]], return_inverse=True)
                size, root, doc = np.diff(off), roots[a:b].copy(), ids[a:b]
                for p in range(b - a - 1):
                    if (root[p + 1 :] == root[p]).all():
                        continue
                    mine = np.zeros(len(values), bool)
                    mine[code[off[p] : off[p + 1]]] = True
                    both = np.add.reduceat(mine[code].astype(np.int64), off[:-1])
                    share = both / (size + size[p] - both)
                    for q in np.flatnonzero(share[p + 1 :] >= threshold) + p + 1:
                        if root[p] != root[q]:
                            u.append(max(doc[p], doc[q]))
                            v.append(min(doc[p], doc[q]))
                            j.append(share[q])
                            root[root == root[q]] = root[p]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(j, pa.float64())], ["u", "v", "j"])

    return run


def _blocks(ids: DataFrame, block: int) -> DataFrame:
    """(b, i, j, doc_id): the members of every pair of blocks of each row (b, ids)."""
    last = F.floor((F.size("ids") - 1) / block).cast("int")
    cell = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: F.struct(i.alias("i"), j.alias("j")))))).alias("cell")
    part = lambda k: F.slice("ids", k * block + 1, F.lit(block))
    both = F.when(F.col("cell.i") == F.col("cell.j"), part(F.col("cell.i"))).otherwise(F.concat(part(F.col("cell.i")), part(F.col("cell.j"))))
    return ids.select("b", "ids", cell).select("b", "cell.i", "cell.j", F.explode(both).alias("doc_id"))


def _shingle_batches(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        data, offsets = c.utf8(batch.column("text"))
        for i, j in c.chunks(offsets):
            hashes, at = c.distinct_sorted(*c.shingles(c.Words(data, offsets[i : j + 1]), SHINGLE))
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), c.lists(hashes.view(np.int64), at, pa.int64())], ["doc_id", "s"])


def _verify_batches(threshold: float):
    def run(batches):
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            va, vb = a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64)
            oa, ob = a.offsets.to_numpy(), b.offsets.to_numpy()
            j = np.empty(len(batch))
            for i in range(len(batch)):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                j[i] = both / max(1, len(x) + len(y) - both)
            keep = pa.array(j >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(j)], ["u", "v", "j"]).filter(keep)

    return run


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, s): the shingle set of one text of each of ``ids``."""
    wanted = c.by_ids(c.id_text(docs).where("doc_id is not null"), ids, "left_semi")
    return wanted.mapInArrow(_shingle_batches, "doc_id bigint, s array<bigint>").dropDuplicates(["doc_id"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(u, v, j) of the pairs whose exact similarity is at least ``threshold``."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("s").alias("sa"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("s").alias("sb"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "sa", "sb").mapInArrow(_verify_batches(threshold), "u bigint, v bigint, j double")


def _part(n: str, size: int):
    """The part of ``size`` or so of a bucket of n that a document is in, by its hash."""
    return F.pmod(F.xxhash64("doc_id"), F.ceil(F.col(n) / size)).cast("int")


def _parts(n: str, size: int):
    return F.sequence(F.lit(0), F.ceil(F.col(n) / size).cast("int") - 1)


def _hot_buckets(spark: SparkSession, docs: DataFrame, rows: DataFrame, regs: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Edges of buckets (key, doc_id) of more than ``block`` documents: verified ones (u, v, j), and (tree, u, v) to verify.

    All members are compared with the bucket's least document. Those that are similar to it are joined; the
    others, if not over ``block``, are compared exactly with all members, in rectangles. So a bucket of true near-copies costs in
    proportion to its size. Where more than ``block`` are unlike the least document, all pairs of blocks are compared by
    registers. No bucket is ever gathered in a row or a task.
    """
    ids = F.bit_xor(F.xxhash64("doc_id"))
    # a group of copies fills the same bucket in most bands: each set of documents is treated once
    once = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), ids.alias("x")).groupBy("n", "rep", "x").agg(F.min("key").alias("key"))
    members = c.materialize(spark, rows.join(once.select("key", "n", "rep"), "key"))
    sets = c.materialize(spark, _sets(docs, members.select("doc_id").distinct()))
    star = members.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    star = c.materialize(spark, _verified(star, sets, 0.0))
    judged = members.join(star, (members["doc_id"] == star["u"]) & (members["rep"] == star["v"]), "left").select("key", "n", "rep", "doc_id", (F.coalesce("j", F.lit(1.0)) < threshold).alias("far"))
    judged = c.materialize(spark, judged)
    unlike = judged.where("far").groupBy("key").agg(F.count("*").alias("m"))
    few = judged.join(c.materialize(spark, unlike.where(F.col("m") <= block)), "key")
    mine = few.where("far").select("key", _part("m", RECTANGLE).alias("i"), F.explode(_parts("n", RECTANGLE)).alias("k"), F.lit(0).alias("side"), "doc_id", F.col("doc_id").alias("root"))
    theirs = few.select("key", F.explode(_parts("m", RECTANGLE)).alias("i"), _part("n", RECTANGLE).alias("k"), F.lit(1).alias("side"), "doc_id", F.when(F.col("far"), F.col("doc_id")).otherwise(F.col("rep")).alias("root"))
    cells = mine.union(theirs).join(sets, "doc_id").groupBy("key", "i", "k").agg(F.sort_array(F.collect_list(F.struct("side", "doc_id", "root", "s"))).alias("members"))
    near = cells.select("members").mapInArrow(_rest_batches(threshold), "u bigint, v bigint, j double")
    verified = c.materialize(spark, star.where(F.col("j") >= threshold).union(near))
    many = members.join(unlike.where(F.col("m") > block).select("key"), "key", "left_semi").withColumn("at", _part("n", block // 2))
    pair = F.explode(F.transform(_parts("n", block // 2), lambda x: F.struct(F.least("at", x).alias("i"), F.greatest("at", x).alias("k")))).alias("cell")
    grouped = many.select("key", "doc_id", pair).join(regs, "doc_id").groupBy("key", "cell").agg(F.collect_list(F.struct("doc_id", "n", "regs")).alias("members")).where("size(members) > 1")
    edges = grouped.select(F.xxhash64("key", "cell").alias("cell"), "members").mapInArrow(_bucket_batches(threshold), "tree bigint, u bigint, v bigint")
    return verified, edges


def _edges(spark: SparkSession, docs: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Documents with the shingle set of a smaller id, (u, v); verified edges (u, v, j) among those smallest ids."""
    sk = c.materialize(spark, sketches(docs))
    # one sketch per shingle set, held by its smallest id; an id that occurs in several rows counts as one document
    reps = sk.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("doc_id"))
    same = c.materialize(spark, sk.join(reps.withColumnRenamed("doc_id", "v"), ["s1", "s2", "n"]).where("doc_id <> v").select(F.col("doc_id").alias("u"), "v"))
    regs = c.materialize(spark, sk.join(reps, ["s1", "s2", "n", "doc_id"], "left_semi").dropDuplicates(["s1", "s2", "n"]).select("doc_id", "n", "regs"))
    c.discard(sk)
    rows = regs.select("doc_id", "regs").mapInArrow(_band_batches, "key bigint, doc_id bigint")
    hot = c.materialize(spark, rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > block).select("key"))
    n_hot = hot.count()
    cold = c.by_ids(rows, hot, "left_anti", n_hot, "key") if n_hot else rows
    full = cold.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1")
    buckets = full.groupBy("key").agg(F.sort_array(F.collect_set("doc_id")).alias("ids")).where("size(ids) > 1")
    # a group of copies fills the same bucket in most bands: each set of documents is compared once
    buckets = buckets.select("ids").distinct().withColumn("b", F.xxhash64("ids"))
    grouped = buckets.select("b", F.explode("ids").alias("doc_id")).join(regs, "doc_id").groupBy("b").agg(F.collect_list(F.struct("doc_id", "n", "regs")).alias("members")).where("size(members) > 1")
    edges = grouped.select(F.col("b").alias("cell"), "members").mapInArrow(_bucket_batches(threshold), "tree bigint, u bigint, v bigint")
    known = None
    if n_hot:
        known, more = _hot_buckets(spark, docs, c.materialize(spark, c.by_ids(rows, hot, "left_semi", n_hot, "key")), regs, threshold, block)
        edges = edges.union(more)
    edges = c.materialize(spark, edges)
    cand = c.materialize(spark, edges.select("u", "v").distinct())
    ids = c.materialize(spark, cand.select(F.col("u").alias("i")).union(cand.select("v")).distinct())
    sets = c.materialize(spark, _sets(docs, ids))
    verified = c.materialize(spark, _verified(cand, sets, threshold))
    # trees with an edge that failed: what verified edges do not join is compared pair by pair
    failed = cand.join(verified, ["u", "v"], "left_anti")
    open_trees = edges.join(failed, ["u", "v"], "left_semi").select("tree").distinct()
    left = edges.join(open_trees, "tree", "left_semi")
    left = left.select("tree", F.explode(F.array("u", "v")).alias("doc_id")).groupBy("tree").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    left = c.materialize(spark, left.where("size(ids) > 2").select("ids").distinct().withColumn("b", F.xxhash64("ids")))
    found = verified if known is None else verified.union(known)
    if left.isEmpty():
        return same, found
    comp = components(spark, found.select("u", "v"))
    rooted = sets.join(comp, sets["doc_id"] == comp["id"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"), "s")
    rest = _blocks(left, SET_BLOCK).join(rooted, "doc_id").groupBy("b", "i", "j").agg(F.collect_list(F.struct("doc_id", "root", "s")).alias("members"))
    rest = rest.where("size(array_distinct(members.root)) > 1").select("members").mapInArrow(_rest_batches(threshold), "u bigint, v bigint, j double")
    return same, found.union(c.materialize(spark, rest))


def near_edges(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Verified edges (u, v, j), v < u, that span the near-duplicate groups; j is the exact Jaccard
    similarity of the two shingle sets. Documents as in :func:`near_groups`."""
    same, edges = _edges(spark, docs, threshold, block)
    return same.withColumn("j", F.lit(1.0)).union(edges)


def _roots(spark: SparkSession, docs: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, root) of every document that is not the smallest of its group. Copies follow what they are a copy of; only
    documents of different shingle sets take part in the search for components."""
    same, edges = _edges(spark, docs, threshold, block)
    comp = components(spark, edges.select("u", "v"))
    copies = same.join(comp, same["v"] == comp["id"], "left").select(F.col("u").alias("id"), F.coalesce("root", "v").alias("root"))
    # the smallest id of a shingle set is smaller than its copies, so a root stays the smallest of its group
    return c.materialize(spark, comp.union(copies).groupBy("id").agg(F.min("root").alias("root")))


def near_groups(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, group_id, group_size, kept): every document of a near-duplicate group of two or more.
    group_id is the smallest doc_id of the group, which is the one kept.

    Groups are the components of verified pairs. NULL or wordless texts and NULL ids are in no
    group; long texts are read whole; rows that repeat a doc_id are one document (of which any text may be verified); equal
    texts tie for the smallest id; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    comp = _roots(spark, docs, threshold, block)
    sizes = comp.groupBy("root").agg((F.count("*") + 1).alias("group_size"))
    members = comp.select(F.col("id").alias("doc_id"), "root").union(comp.select(F.col("root").alias("doc_id"), "root").distinct())
    return members.join(sizes, "root").select("doc_id", F.col("root").alias("group_id"), "group_size", (F.col("doc_id") == F.col("root")).alias("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``docs``, with every column whatever its name, without the documents whose group, as in :func:`near_groups`, keeps another one.

    Rows of one doc_id share their fate; rows with a NULL doc_id and NULL, empty and wordless texts stay; long texts are read
    whole; of equal texts the smallest doc_id stays; an empty table gives no rows.
    """
    return c.by_ids(docs, _roots(spark, docs, threshold, block).select("id"), "left_anti")
