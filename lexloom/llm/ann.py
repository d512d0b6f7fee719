"""Approximate nearest neighbours by learned partitions (Dong, Indyk, Razenshteyn and Wagner, "Learning
Space Partitions for Nearest Neighbor Search", 2020), as a tree.

1. A node's sample of vectors gives a nearest-neighbour graph, which is cut into balanced parts: parts grow along
   edges up to a capacity, then vertices move to where most of their neighbours are, as far as there is room.
2. A softmax classifier learns, for each sampled vector, in which parts its neighbours lie; then graph and
   classifier are made to agree in turns: each vector goes to the part that its own and its neighbours'
   probabilities favour, parts kept balanced, and the classifier is trained on.
3. Every vector is stored in its most probable part. Parts that are too large are nodes of the next level. A
   query goes to the most probable parts of a node until they hold PROBE of the probability, and what it
   reaches is reranked by exact distance.

Nodes are trained in tasks of their own, from samples of bounded size; the driver holds the root's classifier only.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import _common as c

#: Production parameters: neighbours; vectors of a part, which set the number of parts; share of the probability that is probed.
K, PART_ROWS, PROBE = 10, 1024, 0.95
#: Bounds: parts of a node; vectors that a node's graph and classifier are made from; a part's least share of them.
FANOUT, SAMPLE, LEAST = 64, 8192, 16
#: Parts that a node has at least, if its sample allows.
MIN_PARTS = 8
GRAPH_K, TURNS, EPOCHS, SLACK = 10, 8, 10, 1.1
#: Vectors that one task routes; stored vectors, and queries, that one task reranks against each other.
ROUTE_ROWS, TASK_ROWS, TASK_QUERIES = 50_000, 20_000, 20_000


def neighbours(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Indices of the k nearest other rows, brute force, in blocks."""
    n = len(x)
    k = min(k, n - 1)
    sq = (x * x).sum(1)
    out = np.zeros((n, k), np.int64)
    for i in range(0, n, block):
        d = sq[None, :] - 2 * (x[i : i + block] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + block] = np.argpartition(d, k - 1, 1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, parts: int, sweeps: int = 8) -> np.ndarray:
    """A part of each vertex, none larger than SLACK times the average."""
    n = len(graph)
    room = int(np.ceil(n / parts))
    back: list[list[int]] = [list(r) for r in graph]
    for i, r in enumerate(graph):
        for j in r:
            back[j].append(i)
    part = np.full(n, -1)
    rest = iter(range(n))
    for p in range(parts):
        gain: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        size = 0
        while size < room:
            v = -1
            while heap:
                g, u = heapq.heappop(heap)
                if part[u] < 0 and gain[u] == -g:
                    v = u
                    break
            if v < 0:
                v = next((u for u in rest if part[u] < 0), -1)
                if v < 0:
                    break
            part[v] = p
            size += 1
            for u in back[v]:
                if part[u] < 0:
                    gain[u] = gain.get(u, 0) + 1
                    heapq.heappush(heap, (-gain[u], u))
    part[part < 0] = parts - 1
    count = np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for v in range(n):
            votes = np.bincount(part[back[v]], minlength=parts)
            votes = np.where(count + 1 <= room * SLACK, votes, -1)
            to = int(votes.argmax())
            if to != part[v] and votes[to] > np.sum(part[back[v]] == part[v]):
                count[part[v]] -= 1
                count[to] += 1
                part[v] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """The classifier of a node: probabilities of its parts for vectors."""

    def __init__(self, x: np.ndarray, parts: int, seed: int = 2):
        self.parts = parts
        self.mean = x.mean(0)
        self.scale = float(np.sqrt(((x - self.mean) ** 2).mean())) or 1.0
        graph = neighbours(x, GRAPH_K)
        part = balanced_parts(graph, parts)
        z = self._scaled(x)
        n, dim = z.shape
        self.w, self.b = np.zeros((dim, parts), np.float32), np.zeros(parts, np.float32)
        rng = np.random.default_rng(seed)
        rows = np.repeat(np.arange(n), graph.shape[1] + 1)
        for turn in range(TURNS):
            y = np.bincount(rows * parts + np.concatenate([part[graph], part[:, None]], 1).ravel(), minlength=n * parts).reshape(n, parts).astype(np.float32) / (graph.shape[1] + 1)
            aw, ab = np.full(self.w.shape, 1e-3, np.float32), np.full(parts, 1e-3, np.float32)
            for _ in range(EPOCHS):
                order = rng.permutation(n)
                for i in range(0, n, 128):
                    pick = order[i : i + 128]
                    g = (self._softmax(z[pick]) - y[pick]) / len(pick)
                    gw, gb = z[pick].T @ g, g.sum(0)
                    aw += gw * gw
                    ab += gb * gb
                    self.w -= 0.05 * gw / np.sqrt(aw)
                    self.b -= 0.05 * gb / np.sqrt(ab)
            if turn < TURNS - 1:
                p = self._softmax(z)
                p = (p + p[graph].mean(1)) / 2
                price = np.ones(parts, np.float32)
                for _ in range(30):  # dearer parts shrink until all are of about one size
                    part = (p * price).argmax(1)
                    price *= (n / parts / np.maximum(np.bincount(part, minlength=parts), 1)) ** 0.3

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(np.float32)

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        s = z @ self.w + self.b
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(self._scaled(x))

    def pack(self) -> bytes:
        return np.concatenate([[self.parts, self.scale], self.mean, self.b, self.w.ravel()]).astype(np.float32).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, dim: int) -> Router:
        a, r = np.frombuffer(raw, np.float32), cls.__new__(cls)
        r.parts, r.scale = int(a[0]), float(a[1])
        r.mean, r.b = a[2 : 2 + dim], a[2 + dim : 2 + dim + r.parts]
        r.w = a[2 + dim + r.parts :].reshape(dim, r.parts)
        return r


def node_parts(rows: int, sampled: int, levels: int, part_rows: int = PART_ROWS, fanout: int = FANOUT) -> int:
    """Parts of a node of ``rows`` vectors with ``levels`` levels to go, this one included; 1 if it is not cut."""
    want = math.ceil((rows / part_rows) ** (1 / levels))
    return max(1, min(fanout, max(want, MIN_PARTS), sampled // LEAST))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dim`` finite numbers as float32, and which rows they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten() if not column.null_count else column.filter(column.is_valid()).flatten()
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (size == dim)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32)  # a NULL entry becomes NaN
    live = np.where(column.is_valid().to_numpy(zero_copy_only=False), size, 0)
    start = np.concatenate([[0], np.cumsum(live)])[:-1][ok]
    x = values[start[:, None] + np.arange(dim)] if len(start) else np.zeros((0, dim), np.float32)
    good = np.isfinite(x).all(1)
    ok[np.flatnonzero(ok)[~good]] = False
    return x[good], ok


def _vectors(embeddings: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(vec_id, v): packed vectors of the usable rows, one of each id."""

    def pack(batches):
        for batch in batches:
            x, ok = _matrix(batch.column("v"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(ok)), pa.array([r.tobytes() for r in x + np.float32(0)], pa.binary())], ["vec_id", "v"])

    rows = embeddings.select(embeddings[id_col].cast("bigint").alias("vec_id"), embeddings[vec_col].cast("array<float>").alias("v")).where("vec_id is not null and v is not null")
    return rows.mapInArrow(pack, "vec_id bigint, v binary").groupBy("vec_id").agg(F.min("v").alias("v"))


def _unpack(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, dim)


def _children(router: Router | None, x: np.ndarray, share: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, child, probability): the most probable child of each row, or with ``share`` as many as hold it."""
    if router is None:
        return np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x))
    p = router.probabilities(x)
    if share is None:
        best = p.argmax(1)
        return np.arange(len(x)), best, p[np.arange(len(x)), best].astype(float)
    order = np.argsort(-p, 1, kind="stable")
    mass = np.cumsum(np.take_along_axis(p, order, 1), 1)
    n = np.minimum((mass < share).sum(1) + 1, p.shape[1])
    row = np.repeat(np.arange(len(x)), n)
    child = order[np.arange(p.shape[1])[None, :] < n[:, None]]
    return row, child, p[row, child].astype(float)


def _descend(spark: SparkSession, rows: DataFrame, routers: DataFrame, sizes: DataFrame | None, level: int, dim: int, share: float | None, fanout: int) -> DataFrame:
    """Rows (path, id, v) one level further down. The root's classifier is broadcast; of the others each meets only its
    own node's rows, a large node's in several tasks."""
    schema = "path bigint, id bigint, v binary"
    if level == 0:
        raw = routers.select("router").first()
        root = spark.sparkContext.broadcast(raw[0] if raw else None)

        def whole(batches):
            router = Router.unpack(root.value, dim) if root.value else None
            for batch in batches:
                row, child, _ = _children(router, _unpack(batch.column("v").to_pylist(), dim), share)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), batch.column("id").take(take), batch.column("v").take(take)], ["path", "id", "v"])

        return rows.select("path", "id", "v").mapInArrow(whole, schema)

    def step(key, data, own):
        if not len(data):
            return pd.DataFrame({"path": [], "id": [], "v": []})
        router = Router.unpack(own["router"].iloc[0], dim) if len(own) else None
        row, child, _ = _children(router, _unpack(data["v"], dim), share)
        return pd.DataFrame({"path": key[0] * fanout + child, "id": data["id"].to_numpy()[row], "v": data["v"].to_numpy()[row]})

    tasks = sizes.select("path", F.ceil(F.col("n") / ROUTE_ROWS).cast("int").alias("tasks"))
    data = rows.join(tasks, "path").select("path", F.pmod(F.xxhash64("id"), "tasks").cast("int").alias("task"), "id", "v")
    own = routers.join(tasks, "path").select(F.col("path").alias("r_path"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("r_task"), "router")
    return data.groupBy("path", "task").cogroup(own.groupBy("r_path", "r_task")).applyInPandas(step, schema)


def nearest(
    spark: SparkSession, embeddings: DataFrame, queries: DataFrame | None = None, k: int = K, part_rows: int = PART_ROWS, probe: float = PROBE,
    sample: int = SAMPLE, fanout: int = FANOUT, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(vec_id, neighbours, distances): for every vector of ``queries`` (all of ``embeddings`` if none are given), the
    ids and Euclidean distances of the k nearest of ``embeddings`` as found, but for the row of its own id; nearest first, ties by id.

    Rows with a NULL id, a NULL, NaN or infinite entry, or another dimension than the most frequent one
    (the smaller if tied) are left out, as queries too. Rows that repeat an id are one vector (the least in bytes). Equal
    vectors under other ids are neighbours at distance 0; they are stored and searched once, with the k + 1 least of
    their ids, so that a third of all rows may be one vector. Fewer than k others: fewer neighbours. An
    empty table, or one without queries, gives no rows; vectors are read whole, however long; other columns are ignored.
    """
    schema = "vec_id bigint, neighbours array<bigint>, distances array<double>"
    sizes = embeddings.select(F.size(embeddings[vec_col]).alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes[0]
    same = Window.partitionBy("v").orderBy("vec_id")
    copies = _vectors(embeddings, id_col, vec_col, dim).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    rows = c.materialize(spark, copies.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids"))
    wanted = c.materialize(spark, _vectors(embeddings if queries is None else queries, id_col, vec_col, dim))
    n = rows.count()
    levels = max(1, math.ceil(math.log(max(1, n / part_rows)) / math.log(fanout)))
    stored = rows.select(F.lit(0).cast("bigint").alias("path"), "id", "v")
    asked = wanted.groupBy("v").agg(F.min("vec_id").alias("id")).select(F.lit(0).cast("bigint").alias("path"), "id", "v")
    share = probe ** (1 / levels)

    def train(left: int):
        def run(key, pdf):
            pdf = pdf.sort_values(["h", "id"]).head(sample)
            parts = node_parts(int(pdf["n"].iloc[0]), len(pdf), left, part_rows, fanout)
            packed = [] if parts == 1 else [Router(_unpack(pdf["v"], dim), parts).pack()]
            return pd.DataFrame({"path": [key[0]] * len(packed), "router": packed})

        return run

    for level in range(levels):
        nodes = c.materialize(spark, stored.groupBy("path").agg(F.count("*").alias("n"))) if level else None
        # by a hash of the id, a few more than the sample of each node; the rest never leaves its task
        unit = F.shiftrightunsigned(F.xxhash64("id", F.lit(level)), 11) / float(1 << 53)
        counted = stored.join(nodes, "path") if level else stored.withColumn("n", F.lit(n))
        drawn = counted.withColumn("h", unit).where(F.col("h") * F.col("n") <= sample + 6 * math.sqrt(sample))
        routers = c.materialize(spark, drawn.groupBy("path").applyInPandas(train(levels - level), "path bigint, router binary"))
        stored = c.materialize(spark, _descend(spark, stored, routers, nodes, level, dim, None, fanout))
        q_nodes = asked.groupBy("path").agg(F.count("*").alias("n")) if level else None
        asked = c.materialize(spark, _descend(spark, asked, routers, q_nodes, level, dim, share, fanout))

    # a part with many vectors or many queries is reranked by several tasks
    cells = stored.groupBy("path").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("a")).join(asked.groupBy("path").agg(F.ceil(F.count("*") / TASK_QUERIES).cast("int").alias("b")), "path")
    cells = c.materialize(spark, cells)
    spread = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    mine = lambda x: F.pmod(F.xxhash64("id"), x).cast("int")
    data = stored.join(rows.select("id", "ids"), "id").join(cells, "path").select("path", mine("a").alias("x"), spread("b").alias("y"), "id", "v", "ids")
    ask = asked.join(cells, "path").select(F.col("path").alias("q_path"), spread("a").alias("q_x"), mine("b").alias("q_y"), F.col("id").alias("q_id"), F.col("v").alias("q_v"))

    def rerank(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(ask):
            return pd.DataFrame({"q_id": [], "found": []})
        data = data.sort_values("id")
        x, ids = _unpack(data["v"], dim).astype(np.float64), data["ids"].tolist()
        q, qids = _unpack(ask["q_v"], dim).astype(np.float64), ask["q_id"].to_numpy()
        mean = x.mean(0)
        x, q = x - mean, q - mean
        sq, out = (x * x).sum(1), []
        m = min(k + 1, len(x))
        for i in range(0, len(q), 256):
            b = q[i : i + 256]
            d = np.maximum(sq[None, :] - 2 * (b @ x.T) + (b * b).sum(1)[:, None], 0)
            edge = np.partition(d, m - 1, 1)[:, m - 1]
            for r in range(len(b)):
                near = np.flatnonzero(d[r] <= edge[r] * (1 + 1e-12))
                e = np.sqrt(((x[near] - b[r]) ** 2).sum(1))  # exact distances of the few, so that equal vectors are at 0
                all_ids = sorted((float(e[o]), int(v)) for o in range(len(near)) for v in ids[near[o]])[: k + 1]
                out.append([{"distance": e, "id": v} for e, v in all_ids])
        return pd.DataFrame({"q_id": qids, "found": out})

    found = data.groupBy("path", "x", "y").cogroup(ask.groupBy("q_path", "q_x", "q_y")).applyInPandas(rerank, "q_id bigint, found array<struct<distance: double, id: bigint>>")
    merged = found.groupBy("q_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("f"))
    first = wanted.groupBy("v").agg(F.min("vec_id").alias("q_id"))
    every = wanted.join(first, "v").select("vec_id", "q_id").join(merged, "q_id")
    f = F.slice(F.filter("f", lambda x: x["id"] != F.col("vec_id")), 1, k)
    return every.select("vec_id", f.alias("f")).select("vec_id", F.transform("f", lambda x: x["id"]).alias("neighbours"), F.transform("f", lambda x: x["distance"]).alias("distances"))
