"""Approximate nearest neighbours by learned partitions.

On a bounded sample: each vector is joined to its nearest ones, the graph is cut
into ``parts`` balanced parts (spectral bisection, then moves of vertices to the
part of most of their neighbours as far as its capacity allows), and a small
neural network learns to tell from a vector the parts of its neighbours.  The
network then places every row in its most probable part and sends a query to the
most probable parts until their probabilities add up to a level that was set on
the sample, and until they hold enough rows.  In those parts all distances are
exact.

Equal vectors are one entry with their ``k + 1`` smallest ids; no answer needs
more of them.  Parts are searched in blocks of bounded size against queries in
blocks of bounded size.

Defined results: rows with a null id, and vectors that are null, zero, of
another length than most of the sample's or with null or non-finite components
take no part; of rows with one id the one with the smallest hash counts; if
fewer than ``k`` candidates exist, all are returned; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import pick
from tally.session import ensure_checkpoint_dir

SAMPLE = 8192
MAX_PARTS = 256
NEIGHBOURS = 10
HIDDEN, EPOCHS = 96, 40
#: Share of true neighbours in the sample that the probed parts must hold.
TARGET = 0.985
LEVELS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999)
BLOCK_ROWS, QUERY_ROWS = 16384, 8192


def _nearest(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest rows of x to each row of q, nearest first."""
    out = []
    norm = (x * x).sum(axis=1)
    for lo in range(0, len(q), 512):
        d = norm - 2 * q[lo:lo + 512] @ x.T
        near = np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), int)


def _within(x: np.ndarray, q: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of q, places of all rows of x that may be among the k nearest
    or tie with them: distances from products are rounded, so every row counts
    whose distance can, within the error bound, be as small as the k-th."""
    norm, own = (x * x).sum(axis=1), (q * q).sum(axis=1)
    d = norm - 2 * q @ x.T
    error = 4 * (x.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(norm) + np.sqrt(own)[:, None]) ** 2
    k = min(k, len(x))
    most = np.partition(d + error, k - 1, axis=1)[:, k - 1:k]
    for near in ~(d - error > most):
        yield np.flatnonzero(near)


def balanced_parts(near: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 8) -> np.ndarray:
    """Part of each vertex of a neighbour graph; ``near`` lists neighbours."""
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    ends = np.concatenate([a, b]), np.concatenate([b, a])
    rng = np.random.default_rng(7)
    part = np.zeros(n, np.int64)
    for _ in range(int(parts).bit_length() - 1):
        # all parts are bisected at once: edges between parts do not count
        inside = part[ends[0]] == part[ends[1]]
        u, v = ends[0][inside], ends[1][inside]
        degree = np.maximum(np.bincount(u, minlength=n), 1)
        x = rng.standard_normal(n)
        size = np.bincount(part)
        for _ in range(60):
            x = 0.5 * x + 0.5 * np.bincount(u, x[v], n) / degree
            x -= (np.bincount(part, x) / size)[part]
            x /= np.maximum(np.sqrt(np.bincount(part, x * x)), 1e-12)[part]
        order = np.lexsort((x, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        first = np.append(0, np.cumsum(size))[:-1]
        part = 2 * part + (rank - first[part] >= (size // 2)[part])
    order = np.argsort(ends[0], kind="stable")
    to, at = ends[1][order], np.searchsorted(ends[0][order], np.arange(n + 1))
    room = int(np.ceil(n / parts * (1 + slack)))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[to[at[i]:at[i + 1]]], minlength=parts)
            best = int(votes.argmax())
            if best != part[i] and votes[best] > votes[part[i]] and size[best] < room:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer; probabilities of parts from vectors."""

    def __init__(self, x: np.ndarray, target: np.ndarray):
        rng = np.random.default_rng(11)
        self.mean, self.scale = x.mean(axis=0), max(float(x.std()), 1e-12)
        d, p = x.shape[1], target.shape[1]
        self.w = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, p)) / np.sqrt(HIDDEN), np.zeros(p)]
        self.w = [w.astype(np.float32) for w in self.w]
        z = self._scaled(x)
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for epoch in range(EPOCHS):
            rate = 0.005 * (1 - epoch / EPOCHS) + 1e-4
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
                step += 1
                hidden = np.maximum(z[rows] @ self.w[0] + self.w[1], 0)
                error = (self._softmax(hidden @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                back = (error @ self.w[2].T) * (hidden > 0)
                for i, g in enumerate((z[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    self.w[i] -= rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(np.float32)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(self._scaled(x) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def probes(p: np.ndarray, level: float, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and part of each probe."""
    order = np.argsort(-p, axis=1, kind="stable")
    mass = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
    held = np.cumsum(sizes[order], axis=1) - sizes[order]
    query, place = np.nonzero((mass < level) | (held < least))
    return query, order[query, place]


def fit(x: np.ndarray, parts: int, k: int) -> tuple[Router, float]:
    """Network and probability level from a sample of different vectors."""
    near = _nearest(x, x, min(NEIGHBOURS, len(x) - 1) + 1)[:, 1:]
    part = balanced_parts(near, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1 / (near.shape[1] + 1))
    target[np.arange(len(x)), part] += 1 - target.sum(axis=1)
    router = Router(x, target)
    ask = np.arange(0, len(x), max(1, len(x) // 1024))
    truth = _nearest(x, x[ask], min(k + 1, len(x)))[:, 1:]
    p = router(x)
    home = p.argmax(axis=1)
    sizes = np.bincount(home, minlength=parts)
    for level in LEVELS:
        query, probed = probes(p[ask], level, sizes, 0)
        seen = np.zeros((len(ask), parts), bool)
        seen[query, probed] = True
        if seen[np.arange(len(ask))[:, None], home[truth]].mean() >= TARGET:
            return router, level
    return router, 2.0  # all parts


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)


def _search(k: int):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_d = [], [], []
        if entries.num_rows and queries.num_rows:
            x, ids = _matrix(entries["v"]), entries["ids"].to_pylist()
            q, names = _matrix(queries["v"]), queries["query_id"].to_pylist()
            head = np.array([i[0] for i in ids])
            for lo in range(0, len(q), 128):
                for row, places in enumerate(_within(x, q[lo:lo + 128], k + 1), lo):
                    exact = np.sqrt(((x[places] - q[row]) ** 2).sum(axis=1))
                    # the k + 1 first entries by distance and smallest id hold the k first ids besides the query's own
                    first = np.lexsort((head[places], exact))[:k + 1]
                    found = sorted((float(exact[f]), i) for f in first for i in ids[places[f]] if i != names[row])[:k]
                    out_q += [names[row]] * len(found)
                    out_v += [i for _, i in found]
                    out_d += [d for d, _ in found]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_d, pa.float64())})

    return run


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id",
                       vector_col: str = "embedding", parts: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``queries``, a
    condition on ``vec_id``, holds: the ``k`` nearest rows found, by Euclidean
    distance, then by id.  ``parts`` is a power of two, by default from the root of
    the number of different vectors; one part is an exact search."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    src = pick(vectors, vec_id=id_col, v=vector_col)
    good = src.where(F.col("vec_id").isNotNull() & _usable(F.col("v"))) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("k1", "k2"))
    rows = good.withColumn("_n", one).where("_n = 1").drop("_n")
    few = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    entries = rows.withColumn("_n", few).where(f"_n <= {k + 1}").groupBy("k1", "k2") \
        .agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")).checkpoint()
    n = entries.count()
    share = max(1, -(-n // SAMPLE))
    taken = entries.where(F.pmod("k2", F.lit(share)) == 0).select("v").orderBy(F.size("v"), F.xxhash64("v")).toArrow()["v"]
    lengths = np.array([len(x) for x in taken.to_pylist()], int)
    empty = "query_id long, rank int, vec_id long, score double"
    if len(lengths) == 0 and n == 0:
        return spark.createDataFrame([], empty)
    if len(lengths) == 0:
        lengths = np.array([len(entries.first()["v"])])
    size = int(np.bincount(lengths).argmax())
    x = _matrix(taken.filter(pa.array(lengths == size))) if len(taken) else np.zeros((0, size))
    if parts is None:  # a quarter to a half of the root of the entries
        parts = 1 << max(0, isqrt(n).bit_length() - 2)
    parts = min(parts, MAX_PARTS, 1 << max(0, (len(x) // 16).bit_length() - 1)) if len(x) >= 64 else 1
    router, level = fit(x, parts, k) if parts > 1 else (None, 2.0)
    model = spark.sparkContext.broadcast((router, level))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, _ = model.value
        for b in batches:
            if b.num_rows:
                part = use(_matrix(b.column("v"))).argmax(axis=1) if use else np.zeros(b.num_rows, int)
                yield pa.RecordBatch.from_arrays([b.column("v"), b.column("ids"), b.column("k1"), pa.array(part.astype(np.int32))],
                                                 ["v", "ids", "k1", "part"])

    kind = src.schema["v"].dataType.simpleString()
    right_size = F.size("v") == size
    placed = entries.where(right_size).select("v", "ids", "k1").mapInArrow(place, f"v {kind}, ids array<long>, k1 long, part int").checkpoint()
    held = {r["part"]: (r["entries"], r["rows"]) for r in placed.groupBy("part").agg(
        F.count("*").alias("entries"), F.sum(F.size("ids")).alias("rows")).collect()}
    sizes = np.array([held.get(p, (0, 0))[1] for p in range(parts)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, least = model.value
        for b in batches:
            if b.num_rows:
                p = use(_matrix(b.column("v"))) if use else np.ones((b.num_rows, 1))
                query, part = probes(p, least, sizes, k + 1)
                at = pa.array(query)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("v").take(at), pa.array(part.astype(np.int32))],
                                                 ["query_id", "v", "part"])

    asked = rows.where(queries & right_size).select("vec_id", "v").mapInArrow(route, f"query_id long, v {kind}, part int").checkpoint()
    many = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    # a row per part, MAX_PARTS at most
    blocks = F.broadcast(spark.createDataFrame([(p, -(-held.get(p, (0, 0))[0] // BLOCK_ROWS) or 1, -(-many.get(p, 0) // QUERY_ROWS) or 1)
                                                for p in range(parts)], "part int, blocks int, query_blocks int"))

    def spread(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = placed.join(blocks, "part").select("v", "ids", "part", F.pmod("k1", "blocks").cast("int").alias("block"), spread("query_blocks").alias("query_block"))
    right = asked.join(blocks, "part").select("query_id", "v", "part", spread("blocks").alias("block"), F.pmod(
        F.xxhash64("query_id"), "query_blocks").cast("int").alias("query_block"))
    keys = ["part", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
