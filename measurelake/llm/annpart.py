"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into parts of equal size with few edges between them:
recursive bisection at the median of a slow mode of the walk on the graph, then moves to the part that holds most
neighbours as long as sizes allow. A softmax classifier learns, from a vector alone, the parts in which its
neighbours lie. It deals all rows into parts and sends each query to its most probable ones, where candidates are
ranked by their exact cosine. Parts of any size are cut into blocks by hash, and so are a part's queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelake.llm.common import materialize

#: Rows that the parts and the classifier are learned from, at most (in expectation); chosen by hash of the id.
SAMPLE = 8192
NEIGHBOURS = 10
#: Sampled rows for each part, at least; every HELD_BACKth of the sample tells how many parts a query must go to so
#: that TARGET of its neighbours lie there.
PART_ROWS, HELD_BACK, TARGET = 32, 4, 0.93
#: Candidates, and queries, that one task compares.
BLOCK, QUERIES = 4096, 1024
SEED = 3


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest others of each unit vector, by blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """The part of each vertex, sizes within 5 % (and 1) of each other's mean."""
    n = len(graph)
    label = np.zeros(n, np.int64)
    draw = np.random.default_rng(SEED)

    def bisect(own: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            label[own] = first
            return
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        near = place[graph[own]]
        rows, cols = np.nonzero(near >= 0)[0], near[near >= 0]
        degree = np.bincount(rows, minlength=len(own)) + np.bincount(cols, minlength=len(own)) + 1.0
        v = draw.normal(size=len(own))
        for _ in range(60):
            v -= (v * degree).sum() / degree.sum()
            v = (v + np.bincount(rows, v[cols], len(own)) + np.bincount(cols, v[rows], len(own))) / degree
            v /= np.abs(v).max() + 1e-30
        half = count // 2
        order = np.argsort(v, kind="stable")
        cut = len(own) * half // count
        bisect(own[order[:cut]], first, half)
        bisect(own[order[cut:]], first + half, count - half)

    bisect(np.arange(n), 0, parts)
    most = math.ceil(1.05 * n / parts) + 1
    sizes = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Partitioner:
    weights: np.ndarray
    bias: np.ndarray
    #: How many parts a query goes to.
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """All parts for each unit vector, the most probable first."""
        return np.argsort(-(x @ self.weights + self.bias), axis=1, kind="stable")


def fit(x: np.ndarray, parts: int, probes: int | None = None, steps: int = 400) -> Partitioner:
    """Learn from vectors; few of them make few parts. Without `probes`, their number is learned too.

    Part of the rows is held back: for these, the parts of their nearest others show how far down a query's list
    TARGET of the neighbours are met. Neighbours in the sample are further off than those among all rows, so the
    number errs on the side of recall.
    """
    parts = max(1, min(parts, len(x) // PART_ROWS))
    if parts == 1:
        return Partitioner(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbour_graph(x)
    held = np.arange(len(x)) % HELD_BACK == 0
    seen = np.flatnonzero(~held)
    label = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(x)), label] += graph.shape[1]
    target /= target.sum(axis=1, keepdims=True)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    draw = np.random.default_rng(SEED)
    for step in range(1, steps + 1):
        own = seen[draw.integers(0, len(seen), 1024)]
        z = x[own] @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = (z / z.sum(axis=1, keepdims=True) - target[own]) / len(own)
        rate = 0.3 * (1 - step / (steps + 1))
        for p, g, i in ((w, x[own].T @ d + 1e-6 * w, 0), (b, d.sum(axis=0), 2)):
            state[i] += 0.1 * (g - state[i])
            state[i + 1] += 0.01 * (g * g - state[i + 1])
            p -= rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-8)
    if probes is None:
        order = Partitioner(w, b, 0).order(x)
        place = np.empty_like(order)
        place[np.arange(len(x))[:, None], order] = np.arange(parts)
        met = place[np.flatnonzero(held)[:, None], order[graph[held], 0]]
        probes = int(np.quantile(met, TARGET, method="higher")) + 1
    return Partitioner(w, b, min(probes, parts))


def valid(vector: Column) -> Column:
    """Not null, not empty, not all zero, each component finite."""
    v = vector.cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False)) & F.exists(v, lambda c: c != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(df: DataFrame, query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", parts: int | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that `query` selects, by cosine.

    All rows of the query's length are candidates but those of its own id. Null, zero and non-finite vectors and rows
    without an id take no part. The commonest length is searched by learned partitions: as many `parts` as the square
    root of its rows, as far as the sample allows; a query goes to its `probes` most probable ones, by default as many
    as the sample asks for, and on until they hold k others. Vectors of each other length are a part of their own and
    compared whole. Ties go to the smaller id; rows that repeat count once. With fewer candidates than k, all are
    returned; an empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vec_id).isNotNull() & valid(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("is_query"))
    common = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width, n = (common["w"], common["count"]) if common else (0, 0)
    usual = rows.where(F.size("v") == width)
    cut = 1 << 30 if n <= SAMPLE else math.ceil((1 << 30) * SAMPLE / n)
    got = usual.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < cut).select("id", "v").toArrow().sort_by("id")  # bounded by SAMPLE
    model = fit(_matrix(got.column(1).combine_chunks()) if got.num_rows else np.zeros((0, width)), parts or math.isqrt(n), probes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            order = model.order(x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "v", "is_query", "parts"])

    # an unusual length is part -length
    dealt = usual.mapInArrow(assign, "id long, v array<double>, is_query boolean, parts array<int>").unionByName(rows.where(F.size("v") != width).withColumn("parts", F.array(-F.size("v"))))
    dealt = materialize(dealt.select("id", "v", "is_query", F.get("parts", F.lit(0)).alias("part"), F.when(F.col("is_query"), F.col("parts")).alias("parts")), "vectors")
    sizes = {r["part"]: r["count"] for r in dealt.where("part >= 0").groupBy("part").count().collect()}  # one row for each learned part
    size_of = F.array(*(F.lit(sizes.get(p, 0)) for p in range(len(model.bias))))
    # the parts that a query goes to: the first `probes`, and on while they hold k others or fewer
    reach = F.aggregate("parts", F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum")), lambda a, p: F.when((a["n"] < model.probes) | (a["sum"] <= k), F.struct((a["n"] + 1).alias("n"), (a["sum"] + F.coalesce(F.get(size_of, p), F.lit(0))).cast("long").alias("sum"))).otherwise(a), lambda a: a["n"])
    asked = materialize(dealt.where("is_query").select("id", "v", F.explode(F.slice("parts", 1, reach)).alias("part")), "asked")
    blocks = dealt.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    right = dealt.select("id", "v", "part").join(blocks, "part").join(groups, "part")
    right = right.select("id", "v", "part", F.pmod(F.xxhash64(F.lit(2), "id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    left = asked.join(blocks, "part").join(groups, "part")
    left = left.select("id", "v", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(1), "id"), "groups").cast("int").alias("group"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["part", "block", "group"]
    near = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(lambda q, c: _nearest(q, c, k), "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.distinct().withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of one block to each query; near the k-th place all are scored anew, one way whatever the block."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(q) and len(c):
        q, c = q.drop_duplicates("id"), c.drop_duplicates("id")
        x, y = np.vstack(q["v"].to_numpy()), np.vstack(c["v"].to_numpy())
        ids, own = c["id"].to_numpy(), q["id"].to_numpy()
        lx, ly = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        for at in range(0, len(x), 128):
            s = (x[at : at + 128] / lx[at : at + 128, None]) @ (y / ly[:, None]).T
            s[own[at : at + 128, None] == ids] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
            for i in range(len(s)):
                near = np.flatnonzero((s[i] >= least[i] - 1e-9) & (s[i] > -2))
                score = (y[near] * x[at + i]).sum(axis=1) / (lx[at + i] * ly[near])
                first = np.lexsort((ids[near], -score))[:k]
                out.append((np.full(len(first), own[at + i]), ids[near][first], score[first]))
    parts = [np.concatenate(p) for p in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]})
