"""Approximate nearest neighbours by inner product, over robustly pruned directed graphs.

Rows are dealt to shards by hashed id. A shard's graph starts random; each point
searches the graph greedily for its neighbourhood, and relaxed pruning keeps an
edge only if no kept neighbour is much nearer to its end, so few and diverse
edges remain. Edges get their reverses, pruned alike. Points are worked on in
batches that search side by side. To turn inner products into distances, a
vector gets one more component that gives all the same length.

A query is searched in every shard with a beam, and the shards' finds merge on
exact products of the original vectors in double precision. Equal vectors are
one point with its smallest ids, at most as many as a result can hold.

Defined results: vectors that are null, empty, zero or not finite take no part,
as queries or candidates; a query's own id is left out; ties go to the smaller
id; without candidates, or on an empty table, there are no rows; a repeated id
counts once for each different vector; a query row that repeats id and vector is
asked once, and an id with several vectors gets the best of all their products;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.llm.common import stage
from sparkdesk.llm.exact_search import ranked
from sparkdesk.llm.vectors import filled, finite

SHARD = 4096  # points of a shard, nearly
DEGREE = 32
BEAM = 48  # while a graph is built
SEARCH_BEAM = 128
ALPHA = 1.2
PASSES = 2
SIDE_BY_SIDE = 256
QUERIES = 4096  # of a task


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the beams of many queries, nearest first.

    ``square`` holds squared lengths of ``x``, or zeros to search by inner product.
    """
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), dtype=bool)
    seen[:, [start, -1]] = True
    ids = np.full((n, beam), -1)
    far = np.full((n, beam), np.inf, dtype=np.float32)
    done = np.ones((n, beam), dtype=bool)
    ids[:, 0], far[:, 0], done[:, 0] = start, square[start] - 2 * (q @ x[start]), False
    live = np.arange(n)
    while len(live):
        first = np.where(done[live], np.inf, far[live]).argmin(axis=1)
        done[live, first] = True
        near = graph[ids[live, first]]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        d = square[near] - 2 * np.matmul(x[near], q[live][:, :, None])[:, :, 0]
        d[~fresh] = np.inf
        all_d = np.concatenate([far[live], d.astype(np.float32)], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        all_i = np.concatenate([ids[live], near], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        far[live] = np.take_along_axis(all_d, best, axis=1)
        ids[live] = np.take_along_axis(all_i, best, axis=1)
        done[live] = np.take_along_axis(all_done, best, axis=1)
        live = live[(~done[live] & np.isfinite(far[live])).any(axis=1)]
    order = far.argsort(axis=1, kind="stable")
    return np.where(np.isfinite(far[rows, order]), ids[rows, order], -1), far[rows, order]


def prune(x: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each point among its candidates (-1: none)."""
    own = np.sort(np.where(found == points[:, None], -1, found), axis=1)
    own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
    there = own >= 0
    c = x[np.maximum(own, 0)]
    length = (c**2).sum(axis=2)
    to_point = (length - 2 * np.matmul(c, x[points][:, :, None])[:, :, 0] + (x[points] ** 2).sum(axis=1)[:, None]).clip(0)
    between = (length[:, :, None] + length[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))).clip(0)
    to_point = np.where(there, to_point, np.inf)
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for i in range(degree):
        nearest = to_point.argmin(axis=1)
        ok = np.isfinite(to_point[rows, nearest])
        if not ok.any():
            break
        out[ok, i] = own[rows, nearest][ok]
        hidden = alpha * alpha * between[rows, nearest] <= to_point  # distances are squared
        to_point = np.where(hidden, np.inf, to_point)
        to_point[rows, nearest] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, passes: int = PASSES) -> tuple[np.ndarray, int]:
    """(neighbours with -1 for none, the point to start at)."""
    n = len(x)
    rng = np.random.default_rng(n)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = rng.integers(0, n, (n, degree))
    graph[:, degree // 2 :] = -1
    square = (x**2).sum(axis=1)
    for p in range(passes):
        relaxed = alpha if p == passes - 1 else 1.0
        order = rng.permutation(n)
        for i in range(0, n, SIDE_BY_SIDE):
            batch = order[i : i + SIDE_BY_SIDE]
            ids, _ = beam_search(x, graph, start, x[batch], min(beam, n), square)
            graph[batch] = prune(x, batch, np.concatenate([ids, graph[batch]], axis=1), degree, relaxed)
            to = graph[batch].ravel()
            by = np.repeat(batch, degree)[to >= 0]
            to = to[to >= 0]
            in_order = np.argsort(to, kind="stable")
            to, by = to[in_order], by[in_order]
            ends, firsts, counts = np.unique(to, return_index=True, return_counts=True)
            new = np.full((len(ends), counts.max(initial=1)), -1)
            new[np.repeat(np.arange(len(ends)), counts), np.arange(len(to)) - np.repeat(firsts, counts)] = by
            for j in range(0, len(ends), SIDE_BY_SIDE):
                s = slice(j, j + SIDE_BY_SIDE)
                _reverse(x, graph, ends[s], new[s], degree, relaxed)
    return graph, start


def _reverse(x: np.ndarray, graph: np.ndarray, ends: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges ends -> new; a list that is too long is pruned."""
    both = np.concatenate([graph[ends], new], axis=1)
    both = -np.sort(-both, axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    long = (both >= 0).sum(axis=1) > degree
    short = -np.sort(-both[~long], axis=1)[:, :degree]
    graph[ends[~long]] = short
    if long.any():
        graph[ends[long]] = prune(x, ends[long], both[long], degree, alpha)


def distinct_vectors(vectors: DataFrame, vec_id: str, vector: str, k: int) -> DataFrame:
    """(rep, code, members, v): each different vector with its smallest ids, ``k + 1`` at most.

    Vectors may share their smallest id ``rep``; with the hash ``code`` they are told apart.
    """
    usable = finite(vector) & F.col(vec_id).isNotNull() & F.exists(F.col(vector), lambda x: x != 0)
    rows = vectors.where(usable).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    order = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    grouped = few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("members"))
    return grouped.select(F.element_at("members", 1).alias("rep"), F.xxhash64("v").alias("code"), "members", "v")


def index(points: DataFrame, width: int, longest: float, shards: int) -> DataFrame:
    """(shard, reps, codes, data, graph, start): one row per shard, of bounded size."""
    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["rep", "code"])
        x = filled(f["v"], width)
        rest = np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))
        graph, start = build_graph(np.concatenate([x, rest[:, None]], axis=1).astype(np.float32))
        return pd.DataFrame({
            "shard": [f["shard"].iloc[0]], "reps": [f["rep"].to_numpy(dtype="<i8").tobytes()],
            "codes": [f["code"].to_numpy(dtype="<i8").tobytes()], "data": [x.tobytes()],
            "graph": [graph.astype("<i4").tobytes()], "start": [start],
        })

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("rep", "code"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(build, "shard long, reps binary, codes binary, data binary, graph binary, start long")


def search(vectors: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for rows that ``is_query`` holds for."""
    spark = vectors.sparkSession
    points = stage(distinct_vectors(vectors, vec_id, vector, k), "graph-points")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = points.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("longest"), F.count(F.lit(1)).alias("n")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, shards = facts["width"], -(-facts["n"] // SHARD)
    built = stage(index(points, width, facts["longest"] * (1 + 1e-9), shards), "graph-index")
    asked = vectors.where(is_query & finite(vector) & F.exists(F.col(vector), lambda x: x != 0)).select(
        F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")
    ).distinct()
    chunks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left, right = built.withColumn("chunk", every(chunks)), asked.withColumn("shard", every(shards))

    def find(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "rep": [], "code": [], "score": []}
        if len(own) and len(queries):
            r = own.iloc[0]
            reps, codes = np.frombuffer(r["reps"], dtype="<i8"), np.frombuffer(r["codes"], dtype="<i8")
            x = np.frombuffer(r["data"], dtype=np.float64).reshape(-1, width)
            graph, light = np.frombuffer(r["graph"], dtype="<i4").reshape(-1, DEGREE), x.astype(np.float32)
            zero = np.zeros(len(x), dtype=np.float32)
            for i in range(0, len(queries), SIDE_BY_SIDE):
                some = queries.iloc[i : i + SIDE_BY_SIDE]
                q = filled(some["v"], width)
                ids, _ = beam_search(light, graph, int(r["start"]), q.astype(np.float32), min(max(SEARCH_BEAM, 2 * k), len(x)), zero)
                scores = np.where(ids >= 0, np.einsum("qbd,qd->qb", x[np.maximum(ids, 0)], q), -np.inf)
                best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                scores, ids = np.take_along_axis(scores, best, axis=1), np.take_along_axis(ids, best, axis=1)
                there = ids >= 0
                out["query_id"].append(np.repeat(some["query_id"].to_numpy(), there.sum(axis=1)))
                out["rep"].append(reps[ids[there]])
                out["code"].append(codes[ids[there]])
                out["score"].append(scores[there])
        none = {c: np.zeros(0, dtype=np.float64 if c == "score" else np.int64) for c in out}
        return pd.DataFrame({c: np.concatenate([none[c], *v]) for c, v in out.items()})

    schema = "query_id long, rep long, code long, score double"
    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(find, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep", "code")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    members = best.join(points.select("rep", "code", "members"), ["rep", "code"]).select("query_id", F.explode("members").alias("vec_id"), "score")
    return ranked(members.where("vec_id <> query_id"), F.desc("score"), k)

