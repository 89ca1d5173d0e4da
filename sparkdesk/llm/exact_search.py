"""Exact top-k inner products by a dual-tree search over cover trees.

Rows are cut into blocks of near vectors of bounded size, queries into groups in
the same way; a task holds one pair of a query group and a block, each as a cover
tree: a node's points lie within its radius of its centre, its children's centres
are more than half that radius apart. For two nodes no product exceeds
<a, b> + |a| rb + |b| ra + ra rb (centres a, b; radii ra, rb). A pair of nodes is
pruned if this is below the worst kth score of the queries in the node, and so
is a pair of group and block before any row is sent.

A query's kth score starts from a bounded sample of all rows, a valid lower
bound that prunes but never decides: results come from the search alone.

Defined results: vectors that are null, empty or not finite take no part, as
queries or candidates; a shorter vector counts as filled with zeros; a
candidate of the query's own id is left out, rows that repeat an id are
candidates of their own for other queries; a query row that repeats id and vector
is asked once, and an id with several vectors gets the best of all their products;
ties go to the smaller id; without candidates, or on an empty table, there are no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.llm.common import stage
from sparkdesk.llm.vectors import filled, finite, pivots_of, spread_sample, with_cells

BLOCK = 4096  # rows of a block, and queries of a group, at most twice this
LEAF = 64
SAMPLE = 4096  # rows that centres and first thresholds come from
CENTRES = 64
SUMMARIES = 1024  # blocks, and groups, whose balls are compared in one task
NONE = -(2**62)


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    norm: float
    rows: np.ndarray  # all below
    children: list["Node"] = field(default_factory=list)


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, at: int = 0) -> Node:
    """A cover tree over rows of ``x``; points without neighbours within half the radius share a leaf."""
    rows = np.arange(len(x)) if rows is None else rows
    centre = x[rows[at]]
    far = np.sqrt(((x[rows] - centre) ** 2).sum(axis=1))
    radius = float(far.max())
    node = Node(centre, radius, float(np.sqrt((centre**2).sum())), rows)
    if len(rows) <= LEAF or radius == 0:
        return node
    left, alone = rows, []
    while len(left):
        gap = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(axis=1))
        near = gap <= radius / 2
        if near.sum() > 1:
            node.children.append(cover_tree(x, left[near]))
        else:
            alone.append(left[0])
        left = left[~near]
    for i in range(0, len(alone), LEAF):
        own = np.array(alone[i : i + LEAF])
        node.children.append(Node(centre, float(np.sqrt(((x[own] - centre) ** 2).sum(axis=1)).max()), node.norm, own))
    return node


def above(bound: float | np.ndarray) -> float | np.ndarray:
    """A bound with room for the rounding of doubles, whatever its sign."""
    return bound + np.abs(bound) * 1e-12 + 1e-6


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; doubles hold them exactly while they stay below 2**53."""
    return np.rint(a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T


def search_pair(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of shape (queries, k), best first; empty places hold ``NONE``."""
    none = NONE
    scores, found = np.full((len(q), k), none), np.full((len(q), k), np.iinfo(np.int64).max)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0**53
    worst = least.astype(float)  # lower bounds of the kth score of each query
    stack = [(cover_tree(q), cover_tree(x))]
    while stack:
        a, b = stack.pop()
        mine = a.rows
        bound = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        if above(bound) < worst[mine].min():
            continue
        if a.children and (not b.children or a.radius >= b.radius):
            stack += [(c, b) for c in a.children]
            continue
        if b.children:
            ranked = sorted(b.children, key=lambda c: float(a.centre @ c.centre) + a.norm * c.radius)
            stack += [(a, c) for c in ranked]  # the most promising is taken from the stack first
            continue
        s = products(q[mine], x[b.rows], exact)
        own = q_ids[mine][:, None] == ids[b.rows][None, :]
        s[own] = none
        all_s = np.concatenate([scores[mine], s], axis=1)
        all_i = np.concatenate([found[mine], np.where(own, np.iinfo(np.int64).max, ids[b.rows][None, :])], axis=1)
        order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        scores[mine] = np.take_along_axis(all_s, order, axis=1)
        found[mine] = np.take_along_axis(all_i, order, axis=1)
        worst[mine] = np.maximum(worst[mine], np.where(scores[mine][:, -1] == none, -np.inf, scores[mine][:, -1]))
    return scores, found


def search(vectors: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for rows that ``is_query`` holds for, over all other rows."""
    spark = vectors.sparkSession
    ints = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = stage(
        vectors.where(finite(vector) & F.col(vec_id).isNotNull())
        .select(F.col(vec_id).cast("long").alias("id"), ints.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")), "search-rows",
    )
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    out = "query_id long, rank int, vec_id long, score long"
    sample = spread_sample(rows.select("id", "v"), "id", SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], out)
    sx = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        sx[i, : len(r["v"])] = r["v"]
    s_ids = np.array([r["id"] for r in sample])
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    cells = lambda n: pivots_of(sx.copy(), max(1, min(CENTRES, n // BLOCK)))
    blocks = with_cells(rows.select("id", "v"), "v", "id", cells(sizes["n"]), BLOCK)
    groups = with_cells(rows.where("q").select("id", "v").distinct(), "v", "id", cells(sizes["q"]), BLOCK)

    def ball(f: pd.DataFrame) -> pd.DataFrame:
        x = filled(f["v"], width)
        middle = x.mean(axis=0)
        return pd.DataFrame({
            "cell": [int(f["cell"].iloc[0])], "middle": [middle], "radius": [float(np.sqrt(((x - middle) ** 2).sum(axis=1)).max())],
        })

    def first_scores(f: pd.DataFrame) -> np.ndarray:
        q = filled(f["v"], width)
        s = np.where(f["id"].to_numpy()[:, None] == s_ids[None, :], -np.inf, q @ sx.T)
        return np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)

    def group_ball(f: pd.DataFrame) -> pd.DataFrame:
        return ball(f).assign(least=float(first_scores(f).min()))

    balls = blocks.groupBy("cell").applyInPandas(ball, "cell long, middle array<double>, radius double")
    group_balls = groups.groupBy("cell").applyInPandas(group_ball, "cell long, middle array<double>, radius double, least double")
    # every group meets the blocks it cannot rule out: a stated query set against all rows, in blocks
    chunk = F.floor(F.col("cell") / SUMMARIES)
    g, b = (stage(x.withColumn("own", chunk), name) for x, name in ((group_balls, "search-groups"), (balls, "search-balls")))
    last = [x.agg(F.coalesce(F.max("own"), F.lit(-1))).first()[0] for x in (g, b)]
    if min(last) < 0:
        return spark.createDataFrame([], out)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    g = g.withColumnRenamed("own", "gc").withColumn("bc", every(last[1]))
    b = b.withColumnRenamed("own", "bc").withColumn("gc", every(last[0]))

    def kept(gs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        grp, block = [], []
        if len(gs) and len(bs):
            centre, radii, numbers = np.stack(bs["middle"]), bs["radius"].to_numpy(), bs["cell"].to_numpy()
            norms = np.sqrt((centre**2).sum(axis=1))
            for number, middle, radius, least in zip(gs["cell"], gs["middle"], gs["radius"], gs["least"]):
                m = np.asarray(middle)
                bound = centre @ m + np.sqrt((m**2).sum()) * radii + norms * radius + radii * radius
                near = numbers[above(bound) >= least]
                grp += [number] * len(near)
                block += near.tolist()
        return pd.DataFrame({"grp": np.array(grp, dtype=np.int64), "block": np.array(block, dtype=np.int64)})

    pairs = stage(g.groupBy("gc", "bc").cogroup(b.groupBy("gc", "bc")).applyInPandas(kept, "grp long, block long"), "search-pairs")
    left = groups.withColumnRenamed("cell", "grp").join(pairs, "grp").select("grp", "block", "id", "v")
    right = blocks.withColumnRenamed("cell", "block").join(pairs, "block").select("grp", "block", "id", "v")

    def pair(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = q["id"].to_numpy()
        scores, found = search_pair(ids, filled(q["v"], width), x["id"].to_numpy(), filled(x["v"], width), k, first_scores(q))
        there = scores != NONE
        return pd.DataFrame({"query_id": np.repeat(ids, there.sum(axis=1)), "vec_id": found[there], "score": scores[there]})

    found = left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInPandas(pair, "query_id long, vec_id long, score long")
    return ranked(found, F.desc("score"), k)


def ranked(found: DataFrame, best: Column, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(best, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

