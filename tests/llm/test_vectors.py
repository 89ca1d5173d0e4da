"""Searches against brute force, and on vectors at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdesk.llm import exact_search, graph_search, vectors
from sparkdesk.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(ids, x, queries, k, same_id):
    out = {}
    for q in queries:
        scores = [(-(x[q] @ x[c]), ids[c]) for c in range(len(ids)) if ids[c] != ids[q]]
        out[ids[q]] = [(v, -s) for s, v in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def given_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)


def test_exact_search(spark, given_vectors):
    ids, x = given_vectors
    want = brute(ids, np.floor(256 * x), [i for i, v in enumerate(ids) if v % 50 == 0], 5, False)
    assert found(QUERIES["op3_dual_tree"](spark, SF)) == want


def test_graph_search_recall(spark, given_vectors):
    ids, x = given_vectors
    want = brute(ids, x, [i for i, v in enumerate(ids) if v % 20 == 0], 20, False)
    got = found(QUERIES["op10_graph"](spark, SF))
    assert set(got) == set(want)
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9
    at = {v: i for i, v in enumerate(ids)}
    for q, rows in got.items():
        assert all(abs(s - x[at[q]] @ x[at[v]]) < 1e-12 for v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_trees_prune_but_lose_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (20, 8))
    x = (centres[rng.integers(0, 20, 3000)] + rng.integers(-5, 6, (3000, 8))).astype(float)
    q = x[:200] + rng.integers(-2, 3, (200, 8))
    ids, q_ids = np.arange(3000), np.arange(5000, 5200)
    scores, got = exact_search.search_pair(q_ids, q, ids, x, 5, np.full(200, -np.inf))
    for i in range(200):
        want = sorted(zip(-(x @ q[i]), ids))[:5]
        assert [(-s, v) for s, v in zip(scores[i], got[i])] == [(int(s), v) for s, v in want]
    large = np.full((3, 2), 2.0**31)
    scores, _ = exact_search.search_pair(np.array([9]), large[:1], np.arange(3), large, 2, np.full(1, -np.inf))
    assert scores[0].tolist() == [2**63 - 1, 2**63 - 1] or scores[0, 0] == scores[0, 1]


def test_cover_tree_holds_its_points():
    x = np.random.default_rng(1).normal(size=(700, 3))
    stack = [exact_search.cover_tree(x)]
    leaves = []
    while stack:
        n = stack.pop()
        assert (np.sqrt(((x[n.rows] - n.centre) ** 2).sum(axis=1)) <= n.radius + 1e-9).all()
        stack += n.children
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
        else:
            leaves.append(n.rows)
    assert sorted(np.concatenate(leaves)) == list(range(700))


ODD = [
    (0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, []),
    (None, [1.0, 1.0]), (50, [1.0, 2.0]), (100, [1.0, 2.0]), (101, [1.0, 2.0]), (101, [1.0, 2.0]), (7, [-1.0, 0.5]), (150, [3.0]),
]


def test_odd_vectors(spark):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in ODD], "vec_id long, embedding array<double>, score string, rank int")
    got = found(exact_search.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=3, scale=1))
    assert got[0] == [(50, 5), (100, 5), (101, 5)] and got[50] == [(0, 5), (100, 5), (101, 5)]
    assert [v for v, _ in got[150]][:2] == [0, 50] and set(got) == {0, 50, 100, 150}
    near = found(graph_search.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=3))
    assert near[0] == [(50, 5.0), (100, 5.0), (101, 5.0)] and set(near) == {0, 50, 100, 150}
    for search in (exact_search.search, graph_search.search):
        assert search(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0
        alone = df.where("vec_id = 50")
        assert search(alone, "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


def by_pairs(rows, queries, k, same_vector_once):
    """The best over all pairs of a query's different vectors and candidate rows of other ids."""
    rows = sorted(set(rows)) if same_vector_once else rows
    out = {}
    for q in queries:
        mine = {v for i, v in rows if i == q}
        pairs = sorted((-float(np.dot(v, w)), i) for v in mine for i, w in rows if i != q)[:k]
        out[q] = [(i, -s) for s, i in pairs]
    return out


@pytest.mark.parametrize("scale", [1, 100])
def test_scores_below_zero(spark, scale):
    rows = [(0, (-20.0 * scale, -10.0 * scale))] + [(i, (20.0, 10.0)) for i in range(1, 197)]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "id long, v array<double>")
    got = found(exact_search.search(df, "id", "v", F.col("id") == 0, k=5, scale=1))
    assert got == {0: [(i, -500 * scale) for i in range(1, 6)]}
    assert found(graph_search.search(df, "id", "v", F.col("id") == 0, k=5)) == {0: [(i, -500.0 * scale) for i in range(1, 6)]}


def test_ids_that_share_or_repeat_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(7, (1.0, 2.0)), (7, (5.0, 1.0)), (9, (5.0, 1.0)), (100, (1.0, 0.0)), (100, (1.0, 0.0)), (200, (0.0, 1.0)), (200, (-1.0, 3.0))]
    rows += [(int(i), tuple(map(float, v))) for i, v in zip(rng.integers(0, 40, 150), rng.integers(-4, 5, (150, 2))) if v.any()]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "id long, v array<double>")
    asked = F.col("id") % 100 == 0
    queries = sorted({i for i, _ in rows if i % 100 == 0})
    assert found(exact_search.search(df, "id", "v", asked, k=9, scale=1)) == by_pairs(rows, queries, 9, False)
    assert found(graph_search.search(df, "id", "v", asked, k=9)) == by_pairs(rows, queries, 9, True)


def test_a_repeated_vector_is_cut_into_cells(spark):
    rows = [(i, [1.0, 1.0]) for i in range(900)] + [(1000 + i, [float(i), -1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    cells = vectors.with_cells(df, "v", "id", np.array([[1.0, 1.0], [50.0, -1.0]]), 100).groupBy("cell").count().collect()
    assert sum(r["count"] for r in cells) == 1000 and max(r["count"] for r in cells) < 200


def test_pruned_graph_reaches_everything():
    x = np.random.default_rng(5).normal(size=(400, 6)).astype(np.float32)
    graph, start = graph_search.build_graph(x)
    seen, todo = {start}, [start]
    while todo:
        for n in graph[todo.pop()]:
            if n >= 0 and int(n) not in seen:
                seen.add(int(n))
                todo.append(int(n))
    assert len(seen) >= 396 and graph.shape[1] == graph_search.DEGREE
    assert all(i not in graph[i] for i in range(400))
