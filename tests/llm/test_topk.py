import math
import random

import numpy as np

from inkfall.llm import topk


def test_dual_tree_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 6)) * 900
    data = np.floor(centers[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 6)) * 9)
    data[100:140] = data[0]
    ids = rng.permutation(3000)
    queries = topk.CoverTree(data[::40], ids[::40], leaf=16)
    search = topk.Search(queries, 5)
    for first in range(0, 3000, 700):
        search.block(topk.CoverTree(data[first : first + 700], ids[first : first + 700], leaf=16))
    for row, own in enumerate(queries.ids):
        score = (data @ queries.vectors[row]).astype(int)
        want = sorted((-s, i) for s, i in zip(score, ids) if i != own)[:5]
        assert list(zip((-search.score[row]).tolist(), search.id[row].tolist())) == want
    assert search.scored + search.bounded < len(data) * len(queries.ids) / 4


def test_levels_and_pruning_on_a_table_with_groups_of_near_copies():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(40, 64))
    unit = np.concatenate([unit.repeat(100, axis=0) + rng.normal(size=(4000, 64)) * 0.05, rng.normal(size=(2000, 64))])
    data = np.floor(256 * unit / np.linalg.norm(unit, axis=1)[:, None])
    ids = np.arange(len(data))
    sample = rng.permutation(len(data))[:1500]
    tree = topk.CoverTree(data[:2000], ids[:2000])
    level, depth = tree.root, 0
    while level is not None:
        for first, last, radius, below in zip(level.first, level.last, level.radius, level.below):
            gap = np.linalg.norm(tree.vectors[first:last] - tree.vectors[first], axis=1).max()
            assert gap <= radius + 1e-6 and (below is None or (below.radius <= radius / 2 + 1e-6).all())
        level, depth = next((b for b in level.below if b is not None), None), depth + 1
    assert depth >= 2 and sorted(tree.ids) == list(range(2000))
    search = topk.Search(topk.CoverTree(data[::50], ids[::50]), 5, (sample, data[sample]))
    for first in range(0, len(data), 500):
        search.block(topk.CoverTree(data[first : first + 500], ids[first : first + 500]))
    for row, own in enumerate(search.queries.ids):
        score = (data @ search.queries.vectors[row]).astype(int)
        assert list(zip((-search.score[row]).tolist(), search.id[row].tolist())) == sorted((-s, i) for s, i in zip(score, ids) if i != own)[:5]
    assert search.scored + search.bounded < 0.75 * len(data) * len(search.queries.ids)


def test_top_k(spark):
    random.seed(4)
    rows = [(i, [random.uniform(-1, 1) for _ in range(4)], "q") for i in range(160)]
    rows += [(1000 + i, [0.5, 0.25, 0.125, 1.0], "q") for i in range(30)]
    rows += [(50, rows[3][1], "q"), (150, rows[150][1], "q"), (None, rows[0][1], "q"), (2000, None, "q"), (2001, [1.0, None, 0.0, 0.0], "q"), (2050, [float("nan")] * 4, "q"), (2100, [float("inf"), 0.0, 0.0, 0.0], "q"), (3000, [1.0, 2.0], "q"), (3001, [1.5, -2.0], "q"), (4000, [], "q"), (4050, [], "q"), (5000, [1.0, 1.0, 1.0], "q")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    topk.QUERY_BLOCK, kept = 3, topk.QUERY_BLOCK
    small = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, k=5, every=50).collect())
    topk.QUERY_BLOCK = kept
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, k=5, every=50).collect())
    fine = [(i, tuple(math.floor(256 * x) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in sorted(set(fine)):
        if i % 50 == 0:
            some = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i and len(w) == len(v))
            want += [(i, n, j, -s) for n, (s, j) in enumerate(some[:5], 1)]
    assert got == sorted(want) == small
    assert topk.top_k(table.limit(0)).count() == 0


def test_scores_beyond_doubles():
    a, b = np.array([[2.0**40 + 1, -3.0]]), np.array([[2.0**20 + 1, 5.0], [2.0**60, 0.0]])
    assert topk._scores(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) - 15, 2**63 - 1]]
