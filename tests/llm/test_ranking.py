import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from inkfall.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, k):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    total, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(_terms(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * total // length if c else 0
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[:2], x[2] or 0))[:k])]
    return sorted(out, key=str)


def _ranked(spark, docs, items, k, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranking.rank(d, i, k, **more).collect()), key=str)


@pytest.mark.parametrize("leaf,shard", [(64, 8192), (2, 40)])
def test_against_brute_force(spark, monkeypatch, leaf, shard):
    monkeypatch.setattr(ranking, "LEAF", leaf)
    monkeypatch.setattr(ranking, "SHARD", shard)
    random.seed(leaf)
    pool = [f"w{i}" for i in range(40)] + ["Été", "été", "日本", "a-b", "X_y"]
    text = lambda n: " ".join(random.choices(pool, [1 / (i + 1) for i in range(len(pool))], k=n))
    docs = [(i - 20, text(random.randint(0, 60))) for i in range(400)] + [(900 + i, "w3 w9 w9") for i in range(90)] + [(5, "w1 w2"), (5, "w1 w2"), (7, None), (8, "..."), (None, "w3 w9 w9 w9")]
    items = [(i, text(random.randint(1, 12))) for i in range(25)] + [(40, ""), (41, None), (42, "unheard"), (None, "w3"), (3, "w44 日本"), (50, "w3 w9")]
    assert _ranked(spark, docs, items, 7) == _brute(docs, items, 7)
    assert _ranked(spark, docs, items, 30, item_bytes=60) == _brute(docs, items, 30)


def test_trees_leave_out_what_cannot_enter(spark):
    rng = np.random.default_rng(1)
    topics = [np.arange(60 * t, 60 * t + 60) for t in range(8)]
    rows = [np.unique(rng.choice(topics[i % 8], 12)) for i in range(4000)]
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    term, count = np.concatenate(rows), rng.integers(1, 4, start[-1])
    df, key = np.bincount(term, minlength=480), np.arange(4000)
    tree = ranking.plant(start, term, count, np.full(4000, 100), key, df)
    weights = np.zeros(480, np.int64)
    weights[topics[2][:10]] = 100
    none = np.zeros(0, np.int64)
    best = ranking.Best(none, none, none)
    scored = ranking.search(tree, weights, best, 10, key, 0)
    sums = np.zeros(4000, np.int64)
    np.add.at(sums, np.repeat(key, np.diff(start)), weights[term] * ranking.saturated(count, np.full(len(term), 100)))
    want = np.lexsort((key, -sums))[:10]
    assert best.key.tolist() == want.tolist() and best.score.tolist() == sums[want].tolist()
    assert scored < 2000
    assert all(tree.span[c][0] >= tree.span[n][0] and tree.span[c][1] <= tree.span[n][1] for n, some in enumerate(tree.children) for c in some)


def test_empty_tables_and_other_columns(spark):
    docs, items = [(1, "a b"), (2, "a")], [(1, "a")]
    assert _ranked(spark, [], items, 5) == [] and _ranked(spark, docs, [], 5) == [] and _ranked(spark, [(1, None)], items, 5) == []
    names = ["n", "terms", "counts", "item_id", "part", "rank", "score"]
    d = spark.createDataFrame([(*r, *range(7)) for r in docs], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    i = spark.createDataFrame([(*r, 1, 1) for r in items], "item_id long, text string, doc_id int, id int")
    assert sorted(map(tuple, ranking.rank(d, i, 5).collect())) == _brute(docs, items, 5)


def test_a_very_long_document(spark):
    docs = [(1, "a " * 300_000 + "b"), (2, "b c"), (3, "c")]
    assert _ranked(spark, docs, [(1, "a b"), (2, "c b")], 2) == _brute(docs, [(1, "a b"), (2, "c b")], 2)
