import random
from collections import Counter

from inkfall.llm import substrings


def _brute(texts, size):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + size]) for d in docs for i in range(len(d) - size + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - size + 1):
            if seen[tuple(d[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(d), len(gone), b" ".join(w for i, w in enumerate(d) if i not in gone).decode()))
    return out


def _texts(size):
    random.seed(size)
    few, many = ["a", "b", "A"], [f"w{i}" for i in range(400)]
    passages = [" ".join(random.choices(many, k=random.choice([size - 1, size, size + 1, 3 * size]))) for _ in range(6)]
    texts = [None, "", " ", "x\x1cy é", " ".join(["same"] * 6 * size), " ".join(random.choices(few, k=20 * size))]
    for _ in range(60):
        parts = [" ".join(random.choices(random.choice([few, many, many]), k=random.randint(0, 2 * size)))]
        for _ in range(random.randint(0, 3)):
            parts += [random.choice(passages), " ".join(random.choices(many, k=random.randint(0, size)))]
        texts.append(random.choice([" ", "\n", "\t"]).join(parts))
    base = random.choices(many, k=10 * size)
    for _ in range(12):
        some = list(base)
        some[random.randrange(len(some))] = "edit"
        texts.append(" ".join(some))
    return texts + texts[20:24] + ["lone words " * 1 + " ".join(f"u{i}" for i in range(3 * size))]


def test_matches_brute_force(spark):
    for size, hot_rows in ((10, 10**6), (10, 3), (35, 8)):
        texts = _texts(size)
        rows = [(i, t, "x") for i, t in enumerate(texts)]
        rows += [(3, texts[-1], "x"), (3, texts[-1], "x"), (None, "null id " * size, "x")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
        want = Counter((r[0], *w) for r, w in zip(rows, _brute([r[1] for r in rows], size)))
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.drop_repeated_windows(docs, size, hot_rows=hot_rows).collect())
        assert got == want
    assert substrings.drop_repeated_windows(docs.limit(0), 10).count() == 0


def test_automaton_counts_places():
    random.seed(3)
    for _ in range(300):
        size = random.randint(1, 5)
        passages = [b" ".join(random.choices([b"a", b"b", b"c"], k=random.randint(size, 14))) for _ in range(random.randint(1, 5))]
        want = _brute([p.decode() for p in passages], size)
        for p, spans, (n, gone, _) in zip(passages, substrings.shard_spans(passages, size), want):
            if len(set(passages)) > 1 or len(passages) == 1 and gone == 0:
                assert sum(b - a for a, b in spans) == gone
