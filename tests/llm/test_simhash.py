import random
import re

import numpy as np
import xxhash

from inkfall.llm import simhash
from inkfall.llm.components import components


def _fingerprint(text):
    """The fingerprint, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _components(ids, fps, radius):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a in set(fps):
        for b in set(fps):
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    least = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return {(i, f): least.get(top(f)) for i, f in zip(ids, fps, strict=True)}


def _docs():
    random.seed(4)
    words = [f"W{i}" for i in range(200)]
    texts = [None, "", "  ", "one", "one two", "ONE TWO", "a\x1cb c d e", "Été à la plage", "x " * 5000]
    for _ in range(25):
        base = random.choices(words, k=random.choice([5, 40, 300]))
        texts.append(" ".join(base))
        for _ in range(4):
            some = list(base)
            for _ in range(random.randint(0, 2)):
                some[random.randrange(len(some))] = random.choice(words)
            texts.append("\n".join(some))
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(None, "one two"), (100, "one two"), (100, "one two")]
    return [(a, b, "clash", 3) for a, b in rows]


def test_components_match_brute_force(spark):
    rows = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, id int")
    want = _components([r[0] for r in rows], [_fingerprint(r[1]) for r in rows], 3)
    for shard_rows in (simhash.SHARD_ROWS, 2):
        got = simhash.near_components(docs, 3, 3, shard_rows=shard_rows).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in got} == want
    assert simhash.near_components(docs.limit(0)).count() == 0


def test_links_near_the_radius(spark):
    random.seed(6)
    fps = {random.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for k in (1, 2, 3, 4, 5):
            fps.add(f ^ sum(1 << b for b in random.sample(range(64), k)))
    ids = list(range(len(fps)))
    want = _components(ids, list(fps), 3)
    df = spark.createDataFrame([(simhash._signed(f), 0) for f in fps], "fp long, seed int")
    for shard_rows in (3,):
        roots = {r.node: r.root for r in components(simhash.links(df, 3, shard_rows), "a", "b").collect()}
        groups = {}
        for i, f in zip(ids, fps, strict=True):
            groups.setdefault(roots.get(simhash._signed(f), simhash._signed(f)), set()).add(want[(i, f)])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(200, i) for i in range(300, 340)] + [(5, 5), (1, 0), (900, 901)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in [200, *range(300, 340)]} == {200} and got[901] == 900
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies_are_dropped(spark):
    random.seed(8)
    words = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(40):
        base = random.choices(words, k=300)
        for k in range(3):
            some = list(base)
            for _ in range(k):
                some[random.randrange(300)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(some)))
    rows += [(1000 + i, " ".join(random.choices(words, k=200))) for i in range(60)] + [(None, "lone words without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in simhash.drop_near_copies(docs).collect()]
    assert all(1000 + i in kept for i in range(60)) and None in kept
    assert all(3 * g in kept for g in range(40))
    assert sum(i is not None and i < 1000 for i in kept) <= 44


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def _least_of_near(rows, similarity=0.8):
    """The least id of each row's component, all pairs compared."""
    sets, root = {i: _shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root


def _edited(words, k):
    out = list(words)
    for at in random.sample(range(len(out)), k):
        out[at] = f"edit{random.random()}"
    return out


def test_pairs_of_little_more_than_the_similarity(spark):
    random.seed(11)
    words = [f"w{i}" for i in range(3000)]
    common, rows = random.choices(words, k=30), []
    for g in range(60):
        base = random.choices(words, k=random.choice([40, 120, 400])) + common * (g % 2)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(_edited(base, max(1, len(base) // random.choice([44, 50, 60, 90])))))]
    root = _least_of_near(rows)
    scores = [len(a & b) / len(a | b) for g in range(60) for a, b in [(_shingles(rows[2 * g][1]), _shingles(rows[2 * g + 1][1]))]]
    assert sum(0.8 <= x < 0.9 for x in scores) >= 15 and sum(0.7 < x < 0.8 for x in scores) >= 5
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(root.values())


def test_no_pair_is_lost_for_its_links(spark):
    random.seed(12)
    words, rows = [f"w{i}" for i in range(500)], []
    for _ in range(15):
        base = random.choices(words, k=60)
        rows += [(len(rows) + k, " ".join(_edited(base, k % 3))) for k in range(4)]
    root = _least_of_near(rows)
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), radius=0, seeds=1)
    assert {i: r for i, r in found.collect() if i != r} == {i: r for i, r in root.items() if i != r} != {}


def test_parities_leave_no_pair_out():
    random.seed(13)
    for _ in range(400):
        one = {random.getrandbits(64) for _ in range(random.choice([0, 1, 5, 40, 900]))}
        two = set(random.sample(sorted(one), len(one) - len(one) // random.choice([4, 8, 10, 30]))) | {random.getrandbits(64) for _ in range(len(one) // random.choice([8, 10, 20, 60]))}
        a, b = (np.array(sorted(x), np.uint64) for x in (one, two))
        bits = [np.frombuffer(simhash.parities(x), np.uint64)[None] for x in (a, b)]
        able = simhash._able(np.array([len(a)]), np.array([len(b)]), *bits, 0.8)[0]
        assert able or (one | two and len(one & two) / len(one | two) < 0.8)


def test_a_family_under_one_key_is_dealt_in_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "BLOCK_ROWS", 20)
    keyed = spark.range(95).select(F.lit(7).cast("long").alias("h"), F.col("id").alias("part"), "id", F.lit(95).cast("long").alias("size"))
    groups = {}
    for r in simhash._in_blocks(keyed).collect():
        groups.setdefault(r.h, set()).add(r.id)
    assert len(groups) == 15 and max(map(len, groups.values())) < 80
    assert {(a, b) for g in groups.values() for a in g for b in g if a < b} == {(a, b) for a in range(95) for b in range(a + 1, 95)}
    random.seed(12)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(_edited(base, 4))) for i in range(90)]
    rows += [(200 + i, " ".join(_edited(rows[i][1].split(), 1))) for i in range(30)]
    want = _least_of_near(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == set(want.values())


def test_documents_with_the_names_that_the_stage_uses(spark):
    names = ["_id", "node", "root", "id", "other", "h", "part", "size", "n", "bits", "fps", "bands", "seed", "fp", "_node", "_h", "c0"]
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(3, text, *names), (2, text, *names), (5, "other words stand here in a row", *names)], ["doc_id", "text", *names])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5] and kept.first()[2:] == tuple(names)
