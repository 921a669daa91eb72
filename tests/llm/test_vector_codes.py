import hashlib
import math
import random

import numpy as np
import pytest

from inkfall.llm import vector_codes


def _brute(rows, parts=8, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    each = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * parts * each)[p * each : p * each + each] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:16]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors, digest = {}, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    for (_, _, label), f in zip(kept, found, strict=True):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label], digest) for (i, _, label), f in zip(kept, found, strict=True)), key=str)


def _coded(spark, rows, more=""):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" + more).repartition(3)
    return sorted(map(tuple, vector_codes.digests(df).collect()), key=str)


@pytest.mark.parametrize("length", [16, 21, 5])
def test_against_brute_force(spark, length):
    random.seed(length)
    vector = lambda: [random.choice([0.0, 0.25, -0.5, random.gauss(0, 1)]) for _ in range(length)]
    rows = [(i - 3, vector(), random.choice([1, 2, None])) for i in range(120)]
    rows += [(500 + i, rows[7][1], 1) for i in range(60)] + [(4, rows[9][1], 2), (4, rows[9][1], 2), (None, vector(), 3)]
    rows += [(-90, None, 1), (-91, [None] * length, 1), (-92, [float("nan")] * length, 1), (-93, [float("inf")] * length, 1), (-94, [], 1), (900, [1.0] * (length + 1), 1)]
    assert _coded(spark, rows) == _brute(rows)


def test_few_rows_empty_tables_and_other_columns(spark):
    rows = [(3, [0.5] * 8, None), (1, [0.25] * 8, 7)]
    assert _coded(spark, rows) == _brute(rows) and _coded(spark, []) == [] and _coded(spark, [(1, None, 1)]) == []
    own = [(*r, 1, 2, 3, 4, 5) for r in rows]
    assert _coded(spark, own, ", id int, v int, code int, error int, `of` int") == _brute(rows)


def test_far_values_raise(spark):
    with pytest.raises(ValueError, match="64 bits"):
        _coded(spark, [(1, [1e30] * 8, 1), (2, [0.5] * 8, 1)])
    assert _coded(spark, [(i, [(-1) ** i * 900.0] * 8, 1) for i in range(20)]) == _brute([(i, [(-1) ** i * 900.0] * 8, 1) for i in range(20)])


def test_transform_keeps_distances_and_drops_entries_early():
    rng = np.random.default_rng(3)
    for width in (1, 3, 8, 13):
        parts, entries = rng.integers(-3000, 3000, (200, width)), rng.integers(-3000, 3000, (16, width))
        entries[5] = entries[9] = parts[0]
        index, least, work = vector_codes.nearest(parts, entries)
        full = ((parts[:, None].astype(object) - entries[None]) ** 2).sum(2)
        assert index.tolist() == [int(np.argmin(f)) for f in full] and least.tolist() == [int(min(f)) for f in full]
        assert index[0] == 5 and work <= 200 * 17 * (1 << max(0, width - 1).bit_length())
    matrix = vector_codes.sequency_matrix(16)
    assert (matrix @ matrix.T == 16 * np.eye(16)).all() and [int((r[1:] != r[:-1]).sum()) for r in matrix] == list(range(16))
    smooth = np.repeat(rng.integers(-3000, 3000, (2000, 1)), 8, 1) + rng.integers(-20, 20, (2000, 8))
    assert vector_codes.nearest(smooth, smooth[:16])[2] < 2000 * 16 * 8 / 3
