import random
import shutil
import time
import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkfall.llm import packing, tokens
from inkfall.llm.common import written
from inkfall.llm.tokens import encoder

TEXTS = [
    "", " ", "a", "A b", "a  b", " lead", "trail ", "two\nlines", "two \n lines", "tab\tx", "it's John's!!", "naïve Straße ÀÉ,", "10.0.0.1 a1b2 ²", "nb sp x", "nb  sp", "nb   sp",
    "日本語 テキスト", "é x", "<|endoftext|> <|startoftext|>", "Σας ΣΑΣ", "x\x1cy \x85 z", "don't ... ___ ' 's", "emoji 😀😀 ok", "İstanbul", "a\r\nb", "w" * 3000, "the! the!! the?? THE",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    random.seed(5)
    parts = ["a", "the", "The", "'s", "'S", " ", "  ", "\n", "\t", "!", "é", "É", "9", " ", "　", "_", "-", "'", "x1", "Ω", "́"]
    texts = TEXTS + ["".join(random.choices(parts, k=random.randint(1, 25))) for _ in range(4000)]
    ids = encoder(public_tokenizers.path(name)).ids
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize(("kind", "name"), [("WordEncoder", "word_bpe_49k.json"), ("ByteEncoder", "byte_bpe_50k.json")])
def test_a_full_cache_keeps_frequent_words(kind, name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 200)
    made = []

    class Counted(getattr(tokens, kind)):
        cache_words = 200

        def _new(self, word):
            made.append(word.decode() if isinstance(word, bytes) else word)
            return super()._new(word)

    path = public_tokenizers.path(name)
    counted, whole = Counted(path), tokens.WholeEncoder(path)
    random.seed(7)
    rare = ["".join(random.choices("abcdéÉ", k=9)) + random.choice(["", ",", "%%%"]) for _ in range(3000)]
    for k in range(0, 3000, 10):
        text = " ".join(["The", "cat", "sat,", "naïve", *rare[k : k + 10], "the\nCat"])
        assert counted.ids(text.encode()) == whole.ids(text.encode())
    assert all(made.count(w) <= 1 for w in ("the", "cat", "sat,", "naïve", "\nCat")) and len(made) > 2900
    assert len(counted.words) <= 200 and len(counted.parts) <= 200


def _least(sizes, capacity):
    """Fewest sequences, by trying all."""
    best = len(sizes)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= capacity and bins[i] not in bins[:i]:
                go(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
        go(rest[1:], [*bins, rest[0]])

    go(sorted(sizes, reverse=True), [])
    return best


def test_reduction_keeps_the_optimum():
    random.seed(1)
    for _ in range(400):
        capacity = random.randint(8, 40)
        sizes = [random.randint(1, capacity) for _ in range(random.randint(1, 11))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.reduced(counts, capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(p.times for p in fixed) + (_least(left, capacity) if left else 0) == _least(sizes, capacity)
        whole = packing.packed(counts, capacity)
        assert all(p.used() <= capacity for p in whole)
        got = {}
        for p in whole:
            for s, n in p.items:
                got[s] = got.get(s, 0) + n * p.times
        assert got == counts


def _one_by_one(counts, capacity):
    left, fixed, again = packing._Lengths(counts), {}, True
    while again:
        again = False
        for large in sorted(left.sizes, reverse=True):
            while left.count.get(large) and (partners := packing._dominating(left, large, capacity)) is not None:
                for size in (large, *partners):
                    left.take(size, 1)
                fixed[tuple(sorted([large, *partners]))] = fixed.get(tuple(sorted([large, *partners])), 0) + 1
                again = True
    return fixed, left.count


def test_reduction_of_many_at_once_is_that_of_one_at_a_time():
    random.seed(8)
    pairs = 0
    for _ in range(300):
        capacity = random.randint(20, 60)
        least = random.choice([1, capacity // 4, capacity * 3 // 10])
        counts = {random.randint(least, capacity): random.randint(1, 14) for _ in range(random.randint(1, 12))}
        fixed, rest = packing.reduced(counts, capacity)
        got = {}
        for p in fixed:
            key = tuple(sorted(s for s, n in p.items for _ in range(n)))
            got[key] = got.get(key, 0) + p.times
            pairs += len(key) == 3 and p.times > 1
        assert (got, rest) == _one_by_one(counts, capacity)
        left, large = packing._Lengths(counts), max(counts)
        all_ = [s for s, n in counts.items() for _ in range(min(n, 3) - (s == large))]
        sums = [a + b for i, a in enumerate(all_) for b in all_[i + 1 :]]
        assert left.largest_pair(capacity, large) == max((x for x in sums if x <= capacity), default=0)
    assert pairs


def test_reduction_without_short_texts_takes_no_step_a_document():
    counts = {size: 10**6 for size in range(1100, 1400, 7)}
    start = time.monotonic()
    fixed, rest = packing.reduced(counts, 4096)
    assert time.monotonic() - start < 20
    assert sum(p.times * n for p in fixed for _, n in p.items) + sum(rest.values()) == 10**6 * len(counts)


def test_best_fit_is_that_of_single_documents():
    random.seed(2)
    for _ in range(200):
        capacity = random.randint(5, 60)
        sizes = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 80))), reverse=True)
        bins = []
        for s in sizes:
            fits = [i for i, b in enumerate(bins) if b + s <= capacity]
            if fits:
                bins[max(fits, key=lambda i: bins[i])] += s
            else:
                bins.append(s)
        counts = {s: sizes.count(s) for s in sizes}
        assert sum(p.times for p in packing.best_fit(counts, capacity)) == len(bins)


def test_pack(spark):
    random.seed(3)
    rows = [(i, " ".join(random.choices(["alpha", "beta!", "gamma"], k=random.choice([0, 1, 5, 60, 61, 200, 900]))), "x", 1) for i in range(120)]
    rows += [(7, "again", "x", 1), (7, "again", "x", 1), (None, "no id", None, None), (500, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, piece int")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=128, with_ids=True).collect()
    ids = encoder(public_tokenizers.path("word_bpe_49k.json")).ids
    by_sequence, by_doc = {}, {}
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    for i, text, *_ in rows[:120]:
        if i != 7:
            got = sorted(by_doc[i])
            assert b"".join(x for *_, x in got) == ids(text.encode()) + (1).to_bytes(4, "little")
            assert [s for _, s, _ in got] == [128 * k for k in range(len(got))]
    assert len(by_doc[None]) == 1 and by_doc[500][0][2] == (1).to_bytes(4, "little")
    assert len(by_doc[7]) >= 3
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_pack_in_order(spark):
    random.seed(4)
    rows = [(random.choice([None, i, i // 2]), " ".join(random.choices(["alpha", "beta!", "gamma"], k=random.choice([0, 1, 5, 60, 61, 200, 900]))), 3 * i) for i in range(150)]
    docs = spark.createDataFrame([*rows, (9, None, 450)], "doc_id long, text string, at long")
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_in_order(docs, path, "at", 90, capacity=128, with_ids=True).collect()
    ids, want = encoder(path).ids, []
    for doc_id, text, at in [*rows, (9, "", 450)]:
        data = ids(text.encode()) + (1).to_bytes(4, "little")
        want += [(at // 90, str(doc_id), k // 512, k // 4, data[k : k + 512]) for k in range(0, len(data), 512)]
    assert sorted((r.sequence_id >> 32, str(r.doc_id), r.piece, r.start, bytes(r.ids)) for r in out) == sorted(want)
    by_sequence, used = {}, {}
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        used[r.sequence_id >> 32] = used.get(r.sequence_id >> 32, 0) + r.length
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 128
    for window, tokens in used.items():
        numbers = sorted(s & 0xFFFFFFFF for s in by_sequence if s >> 32 == window)
        assert numbers == list(range(len(numbers))) and len(numbers) <= 1.1 * tokens / 128 + 1
    assert packing.pack_in_order(docs.limit(0), path, "at", 90).count() == 0


def test_caches_leave_the_workers_with_the_job(spark, tmp_path):
    path = str(tmp_path / "words.json")
    shutil.copy(public_tokenizers.path("word_bpe_49k.json"), path)
    docs = spark.range(40).selectExpr("id as doc_id", "concat('word ', id, ' of a text') as text", "id as at").repartition(8)
    assert packing.pack_in_order(docs, path, "at", 20).count() == 40 and packing.pack(docs, path).count() == 40

    def held(batches):
        import gc

        from inkfall.llm import tokens

        own = path in tokens._encoders or any(isinstance(x, tokens.Encoder) and x.path == path for x in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own] * batch.num_rows, pa.bool_())], names=["held"])

    others = spark.range(0, 40, 1, 8).mapInArrow(held, "held boolean").collect()
    assert len(others) == 40 and not any(r.held for r in others)


def test_pieces_in_order_are_cut_from_few_texts_at_a_time(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "written", lambda df, name: seen.append((name, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or written(df, name))
    docs = spark.range(1200).selectExpr("id as doc_id", "repeat('word ', 3) as text", "id as at").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert packing.pack_in_order(docs, public_tokenizers.path("word_bpe_49k.json"), "at", 500).count() == 1200
    assert seen == [("pack-pieces", "500")] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
