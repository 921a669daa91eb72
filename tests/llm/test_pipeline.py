import random
import re
import zlib

import corpus_pipeline
import public_tokenizers
from inkfall.llm import langid, mixing, queries
from tokenizers import Tokenizer

from .test_langid import _text
from .test_simhash import _edited, _least_of_near

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items() and len(after) == docs.count()
        seen[name] = (before, after)
    before, after = seen["language_id"]
    assert len(after) >= 0.98 * len(before)
    before, after = seen["exact_dedup"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for i in sorted(before):
        first.setdefault(norm(before[i]), i)
    assert set(after) == set(first.values())
    before, after = seen["simhash_near_dedup"]
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    for i in set(before) - set(after):
        own = shingles(before[i])
        assert any(len(own & s) / len(own | s) > 0.7 for j, t in before.items() if j != i for s in [shingles(t)])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count() and packed.where("offset + length > 4096").count() == 0


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, SF).count() > 0


def _hard_rows():
    random.seed(6)
    texts = []
    for lang in ("xx", "yy", "zz"):
        for _ in range(30):
            words = _text(lang, 120).split()
            texts.append((" ".join(words), lang))
            if random.random() < 0.4:
                texts += [("\n ".join(words), lang), (" ".join([*words[:-1], words[0]]), None), (" ".join(words[::-1]), lang)]
    texts += [(None, "xx"), ("", "yy"), (" \t", None), ("123 !", "zz"), ("ка ло ми ту " * 30, None), ("ка ло ми ту " * 30, None), (_text("xx", 40_000), "xx"), (_text("yy", 30), "yy")]
    rows = [(i, t, lang, random.choice(["src0", "src0", "src0", "src3", "a place", None])) for i, (t, lang) in enumerate(texts)]
    rows += [rows[5], rows[5], (None, _text("zz", 90), "zz", "src1"), (None, _text("yy", 90), None, "src1")]
    return [(*r, None if r[1] is None else len(r[1]), *["clash"] * 8) for r in rows]


_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c0 string, _node string, _size string, _rejected string, block string, sequence_id string, position string, id string"


def test_hard_rows_against_brute_force(spark, tmp_path):
    rows = _hard_rows()
    docs = spark.createDataFrame(rows, _SCHEMA)
    model = langid.learn(docs)
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs, want):
        stages[name](spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == docs.columns
        got = sorted(map(tuple, out.collect()), key=repr)
        assert got == sorted(want, key=repr), name
        return out, want

    def identified(text):
        own = langid.letters(text or "")
        entropy = model.entropies([own])[0] if len(own) else None
        return entropy is not None and entropy.min() <= model.bound[int(entropy.argmin())]

    docs, rows = step("language_id", docs, [r for r in rows if identified(r[1])])
    assert not any("ка" in r[1] for r in rows)
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    docs, rows = step("exact_dedup", docs, list(first.values()))
    root = _least_of_near([r[:2] for r in rows if r[0] is not None])
    near = [r for r in rows if r[0] is None or root[r[0]] == r[0]]
    assert len(near) < len(rows)
    docs, rows = step("simhash_near_dedup", docs, near)
    docs, rows = step("mixing", docs, rows)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want, total = [], 0
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(-(-len(ids) // 4096)):
            piece = ids[4096 * k : 4096 * k + 4096]
            want.append((doc_id, k, 4096 * k, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))))
    packed = stages["best_fit_packing"](spark, docs, "").collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=repr) == sorted(want, key=repr)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in places.values():
        some.sort()
        assert [o for o, _ in some] == [sum(n for _, n in some[:k]) for k in range(len(some))] and sum(n for _, n in some) <= 4096
    assert len(places) <= 1.02 * total / 4096 + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], _SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        assert found.count() == 0 and (name == "best_fit_packing" or found.columns == docs.columns)


def test_sequences_follow_the_mixture(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "WINDOW_DOCS", 64, raising=False)
    # Sources differ in ids and lengths, by which documents were packed whatever their mixture.
    docs = spark.createDataFrame([(i, "word " * (40 * (i // 100) + 5 + i % 7), None, f"src{i // 100}") for i in range(400)], "doc_id long, text string, lang string, source string")
    stages = dict(corpus_pipeline.STAGES)
    stages["mixing"](spark, docs, "").write.parquet(f"{tmp_path}/mixing")
    packed = stages["best_fit_packing"](spark, spark.read.parquet(f"{tmp_path}/mixing"), "").collect()
    order = [r.doc_id for r in mixing.schedule(docs, queries.MIX_WEIGHTS, queries.MIX_OTHER, queries.MIX_BLOCK, whole=True).orderBy("_position").collect()]
    assert sorted(r.doc_id for r in packed) == list(range(400))
    sequence = {r.doc_id: r.sequence_id for r in packed}
    windows = [order[k : k + 64] for k in range(0, 400, 64)]
    for some, later in zip(windows, windows[1:], strict=False):
        assert max(sequence[i] for i in some) < min(sequence[i] for i in later)
    for some in windows[:6]:  # four sources of equal weights, in blocks of 16
        assert sorted(i // 100 for i in some) == [k for k in range(4) for _ in range(16)]
