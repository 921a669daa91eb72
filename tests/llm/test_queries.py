"""The registered queries over a whole small table against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from inkfall.llm import langid, pii, queries

from .test_pii import _base, _disclosing
from .test_simhash import _components, _fingerprint
from .test_substrings import _brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def _ids(name, text):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    return library.encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_packing(spark, rows):
    got = queries.op2_best_fit_packing(spark, SF).collect()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in places.values():
        some.sort()
        assert [o for o, _ in some] == [sum(n for _, n in some[:k]) for k in range(len(some))] and sum(n for _, n in some) <= 4096
    total, want = 0, set()
    for d in rows:
        ids = [*_ids("word_bpe_49k.json", d.text), 1]
        total += len(ids)
        want |= {(d.doc_id, k, 4096 * k, len(ids[4096 * k : 4096 * k + 4096]), _crc(ids[4096 * k : 4096 * k + 4096])) for k in range(-(-len(ids) // 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    assert len(places) <= 1.02 * total / 4096 + 1


def test_token_files(spark, rows):
    got, at = sorted(queries.op6_token_files(spark, SF).collect()), 0
    for d, r in zip(rows, got, strict=True):
        ids = [*_ids("byte_bpe_50k.json", d.text), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), _crc(ids))
        at += len(ids)


def test_simhash(spark, rows):
    want = _components([d.doc_id for d in rows], [_fingerprint(d.text) for d in rows], 3)
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in queries.op3_simhash_near_dedup(spark, SF).collect()} == want


def test_substrings(spark, rows):
    import hashlib

    want = Counter((d.doc_id, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in zip(rows, _brute([d.text for d in rows], 35), strict=True))
    assert Counter(map(tuple, queries.op4_substring_dedup(spark, SF).collect())) == want


def test_pii(spark, rows):
    terms = _disclosing([d.text for d in rows], pii.SUPPORT, pii.GENERALISE, pii.REMOVE)
    got = {r.doc_id: r for r in queries.op9_pii(spark, SF).collect()}
    for d in rows:
        spans = _base(d.text)
        more = [(f"term-{terms[m[0].lower()]}", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{4,}", d.text) if m[0].lower() in terms]
        assert got[d.doc_id].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans + more)
        assert got[d.doc_id].n_email == sum(k == "email" for k, *_ in spans)


def test_language_id_on_held_out_documents(spark, rows):
    lang = {d.doc_id: d.lang for d in rows}
    got = queries.op10_language_id(spark, SF).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_quality_on_held_out_documents(spark, rows):
    good = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()))
    got = queries.op12_quality_classifier(spark, SF).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in good]
    assert len(held) > 5 and sum(r.predicted == good[r.doc_id] for r in held) >= 0.85 * len(held)


def test_language_id_is_that_of_each_text_alone(spark, rows):
    model = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_language_id(spark, SF).collect()}
    for d in rows:
        own = langid.letters(d.text or "")
        if not len(own):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0.0)
            continue
        entropy = model.entropies([own])[0]
        assert got[d.doc_id].lang_pred == model.languages[int(np.argmin(entropy))]
        assert abs(got[d.doc_id].score - 1 / np.exp(-(entropy - entropy.min()) * min(len(own), langid.CERTAIN)).sum()) < 1e-9
