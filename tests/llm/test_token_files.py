import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkfall.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark, tmp_path):
    random.seed(1)
    rows = [(random.randrange(-50, 10**12), " ".join(random.choices(["the", "Quick", "brown\n", "été", "12", "!!"], k=random.choice([0, 1, 30, 3000]))), 1) for _ in range(200)]
    rows += [(5, None, 1), (5, "twice", 2), (5, "twice", 3), (None, "no id", None), (6, "<|endoftext|>", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, path, PATH, 0, shards=5)
    out = token_files.read_token_files(spark, path, with_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want = sorted(((r[0] is not None, r[0] or 0), np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in rows)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), bytes(r.ids)) for r in out)
    assert got == want
    out.sort(key=lambda r: r.start)
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert out[0].doc_id is None and ids == sorted(ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_table(docs, PATH).count() == 0
