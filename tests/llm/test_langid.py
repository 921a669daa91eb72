import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from inkfall.llm import langid
from inkfall.llm.common import written

SYLLABLES = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ei", "un", "ge"], "zz": ["ó", "ñi", "la", "el"]}


def _text(lang, n):
    return " ".join("".join(random.choices(SYLLABLES[lang], k=random.randint(1, 4))) for _ in range(n))


def _brute(texts, order):
    """Interpolated Kneser-Ney straight from its definition: probability of a character after a context."""
    pad = " " * (order - 1)
    counts = [None, *(Counter() for _ in range(order))]
    for t in texts:
        s = pad + t
        for i in range(order - 1, len(s)):
            for n in range(1, order + 1):
                counts[n][s[i - n + 1 : i + 1]] += 1
    use = [None] * (order + 1)
    use[order] = counts[order]
    for n in range(1, order):
        use[n] = Counter(g[1:] for g in counts[n + 1])
        for g in counts[n]:
            use[n].setdefault(g, 1)
    total, types, discount = [defaultdict(float) for _ in range(order + 1)], [Counter() for _ in range(order + 1)], [0] * (order + 1)
    for n in range(1, order + 1):
        for g, c in use[n].items():
            total[n][g[:-1]] += c
            types[n][g[:-1]] += 1
        one, two = sum(c == 1 for c in use[n].values()), sum(c == 2 for c in use[n].values())
        discount[n] = one / (one + 2 * two) if one and two else 0.5

    def p(gram, alphabet):
        n = len(gram)
        if not n:
            return 1 / alphabet
        lower, context = p(gram[1:], alphabet), gram[:-1]
        if context not in total[n]:
            return lower
        return max(use[n][gram] - discount[n], 0) / total[n][context] + discount[n] * types[n][context] / total[n][context] * lower

    return p


def test_probabilities_match_the_definition():
    random.seed(1)
    samples = {lang: [_text(lang, 12) for _ in range(6)] for lang in ("xx", "zz")}
    model = langid.train({k: [langid.letters(t) for t in v] for k, v in samples.items()})
    alphabet = len(set("".join(t for v in samples.values() for t in v)) | {" "}) + 1
    brute = {k: _brute(v, langid.ORDER) for k, v in samples.items()}
    tests = [_text("xx", 5), _text("zz", 7), "qqq kalo q", "a", "laka ñi"]
    got = model.entropies([langid.letters(t) for t in tests])
    for i, t in enumerate(tests):
        s = " " * (langid.ORDER - 1) + t
        for k, lang in enumerate(model.languages):
            want = -sum(math.log(brute[lang](s[j - langid.ORDER + 1 : j + 1], alphabet)) for j in range(langid.ORDER - 1, len(s))) / len(t)
            assert abs(got[i, k] - want) < 1e-4
    whole = model.entropies([langid.letters(t) for t in tests])
    langid._CHUNK, kept = 7, langid._CHUNK
    assert np.allclose(model.entropies([langid.letters(t) for t in tests]), whole)
    langid._CHUNK = kept


def test_letters():
    show = lambda t: "".join(map(chr, langid.letters(t)))
    assert show(" Ab1!Cé  \n") == "ab cé" and show("12 !?") == "" and show("") == "" and show("x") == "x" and show("!x!y!") == "x y"


def test_identify(spark):
    random.seed(2)
    rows = [(i, _text(lang, random.randint(5, 60)), lang, "clash") for i, lang in enumerate(random.choices(list(SYLLABLES), k=240))]
    rows += [(900, None, "xx", ""), (901, "123 !", "yy", ""), (902, "", None, ""), (None, _text("zz", 20), None, ""), (903, "ка ло ми ту " * 20, None, ""), (904, "kalomi " * 60_000, None, "")]
    rows += [(zlib.crc32(b"x") + k, _text("xx", 30), "wrong", "") for k in range(400) if zlib.crc32(str(zlib.crc32(b"x") + k).encode()) % 4 == 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, c0 string")
    model = langid.learn(docs, sample_docs=30)
    assert model.languages == ["xx", "yy", "zz"]
    got = [(r, s) for r, s in zip(langid.identify(docs, model).orderBy("doc_id").collect(), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))]
    for r, (i, text, lang, _) in got:
        assert (r.doc_id, r.text) == (i, text) and 0 <= r._score <= 1
        if i in (900, 901, 902):
            assert r._lang_pred == "und" and r._rejected
        elif i is not None and i < 900:
            assert r._lang_pred == lang and not r._rejected
        elif i == 903:
            assert r._rejected
        elif i == 904:
            assert r._lang_pred == "xx"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    clash = docs.withColumn("_rejected", docs.c0).withColumn("_score", docs.c0).withColumn("_lang_pred", docs.c0)
    assert langid.keep_identified(clash).columns == clash.columns and langid.keep_identified(clash).count() == kept.count()
    named = langid.identify(clash, model)
    assert named.columns == [*clash.columns, "_lang_pred_", "_score_", "_rejected_", "_entropy"] and named.where("_rejected_").count() == sum(r._rejected for r, _ in got)
    assert all((r._entropy is None) == (r._lang_pred == "und") for r, _ in got)
    none = docs.withColumn("lang", docs.lang.cast("string")).where("lang is null and doc_id = 903")
    assert langid.learn(none) is None and [r._lang_pred for r in langid.identify(none, None).collect()] == ["und"]
    assert langid.identify(docs.limit(0), model).count() == 0


def test_kept_documents_pass_few_texts_at_a_time(spark, monkeypatch):
    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(langid, "written", lambda df, to: seen.append(spark.conf.get(name)) or written(df, to))
    random.seed(8)
    rows = [(i, _text("xx", 8), "xx") for i in range(1200)]
    before = spark.conf.get(name)
    assert langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)).count() > 1100
    assert seen == ["500"] and spark.conf.get(name) == before


def test_a_language_of_long_texts_only(spark, monkeypatch):
    random.seed(4)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 50)
    rows = [(i, _text(lang, 60 if lang == "zz" else 5), lang) for i, lang in enumerate(["xx", "zz"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.languages == ["xx", "zz"]
    assert all(r._lang_pred == r.lang for r in langid.identify(docs, model).collect())


def test_every_label_is_learned_however_many_there_are(spark, monkeypatch):
    random.seed(9)
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 60)
    make = lambda k, n: " ".join("".join(random.choices([f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "aeiou"], k=3)) for _ in range(n))
    docs = spark.createDataFrame([(40 * k + i, make(k, 30), f"l{k:03}") for k in range(120) for i in range(6)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.languages) == 120
    got = langid.identify(docs, model).collect()
    assert sum(r._lang_pred == r.lang for r in got) >= 0.95 * len(got)
