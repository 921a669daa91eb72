import math
import random
import re

from inkfall.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _ok(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(map(int, reversed(digits))):
            total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def _base(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if _ok(k, m[0])]


def _texts():
    random.seed(3)
    bits = ["a@b.c", "@", ".", "x_y", "1.2.3.4", "256.1.1.1", "0001.02.3.255", " ", "-", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+", "9", "é", "😀", "\n", "%", "12345678", "d@e.f_g@h.i", "1.2.3.4.5.6.7.8", "(", ")", "00 "]
    texts = ["".join(random.choices(bits, k=random.randint(0, 14))) for _ in range(1500)]
    return [None, "", "a" * 60_000, "1" * 60_000, "a.b@" + "c." * 30_000 + "d", "+1" + " " * 50_000 + "2", "1 " * 30_000, *texts]


def test_base_spans(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in docs.select("doc_id", pii.base_spans(pii.text_of("text")).alias("spans")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == _base(text), repr(text)[:200]


def _disclosing(texts, support, generalise, remove):
    words = lambda t: set(re.findall(r"[^\W\d_]{4,}", t.lower()))
    near, n_e, n = {}, {}, len(texts)
    for row, text in enumerate(texts):
        for kind, a, b in _base(text):
            key = (kind, text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b]))
            n_e.setdefault(key, set()).add(row)
            before = text[max(0, a - pii.REACH) : a]
            if a > pii.REACH:
                before = re.sub(r"^[^\W\d_]+", "", before)
            for t in words(before + " " + re.sub(r"[^\W\d_]+$", "", text[b : b + pii.REACH])):
                near.setdefault((key, t), set()).add(row)
    out = {}
    for (key, t), rows in near.items():
        if len({texts[r] for r in rows}) >= support:
            n_t, content = sum(t in words(x or "") for x in texts), math.log(n / len(n_e[key]))
            share = math.log(len(rows) * n / (len(n_e[key]) * n_t)) / content if content > 0 else 0
            out[t] = max(out.get(t, 0), share)
    return {t: "remove" if s >= remove else "generalise" for t, s in out.items() if s >= generalise}


def test_disclosing_terms(spark):
    random.seed(7)
    common = ["house", "garden", "river", "walking", "tree"]
    texts = [" ".join(random.choices(common, k=20)) for _ in range(80)]
    for k in range(8):
        texts.append(f"{random.choice(common)} Zebulon mayor wrote from boss@corp.example on day {k} about Quillfeather {random.choice(common)}")
    texts += ["mayor of a town", "mayor again", "Quillfeather far from it", texts[-1], None]
    want = _disclosing([t or "" for t in texts], 5, 0.9, 0.98)
    assert want.get("zebulon") == "remove" and want.get("quillfeather") == "generalise" and sorted(want) == ["about", "from", "mayor", "quillfeather", "wrote", "zebulon"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, term string")
    assert {r.term: r.action for r in pii.disclosing_terms(docs).collect()} == want
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        spans = [(s.kind, s.start, s.end) for s in found[i].pii_spans]
        terms = [(f"term-{want[m[0].lower()]}", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{4,}", text or "") if m[0].lower() in want]
        assert spans == _base(text) + terms
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zebulon" not in clean[80] and "[email]" in clean[80] and "boss" not in clean[80] and clean[len(texts) - 1] is None
    assert clean[0] == texts[0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(docs).count() == 0 and pii.sanitise(docs).count() == 0


def test_many_terms_and_free_names(spark):
    names = ["base", "spans", "key", "doc", "held", "word", "term", "c0", "pii_base"]
    texts = [f"filler words number {k % 7}" for k in range(60)] + [f"Zebulon wrote from boss@corp.example on day {k}" for k in range(8)]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], ["doc_id", "text", *names])
    within, joined = pii.find_pii(docs, base_col="found_base"), pii.find_pii(docs, base_col="found_base", inline_terms=0)
    assert within.columns == joined.columns == [*docs.columns, "found_base", "pii_spans"]
    rows = sorted(within.collect())
    assert rows == sorted(joined.collect()) and any(s.kind.startswith("term") for r in rows for s in r.pii_spans)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
