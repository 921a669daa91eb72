"""Language identification by interpolated Kneser-Ney models over characters.

A text becomes its lower-cased letters, with one space for whatever stands between them. For each
language a model of ORDER-grams is learned from a bounded sample of labelled documents. The models
share one sorted array of hashes for each order; beside a hash stands the interpolated probability
of its n-gram in every language, and the weight with which each language backs off from it as a
context, so a character costs one binary search where its longest n-gram is known to any language.
The language of least cross-entropy per character wins. A text whose entropy is beyond what the
language's held-back sample shows but for its oddest hundredth, with a margin, is rejected.

Sample: up to SAMPLE_DOCS documents for each label, those of the least hashes of their ids, and half as
many more to set the bounds; of a text longer than SAMPLE_CHARS, a stretch of so many characters from
a place that the hash gives. Every label is learned; where there are so many that they would have more
than SAMPLE_TOTAL documents together, each has fewer, but one at least. These bounds are parameters of
the learning, and they bound what the driver gathers and the model that is sent to the executors:
SAMPLE_CHARS * ORDER n-grams a document at most. Everything else reads whole texts of all documents.

Defined results: a text that is null or has no letter is `und`, with score 0, and rejected; so is
every text if no document has a label. A null id counts as the text "null" in the choice of learned
documents. Ties go to the first language in order. Other columns are carried along; keep_identified
lets them have any names, and identify adds its own four after them, with an underscore more where a
name is taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_ROWS, plain, small_batches, spare_name, written

ORDER = 5
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 400, 20_000, 4000
#: A text is accepted up to MARGIN nats per character beyond the entropy that this share of the
#: held-back sample keeps within.
MARGIN, USUAL = 1.0, 0.99
#: Characters up to which longer texts make the score more certain.
CERTAIN = 40
_CHUNK = 400_000
_SPACE = 32
_tables: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is not a letter."""
    if not _tables:
        table = np.full(0x110000, _SPACE, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def letters(text: str) -> np.ndarray:
    """Code points of the letters, one space for each gap, none at the ends; empty if no letter."""
    points = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = points == _SPACE
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    points = points[keep]
    first, last = int(len(points) > 0 and points[0] == _SPACE), len(points) - int(len(points) > 1 and points[-1] == _SPACE)
    return points[first:last]


def grams(points: np.ndarray) -> list[np.ndarray]:
    """For n from 0 to ORDER the hash of the n-gram that ends at each position, after ORDER - 1 others."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    out = [np.zeros(len(points), np.uint64)]
    with np.errstate(over="ignore"):
        for _ in range(ORDER):
            before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
            out.append((before * np.uint64(0xBF58476D1CE4E5B9) + x) ^ (before >> np.uint64(32)))
    return out


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # sorted hashes, by order from 0
    prob: list[np.ndarray]  # log probability in each language
    contexts: list[np.ndarray]  # sorted hashes of contexts, by length from 0
    back: list[np.ndarray]  # log weight of backing off from a context
    bound: list[float]  # largest accepted entropy

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Nats per character of each text in each language; nan for empty texts."""
        pad = np.full(ORDER - 1, _SPACE, np.uint32)
        n = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.concatenate([x for t in texts for x in (pad, t)] or [pad])
        owner = np.repeat(np.arange(len(texts)), n + ORDER - 1)
        scored = np.ones(len(owner), bool)
        starts = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
        for k in range(ORDER - 1):
            scored[starts + k] = False
        total = np.zeros((len(texts), len(self.languages)))
        for first in range(0, len(owner), _CHUNK):
            lead = max(0, first - ORDER)
            hashes = grams(points[lead : first + _CHUNK])  # each position's context ends at the one before it
            at = first - lead + np.flatnonzero(scored[first : first + _CHUNK])
            who = owner[lead : first + _CHUNK]
            for order in range(ORDER, -1, -1):
                found, place = _lookup(self.keys[order], hashes[order][at])
                hit = at[found]
                for k in range(len(self.languages)):
                    total[:, k] += np.bincount(who[hit], self.prob[order][place[found], k], len(texts))
                at = at[~found]
                if not len(at):
                    break
                known, place = _lookup(self.contexts[order - 1], hashes[order - 1][at - 1])
                for k in range(len(self.languages)):
                    total[:, k] += np.bincount(who[at[known]], self.back[order - 1][place[known], k], len(texts))
        with np.errstate(invalid="ignore", divide="ignore"):
            return -total / n[:, None]


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[place] == wanted, place


def train(samples: dict[str, list[np.ndarray]]) -> Model:
    """One model of all languages, from the letters of each one's texts."""
    languages = sorted(samples)
    pad = np.full(ORDER - 1, _SPACE, np.uint32)
    kinds: list[list[tuple[np.ndarray, ...]]] = []  # by language and order: hash, context, suffix, count
    alphabet = len(np.unique(np.concatenate([t for some in samples.values() for t in some] + [pad]))) + 1
    for language in languages:
        points = np.concatenate([x for t in samples[language] for x in (pad, t)])
        real = np.ones(len(points), bool)
        at = 0
        for t in samples[language]:
            real[at : at + ORDER - 1] = False
            at += ORDER - 1 + len(t)
        hashes, where = grams(points), np.flatnonzero(real)
        some = []
        for n in range(1, ORDER + 1):
            key, first, count = np.unique(hashes[n][where], return_index=True, return_counts=True)
            at_first = where[first]
            some.append((key, hashes[n - 1][at_first - 1], hashes[n - 1][at_first], count.astype(float)))
        for n in range(ORDER - 1):  # below the highest order, in how many different contexts an n-gram stands
            key, context, suffix, _ = some[n]
            longer, count = np.unique(some[n + 1][2], return_counts=True)
            found, place = _lookup(longer, key)
            some[n] = (key, context, suffix, np.where(found, count[place], 1).astype(float))
        kinds.append(some)
    width = len(languages)
    empty = np.zeros(1, np.uint64)
    keys, prob, contexts, back = [empty], [np.full((1, width), 1 / alphabet)], [], []
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([k[n - 1][0] for k in kinds]))
        context, suffix = np.zeros(len(union), np.uint64), np.zeros(len(union), np.uint64)
        held = np.unique(np.concatenate([k[n - 1][1] for k in kinds]))
        weight, seen = np.ones((len(held), width)), np.zeros((len(union), width))
        for k, some in enumerate(kinds):
            key, before, after, count = some[n - 1]
            place = np.searchsorted(union, key)
            context[place], suffix[place] = before, after
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            groups, group = np.unique(before, return_inverse=True)
            sums, types = np.bincount(group, count), np.bincount(group)
            seen[place, k] = np.maximum(count - discount, 0) / sums[group]
            weight[np.searchsorted(held, groups), k] = discount * types / sums
        _, low = _lookup(keys[n - 1], suffix)
        prob.append(seen + weight[np.searchsorted(held, context)] * prob[n - 1][low])
        contexts.append(held)
        back.append(np.log(weight).astype(np.float32))
        keys.append(union)
    logs = [np.log(p).astype(np.float32) for p in prob]
    return Model(languages, keys, logs, contexts, back, [float("inf")] * width)


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % 4


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """The model of docs' labels; documents whose remainder is 2 are never read. None without labels."""
    labelled = docs.where((remainder(id_col) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = dict(map(tuple, labelled.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).collect()))
    if not counts:
        return None
    sample_docs = max(1, min(sample_docs, SAMPLE_TOTAL // len(counts)))
    hashed = F.crc32(F.concat_ws(":", F.lit("sample"), F.col(id_col).cast("string")).cast("binary"))
    want = max(30, 3 * sample_docs)  # enough for the sample, the held-back part and chance
    shares = F.from_json(F.lit(json.dumps({k: int(min(1.0, want / n) * (1 << 32)) for k, n in counts.items()})), "map<string,long>")
    start = F.pmod(F.xxhash64(hashed), F.greatest(F.length(text_col) - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    part = F.substring(F.col(text_col), start, F.lit(SAMPLE_CHARS)).alias("part")
    rows = labelled.where(hashed < F.element_at(shares, F.col(lang_col).cast("string"))).select(lang_col, hashed.alias("h"), part).collect()
    by: dict[str, list[tuple[int, str]]] = {}
    for lang, h, text in rows:
        by.setdefault(lang, []).append((h, text))
    train_on, held_back = {}, {}
    for lang, some in by.items():
        texts = [x for _, t in sorted(some) if len(x := letters(t))]
        if texts:
            cut = min(sample_docs, max(1, len(texts) * 2 // 3))
            train_on[lang], held_back[lang] = texts[:cut], texts[cut : cut + sample_docs // 2]
    if not train_on:
        return None
    model = train(train_on)
    for k, lang in enumerate(model.languages):
        own = model.entropies(held_back[lang] or train_on[lang])[:, k]
        model.bound[k] = float(np.quantile(own, USUAL)) + MARGIN
    return model


def _chunks(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """The letters of the texts in order, a chunk of about _CHUNK of them at a time."""
    some, size = [], 0
    for text in texts:
        own = letters(text.as_py() or "")
        if some and size + len(own) > _CHUNK:
            yield some
            some, size = [], 0
        some.append(own)
        size += len(own)
    yield some


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1), rejected and entropy (nats a character; null without letters), each after an underscore."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    n = len(docs.columns)
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            pred, score, rejected, least = [], [], [], []
            for texts in _chunks(batch.column(position)):
                entropy = model.entropies(texts) if model else None
                for i, text in enumerate(texts):
                    count = len(text)
                    if entropy is None or not count:
                        pred.append("und")
                        score.append(0.0)
                        rejected.append(True)
                        least.append(None)
                        continue
                    best = int(np.argmin(entropy[i]))
                    gaps = (entropy[i] - entropy[i][best]) * min(count, CERTAIN)
                    pred.append(model.languages[best])
                    score.append(float(1 / np.exp(-gaps).sum()))
                    rejected.append(bool(entropy[i][best] > model.bound[best]))
                    least.append(float(entropy[i][best]))
            added = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    own = docs.toDF(*[f"c{k}" for k in range(n)])
    schema = T.StructType([*own.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_rejected", T.BooleanType()), T.StructField("_entropy", T.DoubleType())])
    names = schema.names
    return own.mapInArrow(run, schema).toDF(*docs.columns, *[spare_name(docs, name) for name in names[n:]])


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are not rejected, with their own columns.

    They are written on the way, so that few texts at a time pass to Python and back.
    """
    own, (id_, text, lang) = plain(docs, id_col, text_col, lang_col)
    found = identify(own, learn(own, id_, text, lang), text).where(~F.col("_rejected"))
    with small_batches(docs.sparkSession, TEXT_ROWS):
        return written(found.select(*own.columns), "language-kept").toDF(*docs.columns)
