"""Quality scores by supervised subword embeddings.

A text's features are its words and its character n-grams of 1 to GRAMS characters, white space and all,
hashed into BUCKETS; a word that repeats the one before it counts as one feature more, the same for all
words. Each bucket has a vector of WIDTH numbers; a document is the mean of its features'
vectors, and a softmax over the two labels follows. Vectors and output weights are learned together by
stochastic gradient descent in numpy, document by document, from a bounded sample of labelled rows.
The output is linear in the mean, so for scoring each bucket's vector becomes one number, the difference
of the two labels' outputs: a table of BUCKETS floats is all that is sent to the executors, whatever the
size of the corpus. Whole texts are scored, a bounded number of characters at a time.

Sample: up to SAMPLE_DOCS rows of each label, those of the least hashes of their ids; of a text longer
than SAMPLE_CHARS a stretch of so many characters from a place that the hash gives. A third of it is not
learned from but sets the temperature and the offset of the softmax, so that a score is the share of
label 1 among texts like it, at the labels' own proportion.

Defined results: a null text counts as empty; a text without features gets the score of an output of 0.
Without any label that can be learned every score is 0.5; with one value only, the scores are near it. A
row with a null id teaches nothing and is scored like any other. A row teaches once for each label of its
id. Labels of other values than 1 count as 0; null ones are not read. Other columns are carried along and
may have any names; where the score's name is taken, an underscore is added to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, spare_name
from .langid import remainder

GRAMS, BITS, WIDTH = 3, 17, 12
BUCKETS = 1 << BITS
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 8000
ROUNDS, RATE = 6, 6.0
#: Characters of a text that are turned into features at a time.
_CHUNK = 250_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    if not _powers:
        inverse = pow(int(_ODD), -1, 1 << 64)
        with np.errstate(over="ignore"):
            for base in (int(_ODD), inverse):
                table = np.full(_CHUNK + GRAMS + 1, base, np.uint64)
                table[0] = 1
                _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers[0], _powers[1]


def _buckets(points: np.ndarray, fresh: int) -> list[np.ndarray]:
    """Buckets of the n-grams that end, of the words that begin and of those that repeat the word before them, at or after `fresh`."""
    up, down = _power_tables()
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    sums = np.zeros(len(points) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mixed * up[: len(points)], dtype=np.uint64, out=sums[1:])
        # The hash of characters a to b is what they add to the running sum, moved back to the start.
        hashes = lambda a, b: (sums[b] - sums[a]) * down[a]
        bucket = lambda h, salt: ((h + np.uint64(salt)) * _ODD) >> np.uint64(64 - BITS)
        found = []
        for n in range(1, GRAMS + 1):
            first = np.arange(max(0, fresh - n + 1), max(0, len(points) - n + 1))
            found.append(bucket(hashes(first, first + n), n))
        inside = (points != 32) & ((points < 9) | (points > 13))
        edge = np.diff(np.concatenate([[False], inside[fresh:], [False]]).astype(np.int8))
        words = hashes(fresh + np.flatnonzero(edge == 1), fresh + np.flatnonzero(edge == -1))
        again = np.zeros(np.count_nonzero(words[1:] == words[:-1]), np.uint64)
        found += [bucket(words, 0), bucket(again, GRAMS + 1)]
    return [f.astype(np.int64) for f in found]


def features(text: str) -> Iterator[np.ndarray]:
    """The buckets of a text's features, with repeats, some at a time. Words longer than a chunk count in pieces."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _CHUNK)
        if end < len(text):  # not within a word
            cut = max(text.rfind(c, at, end) for c in " \n\t")
            end = cut + 1 if cut > at else end
        lead = max(0, at - GRAMS + 1)
        points = np.frombuffer(text[lead:end].encode("utf-32-le", "surrogatepass"), "<u4")
        yield np.concatenate(_buckets(points, at - lead))
        at = end


@dataclass
class Model:
    table: np.ndarray  # of each bucket, what it adds to the output of label 1 over that of label 0
    offset: float
    scale: float = 1.0

    def output(self, text: str) -> float:
        total, count = 0.0, 0
        for some in features(text):
            total, count = total + float(self.table[some].sum(dtype=np.float64)), count + len(some)
        return total / count if count else 0.0

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.output(text) + self.offset, -40, 40))))


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """The table of a model learned by stochastic gradient descent, each label weighing the same."""
    rng = np.random.default_rng(7)
    vectors, out = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)), np.zeros((2, WIDTH))
    bags = []
    for text in texts:
        used, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *features(text)]), return_counts=True)
        bags.append((used, counts / max(1, counts.sum())))
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    step, steps = 0, rounds * len(bags)
    for _ in range(rounds):
        for i in rng.permutation(len(bags)):
            used, share = bags[i]
            pace = rate * (1 - step / steps) * weight[labels[i]]
            step += 1
            hidden = share @ vectors[used]
            logits = out @ hidden
            odds = np.exp(logits - logits.max())
            wrong = odds / odds.sum()
            wrong[labels[i]] -= 1
            back = wrong @ out
            out -= 0.1 * pace * np.outer(wrong, hidden)
            vectors[used] -= pace * np.outer(share, back)
    return (vectors @ (out[1] - out[0])).astype(np.float32)


def calibrated(table: np.ndarray, texts: list[str], labels: list[int], share: float) -> Model:
    """The model whose scale and offset fit held-back rows best, at the given share of label 1."""
    model = Model(table, 0.0)
    x, y = np.array([model.output(t) for t in texts]), np.array(labels, float)
    share = min(max(share, 1e-6), 1 - 1e-6)
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max() or x.std() == 0:
        return Model(table, prior)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    centre, spread, a, b = x.mean(), x.std(), 1.0, prior
    z = (x - centre) / spread
    for _ in range(50):  # Newton's steps of a logistic fit with a slight pull to zero
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([(weight * (p - y) * z).mean() + 1e-3 * a, (weight * (p - y)).mean()])
        h = weight * np.maximum(p * (1 - p), 1e-9)
        matrix = np.array([[(h * z * z).mean() + 1e-3, (h * z).mean()], [(h * z).mean(), h.mean() + 1e-9]])
        move = np.linalg.solve(matrix, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return Model(table, float(b - a * centre / spread), float(a / spread))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of the labels; rows whose remainder is 2 are never read."""
    marks, (of, mark) = plain(labels, label_id, label_col)
    known = marks.where(F.col(mark).isNotNull() & F.col(of).isNotNull() & (remainder(of) != 2)).select(F.col(of).alias("of"), (F.col(mark) == 1).alias("good"))
    counts = dict(map(tuple, known.groupBy("good").count().collect()))
    if not counts:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    hashed = F.xxhash64(F.lit("sample"), F.col("of").cast("string"))
    chosen = [known.where(F.col("good") == good).orderBy(hashed, "of").limit(sample_docs) for good in (False, True)]
    own, (id_, text) = plain(docs, id_col, text_col)
    start = F.pmod(F.xxhash64(F.col(id_).cast("string")), F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    part = F.substring(F.col(text), start, F.lit(SAMPLE_CHARS)).alias("part")
    taught = own.where(F.col(text).isNotNull()).join(F.broadcast(chosen[0].union(chosen[1])), F.col(id_) == F.col("of")).select("good", part)
    # Ids should be single; should one stand in very many rows, the sample still has its bound.
    rows = taught.orderBy(F.xxhash64("part", "good"), "part", "good").limit(2 * sample_docs).collect()
    texts, good = [r.part for r in rows], [int(r.good) for r in rows]
    cut = max(1, len(rows) * 2 // 3)
    share = counts.get(True, 0) / sum(counts.values())
    return calibrated(train(texts[:cut], good[:cut]), texts[cut:], good[cut:], share)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """docs with the score of each row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own, (text,) = plain(docs, text_col)
    position, names = own.columns.index(text), [*own.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(position)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())])
    return own.mapInArrow(run, schema).toDF(*docs.columns, spare_name(docs, name))
