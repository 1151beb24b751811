"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the words and word stems it holds; a document
is toxic unless every sentence is harmless: p = 1 - prod(1 - p_sentence) (noisy-or). Weights are learnt from document
labels alone, by gradient descent on the bags' likelihood; what a sentence gets thus tells which ones offend. A last
monotone (Platt) step fits the bag's evidence to the labels, since one slip in a long text rarely earns the label.

Training reads a bounded sample, `SAMPLE` documents of each class of `LONGEST` characters at most; every document is
scored whole. Words that don't favour toxic documents clearly are left out; at most `VOCABULARY` words and stems stay.

Null and empty texts hold no sentence and get the least score. No labels, or labels of one class: every score is the
share of toxic labels (0 without labels). Rows with equal or null doc_id stay rows of their own. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket
from .sampling import labelled

SAMPLE, LONGEST, VOCABULARY = 3000, 20_000, 512
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
STEMS = (5, 7)
ROUNDS, RATE, RIDGE = 400, 0.05, 1e-3
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def features(word: str) -> list[str]:
    """A word as it is, and its beginnings (marked by *)."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class Model:
    """Weights of words and stems, and the scorer over whole texts."""

    def __init__(self, weights: dict[str, float], bias: float, slope: float, offset: float, constant: float | None = None):
        self.weights, self.bias, self.slope, self.offset, self.constant = weights, bias, slope, offset, constant
        self.finder = None

    def __getstate__(self):
        return self.__dict__ | {"finder": None}

    def _finder(self):
        import ahocorasick

        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for f in self.weights:
                self.finder.add_word(f.removesuffix("*"), f.removesuffix("*"))
            self.finder.make_automaton()
        return self.finder

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and probability of every sentence that holds a known word or stem."""
        lower = text.lower()
        if not self.weights or len(lower) != len(text):  # rare letters change length: go by words
            hits = [m.start() for m in _WORD.finditer(text)] if self.weights else []
        else:
            hits = [end + 1 - len(f) for end, f in self._finder().iter(lower)]
        out, last, done = [], -1, -1
        for start in sorted(set(hits)):
            if start < done or (start and lower[start - 1].isalpha() and len(lower) == len(text)):
                continue
            begin = max(text.rfind(c, last + 1, start) for c in ".!?\n") + 1
            begin = max(begin, last + 1)
            m = _SENTENCE.match(text, begin)
            stop = m.end() if m else start + 1
            found = {f for w in _WORD.findall(text[begin:stop].lower()) for f in features(w) if f in self.weights}
            done, last = stop, stop - 1
            if found:
                out.append((begin, stop, 1 / (1 + np.exp(-(self.bias + sum(self.weights[f] for f in found))))))
        return out

    def score(self, found: list[tuple[int, int, float]]) -> float:
        if self.constant is not None:
            return self.constant
        evidence = -sum(np.log1p(-min(p, 1 - 1e-9)) for _, _, p in found)
        return float(1 / (1 + np.exp(-(self.slope * np.log(evidence + 1e-3) + self.offset))))


def fit(rows: list[tuple[bytes, int]], totals: dict[int, int]) -> Model:
    """Learn from (text, label) pairs; `totals` has the classes' sizes in the whole table, to which scores are fitted."""
    y = np.array([label for _, label in rows], float)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, 0.0, 0.0, 0.0, float(y.mean()) if len(y) else 0.0)
    toxic, clean = Counter(), Counter()
    for text, label in rows:
        words = set(_WORD.findall(text.decode("utf-8", "replace").lower()))
        (toxic if label else clean).update({f for w in words for f in features(w)})
    n1, n0 = y.sum(), len(y) - y.sum()
    gain = {}
    for f, a in toxic.items():
        b = clean[f]
        p, q = a / n1, b / n0
        spread = np.sqrt((a + b) / (n1 + n0) * (1 - min(1, (a + b) / (n1 + n0))) * (1 / n1 + 1 / n0)) + 1e-9
        if a >= 5 and p > 2 * q and (p - q) / spread > 4:
            gain[f] = (p - q) / spread
    names = sorted(sorted(gain, key=lambda f: (-gain[f], f))[:VOCABULARY])
    at = {f: i for i, f in enumerate(names)}
    owner, bag_of, column = [], [], []  # one entry per feature of a sentence
    sentences = 0
    for i, (text, _) in enumerate(rows):
        for s in _SENTENCE.findall(text.decode("utf-8", "replace").lower()):
            own = [at[f] for f in {f for w in _WORD.findall(s) for f in features(w)} if f in at]
            if own:
                owner += [sentences] * len(own)
                column += own
                bag_of.append(i)
                sentences += 1
    owner, column, bag_of = np.array(owner, int), np.array(column, int), np.array(bag_of, int)
    weights, bias = np.full(len(names), 1.0), -2.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    moment, spread = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, ROUNDS + 1):
        z = np.clip(bias + np.bincount(owner, weights[column], sentences), -30, 30)
        p = 1 / (1 + np.exp(-z))
        survive = np.clip(np.bincount(bag_of, -np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)), 1e-6, 50)
        held = 1 - np.exp(-survive)
        # d/dz of the bag's log-likelihood: p (1 - h) / h for toxic bags, -p for clean ones
        pull = np.where(y == 1, (1 - held) / held, -1.0) * balance
        g = pull[bag_of] * p
        grad = np.concatenate((np.bincount(column, g[owner], len(names)) / len(y) - RIDGE * weights, [g.sum() / len(y)]))
        moment, spread = 0.9 * moment + 0.1 * grad, 0.999 * spread + 0.001 * grad**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights + move[:-1], bias + move[-1]
    z = np.clip(bias + np.bincount(owner, weights[column], sentences), -30, 30)
    evidence = np.log(np.bincount(bag_of, np.log1p(np.exp(z)), len(y)) + 1e-3)
    share = np.where(y == 1, totals[1] / n1, totals[0] / n0)
    slope, offset = platt(evidence, y, share / share.mean())
    return Model(dict(zip(names, weights.tolist(), strict=True)), float(bias), slope, offset)


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of the weighted logistic curve of y over x, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = weight * p * (1 - p) + 1e-6
        r = weight * (y - p)
        g = np.array([(r * x).sum() - 1e-3 * a, r.sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + da, b + db
    return max(float(a), 1e-3), float(b)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_offending, worst_start, worst_end) for every row of `docs`.

    n_offending: sentences of probability 0.5 or more; worst_*: code points of the sentence of highest probability.
    """
    held = doc_bucket("doc_id", FOLDS) == HELD_OUT
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled(docs, labels, "toxic", ~held, SAMPLE, LONGEST)))
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, held_out boolean, score double, predicted int, n_offending long, worst_start long, worst_end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            out = []
            for text in batch.column(2):
                found = own.sentences((text.as_py() or b"").decode("utf-8", "replace"))
                score, worst = own.score(found), max(found, key=lambda s: (s[2], -s[0]), default=(None, None, 0))
                out.append((score, int(score >= THRESHOLD), sum(p >= 0.5 for _, _, p in found), worst[0], worst[1]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)
