"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good (1) or bad (0). A line's own features and those of the lines before and after it pull it
either way, and a transition matrix ties neighbours together. Training maximises the likelihood of line labels, all
taken from the document's label; forward-backward then gives each line's marginal probability of being good, and the
document's quality is their mean weighted by line length.

Training reads a bounded sample: `SAMPLE` documents of each class, of `LONGEST` characters at most. Every document is
scored whole. Texts of like line counts are walked side by side, at most `CELLS` padded lines at once; a chain of `LONG`
lines or more is cut into blocks whose transfer matrices are multiplied side by side, which gives the same marginals.

Null and empty texts are one empty line. No labels, or labels of one class: every score is the share of label 1 (0.5
without labels). Rows with equal or null doc_id stay rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket
from .sampling import labelled

SAMPLE, LONGEST = 800, 8_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
ROUNDS, RATE, RIDGE = 120, 0.1, 1e-3
#: Documents, and bytes but for a single longer one, whose lines are described at once.
GROUP, GROUP_BYTES = 512, 1 << 23
#: Documents and padded lines walked side by side, and lines from which a text's chain is walked in blocks.
ABREAST, CELLS, LONG = 64, 1 << 16, 4096

_SYMBOL, _DIGIT, _UPPER, _POINT, _BLANK = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
for _of, _chars in ((_SYMBOL, b"#*$%&|<>{}[]=\\^~@"), (_DIGIT, b"0123456789"), (_UPPER, bytes(range(65, 91))), (_POINT, b".,;:!?\"'()-"), (_BLANK, b" \t\n\x0b\x0c\r")):
    _CLASS[list(_chars)] = _of
OWN = 9  # features of a line before its neighbours'


def own_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's features without its neighbours', the lines' lengths in bytes, and each text's number of lines."""
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _CLASS[flat]
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(float)

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (total[ends] - total[starts]).astype(float)

    blank = kind == _BLANK
    begins = ~blank
    begins[1:] &= blank[:-1]
    words, chars = per_line(begins), per_line(~blank)
    fresh = np.empty(len(size))
    again = np.empty(len(size))
    i = 0
    for own in lines:
        seen: set[bytes] = set()
        for line in own:
            fresh[i] = len(set(line.split()))
            again[i] = line in seen and len(line) > 0
            seen.add(line)
            i += 1
    share = lambda a: a / np.maximum(chars, 1)
    own = np.stack(
        [
            np.minimum(1, 5 * share(per_line(kind == _SYMBOL))),
            share(per_line(kind == _DIGIT)),
            share(per_line(kind == _UPPER)),
            np.minimum(1, 4 * share(per_line(kind == _POINT))),
            1 - fresh / np.maximum(words, 1) * (words > 0) - (words == 0),
            np.log1p(words) / 6,
            np.minimum(2, chars / np.maximum(words, 1) / 8),
            again,
            (words < 4).astype(float),
        ],
        axis=1,
    )
    return own, size, n_lines


def beside(own: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the line before and the line after have (rows of `own`), 0 beyond a text's ends."""
    first = np.cumsum(n_lines) - n_lines
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[first + n_lines - 1] = 0
    return before, after


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of all texts, the lines' lengths in bytes, and each text's number of lines."""
    own, size, n_lines = own_features(texts)
    return np.concatenate((own, *beside(own, n_lines), np.ones((len(own), 1))), axis=1), size, n_lines


def emissions(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features(texts) @ weights, without the wide table."""
    own, size, n_lines = own_features(texts)
    of = [own @ weights[i * OWN : (i + 1) * OWN] for i in range(3)]
    return of[0] + beside(of[1], n_lines)[0] + beside(of[2], n_lines)[1] + weights[-1], size, n_lines


def _padded(values: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """One row per text, padded with zeros."""
    out = np.zeros((len(n_lines), int(n_lines.max(initial=1))) + values.shape[1:])
    out[np.arange(out.shape[1])[None, :] < n_lines[:, None]] = values
    return out


def marginals(emission: np.ndarray, move: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line good), one row per text, and the summed probabilities of each transition.

    emission: log-weight of good against bad per text and line, padded; move: log-weights of transitions.
    """
    n, steps = emission.shape
    m = np.exp(move - move.max())
    e = np.stack((np.zeros_like(emission), np.clip(emission, -30, 30)), axis=2)
    e = np.exp(e - e.max(axis=2, keepdims=True))
    forward, backward = np.zeros((n, steps, 2)), np.ones((n, steps, 2))
    live = np.arange(steps)[None, :] < n_lines[:, None]
    a = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    forward[:, 0] = a
    for t in range(1, steps):
        a = (a @ m) * e[:, t]
        a /= a.sum(axis=1, keepdims=True)
        forward[:, t] = a
    pairs = np.zeros((2, 2))
    b = np.ones((n, 2))
    for t in range(steps - 1, 0, -1):
        ahead = e[:, t] * b
        joint = forward[:, t - 1, :, None] * m[None] * ahead[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint[live[:, t]].sum(axis=0)
        back = ahead @ m.T
        back /= back.sum(axis=1, keepdims=True)
        b = np.where(live[:, t, None], back, 1.0)
        backward[:, t - 1] = b
    p = forward * backward
    return np.where(live, p[:, :, 1] / np.maximum(p.sum(axis=2), 1e-300), 0.0), pairs


def long_marginals(emission: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(line good) along one chain: about sqrt(n) blocks of steps, multiplied side by side."""
    n, m = len(emission), np.exp(move - move.max())
    e = np.stack((np.zeros(n), np.clip(emission, -30, 30)), axis=1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    width = max(1, int((n - 1) ** 0.5))
    blocks = max(1, -(-(n - 1) // width))
    step = np.tile(np.eye(2), (blocks * width, 1, 1))
    step[: n - 1] = m[None] * e[1:, None, :]
    step = step.reshape(blocks, width, 2, 2)
    scaled = lambda x: x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)
    ahead, behind = np.empty_like(step), np.empty_like(step)  # products up to each step, and from each step on
    now = np.tile(np.eye(2), (blocks, 1, 1))
    for t in range(width):
        now = ahead[:, t] = scaled(now @ step[:, t])
    now = np.tile(np.eye(2), (blocks, 1, 1))
    for t in range(width - 1, -1, -1):
        now = behind[:, t] = scaled(step[:, t] @ now)
    starts, stops = np.empty((blocks, 2)), np.empty((blocks, 2))
    at = e[0] / e[0].sum()
    for b in range(blocks):
        starts[b] = at
        at = at @ ahead[b, -1]
        at = at / at.sum()
    at = np.ones(2)
    for b in range(blocks - 1, -1, -1):
        stops[b] = at
        at = behind[b, 0] @ at
        at = at / at.sum()
    forward = np.concatenate((e[:1] / e[0].sum(), (starts[:, None, None] @ ahead).reshape(-1, 2)[: n - 1]))
    backward = np.concatenate(((behind @ stops[:, None, :, None]).reshape(-1, 2)[: n - 1], np.ones((1, 2))))
    p = scaled(scaled(forward) * scaled(backward))
    return p[:, 1]


class Field:
    def __init__(self, weights: np.ndarray, move: np.ndarray, constant: float | None = None):
        self.weights, self.move, self.constant = weights, move, constant

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted marginals; texts of like line counts go side by side."""
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        emission, size, n_lines = emissions(texts, self.weights)
        weight = size + 1
        first = np.cumsum(n_lines) - n_lines
        out, order = np.empty(len(texts)), np.argsort(n_lines, kind="stable")
        at = 0
        while at < len(order):
            longest = int(n_lines[order[at]])
            if longest >= LONG:
                own = slice(first[order[at]], first[order[at]] + longest)
                out[order[at]] = (long_marginals(emission[own], self.move) * weight[own]).sum() / weight[own].sum()
                at += 1
                continue
            sizes = n_lines[order[at : at + ABREAST]]
            fit_in = (sizes * np.arange(1, len(sizes) + 1) <= CELLS) & (sizes < LONG)
            group = order[at : at + max(1, int(fit_in.sum()))]
            at += len(group)
            n = n_lines[group]
            lines = np.concatenate([np.arange(first[g], first[g] + n_lines[g]) for g in group])
            p, _ = marginals(_padded(emission[lines], n), self.move, n)
            w = _padded(weight[lines], n)
            out[group] = (p * w).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def fit(rows: list[tuple[bytes, int]]) -> Field:
    """Learn from (text, label) pairs."""
    y = np.array([label for _, label in rows], float)
    if len(y) == 0 or y.min() == y.max():
        return Field(np.zeros(3 * OWN + 1), np.zeros((2, 2)), float(y.mean()) if len(y) else 0.5)
    x, _, n_lines = line_features([text for text, _ in rows])
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n_lines
    truth = np.repeat(y, n_lines)
    importance = np.repeat(balance, n_lines)
    weights, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    # Lines' labels are constant within a document, so the transitions seen are all good-good or bad-bad.
    stays = np.array([((1 - y) * (n_lines - 1)).sum(), (y * (n_lines - 1)).sum()])
    m, v = np.zeros(len(weights)), np.zeros(len(weights))
    shaped = np.arange(int(n_lines.max()))[None, :] < n_lines[:, None]
    for step in range(1, ROUNDS + 1):
        p, pairs = marginals(_padded(x @ weights, n_lines), move, n_lines)
        g = x.T @ (importance * (truth - p[shaped])) / len(y) - RIDGE * weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights = weights + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        seen = np.diag(stays)
        move = np.clip(move + 0.05 * (seen - pairs) / max(1, n_lines.sum()), -2, 2)
    return Field(weights, move)


def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose third column is the text: up to GROUP rows and GROUP_BYTES, or one row of any size."""
    sizes, at = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist(), 0
    while at < batch.num_rows:
        to, total = at, 0
        while to < batch.num_rows and to - at < GROUP and (to == at or total + sizes[to] <= GROUP_BYTES):
            total += sizes[to]
            to += 1
        yield batch.slice(at, to - at)
        at = to


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    held = doc_bucket("doc_id", FOLDS) == HELD_OUT
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled(docs, labels, "quality", ~held, SAMPLE, LONGEST)[0]))
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in groups(whole):
                score = model.value.scores([t or b"" for t in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
