"""A trained text scorer: a multinomial model over hashed words and word pairs, kept as a versioned artefact.

Features of a text: counts of its words and neighbouring pairs in BUCKETS hashed buckets, scaled to length one, and a
constant. Training is full-batch: each step is one pass over the training rows, in which every task adds up its rows'
gradients and Spark sums them by bucket, so the driver sees the model's size and never the rows'. Steps have momentum and
are divided by each bucket's mean square; classes weigh alike, however rare. The model is a few hundred KB whatever the
data; a worker opens it once.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept
from . import scoring

#: Hexadecimal digits of a gram's MD5 that name its bucket, and the buckets; the constant's bucket comes after them.
DIGITS = 3
BUCKETS = 16**DIGITS
STEPS, RATE, MOMENTUM, SHRINK = 40, 0.05, 0.9, 0.001
FORMAT = 1
_WORD = re.compile(r"\w+")
#: Words whose buckets a worker remembers before it starts anew.
MEMORY = 500_000
#: Rows whose features are worked on at once.
ROWS = 256


@dataclass(frozen=True)
class Model:
    """Classes, and their weights by bucket: an array of BUCKETS + 1 rows."""

    classes: tuple[str, ...]
    weights: np.ndarray
    rows: int = 0
    version: int | None = None


class Grams:
    """Turns texts into buckets and values."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def bucket(self, gram: str) -> int:
        at = self.known.get(gram)
        if at is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            at = self.known[gram] = int(md5(gram.encode("utf-8", "replace")).hexdigest()[:DIGITS], 16)
        return at

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Buckets, their values, and the number of words."""
        words = _WORD.findall(text.lower())
        counts = Counter(map(self.bucket, words))
        counts.update(self.bucket(f"{a} {b}") for a, b in zip(words, words[1:], strict=False))
        at, n = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts))
        return np.append(at, BUCKETS), np.append(n / np.sqrt((n * n).sum()) if len(n) else n, 1.0), len(words)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _logits(at: np.ndarray, x: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row's sums; no row is without the constant."""
    return np.add.reduceat(x[:, None] * weights[at], starts, axis=0)


def features(rows: DataFrame, text: str, label: str, classes: Sequence[str]) -> DataFrame:
    """(y, at, x) of the rows whose label is one of the classes; computed once and kept."""
    y = F.coalesce(*(F.when(F.col(label) == c, F.lit(i)) for i, c in enumerate(classes)))
    wanted = rows.select(y.cast("int").alias("y"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("y is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [grams.of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["y", "at", "x"])

    return kept(wanted.mapInArrow(run, "y int, at array<int>, x array<double>"), "features")


def _summed(rows: DataFrame, width: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of `part`(y, buckets, values, starts), an array of BUCKETS + 1 rows and `width` columns.

    A task adds up its batches; tasks are added up by bucket, in a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS + 1, width))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):  # a few times a slice's values are held, not a whole batch's
                y, at, x = batch.slice(start, ROWS).columns
                sizes = at.value_lengths().to_numpy(zero_copy_only=False)
                total += part(y.to_numpy(), at.flatten().to_numpy(), x.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)[:-1])))
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, j]) for j in range(width))], names=["bucket", *(f"v{j}" for j in range(width))])

    names = [f"v{j}" for j in range(width)]
    got = rows.mapInArrow(run, "bucket long, " + ", ".join(f"{n} double" for n in names)).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((BUCKETS + 1, width))
    out[got.column("bucket").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], axis=1) if got.num_rows else 0
    return out


def fit(rows: DataFrame, text: str, label: str, classes: Sequence[str] = scoring.LABELS, steps: int = STEPS) -> Model:
    """A model of `label` (rows of other labels, or none, are left out), trained on all rows in `steps` passes."""
    data, k = features(rows, text, label, classes), len(classes)
    sizes = {r.y: r["count"] for r in data.groupBy("y").count().collect()}
    n = sum(sizes.values())
    weights = np.zeros((BUCKETS + 1, k))
    if not n:
        return Model(tuple(classes), weights)
    balance = np.array([n / (k * sizes[i]) if sizes.get(i) else 0.0 for i in range(k)])
    square = _summed(data, 1, lambda y, at, x, starts: np.bincount(at, x * x, BUCKETS + 1)[:, None]) / n + SHRINK
    shared, moved = data.sparkSession.sparkContext, np.zeros_like(weights)
    for _ in range(steps):
        now = shared.broadcast(weights)

        def slope(y, at, x, starts, now=now):
            off = softmax(_logits(at, x, starts, now.value))
            off[np.arange(len(y)), y] -= 1
            off *= balance[y][:, None]
            spread = np.repeat(off, np.diff(np.append(starts, len(at))), axis=0) * x[:, None]
            return np.stack([np.bincount(at, spread[:, j], BUCKETS + 1) for j in range(k)], axis=1)

        moved = MOMENTUM * moved - RATE * (_summed(data, k, slope) / n + SHRINK * weights) / square
        weights = weights + moved
        now.unpersist()
    return Model(tuple(classes), weights, n)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of an artefact: those whose description, written last, is there."""
    fs, at = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    whole = lambda n: fs.exists(_fs(spark, f"{path}/{n}/about/_SUCCESS")[1])
    return sorted(int(n[2:]) for n in names if re.match(r"v=\d+\Z", n) and whole(n))


def save(spark: SparkSession, model: Model, path: str) -> int:
    """Write the model as the artefact's next version, which it returns: weights first, the description last."""
    version = max(versions(spark, path), default=-1) + 1
    rows = [(i, [float(v) for v in w]) for i, w in enumerate(model.weights) if w.any()]
    spark.createDataFrame(rows, "bucket int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/v={version}/weights")
    about = {"format": FORMAT, "classes": model.classes, "buckets": BUCKETS, "rows": model.rows, "stored": len(rows)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/v={version}/about")
    return version


def open_model(spark: SparkSession, path: str, version: int | None = None) -> Model:
    """A stored model: the latest version unless one is named."""
    there = versions(spark, path)
    if not there or (version is not None and version not in there):
        raise ValueError(f"{path} has no version {'at all' if version is None else version}")
    version = there[-1] if version is None else version
    about = json.loads(spark.read.text(f"{path}/v={version}/about").first()[0])
    if about["format"] != FORMAT or about["buckets"] != BUCKETS:
        raise ValueError(f"{path}/v={version} has another format: {about}")
    weights = np.zeros((BUCKETS + 1, len(about["classes"])))
    rows = spark.read.parquet(f"{path}/v={version}/weights").collect()
    if len(rows) != about["stored"]:
        raise ValueError(f"{path}/v={version} has {len(rows)} of {about['stored']} weights")
    for r in rows:
        weights[r.bucket] = r.weights
    return Model(tuple(about["classes"]), weights, about["rows"], version)


#: The model that this worker has open, by the scorer's name.
_OPEN: dict[str, tuple[Model, Grams]] = {}


def scorer(spark: SparkSession, model: Model, lengths: Callable[[list[str]], np.ndarray] | None = None) -> Callable[[], scoring.Scorer]:
    """What scoring.score() takes: probabilities by the model, token counts by `lengths` (words where it is absent)."""
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def make() -> scoring.Scorer:
        if name not in _OPEN:
            _OPEN.clear()
            _OPEN[name] = shared.value, Grams()
        model, grams = _OPEN[name]

        def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [grams.of(t) for t in texts]
            starts = np.concatenate(([0], np.cumsum([len(f[0]) for f in found])[:-1])).astype(np.int64)
            p = softmax(_logits(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), starts, model.weights))
            return p, lengths(texts) if lengths else np.array([f[2] for f in found], np.int64)

        return run

    return make


def held_out(key: str, tenths: int = 2) -> Column:
    """A fixed fifth or so of the keys, by the first digit of their MD5 (`tenths` of 16 digits and one more)."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 1), 16, 10).cast("int") <= tenths


def agreement(df: DataFrame, keys: Sequence[str], truth: str, predicted: str, classes: Sequence[str] = scoring.LABELS) -> DataFrame:
    """Per keys: n, accuracy, macro F1 over the classes and Cohen's kappa, from one row of counts a group."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    counts = {f"t{i}": is_(truth, c) for i, c in enumerate(classes)} | {f"p{i}": is_(predicted, c) for i, c in enumerate(classes)}
    counts |= {f"b{i}": F.count_if((F.col(truth) == c) & (F.col(predicted) == c)) for i, c in enumerate(classes)}
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in counts.items()))
    every = range(len(classes))
    right = sum((F.col(f"b{i}") for i in every), F.lit(0)) / F.col("n")
    chance = sum((F.col(f"t{i}") / F.col("n") * F.col(f"p{i}") / F.col("n") for i in every), F.lit(0.0))
    f1 = sum((F.coalesce(F.try_divide(2.0 * F.col(f"b{i}"), F.col(f"t{i}") + F.col(f"p{i}")), F.lit(0.0)) for i in every), F.lit(0.0)) / len(classes)
    return got.select(*keys, "n", right.alias("accuracy"), f1.alias("macro_f1"), F.try_divide(right - chance, 1 - chance).alias("kappa"))


def about(model: Model) -> dict:
    """What a report says of a model."""
    return {k: v for k, v in asdict(model).items() if k != "weights"} | {"weights": int(np.count_nonzero(model.weights))}
