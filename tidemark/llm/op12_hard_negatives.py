"""Hard-negative mining by product quantisation with residual bounds, completed by exact integer scores.

Rows are vectors of whole numbers (each component x becomes floor(256 * x)); a row's score is its inner product with an
anchor. Anchors are the rows whose vec_id is divisible by EVERY. An anchor's positives are its POSITIVES highest-scoring
other rows of the same label; its negatives, for each positive, the NEGATIVES highest-scoring rows of other labels whose
scores are 30 to 90 % of the positive's.

Each pair of components is quantised by a codebook of up to CODES centres, fitted to a sample of rows (SAMPLE, spread by
hash: it bounds the fit; every row is indexed). A row is stored as its codes, the norm of what the codes leave out, and
its components. Per block of anchors a task adds up table look-ups; by Cauchy and Schwarz the true score lies within
anchor norm x residual norm of that sum (rounding included in the stored norm), so rows whose upper bound misses the
window, or the best found so far, are out for certain, and only the rest are scored exactly. No candidate is capped.

Anchors go to the tasks in groups of GROUP (a broadcast of bounded size; a driver loop over groups), and rows stay where
they are stored: nothing shuffles but the best few of each task. So a hot label is as many tasks as any other.

Defined results: rows with a null label or vector, or a null or non-finite component, or one beyond 2**20 (whose products
would leave 64 bits), take no part. Missing components count as 0. Rows of equal vec_id are different rows: each anchor
row has its own results, of which equal ones may be told apart by nothing. A null vec_id is no anchor, keeps its label,
and comes last among equal scores; rows that tie in that too are taken in any one order. A positive of score zero or less
has a window that holds 0 alone, or nothing. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import park

SCALE, LARGEST = 256, 1 << 20
EVERY, SHIFTED, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
#: Components a codebook, centres a codebook, sampled rows, rounds of fitting.
WIDTH, CODES, SAMPLE, ROUNDS = 2, 256, 8192, 6
#: Anchors a broadcast, anchors and rows that are scored together.
GROUP, ANCHORS, ROWS = 8192, 128, 4096
#: Sorts a missing vec_id behind all others.
_LAST = np.iinfo(np.int64).max


def prepared(embeddings: DataFrame) -> DataFrame:
    """(uid, vec_id, label, vector) of the rows that take part, in whole numbers; parked."""
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False)) & ~F.isnan(x))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    label = F.when(F.col("vec_id") % SHIFTED == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    # Written once: from here on the row's number is as fixed as its values.
    return park(rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("vector")), "vectors")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of `dims` numbers, short ones filled up with 0."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False)
    if (ends == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(ends), dims), np.int64)
    out[np.repeat(np.arange(len(ends)), ends), np.concatenate([np.arange(n) for n in ends])] = flat
    return out


def fit(sample: np.ndarray) -> np.ndarray:
    """Codebooks by Lloyd's rounds: [codebook, centre, component]. The start is spread over the sorted sample."""
    parts = sample.reshape(len(sample), -1, WIDTH).astype(float)
    books = np.empty((parts.shape[1], CODES, WIDTH))
    for b in range(parts.shape[1]):
        points = parts[:, b]
        centres = points[np.lexsort(points.T)][np.linspace(0, len(points) - 1, CODES).astype(int)]
        for _ in range(ROUNDS):
            near = _nearest(points, centres)
            size = np.bincount(near, minlength=CODES)
            sums = np.stack([np.bincount(near, points[:, j], CODES) for j in range(WIDTH)], 1)
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        books[b] = centres
    return books


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def encode(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row, and its reach: the residual's norm, with room for rounding."""
    parts = vectors.reshape(len(vectors), -1, WIDTH).astype(float)
    codes = np.empty(parts.shape[:2], np.uint8)
    left = np.zeros(len(vectors))
    for b in range(len(books)):
        codes[:, b] = _nearest(parts[:, b], books[b])
        left += ((parts[:, b] - books[b][codes[:, b]]) ** 2).sum(1)
    residual = np.sqrt(left)
    return codes, residual + 1e-9 * (np.sqrt((parts**2).sum((1, 2))) + residual)


def index(rows: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """The index of all rows (uid, vec_id, label, vector, codes, reach; parked), the codebooks, and the vectors' length."""
    spark = rows.sparkSession
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    dims = max(WIDTH, -(-longest // WIDTH) * WIDTH)
    drawn = rows.select("vector").orderBy(F.xxhash64("uid", F.lit(7))).limit(SAMPLE).toArrow()
    books = fit(_matrix(drawn.column(0).combine_chunks(), dims)) if drawn.num_rows else np.zeros((dims // WIDTH, CODES, WIDTH))
    shared = spark.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, reach = encode(_matrix(batch.column(3), dims), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(reach)], names=[*batch.schema.names, "codes", "reach"])

    return park(rows.mapInArrow(add, "uid long, vec_id long, label long, vector array<int>, codes binary, reach double"), "index"), books, dims


class _Block:
    """Rows of the index as arrays."""

    def __init__(self, batch: pa.RecordBatch, dims: int):
        uid, vec_id, label, vector, codes, reach = batch.columns
        self.uid, self.label = (c.to_numpy(zero_copy_only=False) for c in (uid, label))
        self.vec_id, self.named = vec_id.fill_null(_LAST).to_numpy(zero_copy_only=False), vec_id.is_valid().to_numpy(zero_copy_only=False)
        self.vectors, self.reach = _matrix(vector, dims), reach.to_numpy()
        self.codes = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(self.uid), -1)


def _bounds(block: _Block, anchors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Look-up sums [anchor, row] and how far the true scores may lie from them."""
    parts = anchors.reshape(len(anchors), -1, WIDTH).astype(float)
    sums = np.zeros((len(block.uid), len(anchors)))
    for b in range(len(books)):
        sums += (books[b] @ parts[:, b].T)[block.codes[:, b]]
    return sums.T, np.sqrt((anchors.astype(float) ** 2).sum(1))[:, None] * block.reach[None, :] + 1


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:n]


class _Tops:
    """The best rows found so far of each list: scores and ids, best first."""

    def __init__(self, n: int):
        self.n, self.lists = n, {}

    def least(self, key: tuple) -> float:
        """The score below which nothing enters the list."""
        found = self.lists.get(key)
        return -np.inf if found is None or len(found[0]) < self.n else found[0][-1]

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        if key in self.lists:
            scores, ids, named = (np.concatenate(x) for x in zip(self.lists[key], (scores, ids, named), strict=True))
        keep = _best(scores, ids, self.n)
        self.lists[key] = scores[keep], ids[keep], named[keep]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys := list(self.lists)), 4096):
            part = keys[at : at + 4096]
            sizes = [len(self.lists[k][0]) for k in part]
            lists = [np.repeat(np.array([k[i] for k in part], np.int64), sizes) for i in range(2)]
            scores, ids, named = (np.concatenate([self.lists[k][i] for k in part]) for i in range(3))
            yield pa.RecordBatch.from_arrays([*map(pa.array, lists), pa.array(scores), pa.array(ids, pa.int64(), mask=~named)], names=["anchor", "list", "score", "vec_id"])


def _search(rows: DataFrame, group: list, books: np.ndarray, dims: int, windows: np.ndarray | None) -> DataFrame:
    """(anchor, list, score, vec_id): each task's best rows for each anchor of the group (by its place there).

    Without windows: the same label's best. With windows [anchor, positive, (low, high)]: other labels' best in each.
    """
    anchors = np.zeros((len(group), dims), np.int64)
    for i, a in enumerate(group):
        anchors[i, : len(a.vector)] = a.vector
    shared = rows.sparkSession.sparkContext.broadcast((anchors, np.array([a.label for a in group]), np.array([a.uid for a in group]), books, windows))

    def same(block: _Block, tops: _Tops) -> None:
        anchors, labels, uids, books, _ = shared.value
        for label in np.unique(block.label):
            mine, here = np.flatnonzero(labels == label), np.flatnonzero(block.label == label)
            for at in range(0, len(mine), ANCHORS):
                some = mine[at : at + ANCHORS]
                sums, off = _bounds(block, anchors[some], books)
                for i, a in enumerate(some):
                    rows = here[block.uid[here] != uids[a]]
                    high, low = sums[i, rows] + off[i, rows], sums[i, rows] - off[i, rows]
                    floor = max(tops.least((a, 0)), np.partition(low, -POSITIVES)[-POSITIVES] if len(low) > POSITIVES else -np.inf)
                    rows = rows[high >= floor]
                    if len(rows):
                        tops.add((a, 0), block.vectors[rows] @ anchors[a], block.vec_id[rows], block.named[rows])

    def other(block: _Block, tops: _Tops) -> None:
        anchors, labels, _, books, windows = shared.value
        for at in range(0, len(anchors), ANCHORS):
            sums, off = _bounds(block, anchors[at : at + ANCHORS], books)
            for i in range(len(sums)):
                a = at + i
                apart, high, low = block.label != labels[a], sums[i] + off[i], sums[i] - off[i]
                wanted = np.zeros(len(apart), bool)
                for p, (least, most) in enumerate(windows[a]):
                    if least <= most:
                        inside = low[apart & (low >= least) & (high <= most)]
                        floor = max(least, tops.least((a, p)), np.partition(inside, -NEGATIVES)[-NEGATIVES] if len(inside) > NEGATIVES else -np.inf)
                        wanted |= apart & (high >= floor) & (low <= most)
                rows = np.flatnonzero(wanted)
                if not len(rows):
                    continue
                scores, ids, named = block.vectors[rows] @ anchors[a], block.vec_id[rows], block.named[rows]
                for p, (least, most) in enumerate(windows[a]):
                    hit = (scores >= least) & (scores <= most)
                    if hit.any():
                        tops.add((a, p), scores[hit], ids[hit], named[hit])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = _Tops(POSITIVES if windows is None else NEGATIVES)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                (same if windows is None else other)(_Block(batch.slice(at, ROWS), dims), tops)
        yield from tops.rows()

    found = rows.mapInArrow(best, "anchor long, list long, score long, vec_id long")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "list").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))).where(F.col("rank") <= (POSITIVES if windows is None else NEGATIVES))


def _groups(rows: DataFrame, size: int) -> Iterator[list]:
    """The anchors in groups of `size`: the least uids first."""
    anchors, last = rows.where(F.col("vec_id") % EVERY == 0), -1
    while group := anchors.where(F.col("uid") > last).orderBy("uid").limit(size).select("uid", "vec_id", "label", "vector").collect():
        yield group
        if len(group) < size:
            return
        last = group[-1].uid


def mine(embeddings: DataFrame, group_size: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from `embeddings` (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    rows, books, dims = index(prepared(embeddings))
    out = []
    for group in _groups(rows, group_size):
        positives = _search(rows, group, books, dims, None).select("anchor", "rank", "score", "vec_id").toArrow().to_pydict()
        windows = np.tile(np.array([1, 0], np.int64), (len(group), POSITIVES, 1))
        named = []
        for anchor, rank, score, vec_id in zip(*positives.values(), strict=True):
            windows[anchor, rank - 1] = -(-LOW * score // 100), HIGH * score // 100
            named.append((anchor, rank - 1, group[anchor].vec_id, vec_id, score))
        pairs = spark.createDataFrame(named, "anchor long, list long, anchor_id long, positive_id long, positive_score long")
        found = _search(rows, group, books, dims, windows)
        out.append(park(found.join(F.broadcast(pairs), ["anchor", "list"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    paths = [df._parked_at for df in out]
    return spark.read.schema(out[0].schema).parquet(*paths)


def oracle_sql() -> str:
    """The same in DuckDB SQL, scoring every row against every anchor."""
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, embedding
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND abs(CAST(x AS DOUBLE)) <= {LARGEST})), true)),
v AS (SELECT uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM kept),
scored AS (
  SELECT a.uid AS au, a.vec_id AS anchor_id, r.uid AS ru, r.vec_id, a.label = r.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(r.q)) + 1), lambda i: a.q[i] * r.q[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % {EVERY} = 0 AND a.uid <> r.uid),
positives AS (SELECT au, anchor_id, vec_id AS positive_id, score, row_number() OVER (PARTITION BY au ORDER BY score DESC, vec_id NULLS LAST) AS p FROM scored WHERE same QUALIFY p <= {POSITIVES}),
negatives AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.au, p.p ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.au = p.au AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {NEGATIVES}"""
