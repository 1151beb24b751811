"""Links between near copies: MinHash bands propose pairs, the exact Jaccard of their shingle sets decides.

A text's set holds the hashes of its runs of `SHINGLE` words (the whole text if shorter; words as in the fingerprint).
Two texts link when their sets have a Jaccard of `SIMILAR` or more. Each of `BANDS` keys hashes `ROWS` minima, so a pair
at 0.8 shares none with probability (1 - 0.8^4)^16, about 0.0002, and more alike pairs more rarely. Within a key's bucket
a sketch of two bits of each of `MINIMA` minima drops pairs whose estimate lies far below `SIMILAR`.

Links serve to connect, so a bucket needs no more than what connects it. Buckets up to `SMALL` texts propose all their
pairs. Larger ones first propose a maximum spanning forest by estimate, `BLOCK` texts at a time (each block with the
bucket's first text), which connects a group of near copies in rows in proportion to its size. A second round then takes
the pairs of those buckets that the verified links left apart: texts outside their bucket's largest connected part,
against all its others. So no link between unconnected texts is lost to the estimates' order. Those buckets' texts get
a sketch of WIDE minima first, which tells pairs near the threshold apart more sharply: what is put out and verified are
pairs whose Jaccard may well be `SIMILAR`, not all that share a bucket, and each pair once, in the bucket of the least
key that it shares. What lies apart still meets the bucket's others, in a join that adaptive execution splits where a
bucket is large.

Sets hold 32-bit hashes. Texts without words have no set; equal texts count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import park, unpark
from .components import components

SEED, SHINGLE, SIMILAR = 42, 5, 0.8
MINIMA, BANDS, ROWS, SMALL, BLOCK = 128, 16, 4, 8, 1024
#: Unequal places of MINIMA that a pair may have: a pair at 0.8 has 19.2, with a deviation of 4.1.
MOST = 36
#: The same of the wide sketch: a pair at 0.8 has 153.6, with a deviation of 11.4; as many deviations above as MOST is.
WIDE, MOST_WIDE = 1024, 201

_WIDE_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, WIDE, dtype=np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_FACTORS = _WIDE_FACTORS[:MINIMA]


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The distinct hashes (uint64) of a text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: max(0, len(words) - SHINGLE)].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist() or [len(joined)]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def minima(hashes: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """For each order of the hashes, one a factor, the least (uint32)."""
    least = np.full(len(factors), (1 << 32) - 1, np.uint32)
    for at in range(0, len(hashes), 2048):
        mixed = hashes[at : at + 2048, None] * factors[None, :]
        np.minimum(least, (mixed >> np.uint64(32)).min(axis=0).astype(np.uint32), out=least)
    return least


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, keys, sketches = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            hashes = shingle_hashes(text.as_py())
            if len(hashes):
                least = minima(hashes)
                items.append(item)
                keys.append([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)])
                sketches.append(np.packbits([least & 1, least >> 1 & 1], axis=1).tobytes())
        signed = np.array(keys, np.uint64).reshape(-1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(items) + 1, dtype=np.int32) * BANDS), pa.array(signed))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), lists, pa.array(sketches, pa.binary())], names=["item", "keys", "sketch"])


#: Words of the wide sketch: low bits, then high ones.
WIDE_WORDS = [f"w{i}" for i in range(2 * WIDE // 64)]


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = [minima(shingle_hashes(t.as_py()), _WIDE_FACTORS) for t in batch.column(1)]
        words = np.array([np.packbits([x & 1, x >> 1 & 1], axis=1) for x in least], np.uint8).reshape(len(least), -1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], names=["item", *WIDE_WORDS])


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row for each wanted item (distinct) with its text. Texts that a filter of the items rules out don't move."""
    spark, key = texts.sparkSession, lambda c: F.unhex(F.md5(F.col(c).cast("string").cast("binary")))
    items = park(wanted.select("item", key("item").alias("digest")), "wanted")
    tasks = max(1, spark.sparkContext.defaultParallelism)
    table = bloom.filter_of(items, "digest", bloom.bits_for(items.count()), tasks)
    return texts.where(bloom.might_hold(spark, table, key("item"))).join(items.select("item"), "item", "left_semi").dropDuplicates(["item"])


def unequal(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many of the MINIMA places the sketches (rows of four uint64) differ from `one`."""
    apart = sketches ^ one
    return np.bitwise_count(apart[:, :2] | apart[:, 2:]).sum(axis=1)


def proposed(sketches: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows to verify: all within MOST in small buckets, else a spanning forest of the most alike."""
    n = len(sketches)
    if n <= SMALL:
        return [(a, b) for a, b in combinations(range(n), 2) if unequal(sketches[a : a + 1], sketches[b])[0] <= MOST]
    out, best, parent, now = [], np.full(n, MINIMA + 1), np.zeros(n, np.int64), 0
    done = np.zeros(n, bool)
    for _ in range(n - 1):
        done[now] = True
        apart = unequal(sketches, sketches[now])
        nearer = ~done & (apart < best)
        best[nearer], parent[nearer] = apart[nearer], now
        best[now] = MINIMA + 2
        now = int(best.argmin())
        if best[now] <= MOST:
            out.append((int(parent[now]), now))
    return out


WORDS = [f"x{i}" for i in range(4)]
#: A pair (item, other), or a member of a large bucket with its sketch.
PROPOSED = "item long, other long, key long, " + ", ".join(f"{w} long" for w in WORDS)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both, n = np.array(found, np.int64).reshape(-1, 2), len(found)
    nothing = [pa.nulls(n, pa.int64())] * 5
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *nothing], names=["item", "other", "key", *WORDS])


def _members(key: int, items: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
    words = [pa.array(np.ascontiguousarray(w)) for w in sketches.view(np.int64).T]
    return pa.RecordBatch.from_arrays([pa.array(items), pa.nulls(len(items), pa.int64()), pa.array(np.full(len(items), key)), *words], names=["item", "other", "key", *WORDS])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and item; a key's rows may go over a batch's end. At most BLOCK of a bucket are held."""
    held_key, held = 0, (np.empty(0, np.int64), np.empty((0, 4), np.uint64))
    pivot = None  # the first text of a bucket of which blocks have gone

    def block(items: np.ndarray, sketches: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        """A whole bucket, or a piece of one."""
        nonlocal pivot
        if pivot is not None or not last or len(items) > SMALL:
            if len(items):
                yield _members(held_key, items, sketches)
            first = items[:1], sketches[:1]
            if pivot is not None:
                items, sketches = np.concatenate((pivot[0], items)), np.concatenate((pivot[1], sketches))
            pivot = None if last else pivot or first
        if len(items) > 1:
            yield _pairs([(int(items[a]), int(items[b])) for a, b in proposed(sketches)])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, item = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
        sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, 4)
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            if key[a] != held_key:
                yield from block(*held, True)
                held_key, held = int(key[a]), (item[a:b], sketch[a:b])
            else:
                held = np.concatenate((held[0], item[a:b])), np.concatenate((held[1], sketch[a:b]))
            while len(held[0]) > BLOCK:
                yield from block(held[0][:BLOCK], held[1][:BLOCK], False)
                held = held[0][BLOCK:], held[1][BLOCK:]
    yield from block(*held, True)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, fingerprint, label: str) -> DataFrame:
    """The rows (a, b) of `pairs` whose texts are near copies, with their fingerprints."""

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [t.as_py() for t in batch.column(1)]
            prints = np.array([fingerprint(t) for t in of], np.uint64).view(np.int64)
            sets = [np.unique(shingle_hashes(t).astype(np.uint32)).tobytes() for t in of]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), pa.array(sets, pa.binary())], names=["item", "print", "shingles"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_a, of_b = (batch.column(i).to_pylist() for i in (4, 5))
            near = [jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= SIMILAR for x, y in zip(of_a, of_b, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "print_a", "print_b"]).filter(pa.array(near, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    sets = park(_texts_of(texts, wanted).mapInArrow(with_sets, "item long, print long, shingles binary"), "shingle-sets")
    first = sets.select(F.col("item").alias("a"), F.col("print").alias("print_a"), F.col("shingles").alias("of_a"))
    second = sets.select(F.col("item").alias("b"), F.col("print").alias("print_b"), F.col("shingles").alias("of_b"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "print_a", "print_b", "of_a", "of_b")
    links = park(joined.mapInArrow(decide, "a long, b long, print_a long, print_b long"), label)
    unpark(sets)
    return links


def _met(split: DataFrame, wide: DataFrame) -> DataFrame:
    """(one, two): the pairs that may be near copies, of a text outside its bucket's largest part and one of another part.

    `split` has every member (key, item, root, largest) of buckets in several parts, so whatever buckets two texts of
    different parts share are all there: they meet in the one of the least key alone.
    """
    keys = split.groupBy("item").agg(F.collect_set("key").alias("keys"))
    sketched = split.join(wide.join(keys, "item"), "item")
    one, two = sketched.where("root <> largest").alias("one"), sketched.alias("two")
    half = len(WIDE_WORDS) // 2
    differ = lambda w: F.col(f"one.{w}").bitwiseXOR(F.col(f"two.{w}"))
    unlike = reduce(lambda a, b: a + b, (F.bit_count(differ(low).bitwiseOR(differ(high))) for low, high in zip(WIDE_WORDS[:half], WIDE_WORDS[half:], strict=True)))
    once = (F.col("two.root") == F.col("one.largest")) | (F.col("one.item") < F.col("two.item"))
    here = F.array_min(F.array_intersect("one.keys", "two.keys")) == F.col("one.key")
    met = one.join(two, (F.col("one.key") == F.col("two.key")) & (F.col("one.root") != F.col("two.root")) & once & (unlike <= MOST_WIDE) & here)
    return met.select(F.col("one.item").alias("one"), F.col("two.item").alias("two"))


def _apart(members: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket that `links` leave unconnected, one of them outside the bucket's largest connected part."""
    root = components(links.select("a", "b")).select(F.col("node").alias("item"), "root")
    rooted = park(members.join(root, "item", "left").select("key", "item", F.coalesce("root", "item").alias("root")), "bucket-members")
    largest = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.count("*").alias("parts"))
    split = park(rooted.join(largest.where("parts > 1").drop("parts"), "key"), "split-buckets")
    wide = park(_texts_of(texts, split.select("item").distinct()).mapInArrow(_wide, "item long, " + ", ".join(f"{w} long" for w in WIDE_WORDS)), "wide-sketches")
    pairs = park(_met(split, wide).select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")), "apart")
    for table in (rooted, split, wide):
        unpark(table)
    return pairs


def near_copy_links(docs: DataFrame, text_col: str, fingerprint) -> DataFrame:
    """(a, b): links of fingerprints that connect all texts which are near copies of each other and differ in theirs."""
    texts = docs.select(F.col(text_col).cast("binary").alias("text")).select(F.xxhash64("text").alias("item"), "text")
    sketched = park(texts.mapInArrow(_sketch, "item long, keys array<long>, sketch binary").dropDuplicates(["item"]), "sketches")
    keyed = sketched.select(F.explode("keys").alias("key"), "item", "sketch")
    rows = park(keyed.repartition("key").sortWithinPartitions("key", "item").mapInArrow(_propose, PROPOSED), "proposed")
    unpark(sketched)
    pairs = park(rows.where("other is not null").select(F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b")).distinct(), "pairs")
    links = _verified(pairs, texts, fingerprint, "near-copy-links")
    members = rows.where("other is null").drop("other")
    if not members.isEmpty():
        apart = _apart(members, links, texts)
        fresh = park(apart.join(pairs, ["a", "b"], "left_anti"), "fresh-pairs")
        if not fresh.isEmpty():
            links = links.unionAll(_verified(fresh, texts, fingerprint, "more-near-copy-links"))
        unpark(apart)
        unpark(fresh)
    unpark(pairs)
    unpark(rows)
    return links.where("print_a <> print_b").select(F.col("print_a").alias("a"), F.col("print_b").alias("b")).distinct()
