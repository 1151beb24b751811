"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits, each set if set in over half the XXH64 hashes of its shingles. Two fingerprints
link at `MAX_BITS` or fewer differing bits. To find every link without comparing all pairs, a fingerprint is cut into
three segments (22, 21 and 21 bits), each read as a Golay word and decoded to the indices of the nearby codewords.
Of four errors or fewer over three segments, either

* some segment has none: then some other has two at most, so the pair shares the key (that segment's bits, one of the
  other's nearby indices), or
* two have one each and the third one or two: then the pair shares (first's own index, second's nearby index, the
  third's bits in one of three parts), where either fingerprint takes the side that holds its own index first.

Every pair within four bits meets under such a key; each meeting is verified by counting differing bits. Only distinct
fingerprints take part, so copies cost one row each. A key with over `HOT` fingerprints is streamed on to another round
under finer keys: four errors leave one of five parts of the bits untouched, so its fingerprints are dealt again by each
part of a fresh arrangement of bits, round after round, until no bucket is large. No task holds more than `HOT` of them.

Null and empty texts have fingerprint 0 and link like any other. Rows with equal doc_id stay rows of their own; a null
doc_id gets a component but never names one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import park, unpark
from .components import components
from .golay import decode, near
from .near_copies import near_copy_links

SEED, SHINGLE, MAX_BITS = 42, 4, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
#: Fingerprints of a bucket that are compared in one task, in rows of BLOCK; larger buckets are dealt again.
HOT, BLOCK = 1 << 14, 1024

#: Spreads a byte's bits over the eight bytes of a word, so that one addition counts eight bits.
_SPREAD = np.array([sum(1 << (8 * k) for k in range(8) if v >> k & 1) for v in range(256)], np.uint64)


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of `hashes` (uint64); 0 for none."""
    counts = np.zeros(64, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 255):  # 255: a byte's count can't overflow
        counts += _SPREAD[octets[at : at + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one whole text (UTF-8 bytes)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -SHINGLE].tolist()]
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    return bit_majority(np.array(hashes, np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *others, texts = batch.columns
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*others, pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, print): one row per row of `docs`, the fingerprint as a signed long; with text_key before it if `keyed`."""
    keys_of = [text_key(text_col).alias("text_key")] if keyed else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys_of, F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_key long, print long" if keyed else "doc_id long, print long")


def text_key(text_col: str) -> Column:
    """Tells rows that share an id apart by their text."""
    return F.xxhash64(F.col(text_col).cast("binary"))


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `prints` (uint64) and the search keys they emit."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    around = [near(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    own = [decode(p).astype(np.int64) for p in parts]
    owners, found, tag = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:  # segment i without error, segment j with two at most
                who, index = around[j]
                owners.append(who)
                found.append(parts[i][who] << 12 | index | tag << 48)
                tag += 1
    for i, j, k in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):  # i and j with one error each, k with two at most
        bits = SEGMENTS[k][1]
        for low, high in ((0, 7), (7, 14), (14, bits)):
            part = (parts[k] >> low) & ((1 << (high - low)) - 1)
            for own_at, near_at in ((i, j), (j, i)):
                who, index = around[near_at]
                first, second = (own[own_at][who], index) if own_at == i else (index, own[own_at][who])
                owners.append(who)
                found.append(part[who] << 24 | first.astype(np.int64) << 12 | second.astype(np.int64) | tag << 48)
            tag += 1
    return np.concatenate(owners), np.concatenate(found)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            prints = batch.column(0).slice(at, 2048).to_numpy(zero_copy_only=False).view(np.uint64)
            who, key = keys(prints)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[who].view(np.int64))], names=["key", "print"])


def links(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct `prints`: as many links as connect what is connected."""
    n = len(prints)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for at in range(0, n, BLOCK):
        rows = prints[at : at + BLOCK]
        for to in range(at, n, BLOCK):
            a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ prints[None, to : to + BLOCK]) <= MAX_BITS)
            for x, y in zip((a + at).tolist(), (b + to).tolist(), strict=True):
                if x < y and (p := find(x)) != (q := find(y)):
                    root[q] = p
                    out.append((int(prints[x]), int(prints[y])))
    return out


def verifier(hot: int):
    """A function from rows (key, print) sorted by key to the links of each bucket, as (a, b, false).

    Of buckets over `hot` rows come the rows themselves, as (key, print, true), for another round.
    """

    def out(pairs: np.ndarray, again: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), again))], names=["a", "b", "again"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        rest_key, rest, held, flowing = 0, [], 0, False  # the bucket at the last batch's end

        def forest(buckets: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal known
            found = []
            for prints in buckets:
                members = np.unique(prints.view(np.uint64))
                if len(members) > 1:
                    fresh = [e for e in links(members) if e not in known]
                    found += fresh
                    known.update(fresh)
            if len(known) > 1 << 18:
                known = set()
            return out(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), False)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            head = int(np.searchsorted(key, rest_key, "right")) if held else 0
            if head:
                rest.append(prints[:head])
                held += head
            if held and head < len(key):  # the bucket is complete
                if not flowing:
                    yield forest([np.concatenate(rest)])
                rest, held, flowing = [], 0, False
            if head < len(key):
                cut = int(np.searchsorted(key, key[-1]))
                if cut > head:
                    edges = np.flatnonzero(np.diff(key[head:cut])) + 1
                    several = [b for b in np.split(prints[head:cut], edges) if len(b) > 1]
                    if several:
                        yield forest(several)
                rest_key, rest, held = int(key[-1]), [prints[cut:]], len(key) - cut
            if flowing or held > hot:
                flow = np.concatenate(rest)
                rest, flowing = [], True
                yield out(np.stack((np.full(len(flow), rest_key), flow), axis=1), True)
        if rest and not flowing:
            yield forest([np.concatenate(rest)])

    return verify


PARTS = MAX_BITS + 1


def dealer(level: int):
    """A function from rows (key, print) to finer keys: one of five parts of the bits, arranged anew on each level."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.array_split(np.random.default_rng(SEED + level).permutation(64), PARTS)
        masks = [np.uint64(sum(1 << int(b) for b in part)) for part in parts]
        for batch in batches:
            key, prints = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            for i, mask in enumerate(masks):
                mixed = (key * _ODD[0] + np.uint64(i)) * _ODD[1] ^ (prints & mask) * _ODD[2]
                mixed = (mixed ^ mixed >> np.uint64(31)) * _ODD[0]
                yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(prints.view(np.int64))], names=["key", "print"])

    return deal


_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def linked(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints of `prints` (print long) within MAX_BITS of each other."""
    keyed, found, level = prints.select("print").mapInArrow(_emit, "key long, print long"), None, 0
    while True:
        verified = park(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(verifier(hot), "a long, b long, again boolean"), "links")
        own = verified.where("not again").select("a", "b")
        found = own if found is None else found.unionAll(own)
        again = verified.where("again").select(F.col("a").alias("key"), F.col("b").alias("print"))
        if again.isEmpty():
            return found
        level += 1
        keyed = again.mapInArrow(dealer(level), "key long, print long")


def _with_components(docs: DataFrame, id_col: str, text_col: str, near_copies: bool, keyed: bool) -> DataFrame:
    """The rows of fingerprints() with the component's root, a fingerprint, and component_id, its least doc_id."""
    prints = park(fingerprints(docs, id_col, text_col, keyed), "prints")
    first = park(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    found = linked(first)
    if near_copies:
        found = found.unionAll(near_copy_links(docs, text_col, fingerprint))
    root = components(found)
    linked_ones = park(root.join(first, root.node == first.print).select("print", "root", "first_id"), "linked-prints")
    named = linked_ones.groupBy("root").agg(F.min("first_id").alias("component_id"))
    alone = first.join(linked_ones.select("print"), "print", "left_anti").select("print", F.col("print").alias("root"), F.col("first_id").alias("component_id"))
    of_print = park(linked_ones.join(named, "root").select("print", "root", "component_id").unionAll(alone), "print-components")
    unpark(first)
    unpark(linked_ones)
    return prints.join(of_print, "print")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_copies: bool = False) -> DataFrame:
    """(doc_id, print, component_id) for every row of `docs`.

    With `near_copies`, texts whose five-word shingles have a Jaccard of 0.8 or more link too, whatever their bits.
    """
    return _with_components(docs, id_col, text_col, near_copies, False).select("doc_id", "print", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_copies: bool = False) -> DataFrame:
    """The rows of `docs` that stay: one document of each component, one whose id is the component's.

    Of a component's rows that share that id one stays; rows that share an id in different components are decided apart.
    Rows without an id all stay.
    """
    found = _with_components(docs, id_col, text_col, near_copies, True).select("doc_id", "text_key", "root", "component_id")
    components_of = park(found, "components")
    gone = components_of.where("doc_id <> component_id").select("doc_id", "text_key")
    staying = components_of.where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("text_key").alias("stays"), F.count("*").alias("n"))
    repeated = staying.where("n > 1").drop("n")
    some = not repeated.isEmpty()
    if some:
        others = components_of.where("doc_id = component_id").join(repeated, ["doc_id", "root"]).where("text_key <> stays")
        gone = gone.unionAll(others.select("doc_id", "text_key"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"))
    kept = boxed.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    if some:
        kept = kept.where(F.col("id").isNotNull()).dropDuplicates(["id", "key"]).unionAll(kept.where(F.col("id").isNull()))
    return kept.select("row.*")
