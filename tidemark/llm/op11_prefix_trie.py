"""Conversation prefix trie: what conversations share, rolled up to every prefix by pointer jumping.

Conversations are sequences of turns; every distinct sequence of first turns is a node of a trie, whose parent lacks the
last turn. A node's digest is additive: each turn gives four 32-bit lanes of a hash of its place and content, and a
prefix's lanes are the sums of its turns' (64-bit sums, which 2^31 turns can't overflow). So prefixes come from sums over
blocks of turns, a conversation of any length spreads over tasks, and a parent's digest is the node's less one turn.

Leaf counts and savings reach all ancestors by doubling: after round k a node holds the sums over descendants less than
2^k steps below it and points to its ancestor 2^k steps above, so a trie of depth d takes log2(d) rounds of two joins.

Defined results: rows without conv_id belong to no conversation and are left out; a null role or text is the empty one;
turns that tie (null turns, which come first, among them) are ordered by the SHA-256 of role and text, and equal rows
count as several turns; an empty table has no node, not even a root. Texts of any length are digested where they are read
and never shuffled. Other columns are ignored, whatever their names. What one task takes whole is the list of ends of one
node, as a stream of runs of 256 ids, since SHA-256 of it can't be split: memory is bounded, time is that of hashing it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import park, unpark

#: Conversations borrow their first turns from the conversation whose id is the next lower multiple of FAMILY.
FAMILY = 20
#: At most so many turns less one.
BORROWED = 4
#: Turns of a conversation that one window takes.
BLOCK = 1024
#: A run of ends: ids that agree but for so many low bits.
RUN_BITS = 8
LANES = 4
_LANES = [f"lane{i}" for i in range(LANES)]
_WORD = r"[^\x20\x09-\x0D]+"


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(x.cast("string") for x in lanes)).cast("binary")))


def _borrowed(conv_id: str) -> Column:
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % BORROWED


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, digest, words): each conversation's turns in order, numbered from 1; parked.

    Ranks are counted within ranges of the order, and what a conversation has in earlier ranges is added.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = park(turns.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only a conversation that crosses into a range has turns before it there: a row a range at most.
    offsets = dealt.groupBy("conv_id", "part").count().withColumn("before", F.sum("count").over(before)).where("before is not null").drop("count")
    ranks = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).cast("long"))
    whole = ranks.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    out = park(whole.select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "digest", "words"), "ranks")
    unpark(dealt)
    return out


def rebuilt(ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, length, digest, words) of every rebuilt conversation, and (conv_id, length) with the turnless ones.

    A conversation's first turns, up to BORROWED - 1, are those of the first one of its family.
    """
    heads = ranks.where((F.col("conv_id") % FAMILY == 0) & (F.col("rank") < BORROWED)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest", "words"))).alias("head"))
    all_of = ranks.groupBy("conv_id").agg(F.max("rank").alias("n")).withColumns({"h": _borrowed("conv_id"), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    convs = all_of.join(heads, "base", "left").withColumn("head", F.when(F.col("head").isNull() | (F.col("h") == 0), F.array()).otherwise(F.slice("head", 1, F.greatest(F.col("h"), F.lit(1)).cast("int"))))
    convs = convs.withColumn("k", F.size("head").cast("long"))
    convs = park(convs.select("conv_id", "h", "k", "head", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    first = convs.select("conv_id", "length", F.posexplode("head").alias("pos", "turn")).select("conv_id", (F.col("pos") + 1).cast("long").alias("pos"), "length", "turn.digest", "turn.words")
    own = ranks.where(F.col("rank") > _borrowed("conv_id")).join(convs.drop("head"), "conv_id")
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("k")).alias("pos"), "length", "digest", "words")
    return first.unionAll(own), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, length, key, parent, words): the node of each prefix of each conversation."""
    place = F.md5(F.concat("digest", F.lit(":"), F.col("pos").cast("string")).cast("binary"))
    lanes = {x: F.conv(F.substring(place, 1 + 8 * i, 8), 16, 10).cast("long") for i, x in enumerate(_LANES)}
    laned = park(turns.withColumns(lanes | {"block": F.floor((F.col("pos") - 1) / BLOCK)}).drop("digest"), "lanes")
    w = Window.partitionBy("conv_id", "block")
    within = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = laned.groupBy("conv_id", "block").agg(*(F.sum(x).alias(x) for x in _LANES))
    offsets = totals.select("conv_id", "block", *(F.sum(x).over(before).alias(f"{x}_before") for x in _LANES)).where("block > 0")
    sums = laned.withColumns({f"{x}_sum": F.sum(x).over(within) for x in _LANES}).join(offsets, ["conv_id", "block"], "left")
    sums = sums.withColumns({f"{x}_sum": F.col(f"{x}_sum") + F.coalesce(f"{x}_before", F.lit(0)) for x in _LANES})
    key = _key(F.col("pos"), [F.col(f"{x}_sum") for x in _LANES])
    parent = _key(F.col("pos") - 1, [F.col(f"{x}_sum") - F.col(x) for x in _LANES])
    return sums.select("conv_id", F.col("pos").alias("depth"), "length", key.alias("key"), parent.alias("parent"), "words")


def _digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the SHA-256 of each key's conv_ids, ascending, comma-joined.

    Ids meet in runs first; a key's runs then pass through one task in order, of which only the hash is kept.
    """
    runs = ends.groupBy("key", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, digests = [], []
            for key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if state is not None:
                        keys.append(now)
                        digests.append(state.hexdigest())
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return ordered.mapInArrow(digest, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(key, *values): each value summed over the node's subtree, by pointer jumping.

    `nodes` has key, parent (null at the top), depth (0 at the top) and the values (long). A round sends each node's sums
    to the node it points to and moves its pointer to that node's own; nodes nearer the top than the next pointer's
    length are through, so no round looks up the top, and lookups shrink as pointers grow.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, step = park(nodes.select("key", F.col("parent").alias("ptr"), "depth", *values), "rollup"), 1
    while step <= deepest:
        sums = now.where("ptr is not null").groupBy(F.col("ptr").alias("key")).agg(*(F.sum(v).alias(f"{v}_below") for v in values))
        there = now.select(F.col("key").alias("ptr"), F.col("ptr").alias("next"))
        on = now.where(F.col("depth") >= 2 * step).join(there, "ptr").select("key", F.col("next").alias("ptr"), "depth", *values)
        through = now.where(F.col("depth") < 2 * step).withColumn("ptr", F.lit(None).cast("binary")).select("key", "ptr", "depth", *values)
        moved = on.unionAll(through).join(sums, "key", "left")
        after = park(moved.select("key", "ptr", "depth", *((F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values)), "rollup")
        unpark(now)
        now, step = after, 2 * step
    return now.select("key", *values)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt `conversations` (conv_id, turn, role, text); all columns but the digest are long.

    conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; root: null), n_convs, n_children, n_leaves
    (childless nodes of the subtree), saved_tokens (over the subtree: members beyond the first times words of the last
    turn), ends_sha256 (of the conversations that end here).
    """
    turns, convs = rebuilt(ranked_turns(conversations))
    levels = park(prefixes(turns), "levels")
    top = F.unhex(F.md5(F.concat_ws(",", *[F.lit("0")] * (1 + LANES)).cast("binary")))
    inner = levels.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(top.alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = park(inner.unionByName(root), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    counted = park(counted.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "nodes")
    unpark(nodes)
    sums = rolled_up(counted, ["n_leaves", "saved_tokens"])
    ends = levels.where("depth = length").select("key", "conv_id").unionAll(convs.where("length = 0").select(top.alias("key"), "conv_id"))
    whole = counted.drop("n_leaves", "saved_tokens").join(sums, "key").join(_digests(ends), "key", "left")
    # The root's children know their parent; the others look theirs up.
    first = counted.where("depth = 0").select(F.col("conv_id").alias("parent_conv_id"))
    near = whole.where("depth = 1").crossJoin(F.broadcast(first))
    far = whole.where("depth > 1").join(counted.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    all_of = whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).unionByName(near).unionByName(far)
    none = hashlib.sha256(b"").hexdigest()
    return all_of.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def oracle_sql() -> str:
    """The trie in DuckDB SQL: prefixes as lists of turn digests, subtrees by their members' paths."""
    return rf"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS rank, digest, words FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL)),
counts AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1),
convs AS (SELECT conv_id, n, conv_id - conv_id % {FAMILY} AS base,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, (x & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % {BORROWED} AS h
  FROM counts),
placed AS (
  SELECT c.conv_id, t.rank AS pos, digest, words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.rank <= c.h
  UNION ALL
  SELECT c.conv_id, t.rank - c.h + least(c.h, coalesce(b.n, 0)) AS pos, digest, words
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.rank > c.h LEFT JOIN counts b ON b.conv_id = c.base),
paths AS (
  SELECT conv_id, pos AS depth, words, md5(array_to_string(list(digest) OVER (PARTITION BY conv_id ORDER BY pos), ',')) AS key FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
linked AS (SELECT *, lag(key) OVER w AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM linked GROUP BY key, depth),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
own AS (SELECT n.*, coalesce(c.n, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes n LEFT JOIN children c ON c.key = n.key),
sums AS (SELECT p.key, sum(CAST(o.n_children = 0 AS BIGINT)) AS n_leaves, sum(o.saved) AS saved_tokens FROM own o JOIN paths p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY 1)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, CAST(o.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN sums s ON s.key = o.key LEFT JOIN nodes p ON p.key = o.parent"""
