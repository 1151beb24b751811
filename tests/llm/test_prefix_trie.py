import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import pandas as pd

from tidemark.llm import op11_prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node from the contract's words alone."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t for _, _, t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h, rest = crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole = tuple(own.get(rest, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(kids), len(leaves), saved, sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA + ", key string, depth long" if rows and len(rows[0]) > 4 else SCHEMA)
    return sorted((tuple(r) for r in T.trie(df.repartition(parts)).collect()), key=str)


def test_equals_brute_force_and_sql(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d\u00a0e f"])) for c in [*range(0, 64), 7, -5, -20, 400] for t in range(rng.randrange(1, 6))]
    rows += [(None, 1, "user", "lost"), (3, None, "user", "first"), (3, None, "user", "first"), (9, 2, "user", "tie"), (9, 2, "user", "tie two")]
    want = brute(rows)
    assert run(spark, rows) == want
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    got = duckdb.connect().execute(T.oracle_sql()).df().astype(object)
    got = got.where(got.notna(), None)
    assert sorted(((*(None if v is None else int(v) for v in r[:-1]), r[-1]) for r in got[["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]].itertuples(index=False, name=None)), key=str) == want


def test_turnless_empty_and_clashing_columns(spark):
    alone = next(c for c in range(21, 40) if crc32(str(c).encode()) % 4 == 3)
    assert run(spark, [(alone, 1, "user", "gone")]) == brute([(alone, 1, "user", "gone")]) == [(alone, 0, None, 1, 0, 1, 0, sha256(str(alone).encode()).hexdigest())]
    assert run(spark, []) == []
    rows = [(20, 1, "user", "x y", "k", 9), (21, 1, None, None, None, None)]
    assert run(spark, rows) == brute([r[:4] for r in rows])


def test_long_conversations_and_many_copies_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    monkeypatch.setattr(T, "RUN_BITS", 2)
    rows = [(1000, t, "user", f"w{t} " + "long " * 500) for t in range(130)] + [(1001, t, "user", f"w{t} " + "long " * 500) for t in range(100)]
    rows += [(c, 1, "user", "same first turn") for c in range(2000, 2060)]
    assert run(spark, rows, 6) == brute(rows)


def test_rollup_counts_all_descendants(spark):
    """A path of 40 nodes with a fork at each: sums reach the top in log2 rounds."""
    nodes = [(bytes([1, d]), bytes([1, d - 1]) if d else None, d, 1, d) for d in range(40)] + [(bytes([2, d]), bytes([1, d - 1]), d, 1, 0) for d in range(1, 40)]
    got = {bytes(r.key): (r.n, r.v) for r in T.rolled_up(spark.createDataFrame(nodes, "key binary, parent binary, depth long, n long, v long"), ["n", "v"]).collect()}
    for d in range(40):
        assert got[bytes([1, d])] == ((40 - d) + (39 - d), sum(range(d, 40)))
    assert all(got[bytes([2, d])] == (1, 0) for d in range(1, 40))
