import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import golay
from tidemark.llm import op6_simhash as S

WORDS = [f"w{i}" for i in range(400)]


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_golay_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    index = golay.decode(words)
    for flips in ([], [3], [0, 22], [5, 9, 17]):
        # a codeword with three flips or fewer decodes to itself
        code = words ^ 0
        low, high, errors = golay._tables()
        code = (words.astype(np.uint32) ^ errors[low[words & 0xFFF] ^ high[words >> 12]]).astype(np.int64)
        noisy = code
        for b in flips:
            noisy = noisy ^ (1 << b)
        assert (golay.decode(noisy) == index).all()
    assert len(np.unique(golay.decode(np.arange(1 << 23)))) == 1 << 12


@pytest.mark.parametrize("flips", range(5))
def test_every_pair_within_four_bits_shares_a_key(flips):
    rng = np.random.default_rng(flips)
    a = rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 400).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, flips, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    of = []
    for x in (a, b):
        sets = [set() for _ in x]
        for who, key in zip(*(v.tolist() for v in S.keys(x)), strict=True):
            sets[who].add(key)
        of.append(sets)
    assert all(p & q for p, q in zip(*of, strict=True))


def _docs():
    rng = random.Random(3)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(60, 200))) for _ in range(60)]
    texts = list(base)
    for t in base[:25]:
        words = t.split()
        for _ in range(3):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    texts += [base[0]] * 40 + [None, "", " \n", "one", "one two", "Straße Über ÄÖÜ é", "A B C D", "a b c d", "x " * 5000]
    return [(i, t, "extra") for i, t in enumerate(texts)] + [(7, base[7], "twice"), (None, base[3], "no id")]


def test_against_brute_force(spark):
    rows = _docs()
    found = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, print string")).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    want = sorted(zip([r[0] for r in rows], prints, brute_components([r[0] for r in rows], prints), strict=True), key=str)
    got = sorted(((r.doc_id, r.print & (2**64 - 1), r.component_id) for r in found), key=str)
    assert got == want


def test_deduplicate_keeps_one_of_each(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = S.deduplicate(df).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    comp = brute_components([r[0] for r in rows], prints)
    stay = {r[0] for r, c in zip(rows, comp, strict=True) if r[0] is not None and r[0] == c}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(stay)
    assert sum(r.doc_id is None for r in kept) == 1
    assert kept[0].__fields__ == ["doc_id", "text", "component_id"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    assert S.deduplicate(empty).count() == 0


def test_large_buckets_are_compared_whole():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**62, 3, dtype=np.int64).astype(np.uint64)
    prints = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) for s in seeds]))
    assert len(prints) > S.BLOCK
    assert len(S.links(prints)) == len(prints) - 3


@pytest.mark.parametrize("hot", [1 << 14, 40, 3])
def test_hot_buckets_are_dealt_again(spark, hot):
    """Links of dense groups under any limit: the same components as by comparing all pairs."""
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 2**62, 6, dtype=np.int64).astype(np.uint64)
    prints = [int(s) for s in seeds]
    for s in seeds:
        for _ in range(60):
            bits = rng.choice(64, rng.integers(0, 5), replace=False)
            prints.append(int(s) ^ sum(1 << int(b) for b in bits))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = S.linked(spark.createDataFrame([(p,) for p in signed], "print long"), hot).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in found)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        a, b = sorted((find(r.a & (2**64 - 1)), find(r.b & (2**64 - 1))))
        root[b] = a
    want = brute_components(list(range(len(prints))), prints)
    groups = lambda of: {frozenset(i for i in range(len(prints)) if of[i] == g) for g in set(of)}
    assert groups([find(p) for p in prints]) == groups(want)


def test_a_million_prints_under_one_key_flow_on():
    """The verifier holds HOT prints of a bucket, however many come."""
    import pyarrow as pa

    n, sizes = 1_000_000, []

    def batches():
        for at in range(0, n, 10_000):
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.full(10_000, 5)), "print": pa.array(np.arange(at, at + 10_000))})
        yield pa.RecordBatch.from_pydict({"key": pa.array(np.array([6, 6])), "print": pa.array(np.array([1, 2]))})

    out = list(S.verifier(S.HOT)(batches()))
    sizes = [b.num_rows for b in out]
    assert sum(b.num_rows for b in out if b.column(2)[0].as_py()) == n and max(sizes) <= S.HOT + 20_000
    assert [(r["a"], r["b"]) for b in out for r in b.to_pylist() if not r["again"]] == [(1, 2)]
    dealt = [S.dealer(1)(iter([b.select(["a", "b"])])) for b in out[:3]]
    assert sum(b.num_rows for d in dealt for b in d) == 5 * sum(sizes[:3])


def test_clashing_names_pass(spark):
    rows = [(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 1, 2, 3, 4), (3, "other words here", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone int, __key int, id int, row int")
    kept = S.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
