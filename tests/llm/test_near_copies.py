import random

import corpus_pipeline
import numpy as np
import pytest

from tidemark.llm import near_copies as N
from tidemark.llm.op6_simhash import deduplicate, fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def _texts(seed=4, families=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(families):
        base = rng.choices(vocab, k=rng.randint(60, 300))
        out.append(" ".join(base))
        for _ in range(rng.randint(1, 3)):
            words = list(base)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
    return out


def _brute_groups(texts):
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            near = brute_jaccard(sets[i], sets[j]) >= N.SIMILAR
            if near or bin(fingerprint(texts[i].encode()) ^ fingerprint(texts[j].encode())).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_the_stage_leaves_no_near_copies(spark, tmp_path):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == set(_brute_groups(texts)) and len(kept) < len(texts)
    sets = [brute_set(texts[i]) for i in sorted(kept)]
    assert all(brute_jaccard(a, b) < N.SIMILAR for k, a in enumerate(sets) for b in sets[:k])


@pytest.mark.parametrize("text", ["", "one", "a b c d", "a b c d e", "a b c d e f", "x " * 5000, "Ä b\tc\nd e f"])
def test_shingle_sets(text):
    assert len(N.shingle_hashes(text.encode())) == len(brute_set(text))


def test_estimates_follow_the_jaccard():
    texts = _texts(9, 30)
    sketch = lambda t: np.packbits([(m := N.minima(N.shingle_hashes(t.encode()))) & 1, m >> 1 & 1], axis=1).reshape(-1).view(np.uint64)
    sketches, sets = np.array([sketch(t) for t in texts]), [brute_set(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if brute_jaccard(sets[i], sets[j]) >= N.SIMILAR]
    assert near and all(N.unequal(sketches[i : i + 1], sketches[j])[0] <= N.MOST for i, j in near)


def test_a_large_bucket_proposes_a_forest():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 62, (3, 4), dtype=np.int64).astype(np.uint64)
    rows = np.repeat(seeds, 100, axis=0)
    rows[:, 0] ^= np.uint64(1) << rng.integers(0, 64, len(rows)).astype(np.uint64)
    pairs = N.proposed(rows)
    assert len(pairs) == len(rows) - 3 and all(a // 100 == b // 100 for a, b in pairs)


@pytest.mark.parametrize("near_copies", [False, True])
def test_rows_that_share_an_id_are_decided_by_their_text(spark, near_copies):
    rng = random.Random(6)
    a, b, c = (" ".join(rng.choices([f"v{i}" for i in range(300)], k=120)) for _ in range(3))
    kept = lambda rows: sorted(map(tuple, deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), near_copies=near_copies).collect()))
    assert kept([(5, a), (5, b), (3, b)]) == sorted([(5, a), (3, b)])
    assert kept([(5, a), (5, b), (5, a)]) == sorted([(5, a), (5, b)])
    shouted = a.upper()
    assert len(kept([(5, a), (5, shouted), (6, a), (5, c)])) == 2


@pytest.mark.parametrize("block", [1024, 12])
def test_large_groups_lose_no_link(spark, tmp_path, monkeypatch, block):
    """Groups of drifting copies far over SMALL: connected as by comparing all pairs, whatever the estimates' order."""
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(12)
    vocab, texts = [f"u{i}" for i in range(400)], []
    for _ in range(4):
        base = rng.choices(vocab, k=200)
        for _ in range(45):
            words = list(base)
            for _ in range(rng.randint(1, 9)):  # around 0.8 of each other
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in deduplicate(docs, near_copies=True).collect()}
    assert kept == set(_brute_groups(texts))


def test_texts_that_share_several_buckets_meet_in_one(spark):
    base = [f"s{i}" for i in range(120)]
    texts = spark.createDataFrame([(i, bytearray(" ".join([*base, f"end{i}"]).encode())) for i in range(1, 5)], "item long, text binary")
    wide = texts.mapInArrow(N._wide, "item long, " + ", ".join(f"{w} long" for w in N.WIDE_WORDS))
    buckets = {-7: (1, 2, 3), 3: (1, 2, 3, 4), 5: (1, 2), 9: (3, 4, 1)}  # the largest part is another in the last
    split = spark.createDataFrame([(k, i, i, own[0]) for k, own in buckets.items() for i in own], "key long, item long, root long, largest long")
    met = [tuple(sorted(r)) for r in N._met(split, wide).collect()]
    assert sorted(met) == [(a, b) for a in range(1, 5) for b in range(a + 1, 5)]
