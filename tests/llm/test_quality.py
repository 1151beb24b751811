import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import op7_quality as Q


def stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), len(lines)


def features(s):
    n, chars, symbols, dup, rep, lines = s
    return [min(50.0, chars / max(1, n)), math.sqrt(symbols / (chars + 1)), math.sqrt(dup / (lines + 1)), math.sqrt(rep / (n + 1))]


def _texts():
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    rows = []
    for i in range(260):
        words = rng.choices(vocab, k=rng.randint(40, 200))
        if i % 20 == 3:
            words = [w + "$%" for w in words]
        if i % 20 == 7:
            words = words[:30] * 4
        text = " ".join(words)
        if i % 4:
            text = text.replace(" a", "\na")
        rows.append((i, text, ["en", "de", None][i % 7 % 3], f"s{i % 2}", i))
    rows += [(900, None, "en", "s0", 0), (901, "", None, None, 0), (902, " \n\t\n ", "en", "s1", 0), (903, "a b c a b c a b c", "fr", "s9", 0), (904, "é ü x\u0001y #\n#\n#\n", "fr", "s9", 0), (5, rows[9][1], "en", "s0", 5), (905, "long word " * 30000, "en", "s0", 0)]
    return rows


def test_statistics(spark):
    rows = _texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cell int")
    got = sorted(tuple(r) for r in Q.statistics(df).select("doc_id", *Q.STATS).collect())
    assert got == sorted((r[0], *stats(r[1])) for r in rows)


def mcd(x):
    """The same minimum covariance determinant in numpy, over all starts and steps."""
    floor = np.diag(np.square(Q.FLOORS))

    def concentrate(mid, cov):
        d2 = np.einsum("ij,jk,ik->i", x - mid, np.linalg.inv(cov), x - mid)
        bins = np.floor(np.log2(d2 + 1e-9) * Q.FINE)
        keep = x[bins <= np.sort(bins)[math.ceil(Q.SUBSET * len(bins)) - 1]]
        mid = keep.mean(axis=0)
        cov = Q.CONSISTENCY * ((keep - mid).T @ (keep - mid) / len(keep)) + floor
        return np.linalg.slogdet(cov)[1], mid, cov

    grid = np.sort(np.floor(x * Q.GRID), axis=0) / Q.GRID
    lo, mid, hi = (grid[math.ceil(q * len(x)) - 1] for q in (0.25, 0.5, 0.75))
    s = np.sqrt(((hi - lo) / 1.349) ** 2 + np.square(Q.FLOORS))
    z = (x - mid) / s
    t, norm = np.tanh(z), np.linalg.norm(z, axis=1, keepdims=True)
    u = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
    tt = t.T @ t / len(x)
    root = np.sqrt(np.maximum(np.diag(tt), 1e-12))
    corr = tt / np.outer(root, root)
    np.fill_diagonal(corr, 1.0)
    shapes = [(mid, np.eye(4)), (mid + z.mean(axis=0) * s, np.cov(z.T, bias=True)), (mid, corr), (mid, 4 * u.T @ u / len(x))]
    ends = []
    for centre, shape in shapes:
        best = (math.inf, centre, shape * np.outer(s, s) + floor)
        while (got := concentrate(*best[1:]))[0] < best[0] - 1e-9:
            best = got
        ends.append(best)
    _, mid, cov = min(ends, key=lambda e: round(e[0], 6))
    d2 = np.einsum("ij,jk,ik->i", x - mid, np.linalg.inv(cov), x - mid)
    keep = x[d2 <= Q.REWEIGHT_AT]
    mid = keep.mean(axis=0)
    return mid, Q.REWEIGHT_CONSISTENCY * ((keep - mid).T @ (keep - mid) / len(keep)) + floor


@pytest.mark.parametrize("few", [20_000, 0])
def test_verdicts_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "BROADCAST_CELLS", few)
    rows = _texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cell int")
    got = {(r.doc_id, r.n_words, r.distance, r.kept, r.base_failed) for r in Q.verdicts(df).collect()}
    s = [stats(r[1]) for r in rows]
    failed = [v[0] < 50 or 100 * v[4] > 50 * v[0] for v in s]
    x = np.array([features(v) for v in s])
    cell = [(r[2], r[3]) for r in rows]
    size = Counter(c for c, f in zip(cell, failed, strict=True) if not f)
    models = {c: mcd(x[[k == c and not f for k, f in zip(cell, failed, strict=True)]]) for c, n in size.items() if n >= Q.LEAST_CELL}
    every = mcd(x[[not f for f in failed]])
    by_id = {(g[0], g[1]): g for g in got}
    assert any(g[3] for g in got) and any(not g[3] and not g[4] for g in got)
    for r, v, f, row, c in zip(rows, s, failed, x, cell, strict=True):
        g = by_id[r[0], v[0]]
        assert g[4] == f
        if f:
            assert g[2] is None and not g[3]
        else:
            mid, cov = models.get(c, every)
            d2 = float((row - mid) @ np.linalg.inv(cov) @ (row - mid))
            assert g[2] == pytest.approx(d2, rel=1e-6, abs=2e-3)
            assert g[3] == (d2 <= Q.CUTOFF)


def test_keep_good_keeps_columns(spark):
    df = spark.createDataFrame(_texts(), "doc_id long, text string, lang string, source string, cell int")
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    want = sorted(r.doc_id for r in Q.verdicts(df).where("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert Q.keep_good(df.limit(0)).count() == 0 and Q.verdicts(df.limit(0)).count() == 0


def test_masked_outliers_do_not_hide():
    """A fifth of a cell lies together far away: the determinant must settle on the others, from whichever start."""
    rng = np.random.default_rng(4)
    clean, far = rng.normal([5, 0.1, 0.1, 0.1], [0.4, 0.03, 0.05, 0.05], (240, 4)), rng.normal([12, 0.9, 0.6, 0.6], [0.1, 0.01, 0.02, 0.02], (60, 4))
    mid, cov = mcd(np.abs(np.concatenate((clean, far))))
    d2 = np.einsum("ij,jk,ik->i", far - mid, np.linalg.inv(cov), far - mid)
    assert np.abs(mid - clean.mean(axis=0)).max() < 0.1 and d2.min() > Q.CUTOFF
