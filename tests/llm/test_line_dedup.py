import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import bloom
from tidemark.llm import op13_line_dedup as D

BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "this very line stands in many documents"
ROWS = [
    (1, f"{LONG}\nown line of document one\n{LONG}"),
    (2, f"  {LONG.upper()} \r\nÄ own line of document two\n\nshort\n"),
    (3, f"short\nshort\n\t{LONG}\x0b"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (7, "ninechars\nten chars!\nTEN CHARS!"),
    (8, "ninechars\nten chars!"),
    (9, "ÄÖÜ is not lower-cased "),
    (10, "äöü is not lower-cased "),
    (10, "äöü is not lower-cased \nsecond row of ten\n" + LONG),
    (None, f"{LONG}\nonly nameless documents have this line"),
    (None, "only nameless documents have this line"),
    (12, "\n".join(f"line number {i} of a long text" for i in range(3000))),
    (11, "\n".join(f"line number {i} of a long text" for i in range(0, 6000, 2))),
    (13, "😀😀😀😀😀😀😀😀😀\n😀😀😀😀😀😀😀😀😀😀"),
    (14, "😀😀😀😀😀😀😀😀😀\n😀😀😀😀😀😀😀😀😀😀"),
]


def brute(rows):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    order = lambda i: (i is None, i or 0)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [line for line in lines if len(held.get(key(line), ())) < 2 or min(held[key(line)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force_and_sql(spark):
    got = D.digests(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)
    documents = pd.DataFrame(ROWS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    sql = duckdb.connect().execute(D.oracle_sql()).df()
    rows = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in sql.itertuples()]
    assert sorted(rows, key=str) == brute(ROWS)


@pytest.mark.parametrize("most_bits", [64, 1 << 12])
def test_full_filters_change_nothing(spark, monkeypatch, most_bits):
    """Filters far too small for the keys suspect nearly all of them; the result is the same."""
    monkeypatch.setattr(bloom, "LEAST_BITS", 64)
    got = D.deduplicate(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3), most_bits=most_bits)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.where("doc_id is not null").collect()), key=str) == [r for r in brute(ROWS) if r[0] is not None]


def test_columns_stay_and_an_empty_table_is_no_error(spark):
    rows = [(1, LONG, "k", 5, 1), (2, LONG, None, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n_lines long, maybe long")
    got = {r.doc_id: r for r in D.deduplicate(df).collect()}
    assert set(D.deduplicate(df).columns) == {"doc_id", "text", "key", "maybe", "n_lines", "n_dropped"}
    assert (got[1].text, got[2].text, got[2].n_lines, got[2].n_dropped, got[1].key, got[2].maybe) == (LONG, "", 1, 1, "k", 2)
    assert D.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_pair_knows_what_came_twice():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, (4000, 2)).astype("<u8")
    bits = bloom.bits_for(4000)
    one, parts = bloom.Pair(bits), [bloom.Pair(bits) for _ in range(3)]
    again = keys[:300]
    order = np.concatenate((keys, again))[rng.permutation(4300)]
    for at in range(0, 4300, 500):
        one.add(order[at : at + 500])
        parts[at // 500 % 3].add(order[at : at + 500])
    once, twice = parts[0].once, parts[0].twice
    for p in parts[1:]:
        once, twice = once | p.once, twice | p.twice | (once & p.once)
    assert (once == one.once).all() and (twice == one.twice).all()
    suspected = bloom.has(twice, bloom.places(keys, bits))
    assert suspected[:300].all() and suspected[300:].mean() < 0.05
    assert bloom.has(once, bloom.places(keys, bits)).all()


def test_random_tables(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choice(["alpha", "Beta", "gamma", "x"]) for _ in range(3)) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(5)))) for i in range(200)]
    got = D.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
