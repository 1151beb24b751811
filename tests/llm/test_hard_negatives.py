import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import op12_hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """All scores, in whole numbers of any size."""
    kept = []
    for vec_id, x, label in rows:
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            q = [math.floor(256 * float(np.float32(v))) for v in x]
            kept.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, q))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, (a, label, q) in enumerate(kept):
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(q, r, strict=False)), v, lab) for j, (v, lab, r) in enumerate(kept) if j != i]
        for score, positive, _ in sorted((t for t in scored if t[2] == label), key=order)[:5]:
            hard = [t for t in scored if t[2] != label and 30 * score <= 100 * t[0] <= 90 * score]
            out += [(a, positive, rank, t[1], score, t[0]) for rank, t in enumerate(sorted(hard, key=order)[:10], 1)]
    return sorted(out, key=str)


def table(n, seed=0, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (10, dims))
    rows = []
    for i in range(n):
        label = int(rng.integers(10)) if rng.random() > 0.3 else 4  # a label with a third of the rows
        rows.append((i, [float(np.float32(v)) for v in centres[label] + rng.normal(0, 0.15, dims)], label))
    return rows


def run(spark, rows, schema=SCHEMA, **kw):
    return sorted((tuple(r) for r in H.mine(spark.createDataFrame(rows, schema).repartition(4), **kw).collect()), key=str)


def test_equals_brute_force_and_sql(spark, monkeypatch):
    monkeypatch.setattr(H, "SAMPLE", 300)
    rows = table(700)
    rows += [(701, None, 1), (702, rows[0][1], None), (703, [float("nan")] * 12, 2), (704, [None] + [0.1] * 11, 2), (800, [float("inf")] * 12, 3)]
    rows += [(None, rows[100][1], rows[200][2]), (705, rows[300][1], rows[300][2]), (706, rows[5][1], rows[5][2])]  # no id; copies, whose scores tie
    rows += [(900, [0.0] * 12, 4), (1000, [], 4), (1001, rows[1][1][:5], 6), (1002, rows[1][1] + [0.5], 6), (1100, [-v for v in rows[0][1]], 4)]
    want = brute(rows)
    assert run(spark, rows) == want and len(want) > 200
    assert run(spark, rows, group_size=3) == want
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"vec_id": "Int64", "label": "Int64"})
    con = duckdb.connect()
    con.register("frame", embeddings)
    con.execute("create view embeddings as select vec_id, cast(embedding as float[]) as embedding, label from frame")
    got = con.execute(H.oracle_sql()).fetchall()
    assert sorted(got, key=str) == want


def test_few_rows_and_columns_of_other_names(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0, 2.0], 1)]) == []
    rows = [(100, [1.0, 2.0], 1, "x", 1), (3, [1.0, 2.0], 1, None, 2), (4, [0.5, 1.0], 2, "y", 3)]
    assert run(spark, rows, SCHEMA + ", codes string, anchor long") == brute([r[:3] for r in rows]) != []


def test_repeated_anchors_each_have_their_rows(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (101, [0.5, 0.0], 2)]
    assert run(spark, rows) == brute(rows) == [(100, 100, 1, 101, 65536, 32768)] * 2


def test_bounds_hold(spark):
    """No true score lies outside of its bounds, whatever the size of the numbers."""
    rng = np.random.default_rng(2)
    for scale in (1, 300, 1 << 27):
        vectors = rng.integers(-scale, scale + 1, (500, 16))
        books = H.fit(vectors[:256])
        codes, reach = H.encode(vectors, books)
        block = type("Rows", (), {"uid": np.arange(500), "codes": codes, "reach": reach})
        sums, off = H._bounds(block, vectors[:20], books)
        true = vectors[:20].astype(object) @ vectors.T.astype(object)
        assert (np.abs(true.astype(float) - sums) <= off).all()


@pytest.mark.parametrize("n", [5, 6])
def test_bounds_prune(n):
    """Most rows of spread-out data are never scored exactly."""
    rng = np.random.default_rng(n)
    vectors = rng.normal(0, 60, (4000, 32)).astype(np.int64)
    codes, reach = H.encode(vectors, H.fit(vectors[:2000]))
    block = type("Rows", (), {"uid": np.arange(4000), "codes": codes, "reach": reach})
    sums, off = H._bounds(block, vectors[:1], H.fit(vectors[:2000]))
    floor = np.partition(sums[0] - off[0], -H.POSITIVES)[-H.POSITIVES]
    assert ((sums + off)[0] >= floor).mean() < 0.2
