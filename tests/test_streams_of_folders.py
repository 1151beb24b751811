import datetime as dt
import os

import pytest

from tidemark import plans, registry  # noqa: F401


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of 40 days in four files, the latest days in the oldest file."""
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, dt.datetime(2021, 1, 1) + dt.timedelta(hours=i * 4), i % 7, "ab"[i % 2], float(i)) for i in range(240)]
    for k in range(4):
        part = rows[(3 - k) * 60 : (4 - k) * 60]
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id int, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
        for f in os.listdir(f"{at}/events.parquet"):
            path = f"{at}/events.parquet/{f}"
            if f.endswith(".parquet") and os.path.getmtime(path) > 1_700_000_000:
                os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))
    return at, rows


def test_every_event_of_every_file_is_read(spark, folder):
    at, rows = folder
    assert sorted(r.event_id for r in registry.QUERIES["stream_deduplicated"](spark, at).collect()) == [r[0] for r in rows]


def test_windows_count_every_event(spark, folder):
    at, rows = folder
    got = {(r.day, r.event_type): r.n for r in registry.QUERIES["stream_tumbling"](spark, at).collect()}
    assert len(got) >= 76 and set(got.values()) == {3}


def test_expanding_means_follow_the_time(spark, folder):
    at, rows = folder
    got = {(r.event_type, r.ts): (r.n_before, r.mean_before) for r in registry.QUERIES["stream_expanding"](spark, at).collect()}
    assert len(got) == len(rows)
    for kind in "ab":
        values = []
        for _, ts, _, k, v in rows:
            if k == kind:
                n, mean = got[kind, ts]
                assert n == len(values) and (mean is None if not values else abs(mean - sum(values) / n) < 1e-9)
                values.append(v)
