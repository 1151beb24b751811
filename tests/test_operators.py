import datetime as dt
import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.functions import text as T
from tidemark.operators import cleaning, frames, joins, panel, quality, scoring, series, summary

D0 = dt.date(2021, 1, 1)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def day(n):
    return D0 + dt.timedelta(n)


@FEW
@given(st.lists(st.integers(0, 120), max_size=12, unique=True), st.dictionaries(st.integers(-20, 130), st.none() | st.integers(0, 9), max_size=12), st.booleans())
def test_asof_equals_brute_force(spark, left, right, strict):
    lf = spark.createDataFrame([(day(d), d) for d in left], "day date, d int")
    rf = spark.createDataFrame([(day(d), v) for d, v in right.items()], "day date, v int")
    got = {r.d: (r.v, r.source_date) for r in joins.asof_join(lf, rf, "day", ["v"], strict=strict).collect()}
    for d in left:
        past = [x for x in right if x < d or (x == d and not strict)]
        want = (right[max(past)], day(max(past))) if past else (None, None)
        assert got[d] == want


def test_asof_carries_rows_not_values(spark):
    calendar = spark.createDataFrame([(day(i),) for i in range(7)], "day date")
    market = spark.createDataFrame([(day(0), None), (day(3), 1), (day(4), 2)], "day date, v int")
    got = [(r.v, r.source_date) for r in joins.asof_join(calendar, market, "day", ["v"]).orderBy("day").collect()]
    assert got == [(None, None)] + [(None, day(0))] * 3 + [(1, day(3))] + [(2, day(4))] * 2
    aged = joins.asof_join(calendar, market, "day", ["v"], allow_age=1).orderBy("day").collect()
    assert [r.v for r in aged] == [None, None, None, None, 1, 2, None]


def test_checked_joins(spark):
    one, twice = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(ValueError, match="repeats keys"):
        joins.checked_join(one, twice, ["k"])
    assert joins.checked_join(twice, one, ["k"], validate="many_to_one").count() == 2
    assert {r.k: r.matched for r in joins.with_indicator(one, twice.limit(1), ["k"]).collect()} == {1: "both", 2: "left_only"}
    assert joins.same_keys(one, one, ["k"]) and not joins.same_keys(one, twice, ["k"])
    with pytest.raises(ValueError, match="other values"):
        joins.append_verified(one, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"], "v")


def test_frames(spark):
    df = spark.createDataFrame([(1.0, float("nan"), "x"), (2.0, float("inf"), "y"), (3.0, 4.0, "z")], "a double, b double, c string")
    assert [r.b for r in frames.null_missing(df).orderBy("a").collect()] == [None, None, 4.0]
    assert frames.listwise(df, ["a", "b"]).count() == 1
    assert frames.resolve_column(df, ["q", "b"]) == "b"
    with pytest.raises(ValueError):
        frames.require_columns(df, ["a", "zz"])
    with pytest.raises(ValueError):
        frames.forbid_columns(df, ["c"])
    assert frames.leaks_target(["ret", "ret_lag_1", "vol"], "ret") == ["ret"]
    assert frames.select_safe(df.withColumn("x_lag_1", F.lit(1)), ["c"], ["lag"]).columns == ["c", "x_lag_1"]


@FEW
@given(st.lists(st.integers(0, 2), min_size=1, max_size=15))
def test_runs(spark, values):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t int, v int")
    got = [(r.run_start, r.run_end, r.run_length, r.run_value) for r in series.runs(df, ["k"], "t", "v").orderBy("run").collect()]
    want, i = [], 0
    while i < len(values):
        j = i
        while j + 1 < len(values) and values[j + 1] == values[i]:
            j += 1
        want.append((i, j, j - i + 1, values[i]))
        i = j + 1
    assert got == want


def test_series_flags(spark):
    df = spark.createDataFrame([("a", day(i), float(p)) for i, p in enumerate([100, 100, 70, 95, 95.5, 0])], "k string, day date, p double")
    out = series.reversal(series.changes(df, ["k"], "day", "p"), ["k"], "day", "p_pct").orderBy("day").collect()
    assert [r.reversal for r in out] == [False, False, True, False, False, False]
    assert out[1].p_return == 0.0 and out[0].p_pct is None
    assert [r.local_median for r in series.local_median(df, ["k"], "day", "p").orderBy("day").collect()][0] == 97.5


def test_status_and_fill(spark):
    rows = [(day(0), 3, 2, 1, 0.5), (day(1), 2, 0, 2, None), (day(2), 0, 0, 0, None), (day(9), 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "day date, raw int, kept int, dropped int, score double")
    out = panel.with_status(df, "raw", "kept", "dropped", F.col("day") < F.lit(day(5)), "n", ["score"]).orderBy("day").collect()
    assert [(r.status[:3], r.n, r.score) for r in out] == [("OBS", 2, 0.5), ("RAW", 0, None), ("GEN", 0, None), ("OUT", None, None)]


def test_moments_known_answer(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9, 20)], "v double")
    r = df.agg(summary.sample_skewness("v").alias("s"), summary.sample_kurtosis("v").alias("k")).first()
    assert r.s == pytest.approx(1.4901199696) and r.k == pytest.approx(1.8954319322)
    d = summary.describe(df.withColumn("g", F.lit("x")), ["g"], ["v"]).first()
    assert (d.p25, d.p50) == (2.0, 4.0)


POSTS = ["Hello <b>bold</b> &amp; &lt;tag&gt; [site](https://x.y/z) www.q.r *em* ~~s~~ `c`", "> quoted\n> more\n\n```code\nblock``` end", "zero​width﻿ &#39;q&#39; &#x41; &copy;", "HTTP://UP.case/x  many   spaces 　nb", None, "", "&amp;lt;"]


def _python_clean(t):
    t = html.unescape(t or "")
    for p, to, fl in (("[​-‍﻿]", "", 0), ("```.*?```", " ", re.S), (r"\[([^\]]+)\]\([^)]+\)", r"\1", 0), (r"https?://\S+", " ", re.I), (r"www\.\S+", " ", re.I), ("<[^>]+>", " ", 0), ("[*_~`]+", "", 0), (r"(?m)^\s*>\s?", "", 0)):
        t = re.sub(p, to, t, flags=fl)
    return re.sub(r"\s+", " ", t).strip()


def test_clean_text(spark):
    df = spark.createDataFrame(list(enumerate(POSTS)), "i int, t string")
    for r in df.select("i", T.clean_text("t").alias("c"), T.letter_count("t").alias("n")).collect():
        assert r.c == _python_clean(POSTS[r.i]), POSTS[r.i]
        assert r.n == sum(c.isalpha() for c in POSTS[r.i] or "")


def test_entities_are_those_of_html(spark):
    """Every named entity, with and without its semicolon, and numeric ones of every kind, as Python's html reads them."""
    from html.entities import html5

    texts = [f"a&{name} b&{name.rstrip(';')}c" for name in html5]
    texts += [f"&#{n};&#{n}x" for n in (0, 1, 9, 11, 13, 31, 65, 127, 128, 129, 150, 159, 160, 233, 55296, 57343, 64976, 65534, 65535, 65536, 128512, 131071, 1114111, 1114112, 99999999999, 4294967361)]
    texts += [f"&#x{n};&#X{n}g" for n in ("0", "41", "80", "e9", "D800", "1F600", "10FFFF", "110000", "100000041", "00000041")]
    texts += ["&", "&&", "&;", "&#;", "&#x;", "&#xg", "& amp;", "&notit;", "&amp;lt;", "&nosuch;", "x&lt", "&" + "a" * 40 + ";", "&lt;&gt;&amp;&quot;", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", T.unescape("t").alias("u")).collect():
        want = None if texts[r.i] is None else html.unescape(texts[r.i])
        assert r.u == want, (texts[r.i], r.u, want)


def test_matching_key_knows_unicode_blanks(spark):
    texts = ["See https://a.b/c\u00a0The REST", "www.x.y\u2003after", "a\u3000b\x1cc\u0085d", "A&amp;B &eacute;"]

    def key(t):
        t = html.unescape(t.lower())
        for p in (r"https?://\S+", r"www\.\S+", r"[^a-z0-9\s]"):
            t = re.sub(p, " ", t)
        return re.sub(r"\s+", " ", t).strip()

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.k for r in df.select("i", T.matching_key("t").alias("k")).collect()} == {i: key(t) for i, t in enumerate(texts)}


def test_cleaning_flags(spark):
    rows = [
        (1, "Title", "some long body text", "", None),
        (2, "Title", "some long body text", "", None),
        (3, "[removed]", "x", "", None),
        (4, "Daily discussion thread", "talk about it", "", None),
        (5, "A post", "use my promo code now", "", "t3_x"),
        (6, "", "ok", "http://a.b", "none"),
    ]
    df = spark.createDataFrame([(*r, "g") for r in rows], "id int, title string, body string, url string, parent string, grp string")
    out = {r.id: r for r in cleaning.flag(cleaning.clean(df, "title", "body"), "title", "body", ["grp"], ["id"], F.col("url"), F.col("parent")).collect()}
    assert [out[i].reason for i in range(1, 7)] == ["retained", "exact_duplicate", "unusable", "recurring_template", "crosspost;promotional", "unusable;link_only"]
    assert out[1].retain and out[6].exclude


def test_scalars(spark):
    df = spark.createDataFrame([("1,234.5", "yes", "2021-02-03", 0.004), ("nan", "0", "03/02/2021", 0.2), ("x", "?", "never", None)], "n string, b string, d string, p double")
    out = df.select(scalar.to_number("n").alias("n"), scalar.to_bool("b").alias("b"), scalar.to_day("d").alias("d"), scalar.stars("p").alias("s"), scalar.p_text("p").alias("t")).collect()
    assert [tuple(r)[:4] for r in out] == [(1234.5, True, dt.date(2021, 2, 3), "***"), (None, False, dt.date(2021, 2, 3), ""), (None, None, None, "")]
    pair = spark.createDataFrame([(1.0, 2.0), (None, None), (None, 1.0), (-1.0, 1.0), (0.0, 1.0)], "a double, b double")
    got = pair.select(scalar.close("a", "b", 1.5).alias("c"), scalar.same_sign("a", "b").alias("s")).collect()
    assert [r.c for r in got] == [True, True, False, False, True] and [r.s for r in got] == [True, None, None, False, None]


def test_quality_gate(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (2, None)], "k int, v double")
    checks = quality.Checks(spark)
    checks.counts(df, {"range": quality.outside("v", 0, 1), "finite": quality.not_finite("v")})
    checks.unique(df, ["k"])
    checks.size(df, 3)
    assert {r.name: r.passed for r in checks.table().collect()} == {"range": False, "finite": True, "unique key": False, "row count": True}
    with pytest.raises(AssertionError, match="range"):
        checks.gate()


def test_scoring(spark):
    df = spark.createDataFrame([(1, "good great"), (2, "bad"), (3, None), (4, "word " * 600)], "i int, t string")
    out = {r.i: r for r in scoring.score(df, "t").collect()}
    assert [out[i].score_label for i in (1, 3)] == ["positive", "neutral"] and out[2].sentiment_score < 0
    assert out[4].was_truncated and all(abs(r.prob_negative + r.prob_neutral + r.prob_positive - 1) < 1e-9 for r in out.values())
