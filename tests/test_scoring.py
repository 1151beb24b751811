import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resumable, scoring, tokens, trained

GOOD = ["the harvest was rich and the market calm", "a rich calm day", "calm trade, rich yield", "rich markets stay calm today"]
BAD = ["you foul rotten thing", "rotten foul words again", "a foul rotten day for you", "foul and rotten it stays"]


def rows(spark, copies=3):
    data = [(i, t, "positive") for i, t in enumerate(GOOD * copies)] + [(100 + i, t, "negative") for i, t in enumerate(BAD * copies)]
    data += [(200 + i, t, "neutral") for i, t in enumerate(["table of numbers 1 2 3", "numbers 4 5 6 in a table"] * copies)] + [(300, None, "neutral"), (301, "no class", None), (302, "another", "odd")]
    return spark.createDataFrame(data, "id long, text string, label string").repartition(4)


def test_training_is_gradient_descent_on_all_rows(spark):
    """The distributed steps give the weights that the same steps over one matrix give."""
    df, grams = rows(spark), trained.Grams()
    got = trained.fit(df, "text", "label", steps=7)
    data = df.where(F.col("label").isin(*scoring.LABELS)).collect()
    x, y = np.zeros((len(data), trained.BUCKETS + 1)), np.array([scoring.LABELS.index(r.label) for r in data])
    for i, r in enumerate(data):
        at, v, _ = grams.of(r.text or "")
        x[i, at] = v
    n, balance = len(data), len(data) / (3 * np.bincount(y, minlength=3))
    square, w, moved = (x * x).sum(0)[:, None] / n + trained.SHRINK, np.zeros((trained.BUCKETS + 1, 3)), 0.0
    for _ in range(7):
        off = (trained.softmax(x @ w) - np.eye(3)[y]) * balance[y][:, None]
        moved = trained.MOMENTUM * moved - trained.RATE * (x.T @ off / n + trained.SHRINK * w) / square
        w = w + moved
    assert got.rows == n and np.allclose(got.weights, w, atol=1e-12)


def test_a_step_holds_a_slice_of_a_batch(spark):
    """The work arrays of a step grow with ROWS, not with the rows of an Arrow batch; every row is summed once."""
    n, most = 4 * trained.ROWS + 3, trained.ROWS
    df = spark.range(n).coalesce(1).select(F.lit(0).alias("y"), F.array((F.col("id") % 7).cast("int")).alias("at"), F.array(F.lit(1.0)).alias("x"))

    def part(y, at, x, starts):
        assert len(y) <= most
        return np.bincount(at, x, trained.BUCKETS + 1)[:, None]

    got = trained._summed(df, 1, part)
    assert got.sum() == n and got[:7, 0].tolist() == [len(range(i, n, 7)) for i in range(7)]


def test_it_learns_and_the_artefact_keeps_it(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    model = trained.fit(rows(spark), "text", "label")
    with pytest.raises(ValueError, match="no version"):
        trained.open_model(spark, path)
    assert [trained.save(spark, model, path), trained.save(spark, trained.fit(rows(spark), "text", "label", steps=1), path)] == [0, 1]
    again = trained.open_model(spark, path, 0)
    assert (again.weights == model.weights).all() and again.classes == scoring.LABELS and again.version == 0 and trained.open_model(spark, path).version == 1
    new = spark.createDataFrame([("rotten foul thing",), ("a calm and rich harvest",), ("a table with numbers 7 8",), (None,), ("",)], "text string")
    out = scoring.score(new, "text", trained.scorer(spark, again)).collect()
    assert [r.score_label for r in out[:3]] == ["negative", "positive", "neutral"]
    assert all(abs(r.prob_negative + r.prob_neutral + r.prob_positive - 1) < 1e-12 for r in out) and out[3].token_length == 0
    # A version whose description is missing was not finished, and doesn't count.
    os.makedirs(f"{tmp_path}/model/v=2/weights")
    assert trained.versions(spark, path) == [0, 1]
    with pytest.raises(ValueError, match="no version 2"):
        trained.open_model(spark, path, 2)


def test_no_training_rows(spark):
    model = trained.fit(spark.createDataFrame([], "text string, label string"), "text", "label")
    out = scoring.score(spark.createDataFrame([("x",)], "text string"), "text", trained.scorer(spark, model)).first()
    assert model.rows == 0 and abs(out.prob_neutral - 1 / 3) < 1e-12


def test_agreement(spark):
    df = spark.createDataFrame([("a", "positive", "positive"), ("a", "negative", "positive"), ("a", "neutral", "neutral"), ("a", "negative", "negative")], "k string, t string, p string")
    r = trained.agreement(df, ["k"], "t", "p").first()
    assert r.n == 4 and r.accuracy == 0.75 and r.macro_f1 == pytest.approx((2 / 3 + 1 + 2 / 3) / 3) and r.kappa == pytest.approx((0.75 - 5 / 16) / (11 / 16))


def test_token_lengths_are_the_library_s(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, texts = P.path("word_bpe_49k.json"), ["", "one two", None, "Ünïcode — 東京 text " * 300, "<|endoftext|> spelled", "a\n\n  b"]
    got = {r.i: r for r in tokens.token_lengths(spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3), "text", path, window=100).collect()}
    library = Tokenizer.from_file(path)
    own = library.num_special_tokens_to_add(False)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "").ids) + (0 if own else tokens.SPECIAL)
        assert (got[i].token_length, got[i].kept_length, got[i].was_truncated) == (n, min(n, 100), n > 100)
    lengths = spark.createDataFrame([("x", 5, 5, False), ("x", 900, 512, True)], "k string, token_length long, kept_length long, was_truncated boolean")
    r = tokens.audit(lengths, ["k"]).first()
    assert (r.n, r.n_truncated, r.pct_truncated, r.tokens, r.tokens_lost, r.mean_length, r.longest) == (2, 1, 50.0, 905, 388, 452.5, 900)
    assert tokens.quantiles(lengths, ["k"], [0.5]).first().q == [452.5]


class Killed(RuntimeError):
    pass


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    df = spark.range(0, 1000).withColumn("text", F.concat(F.lit("good "), F.col("id").cast("string"))).repartition(5)
    folder, calls = f"file://{tmp_path}/job", []

    def work(part, kill=None):
        out = scoring.score(part, "text").select("id", "sentiment_score")
        calls.append(sorted(r.id for r in part.select("id").collect()))
        if kill is not None and len(calls) == kill:
            out.write.parquet(f"{folder}/data/00000001-half")  # what a killed attempt leaves
            raise Killed
        return out

    with pytest.raises(Killed):
        resumable.run(df, "id", lambda part: work(part, kill=2), folder, 120)
    assert len(resumable.committed(spark, folder)) == 1 and not resumable.finished(spark, folder)
    first, killed = calls
    plan = resumable.planned(df, "id", folder, 7)  # the plan stays, whatever is asked for later
    assert all(r.n <= 120 for r in plan) and sum(r.n for r in plan) == 1000
    assert resumable.run(df, "id", work, folder, 120) == len(plan) and resumable.finished(spark, folder)
    assert calls[2] == killed and first not in calls[2:]  # the killed range again, the committed one not
    out = resumable.result(spark, folder)
    assert out.count() == 1000 == out.select("id").distinct().count()
    assert resumable.swept(spark, folder) == 1 and resumable.result(spark, folder).count() == 1000
    calls.clear()
    assert resumable.run(df, "id", work, folder, 120) == len(plan) and not calls


def test_two_attempts_at_one_range_commit_once(spark, tmp_path):
    folder = f"file://{tmp_path}/job"
    df = spark.range(10)
    df.write.parquet(f"{folder}/data/00000000-a")
    df.write.parquet(f"{folder}/data/00000000-b")
    assert resumable._commit(spark, folder, {"range": 0, "attempt": "a", "rows": 10})
    assert not resumable._commit(spark, folder, {"range": 0, "attempt": "b", "rows": 10})
    assert resumable.committed(spark, folder)[0]["attempt"] == "a" and resumable.result(spark, folder).count() == 10
    assert json.loads(open(f"{tmp_path}/job/log/00000000").read())["rows"] == 10


def test_an_attempt_that_loses_rows_is_refused(spark, tmp_path):
    df = spark.range(50)
    with pytest.raises(ValueError, match="has 25 rows"):
        resumable.run(df, "id", lambda part: part.where("id % 10 != 3"), f"file://{tmp_path}/lossy", 25)
    assert resumable.committed(spark, f"file://{tmp_path}/lossy") == {}
    assert resumable.run(spark.range(0), "id", lambda p: p, f"file://{tmp_path}/none", 25) == 0


def test_ranges_hold_repeated_keys_together(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(2,)] * 3 + [(None,)], "k long")
    got = sorted((r.low, r.high, r.n) for r in resumable.bounds(df, "k", 10).collect())
    assert sum(n for *_, n in got) == 33 and all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))


def test_lengths_by_words_are_the_tokenizers_own(spark):
    """Whole lengths and cuts from remembered words, against the library on whole texts and its own truncation."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    texts = ["", None, " \n\t ", "It's THE end.  Of (all) things!", "don't\u00a0stop caf\u00e9, na\u00efve; \u00c9t\u00c9! \u4f60\u597d 123 4.5", "<|endoftext|> A b <|endoftext|>", "word " * 700, "a.b,c " * 300 + "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    added = 0 if whole.num_special_tokens_to_add(False) else tokens.SPECIAL
    for window in (12, 512):
        got = {r.i: r for r in tokens.token_lengths(rows, "text", path, window, cut=True).collect()}
        cut = {r.i: r.cut_length for r in tokens.windowed_lengths(rows, "text", path, window).collect()}
        for i, t in enumerate(texts):
            assert got[i].token_length == len(whole.encode(t or "").ids) + added, t
            assert got[i].cut_length == cut[i] == got[i].kept_length, t
