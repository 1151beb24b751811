import random
import zlib

import numpy as np
import pytest

from tidemark.llm import op8_quality_classifier as C
from tidemark.llm import op9_language as G
from tidemark.llm import op10_toxicity as T

rng = random.Random(6)
SYLLABLES = {"aa": ["ka", "to", "ri", "mu", "ne"], "bb": ["sch", "ein", "ung", "pf", "er"], "cc": ["eau", "que", "ié", "ou", "le"]}


def prose(lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)).replace("ka ", "ka.\n")


def held(doc_id, modulus, value):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == value


def parse(text, data):
    """Greedy longest phrases, by substring search."""
    i = n = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in data:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_parser_equals_substring_search():
    data = {k: G.normal(prose(k, 60)) for k in SYLLABLES}
    parser = G.Parser(data)
    texts = [G.normal(prose(k, rng.randint(1, 30))) + extra for k in SYLLABLES for extra in (b"", b" zzz", "日本".encode())] + [b"", b"q", b"ka" * 500]
    got = parser.phrases(texts)
    for row, text in zip(got.tolist(), texts, strict=True):
        assert row == [parse(text, data[k]) for k in sorted(data)]


def test_language_batches_end_by_bytes(monkeypatch):
    monkeypatch.setattr(G, "BATCH_ROWS", 3)
    monkeypatch.setattr(G, "BATCH_BYTES", 10)
    assert list(G.cuts([4, 4, 4, 50, 1, 1, 1, 1])) == [(0, 2), (2, 1), (3, 1), (4, 3), (7, 1)] and list(G.cuts([])) == []


def test_language_of_long_texts_and_a_repeated_id(spark):
    """Texts of some 200 KB, and an id that thousands of rows share."""
    en, de = "the cat sat on the mat and looked out ", "die katze sitzt auf der matte und schaut "
    ids = [i for i in range(3, 60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de") for i in ids] + [(ids[0], en * 2, "en")] * 3000 + [(1001, en * 5_000, None), (1002, de * 5_000, None)]
    got = {r.doc_id: r.lang_pred for r in G.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)).collect()}
    assert (got[1001], got[1002]) == ("en", "de")


def test_language(spark):
    rows = [(i, prose(k, rng.randint(5, 80)), k if i % 9 else None, "x") for i, k in enumerate(random.Random(1).choices(sorted(SYLLABLES), k=240))]
    truth = {i: k for i, k in enumerate(random.Random(1).choices(sorted(SYLLABLES), k=240))}
    odd = [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "123 $$$", "bb", "x"), (903, "½ ² Ⅷ 五 _", "bb", "x"), (904, "½ ²", "aa", "x"), (905, "12 ka", "aa", "x"), (None, prose("cc", 9), "cc", "x"), (3, prose("aa", 9), "aa", "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = G.predict(df).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in got)
    mine = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.doc_id != 3]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in mine]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902, 904)} == {"und"}
    assert "und" not in {r.lang_pred for r in got if r.doc_id in (903, 905)}  # 五 is a letter as well as a number
    blind = df.withColumn("lang", df.lang.substr(9, 1)).where("false")
    assert G.predict(blind).count() == 0
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in G.predict(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_marginals_equal_enumeration():
    from itertools import product

    r = np.random.default_rng(2)
    e, move, n = r.normal(size=(3, 5)), r.normal(size=(2, 2)), np.array([5, 3, 1])
    p, pairs = C.marginals(e * (np.arange(5)[None] < n[:, None]), move, n)
    total = np.zeros((2, 2))
    for i in range(3):
        z, good = 0.0, np.zeros(n[i])
        seen = np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n[i])):
            w = np.exp(sum(e[i, t] * y[t] for t in range(n[i])) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
            z += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                seen[a, b] += w
        assert p[i, : n[i]] == pytest.approx(good / z)
        assert (p[i, n[i] :] == 0).all()
        total += seen / z
    assert pairs == pytest.approx(total)


def _labelled(n=500):
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 4 == 1
        text = "\n".join(prose("aa", 12) for _ in range(rng.randint(2, 8)))
        if bad:
            text = "\n".join(" ".join(w + "$%&" for w in line.split()) for line in text.split("\n"))
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "nasty"]))
            text = " ".join(words)
        docs.append((i, text, "extra"))
        labels.append((i, int(not bad), int(toxic)))
    odd = [(9000, None, ""), (9001, "", ""), (9002, "\n\n\n", ""), (None, "vile rotten nasty. vile", ""), (3, docs[3][1], "twice"), (9003, "word " * 40000, "")]
    return docs + odd, labels + [(9000, 1, 1), (None, 0, 1), (4, None, None), (5, None, 1)]


def test_quality_and_toxicity(spark):
    docs, labels = _labelled()
    d, y = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels if i is not None and q is not None}
    for model, place, threshold in ((C, 0, 0.3), (T, 1, 0.5)):
        got = model.predict(d, y).collect()
        assert len(got) == len(docs)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == held(r.doc_id, 5, 0) for r in got)
        right = [r.predicted == truth[r.doc_id][place] for r in got if r.held_out and r.doc_id in truth and r.doc_id < 500]
        assert len(right) > 50 and np.mean(right) > 0.97, model
        assert model.predict(d.limit(0), y).count() == 0
        assert len(model.predict(d, y.limit(0)).collect()) == len(docs)


def test_offending_sentences_are_located(spark):
    docs, labels = _labelled()
    d, y = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    text = {r[0]: r[1] for r in docs}
    found = [r for r in T.predict(d, y).collect() if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 4 == 1]
    marked = [any(w in text[r.doc_id][r.worst_start : r.worst_end] for w in ("vile", "rotten", "nasty")) for r in found if r.worst_start is not None]
    assert len(marked) > 100 and np.mean(marked) > 0.97


@pytest.mark.parametrize("n", [1, 2, 3, 5, 50, 257])
def test_long_chains_have_the_same_marginals(n):
    r = np.random.default_rng(n)
    e, move = r.normal(size=n) * 3, r.normal(size=(2, 2))
    p, _ = C.marginals(e[None], move, np.array([n]))
    assert C.long_marginals(e, move) == pytest.approx(p[0], abs=1e-9)


def plain_score(model, text):
    """A document's score line by line: features with their neighbours', enumerated marginals, weights by length."""
    from itertools import product

    x, size, n = C.line_features([text])
    e = x @ model.weights
    z, good = 0.0, np.zeros(len(e))
    for y in product((0, 1), repeat=len(e)):
        w = np.exp(sum(e[t] * y[t] for t in range(len(e))) + sum(model.move[a, b] for a, b in zip(y, y[1:], strict=False)))
        z, good = z + w, good + w * np.array(y)
    return float((good / z * (size + 1)).sum() / (size + 1).sum())


def test_scores_equal_plain_ones(monkeypatch):
    r = np.random.default_rng(3)
    model = C.Field(r.normal(size=3 * C.OWN + 1), r.normal(size=(2, 2)))
    lines = [b"", b"plain words in a line.", b"$$$ %% | <a>", b"ALL CAPS 12 34", b"plain words in a line.", b"x"]
    texts = [b"\n".join(lines[j] for j in r.integers(0, len(lines), r.integers(1, 9))) for _ in range(40)] + [b"", b"\n\n"]
    want = [plain_score(model, t) for t in texts]
    assert model.scores(texts) == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(C, "CELLS", 12)
    monkeypatch.setattr(C, "LONG", 5)
    assert model.scores(texts) == pytest.approx(want, abs=1e-9)
    alone = [float(model.scores([t])[0]) for t in texts]
    assert alone == pytest.approx(want, abs=1e-9)


def test_features_of_lines():
    x, size, n = C.line_features([b"One two two\n#12 a.\n\nOne two two", b"z"])
    assert n.tolist() == [4, 1] and size.tolist() == [11, 6, 0, 11, 1]
    own = x[:, : C.OWN]
    assert own[0] == pytest.approx([0, 0, 1 / 9, 0, 1 / 3, np.log1p(3) / 6, 3 / 8, 0, 1])
    assert own[1] == pytest.approx([1, 2 / 5, 0, 4 / 5, 0, np.log1p(2) / 6, 2.5 / 8, 0, 1])
    assert own[2] == pytest.approx([0, 0, 0, 0, 0, 0, 0, 0, 1]) and own[3, 7] == 1
    assert (x[0, C.OWN : 2 * C.OWN] == 0).all() and (x[1, C.OWN : 2 * C.OWN] == own[0]).all() and (x[1, 2 * C.OWN : -1] == own[2]).all()
    assert (x[3, 2 * C.OWN : -1] == 0).all() and (x[4, C.OWN : -1] == 0).all() and (x[:, -1] == 1).all()


def test_a_text_of_a_million_lines():
    import resource
    import time

    model = C.Field(np.linspace(-1, 1, 3 * C.OWN + 1), np.eye(2))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.monotonic()
    got = model.scores([b"a line\n" * 1_000_000] + [b"one line"] * 63)
    assert time.monotonic() - began < 60 and (got[1:] == got[1]).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kilobytes


def test_noisy_or_of_documents_equals_a_plain_one(spark):
    """Toxicity: sentence by sentence, feature by feature, for scores, counts and places."""
    import math
    import re as regex

    from tidemark.llm import op10_toxicity as T

    model = T.Model({"awful": 1.5, "stink*": 2.0, "vile": 0.7, "stinker": -0.4}, -1.0, 1.3, 0.2)
    texts = ["You are awful. A nice day!\nThis stinks, vile thing", "nothing here", "", "stinker. stinker! awfulness", "AWFUL vile? ok. Vile", "İ awful. fine"]
    for text in texts:
        found, evidence = [], 0.0
        for m in regex.finditer(r"[^.!?\n]+[.!?]*", text):
            words = [w.lower() for w in regex.findall(r"[^\W\d_]+", m[0])]
            own = {f for w in words for f in [w, *(w[:n] + "*" for n in (5, 7) if len(w) >= n)]} & set(model.weights)
            if own:
                p = 1 / (1 + math.exp(1.0 - sum(model.weights[f] for f in own)))
                evidence -= math.log1p(-p)
                found.append((m.start(), m.end(), p))
        got = model.sentences(text)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in found]
        assert [p for *_, p in got] == pytest.approx([p for *_, p in found])
        assert model.score(got) == pytest.approx(1 / (1 + math.exp(-(1.3 * math.log(evidence + 1e-3) + 0.2))))


def test_samples_take_part_of_every_text():
    assert G.shares([5, 100, 100], 65) == [5, 30, 30] and G.shares([], 9) == [] and G.shares([3, 4], 100) == [3, 4]
    assert G.normal("Ab½c 3d² Ⅷ") == b"ab c d "
