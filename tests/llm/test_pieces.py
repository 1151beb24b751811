import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import op1_piece_samples as S
from tidemark.llm import queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary(MODEL)


def all_paths(v, text):
    """Every segmentation of the whole text (no chunks) with its log-probability."""
    t = S.marked(text)

    def go(i):
        if i == len(t):
            yield (), 0.0
            return
        options = [(t[i:j], *v.pieces[t[i:j]]) for j in range(i + 1, min(len(t), i + 16) + 1) if t[i:j] in v.pieces]
        if t[i] not in v.pieces:
            ids = [v.byte_ids[b] for b in t[i].encode()]
            options.append((t[i], ids, len(ids) * v.byte_weight))
        for piece, ids, w in options:
            for rest, more in go(i + len(piece)):
                yield (*(ids if isinstance(ids, list) else [ids]), *rest), w + more

    paths = list(go(0))
    z = math.log(sum(math.exp(w) for _, w in paths))
    return {p: w - z for p, w in paths}


def test_probabilities_are_those_of_the_whole_lattice(vocabulary):
    graph = S.Graph(vocabulary)
    for text in ("the cat", "a.b é", "²x", "hi\nyou", "  a"):
        truth = all_paths(vocabulary, text)
        found = S.search(graph, [text], np.array([5], np.uint64), 6)[0]
        assert len({tuple(i.tolist()) for i, *_ in found}) == len(found) == min(6, len(truth))
        for ids, lp, value, inclusion in found:
            assert lp == pytest.approx(truth[tuple(ids.tolist())], abs=1e-9)
            assert 0 <= inclusion <= 1
        values = [v for _, _, v, _ in found]
        assert values == sorted(values, reverse=True)


def test_enumerates_everything_when_asked_for_more(vocabulary):
    graph = S.Graph(vocabulary)
    truth = all_paths(vocabulary, "cat")
    found = S.search(graph, ["cat"], np.array([9], np.uint64), len(truth) + 5)[0]
    assert {tuple(i.tolist()) for i, *_ in found} == set(truth)
    assert all(q == 1.0 for *_, q in found)


def test_late_sets_are_opened(vocabulary, monkeypatch):
    monkeypatch.setattr(S, "OPEN", 2)
    graph = S.Graph(vocabulary)
    truth = all_paths(vocabulary, "the cat")
    found = S.search(graph, ["the cat"], np.array([4], np.uint64), len(truth) + 1)[0]
    assert {tuple(i.tolist()) for i, *_ in found} == set(truth)


@pytest.mark.parametrize("wide", [48, 1])
def test_first_and_second_draws_follow_sampling_without_replacement(vocabulary, monkeypatch, wide):
    monkeypatch.setattr(S, "OPEN", wide)
    graph, n = S.Graph(vocabulary), 12_000
    truth = {k: math.exp(v) for k, v in all_paths(vocabulary, "on it").items()}
    keys = S.mix(np.arange(n, dtype=np.uint64))
    first, pair, included, weighted = Counter(), Counter(), Counter(), 0.0
    for at in range(0, n, 2000):
        for found in S.search(graph, ["on it"] * 2000, keys[at : at + 2000], 2):
            a, b = (tuple(i.tolist()) for i, *_ in found)
            first[a] += 1
            pair[a, b] += 1
            weighted += sum(math.exp(lp) / q for _, lp, _, q in found)
    for path, p in truth.items():
        assert abs(first[path] / n - p) < 5 * math.sqrt(p / n) + 1e-4
    top = max(truth, key=truth.get)
    for path, p in sorted(truth.items(), key=lambda x: -x[1])[1:4]:
        want = truth[top] * p / (1 - truth[top])
        assert abs(pair[top, path] / n - want) < 5 * math.sqrt(want / n) + 1e-4
    assert weighted / n == pytest.approx(1.0, abs=0.05)  # inclusion scores make the weights unbiased


def test_samples_do_not_depend_on_neighbours(vocabulary):
    texts, keys = ["one two three", "", "four  five", "x" * 300, "日本語 text"], np.arange(5, dtype=np.uint64)
    together = S.search(S.Graph(vocabulary), texts, keys, 3)
    for i, t in enumerate(texts):
        alone = S.search(S.Graph(vocabulary), [t], keys[i : i + 1], 3)[0]
        assert [(a.tolist(), round(lp, 9)) for a, lp, *_ in alone] == [(a.tolist(), round(lp, 9)) for a, lp, *_ in together[i]]


def test_decoding_gives_the_text_back(spark):
    texts = ["Hello  world.", None, "", "tab\tand\nline", "émigré ñ 日本 \U0001f600", "a" * 5000, "▁mark"]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rank int")
    samples = S.sample(docs, MODEL, k=2)
    for r in S.decode(samples, MODEL).collect():
        want = (texts[r.doc_id or 0] or "").replace("▁", " ")
        assert r.text == want
    digest = S.sample(docs, MODEL, k=2, digest=True).collect()
    assert all(r.decoded for r in digest)
    assert [(r.rank, r.n_pieces, r.inclusion) for r in digest if r.doc_id == 2] == [(1, 0, 1.0)]
    again = S.sample(docs.repartition(3), MODEL, k=2, digest=True).collect()
    assert sorted(map(str, again)) == sorted(map(str, digest))
    assert S.sample(docs.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("remembered", [200_000, 3])
def test_own_encoding_is_the_librarys(vocabulary, monkeypatch, remembered):
    monkeypatch.setattr(S, "ENCODED", remembered)
    graph, rng = S.Graph(vocabulary), random.Random(3)
    parts = ["a", "the", "The", "ing", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", "..", "²", "é", "e\u0301", "日", "本語", "\U0001f600", "\u200d", "\0"]
    parts += ["<s>", "</s>", "<0x41>", "'s", "--", "23", "٣", "\u3000", "ǅ", "क्", "\ufffd", "//", "();", "▁", "x" * 40]
    texts = ["", "\n", " ", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300))]
    for _ in range(2):  # the second time from memory
        for text, (ids, *_) in zip(texts, S.encode(graph, S.chunks(graph, texts)), strict=True):
            assert ids.tolist() == vocabulary.encoder.encode(text), text
    for text in ("the cat", "a.b é", "hi\nyou"):
        ((ids, log_p, *_),) = S.encode(graph, S.chunks(graph, [text]))
        assert log_p == pytest.approx(all_paths(vocabulary, text)[tuple(ids.tolist())], abs=1e-9)


def test_chunks_used_often_stay_when_others_are_forgotten(vocabulary, monkeypatch):
    monkeypatch.setattr(S, "KEPT_NODES", 2500)
    made, add = Counter(), S.Graph._add

    def counted(self, codes, sizes):
        at = np.cumsum([0, *sizes]).tolist()
        made.update("".join(map(chr, codes[a:b])) for a, b in zip(at, at[1:], strict=False))
        return add(self, codes, sizes)

    rng, graph = random.Random(7), S.Graph(vocabulary)
    word = lambda: "".join(rng.choice("etaoinshrdlué日\U0001f600") for _ in range(rng.randint(2, 12)))
    common = [word() for _ in range(60)]
    for _ in range(12):
        texts = [" ".join(common), " ".join([*(word() for _ in range(150)), *common]) + "\n" + "x" * 400, "", *(word() for _ in range(20))]
        keys = np.arange(len(texts), dtype=np.uint64)
        alone = S.search(S.Graph(vocabulary), texts, keys, 3)
        with monkeypatch.context() as m:
            m.setattr(S.Graph, "_add", counted)
            known = S.chunks(graph, texts)
        for text, (ids, *_) in zip(texts, S.encode(graph, known), strict=True):
            assert ids.tolist() == vocabulary.encoder.encode(text)
        for a, b in zip(S.search(graph, texts, keys, 3, known), alone, strict=True):
            assert [(i.tolist(), round(lp, 9), round(v, 9)) for i, lp, v, _ in a] == [(i.tolist(), round(lp, 9), round(v, 9)) for i, lp, v, _ in b]
    assert sum(map(len, made)) > 4 * S.KEPT_NODES and made["x" * 400] > 1
    assert all(made[c] == 1 for w in common[1:] for c in [S.MARK + w] if c in made)
    assert sum(made[S.MARK + w] for w in common) > 20


def test_decoding_passes_over_control_ids(spark, vocabulary):
    rows = [(0, [1, *vocabulary.encoder.encode("Hello  you"), 2]), (1, []), (2, None), (3, [1, 2]), (4, vocabulary.encoder.encode(" é"))]
    found = S.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").selectExpr("doc_id", "0 AS rank", "ids"), MODEL).collect()
    assert [(r.doc_id, r.text) for r in sorted(found)] == [(0, "Hello  you"), (1, ""), (2, ""), (3, ""), (4, " é")]


def test_query_gives_encodings_samples_and_decoded_texts(spark, vocabulary, tmp_path):
    texts = {1: "Hello  world.", 2: None, 3: "", 4: "tab\tand\n\nline", 5: "émigré 日本 \U0001f600", 6: "▁mark", 7: "a" * 3000}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op1_query(spark, str(tmp_path)).collect()
    library = vocabulary.encoder
    assert sorted((r.doc_id, r.rank) for r in rows) == [(d, r) for d, t in texts.items() for r in range(3 if t else 2)]
    for r in rows:
        text = (texts[r.doc_id] or "").replace("▁", " ")
        assert r.decoded and library.decode(r.ids) == text
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        if r.rank == 0:
            assert r.ids == library.encode(text) and r.perturbed is None and r.inclusion is None
        else:
            assert 0 <= r.inclusion <= 1
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.doc_id, r.text) for r in S.decode(S.round_trip(docs, MODEL), MODEL).collect()} == {(d, (t or "").replace("▁", " ")) for d, t in texts.items()}
    digest = S.sample(docs, MODEL, digest=True).collect()
    key = lambda r: (r.doc_id, r.rank, r.n_pieces, r.ids_crc32, r.decoded, r.log_prob, r.perturbed, r.inclusion)
    assert sorted(map(key, digest)) == sorted(key(r) for r in rows if r.rank)
