import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import op5_token_files as O

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["The cat, the CAT. It's I'M don't!", None, "", "a\n\nb\tc  d", "<|endoftext|>. <|ENDOFTEXT|> x", "é. K̂. Σας. 3.4, A. ..b", "word " * 4000, "x́ a…  b c."]


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_equals_the_library(spark, tmp_path):
    rows = [(i * 3 % 8, t) for i, t in enumerate(TEXTS)] + [(5, "again"), (5, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)
    folder = f"file://{tmp_path}/tokens"
    manifest = O.write_parts(df, folder, PATH, parts=3)
    assert [m["base"] for m in manifest] == np.cumsum([0, *(m["ids"] for m in manifest)])[:-1].tolist()
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in O.read_digests(spark, folder, manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    ids, ends, doc_ids, named = O.open_part(folder, manifest[0]["name"], "<u2")
    assert len(ids) == ends[-1] == manifest[0]["ids"] and len(doc_ids) == len(named)


def test_empty_table(spark):
    assert O.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_ids_are_as_wide_as_the_vocabulary_needs(spark, tmp_path):
    assert O.id_type(PATH, 2) == "<u2" and O.id_type(PATH, 70_000) == "<u4"
    folder = f"file://{tmp_path}/wide"
    manifest = O.write_parts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), folder, PATH, end_id=70_000)
    ids, *_ = O.open_part(folder, manifest[0]["name"], manifest[0]["dtype"])
    assert manifest[0]["dtype"] == "<u4" and ids[-1] == 70_000


def test_starts_do_not_depend_on_partitions(spark, tmp_path):
    same = "the same beginning of a text, longer than what bounds look at: "
    df = spark.createDataFrame([(7, same + "x " * (i * 7 % 41)) for i in range(60)] + [(None, f"n{i}") for i in range(20)], "doc_id long, text string")
    digests = []
    for parts in (1, 3, 6):
        folder = f"file://{tmp_path}/p{parts}"
        manifest = O.write_parts(df.repartition(parts + 1), folder, PATH, parts=parts)
        digests.append(sorted((r.start, r.n_tokens, r.ids_crc32) for r in O.read_digests(spark, folder, manifest).collect()))
    assert digests[0] == digests[1] == digests[2]


def test_words_give_the_ids_of_whole_texts():
    """Over every document at hand, and random strings of awkward characters."""
    import os
    import random

    import pyarrow.parquet as pq

    tokenizer, words = Tokenizer.from_file(PATH), O.WordTokens(PATH, "<u4")
    assert words.by_word
    rng = random.Random(3)
    odd = "aAzZéÉßİıΣσςKǺ̂ '’.,-_!?<|>0123½²Ⅷ五\u00a0\u2003\u200b\u0085\t\n\r\x0b\x0c\x1c\x1d\U0001f600"
    texts = ["".join(rng.choices(odd, k=rng.randint(1, 40))) for _ in range(4000)]
    texts += [w.join(["x", "y'"]) + e for w in ("'S ", "'LL.", "n't", "İ. ", "<|endoftext|>", " <| ", "é'. ") for e in ("", ".", " '")]
    path = "/root/testdata/sf0.01/documents.parquet"
    if os.path.exists(path):
        texts += [t or "" for t in pq.read_table(path, columns=["text"]).column(0).to_pylist()]
    got = words.ids([t.encode() for t in texts], b"")
    for text, ids, want in zip(texts, got, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


def test_words_of_letters_go_to_the_model_at_once():
    words, seen = O.WordTokens(PATH, "<u2"), []
    library = words.tokenizer

    class Watched:
        model = library.model

        def encode_batch(self, texts, **how):
            seen.extend(texts)
            return library.encode_batch(texts, **how)

    words.tokenizer = Watched()
    text = "Été straße ÀÖØÞ àöøþÿ plain, A1 don't µ naïve. x\u0301"
    got = words.ids([text.encode()], b"")
    assert np.frombuffer(got[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == sorted([",", "a1", "don't", "µ", ".", "x\u0301"])


def test_other_tokenizers_see_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, texts = O.WordTokens(path, "<u4"), ["Hello  World.\n\n it's", "", " a"]
    assert not words.by_word
    for ids, want in zip(words.ids([t.encode() for t in texts], b""), Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
