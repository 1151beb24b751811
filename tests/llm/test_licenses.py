import duckdb
import pandas as pd

from tidemark.llm import op2_licenses as L

MIT = next(t for label, t in L.TEMPLATES if t.startswith("Permission is hereby"))
TEXTS = [
    "Released under the MIT License.",
    "x\nLICENSED under CC BY-NC 4.0, apache license version 2 under the mit license under the mit license\ny",
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed by no public license",
    "under the mit\nlicense",
    MIT,
    MIT.replace(" ", "\n", 12),
    "one\n\n" + MIT.replace("copy", "copies").replace(", ", "\n").upper() + "\n\ntwo",
    None,
    "",
    "$$$ --- \n\n",
    "é ü ß under™the mit license",
    "Redistribution$$$ and%%% use in source and binary forms*** with or without modification",
    "cc by nc " * 2000,
    "licensed under a Creative Commons\nAttribution 4.0 International License",
    "this work is licensed under the GNU\n\nGeneral Public License,\nversion 3",
    "We released a plan under budget; the team met its license quota. " * 5,
    " ".join(f"word{i}" for i in range(3000)) + " " + " pad ".join(MIT.split()),
    "word " * 2000 + MIT + " word" * 2000,
]


def test_equals_sql(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[1], "y"), (None, TEXTS[0], "z")]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)).toPandas()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "labels"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.connect().execute(L.oracle_sql()).df()
    _close(got, want)


def _close(a, b):
    order = ["n_words", "n_base", "labels", "base_labels", "doc_id"]
    a, b = (d.astype({"doc_id": "float64", "first_word": "float64", "last_word": "float64"}).sort_values(order).reset_index(drop=True)[sorted(d.columns)] for d in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_labels(spark):
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    assert got[0].labels == "mit" and got[0].n_base == 1 and got[0].score == 1.0
    assert (got[1].n_base, got[1].first_word, got[1].base_labels) == (4, 3, "apache-2,cc-by-nc,mit")
    assert got[2].labels == "gpl-3" and got[2].n_base == 0 and got[2].score == 1.0
    assert got[3].labels == "" and got[3].score == 0.0
    assert got[4].base_labels == "mit" and got[7].labels == "mit" and 0.8 <= got[7].score < 1
    assert got[8].n_words == got[9].n_words == got[10].n_words == 0
    assert got[13].n_base == 2000
    assert got[14].labels == "cc-by" and got[15].labels == "gpl-3"  # over line ends
    assert got[16].labels == "" and got[16].score == 0.0  # words by chance in a long line
    assert got[5].labels == "mit" and got[17].labels == "" and got[18].labels == "mit"  # blocks of about the template's size
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
CC = "This work is licensed under a Creative Commons {} 4.0 International License."
#: Notices and the labels that a reader gives them.
NOTICES = [
    ("Released under the MIT License.", "mit"),
    ("released under the ISC License", "isc"),
    ("released under the BSD License", ""),
    ("released under the GPL License", ""),
    ("released under the new License", ""),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("Licensed under the Mozilla Public License, version 2.0.", ""),
    ("Licensed under the EUPL, Version 2.0", ""),
    ("licensed under the BSD 3-Clause License", "bsd"),
    (GNU.format("", 3), "gpl,gpl-3"),
    (GNU.format("", 2), "gpl,gpl-2"),
    (GNU.format("Lesser ", 3), "lgpl"),
    (GNU.format("Affero ", 3), "agpl"),
    (CC.format("Attribution"), "cc-by"),
    (CC.format("Attribution-NonCommercial"), "cc-by-nc"),
    (CC.format("Attribution-ShareAlike"), "cc-by-sa"),
    (CC.format("Attribution-NoDerivatives"), "cc-by-nd"),
    (CC.format("Attribution-NonCommercial-ShareAlike"), "cc-by-nc-sa"),
    (CC.format("Attribution-NonCommercial-NoDerivatives"), "cc-by-nc-nd"),
    ("Text licensed under CC BY 4.0.", "cc-by"),
    ("Text licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Text licensed under CC BY-ND 4.0.", "cc-by-nd"),
    ("Text licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Code is " + CC.format("Attribution") + " Much later, and apart from it, the pictures: " + CC.format("Attribution-NonCommercial"), "cc-by,cc-by-nc"),
]


def test_notices_have_the_labels_a_reader_gives_them(spark):
    rows = [(i, f"Some text before it. {n}\nand after it") for i, (n, _) in enumerate(NOTICES)]
    got = {r.doc_id: r.labels for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(NOTICES[i][0], got[i]) for i in sorted(got)] == NOTICES
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    assert dict(duckdb.connect().execute(f"SELECT doc_id, labels FROM ({L.oracle_sql()})").fetchall()) == got


def test_recall_over_altered_notices(spark):
    """Every template is found after one word in ten was lost or changed, inside of other text."""
    import random

    rng, rows = random.Random(6), []
    for i, (_, t) in enumerate(L.TEMPLATES):
        words = t.split()
        if len(words) >= 20:
            for at in range(0, len(words), 10):
                words[at + rng.randrange(min(10, len(words) - at))] = "changed"
        rows.append((i, "Before it. " * 30 + " ".join(words) + "\nafter it" * 30))
    got = {r.doc_id: r.labels.split(",") for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [label in got[i] for i, (label, _) in enumerate(L.TEMPLATES)]
    assert sum(found) >= 0.9 * len(found)


def test_filters_lose_nothing():
    """Every block at or over the threshold is found, whatever the frequencies say."""
    import random

    rng = random.Random(1)
    vocab = [f"w{i}".encode() for i in range(40)]
    templates = [(f"t{i}", rng.choices(vocab, k=rng.randint(1, 12))) for i in range(20)]
    for _ in range(5):
        known = L.Templates(templates, {w: rng.randint(0, 5) for w in vocab}, 0.8)
        for _ in range(200):
            text, want = rng.choices(vocab, k=rng.randint(1, 40)), set()
            for t, w in templates:
                span, words = max(1, int(len(w) / 0.8 + 1e-9)), set(w)
                share = max(len(set(text[i : i + span]) & words) for i in range(len(text))) / len(words)
                if share >= 0.8 - 1e-9:
                    want.add((t, share))
            assert set(known.search(text)) == want
