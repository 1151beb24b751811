"""License scans: named phrases, and an exact set-similarity join of license templates with text blocks.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A template's blocks are the runs of
consecutive words of a text, over line ends too, of up to 1 / `contained` times the template's words (a longer run
could hold its words by chance). The join finds every block that holds at least `contained` of a template's distinct
words:

* the templates' words are ordered by the number of texts of the whole table that hold them, rarest first;
* a block that holds enough words must hold one of the template's first |T| - needed + 1 (prefix filter), so only
  those words are looked up, and almost every text ends there;
* a text needs as many distinct words of the template as a block does (length filter);
* a first match at place i leaves |T| - i words, which must be enough (positional filter);
* what passes is counted: the places of the template's words are walked with two pointers a block's width apart, which
  meets every block that begins at one of them, and no other block holds more.

Filters only skip what can't pass, so the finds depend on no frequency. Templates are a parameter of bounded size and
go to the workers with the code; the first pass counts only their words. A label has telling words, of which a block must
hold one (of each group) where the template has any, and may have words of its siblings that a block must not hold: else
a notice would be named by every label that shares its wording. Blocks begin at a word of the template and are as long as
allowed; one that would hold a sibling's word earns nothing. A notice that holds the words of two labels is named by both.

Null and empty texts have no words and no labels, score 0. Rows pass one by one: repeated or null doc_ids and empty
tables need no rule. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices and characteristic sentences of public licenses.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License, see the LICENSE file for details"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("isc", "released under the ISC License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("bsd", "licensed under the BSD 3-Clause License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)
#: Words that tell a label from others, in groups: a block holds a word of every group that its template has words of.
NC, SA, ND = "noncommercial nc", "sharealike sa", "noderivatives nd"
TELLING = {
    "mit": ("mit",), "isc": ("isc fee",), "apache-2": ("apache",), "bsd": ("bsd",), "gpl": ("gnu",), "gpl-2": ("gnu", "2"), "gpl-3": ("gnu", "3"), "lgpl": ("lesser",), "agpl": ("affero",), "mpl-2": ("mozilla mpl",), "epl-2": ("eclipse",),
    "cc-by": ("attribution by",), "cc-by-sa": (SA,), "cc-by-nc": (NC,), "cc-by-nd": (ND,), "cc-by-nc-sa": (NC, SA), "cc-by-nc-nd": (NC, ND),
}
#: Words of a label's siblings: a block that holds one does not earn the label.
_NOT_NC, _NOT_SA, _NOT_ND = f"{NC} commercial", f"{SA} alike", f"{ND} derivatives derivs noderivs"
FORBIDDEN = {
    "gpl": "lesser affero library", "gpl-2": "lesser affero library", "gpl-3": "lesser affero library", "lgpl": "affero", "agpl": "lesser",
    "cc-by": f"{_NOT_NC} {_NOT_SA} {_NOT_ND}", "cc-by-sa": f"{_NOT_NC} {_NOT_ND}", "cc-by-nc": f"{_NOT_SA} {_NOT_ND}", "cc-by-nd": f"{_NOT_NC} {_NOT_SA}", "cc-by-nc-sa": _NOT_ND, "cc-by-nc-nd": _NOT_SA,
}
CONTAINED = 0.8

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


def needed(size: int, contained: float) -> int:
    """The fewest of `size` words that make up the share `contained`."""
    n = int(contained * size)
    while n < contained * size - 1e-9:
        n += 1
    return max(1, n)


def width(size: int, contained: float) -> int:
    """The most words of a block for a template of `size` words."""
    return int(size / contained + 1e-9)


class Templates:
    """Templates as word lists in global order, with an index of their prefixes."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], contained: float):
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        self.all: list[tuple[str, list[bytes], frozenset, list[frozenset], frozenset, int, int]] = []
        for t, (label, words) in enumerate(templates):
            ordered = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
            least = needed(len(ordered), contained)
            self.all.append((label, ordered, frozenset(ordered), telling_of(label, words), forbidden_of(label), least, width(len(words), contained)))
            for place, word in enumerate(ordered[: len(ordered) - least + 1]):
                self.index.setdefault(word, []).append((t, place))
        self.prefixes = frozenset(self.index)

    def search(self, text: list[bytes]) -> Iterator[tuple[str, float]]:
        """The label and best containment of every template that a block of `text` holds."""
        if self.prefixes.isdisjoint(text):
            return
        own = frozenset(text)
        first: dict[int, int] = {}
        for word in own & self.prefixes:
            for t, place in self.index[word]:
                first[t] = min(place, first.get(t, place))
        for t, place in sorted(first.items()):
            label, ordered, words, telling, forbidden, least, span = self.all[t]
            if len(ordered) - place < least or len(own & words) < least:
                continue
            marks = words | forbidden
            best = most_words([(i, w) for i, w in enumerate(text) if w in marks], span, telling, forbidden)
            if best >= least:
                yield label, best / len(ordered)


def telling_of(label: str, words: list[bytes]) -> list[frozenset]:
    """The groups of telling words of `label` that the template has words of."""
    groups = (frozenset(words_of(g.encode())) for g in TELLING.get(label, ()))
    return [g for g in groups if not g.isdisjoint(words)]


def forbidden_of(label: str) -> frozenset:
    return frozenset(words_of(FORBIDDEN.get(label, "").encode()))


def most_words(places: list[tuple[int, bytes]], span: int, telling: list[frozenset], forbidden: frozenset) -> int:
    """The most distinct template words of a block of `span` words that begins at one of the places (in order).

    A block counts if it holds a word of each telling group and no forbidden one.
    """
    inside: Counter = Counter()
    best = head = 0
    for at, word in places:
        while head < len(places) and places[head][0] < at + span:
            inside[places[head][1]] += 1
            head += 1
        if len(inside) > best and forbidden.isdisjoint(inside) and not any(g.isdisjoint(inside) for g in telling):
            best = len(inside)
        inside[word] -= 1
        if not inside[word]:
            del inside[word]
    return best


def find_phrases(words: list[bytes], phrases) -> tuple[int, int | None, int | None, set[str]]:
    """Places of all phrases (overlapping ones too), the smallest and largest start in words, and the labels."""
    line = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in phrases:
        key = b" " + phrase.encode() + b" "
        at = line.find(key)
        while at >= 0:
            places.append(at)
            labels.add(label)
            at = line.find(key, at + 1)
    count = lambda at: line.count(b" ", 0, at)
    return len(places), count(min(places)) if places else None, count(max(places)) if places else None, labels


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, contained: float = CONTAINED) -> DataFrame:
    """One row per row of `docs` (doc_id, text): words, phrase places, labels and the best containment."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    worded = [(label, words_of(text.encode())) for label, text in templates]
    vocabulary = frozenset(w for _, words in worded for w in words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(text or b"")))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {bytes(r["word"]): r["n"] for r in counted.collect()}  # the templates' words only
    known = Templates(worded, frequency, contained)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text or b"")
                n, first, last, base = find_phrases(words, phrases)
                found = list(known.search(words))
                labels = base | {label for label, _ in found}
                out.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), max([1.0 if n else 0.0, *(s for _, s in found)])))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(find, schema)


def _sql_words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def oracle_sql(templates=TEMPLATES, phrases=PHRASES, contained: float = CONTAINED) -> str:
    """The same result in DuckDB SQL, by counting the words of every template in every block."""
    quoted = lambda words: "[" + ", ".join("'" + w.decode().replace("'", "''") + "'" for w in words) + "]"
    rows = []
    for t, (label, text) in enumerate(templates):
        words = sorted(set(words_of(text.encode())))
        groups = [sorted(g) for g in telling_of(label, words)] + [[]] * 2
        rows.append(f"({t}, '{label}', {quoted(words)}, {quoted(groups[0])}::VARCHAR[], {quoted(groups[1])}::VARCHAR[], {quoted(sorted(forbidden_of(label)))}::VARCHAR[], {len(words)}, {needed(len(words), contained)}, {width(len(words_of(text.encode())), contained)})")
    phrase_rows = ", ".join(f"({quoted(p.encode().split())}, '{label}')" for p, label in phrases)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, {_sql_words("text")} AS words FROM d),
p(phrase, label) AS (VALUES {phrase_rows}),
t(tid, label, words, first, second, forbidden, size, least, span) AS (VALUES {", ".join(rows)}),
tw AS (SELECT tid, word, span, CASE WHEN list_contains(words, word) THEN word END AS own, len(first) = 0 OR list_contains(first, word) AS one, len(second) = 0 OR list_contains(second, word) AS two, list_contains(forbidden, word) AS bad FROM (SELECT *, unnest(list_concat(words, forbidden)) AS word FROM t)),
spot AS (SELECT rid, i AS pos, words[i] AS word FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
place AS (SELECT rid, label, i - 1 AS pos FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM w) x JOIN p ON x.words[i] = phrase[1] AND x.words[i:i + len(phrase) - 1] = phrase),
base AS (SELECT rid, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY rid),
block AS (SELECT rid, tid, count(DISTINCT own) OVER b AS n, bool_or(one) OVER b AND bool_or(two) OVER b AND NOT bool_or(bad) OVER b AS told FROM spot JOIN tw USING (word) WINDOW b AS (PARTITION BY rid, tid ORDER BY pos RANGE BETWEEN CURRENT ROW AND (span - 1) FOLLOWING)),
most AS (SELECT rid, tid, max(n) AS n FROM block WHERE told GROUP BY rid, tid),
hit AS (SELECT rid, label, n / size::DOUBLE AS s FROM most JOIN t USING (tid) WHERE n >= least),
named AS (SELECT rid, label FROM hit UNION SELECT rid, label FROM place),
lab AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY rid),
best AS (SELECT rid, max(s) AS s FROM hit GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word, coalesce(base.labels, '') AS base_labels, coalesce(lab.labels, '') AS labels,
 CASE WHEN coalesce(base.n, 0) > 0 THEN 1.0 ELSE coalesce(best.s, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN lab USING (rid) LEFT JOIN best USING (rid)"""
