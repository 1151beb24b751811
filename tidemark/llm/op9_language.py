"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises that text's substrings. A document is parsed greedily
into the longest phrases that occur in a language's text (a character not in it is a phrase of its own); with c phrases
over n bytes and m bytes of labelled text, the cross entropy is c * log2(m) / n bits a byte. The language that needs
fewest bits wins, the alphabetically first of equals. Texts are lower-cased, their
letters and blanks read as UTF-8 bytes, so the automata's tables are at most 256 wide whatever the script.

The labelled text of a language is a bounded sample: of the `SAMPLE_DOCS` training rows that come first by a hash of
their id, all give an equal part of `SAMPLE_BYTES` bytes, or their whole text where that is less (what short texts leave
over goes to the longer ones). Every document is parsed whole; a batch's documents go through the automata side by
side, one byte a step.

Null text, or text without a letter (in Unicode's sense: numerals are none): `und`, score 0. No labelled row at all: `und` throughout. Rows with equal or null
doc_id stay rows of their own; null ids aren't trained on, and of an id that several rows have ROWS_AN_ID give text. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_bucket

SAMPLE_DOCS, SAMPLE_BYTES = 64, 1 << 15
#: Rows of one sampled id that may give text, where ids are repeated.
ROWS_AN_ID = 4
#: Texts parsed side by side, and their bytes: a batch ends where either is reached (a longer text is a batch alone).
BATCH_ROWS, BATCH_BYTES = 2048, 1 << 23
FOLDS, HELD_OUT = 3, 1
#: How sharply a difference in bits a byte tells in the score.
SHARPNESS = 4.0
_OTHER = re.compile(r"[\W\d_]+")


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of each state, state 0 the start: its paths spell the substrings of `data`, and nothing else."""
    edges, link, longest, last = [{}], [-1], [0], 0
    for c in data:
        edges.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        new, at, last = len(edges) - 1, last, len(edges) - 1
        while at >= 0 and c not in edges[at]:
            edges[at][c] = new
            at = link[at]
        if at < 0:
            continue
        to = edges[at][c]
        if longest[to] == longest[at] + 1:
            link[new] = to
            continue
        edges.append(dict(edges[to]))
        link.append(link[to])
        longest.append(longest[at] + 1)
        twin = len(edges) - 1
        link[to] = link[new] = twin
        while at >= 0 and edges[at].get(c) == to:
            edges[at][c] = twin
            at = link[at]
    return edges


class Parser:
    """The automata of all languages as one table: row of state and byte class -> next row's offset * 4 + phrases ended."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        self.bits = np.array([math.log2(max(2, len(texts[x]))) for x in self.languages])
        used = sorted(set(b"".join(texts.values())))
        self.classes = np.full(256, len(used), np.uint16)  # up to 256: a byte's class takes two bytes
        self.classes[used] = np.arange(len(used))
        self.width, tables, self.roots, base = len(used) + 1, [], [], 0
        for language in self.languages:
            edges = suffix_automaton(texts[language])
            root = base * self.width
            start = np.full(self.width, root * 4 + 1, np.int64)  # at the start, an unknown byte is a phrase
            for c, to in edges[0].items():
                start[self.classes[c]] = (base + to) * self.width * 4
            table = np.repeat((start + 1)[None, :], len(edges), axis=0)  # elsewhere it also ends one
            table[0] = start
            for state, out in enumerate(edges[1:], 1):
                if out:
                    table[state, self.classes[list(out)]] = (base + np.array(list(out.values()))) * self.width * 4
            tables.append(table)
            self.roots.append(root)
            base += len(edges)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int64)
        if base * self.width * 4 < 2**31:
            self.table = self.table.astype(np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """The phrases of each text in each language."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        flat = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        starts = (np.cumsum(sizes) - sizes)[order]
        left = np.sort(sizes)
        kind = self.table.dtype
        state = np.tile(np.array(self.roots, kind), (len(texts), 1))
        count = np.zeros(state.shape, np.int32)
        for t in range(int(sizes.max(initial=0))):
            m = len(texts) - int(np.searchsorted(left, t, side="right"))
            step = self.table.take(state[:m] + flat[starts[:m] + t].astype(kind)[:, None])
            count[:m] += step & 3
            state[:m] = step >> 2
        count += state != np.array(self.roots, kind)
        out = np.empty_like(count)
        out[order] = count
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        sizes = np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))
        entropy = self.phrases(texts) * self.bits / sizes[:, None]
        best = entropy.argmin(axis=1)
        score = 1 / np.exp(-SHARPNESS * (entropy - entropy.min(axis=1, keepdims=True))).sum(axis=1)
        return [self.languages[b] for b in best], score.tolist()


def normal(text: str) -> bytes:
    """Lower-case letters with single blanks for everything else, as UTF-8."""
    low = text.lower()
    if not low.isascii():
        low = low.translate({ord(c): " " for c in set(low) if c.isnumeric() and not c.isalpha()})
    return _OTHER.sub(" ", low).encode("utf-8", "replace")


def lettered(text: str) -> bool:
    """Whether `text` has a letter. (A word that is no number has one; else its characters are looked at.)"""
    return any(map(str.isalpha, text.split())) or any(map(str.isalpha, text))


def shares(sizes: list[int], total: int) -> list[int]:
    """`total` dealt evenly, to none more than its size."""
    out, left, many = [0] * len(sizes), total, len(sizes)
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        out[i] = min(sizes[i], left // many)
        left, many = left - out[i], many - 1
    return out


def sample(docs: DataFrame, allowed) -> dict[str, bytes]:
    """Labelled text per language from the rows that `allowed` admits."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & allowed)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_DOCS).select("doc_id").distinct()
    # At most SAMPLE_DOCS ids a language: small enough to broadcast, and to collect SAMPLE_BYTES characters of each, which is all that one could give.
    met = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    own = Window.partitionBy("lang", "doc_id").orderBy(F.xxhash64("text"), "text")
    got = met.withColumn("n", F.row_number().over(own)).where(F.col("n") <= ROWS_AN_ID).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"], r["text"])):
        own = texts.setdefault(r["lang"], [])
        if (piece := normal(r["text"])) not in own:
            own.append(piece)
    return {k: b"\n".join(t[:n] for t, n in zip(v, shares(list(map(len, v)), SAMPLE_BYTES - len(v)), strict=True)) for k, v in texts.items() if any(v)}


def cuts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Where batches begin, and how many texts they have: BATCH_ROWS at most, and BATCH_BYTES unless one text has more."""
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and (i - at >= BATCH_ROWS or held + size > BATCH_BYTES):
            yield at, i - at
            at, held = i, 0
        held += size
    if sizes:
        yield at, len(sizes) - at


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs` (doc_id, text, lang)."""
    spark, held = docs.sparkSession, doc_bucket("doc_id", FOLDS) == HELD_OUT
    model = spark.sparkContext.broadcast(sample(docs, ~held))
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(model.value)
        for whole in batches:
            for at, n in cuts(pc.binary_length(whole.column(2)).fill_null(0).to_pylist()):
                batch = whole.slice(at, n)
                texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(2).to_pylist()]
                known = list(map(lettered, texts))
                langs, scores = parser.predict([normal(t) if ok else b"" for t, ok in zip(texts, known, strict=True)])
                langs = [x if ok else "und" for x, ok in zip(langs, known, strict=True)]
                scores = [x if ok else 0.0 for x, ok in zip(scores, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
