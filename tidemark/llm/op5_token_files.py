"""Token ids as flat binary files.

Documents are sorted by id over range partitions. Each partition tokenises its whole texts and writes two files:

* `part-NNNNN.bin`: the ids of its documents one after another, unsigned, little-endian, 16 bits wide where the
  vocabulary allows it, else 32;
* `part-NNNNN.idx`: the number of documents, then as 64-bit integers the end offset of each document in ids (within
  the part), its doc_id, and 1 if it has one.

A part's base, the ids of all parts before it, is a prefix sum over the parts' counts: one row a part reaches the
driver. Readers map the files into memory. A task writes under a name of its own and renames at the end, so a task
that runs twice leaves the same files.

Null and empty texts hold the end id alone. Null doc_ids come first. Rows with equal doc_id stay rows of their own,
ordered by the first 32 bytes of the text, then by its hash, whatever the partitions. An empty table gives no part. Extra columns are ignored.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import MARKS, splits_words
from .common import new_path

TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Words whose ids a worker remembers; it starts anew beyond.
MEMORY = 800_000
#: Letters that are composed and have one lower-case form, a letter too: words of them alone are one pre-token.
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))]
_ONE = re.compile(f"[{''.join(LETTERS)}]+")


def id_type(path: str, end_id: int) -> str:
    """The narrowest type that holds every id of the vocabulary, and the end id."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return "<u2" if max(end_id, *vocabulary.values()) < 1 << 16 else "<u4"


class WordTokens:
    """A tokenizer whose pre-tokens never span white space or go from a letter to a mark, with the ids of words remembered.

    White space ends every pre-token, and so does a mark after a letter: a text's ids are the ids of its parts in a
    row. Letters A-Z count as a-z before anything else, but for texts that may name a special token. That holds for
    tokenizers that say so themselves (`splits_words`); with any other, whole texts are encoded. New words of `LETTERS`
    go to the library's model at once, as the normalizer and the pre-tokenizer leave each letter; others go through all.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.dtype, self.known = Tokenizer.from_file(path), dtype, {}
        self.by_word = splits_words(json.loads(self.tokenizer.to_str()))
        if self.by_word:
            normal, cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.letters = str.maketrans({c: cut(normal(c))[0][0] for c in LETTERS})
            width, ids = np.dtype(dtype).itemsize, self.tokenizer.get_vocab(with_added_tokens=True).values()
            self.bytes_of = [i.to_bytes(width, "little") for i in range(max(ids) + 1)]

    def _learn(self, new: list[bytes]) -> None:
        """Remember the ids of words."""
        known, one, encode, bytes_of, letters = self.known, _ONE.fullmatch, self.tokenizer.model.tokenize, self.bytes_of, self.letters
        rest = []
        for word in new:
            text = word.decode("utf-8", "replace")
            if one(text):
                known[word] = b"".join([bytes_of[t.id] for t in encode(text if text.isascii() else text.translate(letters))])
            else:
                rest.append((word, text))
        encoded = self.tokenizer.encode_batch([text for _, text in rest], add_special_tokens=False)
        known.update((word, np.array(e.ids, self.dtype).tobytes()) for (word, _), e in zip(rest, encoded, strict=True))

    def ids(self, texts: list[bytes], end: bytes) -> list[bytes]:
        """The ids of each text, as bytes of `dtype`, with `end` after them."""
        if not self.by_word:
            encoded = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() + end for e in encoded]
        known = self.known
        words = [(t if b"<|" in t else MARKS.sub(rb" \1", t.lower())).split() for t in texts]
        if len(known) > MEMORY:
            known.clear()
        self._learn(list(set().union(*words).difference(known)))
        look = known.__getitem__
        return [b"".join(map(look, w)) + end for w in words]


@cache
def word_tokens(path: str, dtype: str) -> WordTokens:
    """One tokenizer a worker process, whatever number of tasks it runs."""
    return WordTokens(path, dtype)


def _store(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def write_parts(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, dtype: str | None = None, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the files of `docs` to `folder` and return its manifest: each part's name, documents, ids and base."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    dtype = dtype or id_type(vocabulary, end_id)
    # The same order within and across parts, so that starts depend on no partitioning; beginnings stand in for texts in the sampled bounds.
    by = ["doc_id", F.substring("text", 1, 32), F.xxhash64("text")]
    dealt = (rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).sortWithinPartitions(*by, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        part, trial = TaskContext.get().partitionId(), uuid.uuid4().hex
        name, out = f"part-{part:05d}", None
        words, end = word_tokens(vocabulary, dtype), np.array([end_id], dtype).tobytes()
        width, sizes, ids, named = len(end), [], [], []
        for batch in batches:
            out = out or fs.open_output_stream(f"{root}/.{name}-{trial}.bin")
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                encoded = words.ids([t or b"" for t in piece.column(1).to_pylist()], end)
                out.write(b"".join(encoded))
                sizes += [len(e) // width for e in encoded]
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            named.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        ends = np.cumsum(np.array(sizes, "<i8"))
        with fs.open_output_stream(f"{root}/.{name}-{trial}.idx") as f:
            f.write(b"".join(np.concatenate(x).astype("<i8").tobytes() for x in ([[len(ends)]], [ends], ids, named)))
        for kind in ("bin", "idx"):
            fs.move(f"{root}/.{name}-{trial}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([len(ends)], pa.int64()), "ids": pa.array([int(ends[-1])], pa.int64())})

    fs, root = _store(folder)
    fs.create_dir(root)
    made = sorted(dealt.mapInArrow(write, "part int, docs long, ids long").collect())
    bases = np.concatenate(([0], np.cumsum([r.ids for r in made]))).tolist()
    manifest = [{"name": f"part-{r.part:05d}", "docs": r.docs, "ids": r.ids, "base": b, "dtype": dtype} for r, b in zip(made, bases, strict=False)]
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def open_part(folder: str, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a part (mapped into memory where the store allows it), and its documents' ends, ids and whether they have one."""
    fs, root = _store(folder)

    def view(kind: str, of: str) -> np.ndarray:
        path = f"{root}/{name}.{kind}"
        if fs.type_name == "local":
            with open(path, "rb") as f:
                return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), of)
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.readall(), of)

    index = view("idx", "<i8")
    n = int(index[0])
    return view("bin", dtype), index[1 : 1 + n], index[1 + n : 1 + 2 * n], index[1 + 2 * n :]


def read_digests(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base, dtype in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, ends, doc_ids, named = open_part(folder, name, dtype)
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=named == 0), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = "name string, base long, dtype string"
    rows = [(m["name"], m["base"], m["dtype"]) for m in manifest]
    parts = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write `docs` as token files and read every document's digest back from them."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_digests(docs.sparkSession, folder, write_parts(docs, folder, vocabulary))
