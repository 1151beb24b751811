"""SentencePiece encoding and decoding with segmentations sampled without replacement.

A text's segmentations into pieces are the paths of a lattice. Pieces never go beyond a chunk (word-start marks with
the letters, or with the other characters, that follow; which characters go with letters is read from the vocabulary),
so a text's lattice is its chunks' lattices in a row, and equal chunks share one. A batch's new chunks are made side by
side, as arrays: pieces are matched by stepping through a trie, and backward sums over what is left of each chunk turn
weights (Zipf's law over a piece's rank in the vocabulary) into the probability of each piece given the rest of its
chunk. A worker keeps chunks between batches; beyond `KEPT_NODES` characters of them those used least go, so that the
often used ones aren't made again.

Gumbel top-k without replacement is a best-first (A*) search over sets of segmentations. The perturbed log-probability
of the best member of a set is a Gumbel variable at the set's log-mass, so a set's bound is drawn without looking
inside. The whole lattice is drawn first, and its best member by ancestral sampling; what is left splits into sets that
leave that path at one of its pieces, each with a bound below the found value. The set of greatest bound is opened
next, and so on: the k paths come out in order of perturbed log-probability, all distinct. With the greatest bound left
as threshold, a path's inclusion score is the probability that its own perturbed value passes it. The search is exact:
the sets that leave a path beyond its first `OPEN` pieces are kept as one set, opened when its turn comes.

Random numbers are functions of (seed, doc_id, sample, word, step), so a row's samples don't depend on its neighbours,
on partitions or on retries. All texts of a batch walk the graph side by side.

SentencePiece's own encoding of a text is its chunks' encodings in a row, since no merge goes beyond a chunk: the library
encodes each chunk a worker doesn't know yet. `round_trip` gives it (rank 0) beside the samples, and decodes
every row's ids again.

Null and empty texts have one segmentation, the empty one, with inclusion 1; texts with fewer than k segmentations give
all they have. Characters outside the vocabulary become bytes. U+2581 in a text is taken as a blank. Rows with equal
doc_id share their random numbers; a null doc_id counts as 0. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES, SEED = 2, 20_260_101
OPEN = 48
#: Zipf-Mandelbrot law over vocabulary ranks.
RANK_SHIFT, EXPONENT = 2.7, 1.0
#: Nodes beyond which a worker forgets the chunks used least (about 80 bytes each), characters beyond which a chunk is
#: always among them, characters of new chunks made at once, and nodes below which a backward step goes one by one.
KEPT_NODES, LONG, BUILD, SIDE_BY_SIDE = 1_500_000, 256, 1 << 16, 16
#: What is kept of each chunk: its hash, where its characters lie and how many, its first node, the log-sum of its paths, how
#: often it was used, and where the library's ids lie, how many (-1: not asked for) and their log-probability.
_CHUNK = {"hash_of": np.int64, "at_of": np.int64, "size_of": np.int64, "head": np.int64, "mass": np.float64, "uses": np.int64, "plain_at": np.int64, "plain_size": np.int64, "plain_log_p": np.float64}
BATCH_DOCS, BATCH_CHARS = 256, 500_000
#: Chunks, with their own encodings, beyond which it forgets those too, and how many the library gets at once.
ENCODED, LINES = 200_000, 512
MARK = "▁"
#: Kinds of characters: word-start mark, line break, letters and what goes with them, the others.
BLANK, BREAK, INSIDE, OUTSIDE, UNSEEN = range(5)
#: Whether a chunk ends between two neighbours of these kinds.
_APART = np.array([[a != b and a != BLANK or BREAK in (a, b) for b in range(4)] for a in range(4)])
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function of uint64 values."""
    z = x + _M1
    z ^= z >> np.uint64(30)
    z *= _M2
    z ^= z >> np.uint64(27)
    z *= _M3
    z ^= z >> np.uint64(31)
    return z


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from uint64 counters."""
    u = (mix(x) >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(x, 0.0)))


def below(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at `location`, given that they stay below `bound`."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        g = location - np.log(np.exp(location - bound) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, g)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def runs(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs in order: sizes[i] of them from at[i] on."""
    return np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Places:
    """An open hash table from numbers of 63 bits to numbers, asked by whole arrays."""

    def __init__(self, size: int):
        self.n, self.bits = 0, max(4, size.bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct keys that aren't there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate((self.keys[held], keys)), np.concatenate((self.values[held], values))
            self.__init__(len(keys))
        self.n += len(keys)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each free slot takes one of those that want it, the others move on
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        at = self._slot(keys)
        seen = self.keys.take(at)
        other = seen != keys
        out = self.values.take(at)
        out[other] = missing
        left = np.flatnonzero(other & (seen >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


class Trie:
    """The pieces as a trie over characters; its moves lie in a hash table, so that arrays of states step together."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        moves: dict[tuple[int, str], int] = {}
        ids, weights = [-1], [0.0]
        for piece, (i, w) in pieces.items():
            state = 0
            for c in piece:
                to = moves.get((state, c))
                if to is None:
                    to = moves[state, c] = len(ids)
                    ids.append(-1)
                    weights.append(0.0)
                state = to
            ids[state], weights[state] = i, w
        self.id, self.weight = np.array(ids, np.int32), np.array(weights)
        rank = {c: i for i, c in enumerate(letters, 1)}
        keys = np.array([s * self.width + rank[c] for s, c in moves], np.int64)
        to = np.array(list(moves.values()), np.int32)
        self.moves = Places(len(keys))
        self.moves.put(keys, to)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states reached, 0 where no piece goes on so."""
        return self.moves.get(state.astype(np.int64) * self.width + letter, 0)

    def matches(self, letter: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: the places where a piece of that length starts and ends before `end`, and its state."""
        place = np.flatnonzero(letter)
        state = self.step(np.zeros(len(place), np.int32), letter[place])
        found, size = [], 1
        while True:
            go = state > 0
            place, state = place[go], state[go]
            is_piece = self.id[state] >= 0
            found.append((place[is_piece], state[is_piece]))
            go = place + size < end[place]
            place, state = place[go], state[go]
            if not len(place):
                return found
            state = self.step(state, letter[place + size])
            size += 1


class Vocabulary:
    """The pieces of a SentencePiece model: weights, bytes and ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        norm = math.log(math.log(n))
        self.encoder, self.line = sp, sp.encode("\n")[1:]
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids: list[int] = [0] * 256
        self.bytes_of: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                rank = min(n, max(0.0, -sp.get_score(i)))
                self.pieces[piece] = (i, -EXPONENT * math.log(rank + RANK_SHIFT) - norm)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        self.byte_weight = -EXPONENT * math.log(n + RANK_SHIFT) - norm
        self.weight_of = np.full(n, self.byte_weight)
        for i, w in self.pieces.values():
            self.weight_of[i] = w
        self.add, self.drop = self._joined()
        self.kind_of = np.full(0x110000, UNSEEN, np.uint8)
        if len(self.line) != 1 or (self.cut(list(self.pieces))[2] != 1).any():
            raise ValueError("the model has pieces that go beyond a chunk, or a line break of several")

    @cached_property
    def trie(self) -> Trie:
        return Trie(self.pieces)

    def _joined(self) -> tuple[set[str], set[str]]:
        """Characters that count as letters because some piece joins them to letters, and letters that don't count."""
        add, drop = set(), set()
        pairs = {(a, b) for p in self.pieces for a, b in zip(p, p[1:], strict=False) if MARK not in (a, b)}
        while True:
            inside = lambda c: c not in drop and (c in add or is_letter(c))
            across = [(a, b) if inside(a) else (b, a) for a, b in pairs if inside(a) != inside(b)]
            if not across:
                return add, drop
            for own, other in across:
                (add.add(other) if own.isalpha() or own in add else drop.add(own))

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """What each character (code point) is to chunks."""
        found = self.kind_of[codes]
        if len(new := np.unique(codes[found == UNSEEN])):
            for code in new.tolist():
                c = chr(code)
                inside = c not in self.drop and (c in self.add or is_letter(c))
                self.kind_of[code] = BREAK if c == "\n" else BLANK if c == MARK else INSIDE if inside else OUTSIDE
            found = self.kind_of[codes]
        return found

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The characters of all texts in a row, where their chunks begin (and the last ends), and how many each text has.

        A chunk is a line break, or word-start marks with the letters or with the other characters that follow.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes, starts = code_points("".join(texts)), np.cumsum(sizes) - sizes
        kind = self.kinds(codes)
        begins = np.ones(len(kind) + 1, bool)
        begins[1:-1] = _APART.take(kind[:-1] * np.uint8(len(_APART)) + kind[1:])
        begins[starts] = True
        at = np.flatnonzero(begins)
        return codes, at, np.diff(np.searchsorted(at, np.append(starts, len(kind))))

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of distinct chunks in order, and how many each has.

        The library sees them as lines behind an empty one: nothing joins a line break, no blank is put before. A chunk
        that is a line break is an empty line there.
        """
        flat, breaks = [], [np.zeros(1, np.int64)]
        lone = chunks.index("\n") if "\n" in chunks else len(chunks)
        lines = ["" if i == lone else c for i, c in enumerate(chunks)] if lone < len(chunks) else chunks
        for i in range(0, len(lines), LINES):
            ids = np.array(self.encoder.encode("\n" + "\n".join(lines[i : i + LINES]) + "\n"), np.int32)[2:]
            at = np.flatnonzero(ids == self.line[0])  # each line's end, with as many ends before it as lines
            breaks.append(breaks[-1][-1] + at - np.arange(len(at)))
            flat.append(np.delete(ids, at))
        flat, sizes = np.concatenate(flat), np.diff(np.concatenate(breaks))
        if lone < len(chunks):
            flat = np.insert(flat, sizes[:lone].sum(), self.line[0])
            sizes[lone] = 1
        return flat, sizes

    def decode(self, ids) -> bytes:
        """The text of `ids`, as UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).removeprefix(b" ")


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


class Graph:
    """The lattices of chunks: a node a character, its edges side by side, the longest piece first."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.several: list[list[int]] = []  # the ids of edges of several bytes, which have the id -1 - place
        self.several_of: dict[str, int] = {}
        self.clear()

    def clear(self, salt: int = 0) -> None:
        self.salt = np.uint64(salt)
        self.n_nodes = self.n_edges = self.n_kept = self.n_plain = self.n_chunks = 0
        self.place = Places(1 << 14)  # from a chunk's hash to its number
        nodes, edges = (max(1 << 16, KEPT_NODES * x // 4) for x in (5, 12))  # memory is taken where it is written to
        for name, kind in _CHUNK.items():
            setattr(self, name, np.empty(nodes >> 2, kind))
        self.kept, self.plain_ids = np.empty(nodes, np.uint32), np.empty(nodes, np.int32)  # known chunks' characters and the library's ids of them
        self.first = np.zeros(nodes, np.int32)
        self.to, self.id = np.empty(edges, np.int32), np.empty(edges, np.int32)
        self.cum, self.log_p = np.empty(edges), np.empty(edges)

    def _room(self, of: dict[str, int]) -> None:
        """Make room for that many entries in the arrays named."""
        for name, size in of.items():
            old = getattr(self, name)
            if size > len(old):
                fresh = np.empty(max(size, len(old) * 3 // 2), old.dtype)
                fresh[: len(old)] = old
                setattr(self, name, fresh)

    def numbers(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of each chunk codes[at[i]:at[i + 1]]; makes the nodes of those that are new.

        Chunks are looked up by a hash and compared with what is known under it; should two chunks share a hash, the
        graph starts anew with other hashes.
        """
        if self.n_nodes > KEPT_NODES or self.n_chunks > ENCODED:
            self.forget(KEPT_NODES // 2)
        sizes = np.diff(at)
        while len(sizes):
            within = np.arange(len(codes)) - np.repeat(at[:-1], sizes)
            z = (codes ^ self.salt) * _M2
            z += within.view(np.uint64) * _M1
            z ^= z >> np.uint64(32)
            z *= _M3
            hashed = (mix(np.add.reduceat(z, at[:-1])) >> np.uint64(1)).view(np.int64)
            found = self.place.get(hashed, -1)
            if len(new := np.flatnonzero(found < 0)):
                unique, example, which = np.unique(hashed[new], return_index=True, return_inverse=True)
                example = new[example]
                found[new] = self._learn(unique, codes, at[example], sizes[example])[which]
            if (self.size_of[found] == sizes).all() and (self.kept.take(np.repeat(self.at_of[found], sizes) + within) == codes).all():
                self.uses[: self.n_chunks] += np.bincount(found, minlength=self.n_chunks)
                return found
            self.clear(int(self.salt) + 1)
        return np.empty(0, np.int64)

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends, known, n, i = np.cumsum(sizes), self.n_chunks, len(sizes), 0
        kept_at, total, new = self.n_kept + ends - sizes, int(ends[-1]), slice(known, known + n)
        self._room({"kept": self.n_kept + total} | dict.fromkeys(_CHUNK, known + n))
        self.kept[self.n_kept : self.n_kept + total] = codes[runs(at, sizes)]
        self.n_kept += total
        while i < n:  # some at a time, for memory
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + BUILD)))
            own = slice(known + i, known + j)
            self.head[own], self.mass[own] = self._add(self.kept[kept_at[i] : kept_at[j - 1] + sizes[j - 1]], sizes[i:j])
            i = j
        self.hash_of[new], self.at_of[new], self.size_of[new], self.plain_size[new], self.uses[new] = hashes, kept_at, sizes, -1, 0
        self.n_chunks += n
        found = np.arange(known, self.n_chunks, dtype=np.int32)
        self.place.put(hashes, found)
        return found

    def forget(self, most: int) -> None:
        """Keep the chunks used most, up to half of `ENCODED` with `most` characters together; earlier uses count half from now on."""
        stay = np.argsort(-self.uses[: self.n_chunks], kind="stable")
        stay = stay[self.size_of[stay] <= LONG][: ENCODED // 2]
        stay = np.sort(stay[np.cumsum(self.size_of[stay]) <= most])
        keep, node = np.zeros(self.n_nodes, bool), self.head[stay]
        while len(node):  # a node's last edge takes one character
            keep[node] = True
            node = self.to[self.first[node + 1] - 1]
            node = node[node >= 0]
        number = np.cumsum(keep, dtype=np.int32) - np.int32(1)
        count = np.diff(self.first[: self.n_nodes + 1])
        edges, count = np.flatnonzero(np.repeat(keep, count)), count[keep]
        sizes, plain = self.size_of.take(stay), np.maximum(self.plain_size.take(stay), 0)
        self._keep(("kept",), runs(self.at_of.take(stay), sizes))
        self._keep(("plain_ids",), runs(self.plain_at.take(stay), plain))
        self._keep(("to", "id", "cum", "log_p"), edges)
        self._keep(_CHUNK, stay)
        self._keep(("first",), np.arange(len(count) + 1))
        self.n_chunks, self.n_nodes, self.n_edges, self.n_kept, self.n_plain = len(stay), len(count), len(edges), int(sizes.sum()), int(plain.sum())
        chunk, to = slice(self.n_chunks), self.to[: self.n_edges]
        self.first[: self.n_nodes + 1] = np.concatenate(([0], np.cumsum(count)))
        to[:] = np.where(to >= 0, number.take(to, mode="wrap"), -1)
        self.head[chunk] = number[self.head[chunk]]
        self.at_of[chunk], self.plain_at[chunk] = np.cumsum(sizes) - sizes, np.cumsum(plain) - plain
        self.uses[chunk] //= 2
        self.place = Places(self.n_chunks)
        self.place.put(self.hash_of[chunk], np.arange(self.n_chunks, dtype=np.int32))

    def _keep(self, names: Iterable[str], where: np.ndarray) -> None:
        """Of the arrays named, what lies at the (ascending) places, moved to the front; the memory of arrays far too long is given back."""
        for name in names:
            held = getattr(self, name)
            stays = held.take(where)
            if len(held) > 8 * len(where):
                setattr(self, name, held := np.empty_like(held))
            held[: len(where)] = stays

    def _fallback(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id and the weight of characters that are no pieces."""
        v, kinds, which = self.vocabulary, *np.unique(codes, return_inverse=True)
        ids, weights = np.empty(len(kinds), np.int32), np.empty(len(kinds))
        for i, code in enumerate(kinds.tolist()):
            c = chr(code)
            several = [v.byte_ids[b] for b in c.encode("utf-8", "replace")]
            if len(several) > 1 and c not in self.several_of:
                self.several_of[c] = len(self.several)
                self.several.append(several)
            ids[i], weights[i] = several[0] if len(several) == 1 else -1 - self.several_of[c], len(several) * v.byte_weight
        return ids[which], weights[which]

    def _add(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Make the nodes of new chunks (characters, and how many each chunk has), all side by side; the first of each, and the log-sum of its paths.

        Nodes are numbered by what is left of their chunk, so that each backward step sums a run of edges.
        """
        trie = self.vocabulary.trie
        end = np.repeat(np.cumsum(sizes), sizes)
        left = end - np.arange(len(codes))  # characters up to the chunk's end
        order = np.argsort(left.astype(np.uint16) if len(left) < 1 << 16 or left.max() < 1 << 16 else left, kind="stable")
        rank = np.empty(len(codes), np.int64)
        rank[order] = np.arange(len(codes))
        found = trie.matches(trie.letter[codes], end)
        edges = [(place, size, trie.id[state], trie.weight[state]) for size, (place, state) in enumerate(found, 1)]
        bare = np.ones(len(codes), bool)
        bare[found[0][0]] = False
        bare = np.flatnonzero(bare)
        edges.insert(1, (bare, 1, *self._fallback(codes[bare])))
        nodes = [rank.take(place) for place, *_ in edges]
        count = np.bincount(np.concatenate(nodes), minlength=len(codes))
        first = np.concatenate(([0], np.cumsum(count)))
        n, m = len(codes), int(first[-1])
        self._room({"first": self.n_nodes + n + 1} | dict.fromkeys(("to", "id", "cum", "log_p"), self.n_edges + m))
        own = slice(self.n_edges, self.n_edges + m)
        to, ids, cum, log_p = (x[own] for x in (self.to, self.id, self.cum, self.log_p))
        fill, owner = first[:-1].copy(), np.repeat(np.arange(n), count)
        for (place, size, id_, weight), node in zip(reversed(edges), reversed(nodes), strict=True):
            slot = fill.take(node)
            fill[node] = slot + 1
            ids[slot], log_p[slot] = id_, weight
            ahead = place + size
            inner = ahead < end.take(place)
            to[slot] = np.where(inner, rank.take(ahead, mode="clip"), -1)
        total = self._sum(first, to, owner, log_p, left[order])
        log_p -= total.take(owner)
        log_p[first[:-1][count == 1]] = 0.0
        np.exp(log_p, out=cum)
        slot, last = first[:-1] + 1, first[1:] - 1
        while len(slot):  # each node's next edge, all nodes side by side
            go = np.flatnonzero(slot < last)
            slot, last = slot.take(go), last.take(go)
            cum[slot] += cum.take(slot - 1)
            slot += 1
        cum[first[1:] - 1] = 2.0  # the last edge takes whatever rounding leaves
        to[to >= 0] += self.n_nodes
        self.first[self.n_nodes : self.n_nodes + n + 1] = first + self.n_edges
        heads, before = rank[np.cumsum(sizes) - sizes], self.n_nodes
        self.n_nodes, self.n_edges = before + n, self.n_edges + m
        return heads + before, total[heads]

    @staticmethod
    def _sum(first: np.ndarray, to: np.ndarray, owner: np.ndarray, weight: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Log-sum of the weights of each node's paths; adds to each edge's weight what follows it."""
        total, at, bounds = np.zeros(len(left) + 1), 0, np.flatnonzero(np.diff(left)) + 1  # the last entry, 0, is the chunk's end
        for stop in [*bounds.tolist(), len(left)]:
            if stop - at < SIDE_BY_SIDE:
                break
            a, b = first[at], first[stop]
            weight[a:b] += total[to[a:b]]
            heads = first[at:stop] - a
            high = np.maximum.reduceat(weight[a:b], heads)
            total[at:stop] = high + np.log(np.add.reduceat(np.exp(weight[a:b] - high[owner[a:b] - at]), heads))
            at = stop
        if at < len(left):  # few long chunks are left: one node at a time
            a = first[at]
            ends, tos, weights, sums = (first[at + 1 :] - a).tolist(), to[a:].tolist(), weight[a:].tolist(), total.tolist()
            e, exp, log = 0, math.exp, math.log
            for node, stop in enumerate(ends, at):
                for i in range(e, stop):
                    weights[i] += sums[tos[i]]
                high = max(weights[e:stop])
                sums[node] = high + log(sum([exp(w - high) for w in weights[e:stop]]))
                e = stop
            weight[a:], total[:] = weights, sums
        return total[:-1]

    def plain(self, numbers: np.ndarray, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The library's own encoding of chunks (what `numbers` gave for these characters): all ids in order, each chunk's number of ids and log-probability."""
        unseen = np.flatnonzero(self.plain_size[numbers] < 0)
        if len(unseen):
            new, example = np.unique(numbers[unseen], return_index=True)
            chars, example = codes.tobytes().decode("utf-32-le", "surrogatepass"), unseen[example]
            flat, sizes = self.vocabulary.encode([chars[a:b] for a, b in zip(at[example].tolist(), at[example + 1].tolist(), strict=True)])
            heads = np.cumsum(sizes) - sizes
            self._room({"plain_ids": self.n_plain + len(flat)})
            self.plain_ids[self.n_plain : self.n_plain + len(flat)] = flat
            self.plain_at[new], self.plain_size[new] = self.n_plain + heads, sizes
            self.plain_log_p[new] = np.add.reduceat(self.vocabulary.weight_of[flat], heads) - self.mass[new]
            self.n_plain += len(flat)
        sizes = self.plain_size[numbers]
        return self.plain_ids.take(runs(self.plain_at[numbers], sizes)), sizes, self.plain_log_p[numbers]

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path from each node to its chunk's end: all edges in order, and each path's number of edges."""
        steps, count = [], np.zeros(len(nodes), np.int64)
        active, t = np.flatnonzero(nodes >= 0), 0
        node, key = nodes.take(active), keys.take(active)
        while len(active):
            u, e = uniform(key + np.uint64(t)), self.first.take(node).astype(np.int64)
            miss = np.flatnonzero(u >= self.cum.take(e))
            at, rest = e.take(miss), u.take(miss)
            while len(miss):
                at += 1
                e[miss] = at
                more = np.flatnonzero(rest >= self.cum.take(at))
                miss, at, rest = miss.take(more), at.take(more), rest.take(more)
            t += 1
            count[active] = t
            steps.append((active, e))
            node = self.to.take(e)
            go = np.flatnonzero(node >= 0)
            active, node, key = active.take(go), node.take(go), key.take(go)
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for t, (who, e) in enumerate(steps):
            out[at.take(who) + t] = e
        return out, count

    def range(self, edge: int) -> tuple[int, int]:
        """The edges of the node that `edge` leaves: the first, and the one beyond the last."""
        beyond = int(np.searchsorted(self.first[: self.n_nodes + 1], np.int32(edge), side="right"))
        return int(self.first[beyond - 1]), int(self.first[beyond])

    def ids(self, path: np.ndarray) -> np.ndarray:
        ids = self.id.take(path)
        if not len(ids) or ids.min() >= 0:
            return ids
        out: list[int] = []
        for i in ids.tolist():
            if i < 0:
                out += self.several[-1 - i]
            else:
                out.append(i)
        return np.array(out, np.int32)


@cache
def worker_graph(model: str) -> Graph:
    """One graph a worker process, whatever number of tasks it runs."""
    return Graph(Vocabulary(model))


class Search:
    """The state of one text's search: the paths found and the sets still closed."""

    def __init__(self, nodes: np.ndarray, key: int):
        self.nodes, self.key = nodes, key
        self.paths: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []  # edges up to each word's end
        self.log_p: list[float] = []
        self.value: list[float] = []
        self.closed: list[tuple] = []  # (bound, path, edge number or -1 for the rest, edges left out)
        self.opened: tuple | None = None


def _close(view: Graph, searches: list[Search], fresh: list[np.ndarray], base: np.ndarray, bound: np.ndarray, sample: int, k: int, from_edge: list[int]) -> None:
    """Split what is left beside each new path into sets, and draw their bounds."""
    n = len(searches)
    sizes = np.fromiter(map(len, fresh), np.int64, n)
    width = min(OPEN, int(sizes.max(initial=0)))
    live = np.arange(width)[None, :] < sizes[:, None]
    lp = np.zeros((n, width))
    if width:
        lp[live] = view.log_p[np.concatenate([f[:width] for f in fresh])]
    ends = base[:, None] + np.cumsum(lp, axis=1)
    mass = np.where(live, ends - lp + log1mexp(lp), -np.inf)
    head = ends[:, -1] if width else base
    total = np.array([s.log_p[-1] for s in searches])
    rest = np.where(sizes > width, head + log1mexp(np.minimum(total - head, 0.0)), -np.inf)
    mass = np.concatenate((mass, rest[:, None]), axis=1)
    keys = np.array([s.key for s in searches], np.uint64) ^ np.uint64((sample + 1) << 8 | 1)
    u = uniform(mix(keys)[:, None] + np.arange(width + 1, dtype=np.uint64)[None, :])
    drawn = below(mass, bound[:, None], u)
    best = np.argsort(-drawn, axis=1, kind="stable")[:, :k]
    values = np.take_along_axis(drawn, best, axis=1)
    for s, b, v, start in zip(searches, best.tolist(), values.tolist(), from_edge, strict=True):
        path = len(s.paths) - 1
        for j, x in zip(b, v, strict=True):
            if x > -math.inf:
                s.closed.append((x, path, start + j if j < width else -1 - (start + width), ()))


def _open_rest(view: Graph, s: Search, entry: tuple, salt: int, k: int) -> tuple:
    """Split a set that leaves its path late; the part that holds its best member is returned, the k best others are closed."""
    bound, path, late, _ = entry
    start, edges = -1 - late, s.paths[path]
    lp = view.log_p[edges]
    mass = (np.cumsum(lp) - lp + log1mexp(lp))[start:]
    u = uniform(mix(np.array([s.key ^ salt], np.uint64)) + np.arange(2 * len(mass), dtype=np.uint64))
    pick = int(np.argmax(mass - np.log(-np.log(u[: len(mass)]))))
    drawn = below(mass, np.float64(bound), u[len(mass) :])
    drawn[pick] = -np.inf
    best = np.argsort(-drawn, kind="stable")[:k].tolist()
    s.closed += [(x, path, start + j, ()) for j, x in zip(best, drawn[best].tolist(), strict=True) if x > -math.inf]
    return bound, path, start + pick, ()


def chunks(graph: Graph, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `cut` gives for the texts, and the number of each chunk; it holds until the graph is asked again."""
    codes, at, count = graph.vocabulary.cut([marked(t) for t in texts])
    return codes, at, count, graph.numbers(codes, at)


def encode(graph: Graph, known: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, float, None, None]]:
    """SentencePiece's own encoding of each text of `chunks`: its ids and their log-probability."""
    codes, at, count, numbers = known
    ids, sizes, log_p = graph.plain(numbers, codes, at)
    chunk_at = np.concatenate(([0], np.cumsum(count)))
    id_at, sums = np.concatenate(([0], np.cumsum(sizes)))[chunk_at].tolist(), chunk_at.tolist()
    return [(ids[id_at[i] : id_at[i + 1]], float(log_p[sums[i] : sums[i + 1]].sum()), None, None) for i in range(len(count))]


def search(graph: Graph, texts: list[str], keys: np.ndarray, k: int, known: tuple | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to `k` (ids, log-probability, perturbed value, inclusion score), in order of value; `known` is what `chunks` gives."""
    _, _, count, numbers = known or chunks(graph, texts)
    starts = np.split(graph.head[numbers], np.cumsum(count)[:-1]) if texts else []
    view = graph
    searches = [Search(s, int(key)) for s, key in zip(starts, keys, strict=True)]
    first_value = -np.log(-np.log(uniform(mix(keys) ^ np.uint64(7)))) if len(keys) else np.empty(0)
    active = searches
    for sample in range(k):
        begin, skips, where = [], [], []
        word_keys = mix(np.array([s.key for s in active], np.uint64) + np.uint64(sample + 11))
        draws = uniform(mix(word_keys ^ np.uint64(3))).tolist()
        for i, s in enumerate(active):
            if s.opened is None:
                own, skip = s.nodes, 0
            else:
                _, path, edge, left_out = s.opened
                word = int(np.searchsorted(s.ends[path], edge, side="right"))
                gone = int(s.paths[path][edge])
                left_out = left_out or (gone,)
                a, b = view.range(gone)
                options = [e for e in range(a, b) if e not in left_out]
                p = [math.exp(x) for e, x in enumerate(view.log_p[a:b].tolist(), a) if e not in left_out]
                goal, chosen = draws[i] * sum(p), options[-1]
                for e, x in zip(options, p, strict=True):
                    goal -= x
                    if goal < 0:
                        chosen = e
                        break
                where.append((word, chosen, left_out))
                own, skip = np.concatenate((view.to[chosen : chosen + 1], s.nodes[word + 1 :])), word
            begin.append(own)
            skips.append(skip)
        sizes = np.fromiter(map(len, begin), np.int64, len(begin))
        word = runs(np.array(skips, np.int64), sizes).view(np.uint64)
        edges, count = view.walk(np.concatenate(begin) if begin else np.empty(0, np.int64), np.repeat(word_keys, sizes) + (word << np.uint64(20)))
        log_p = view.log_p.take(edges)
        word_at = np.concatenate(([0], np.cumsum(sizes)))
        edge_at, word_at = np.concatenate(([0], np.cumsum(count)))[word_at].tolist(), word_at.tolist()
        fresh, base, bound, from_edge = [], [], [], []
        for i, s in enumerate(active):
            new, own_count = edges[edge_at[i] : edge_at[i + 1]], count[word_at[i] : word_at[i + 1]]
            if s.opened is None:
                s.paths.append(new)
                s.ends.append(np.cumsum(own_count))
                value, start, before = float(first_value[i]), 0, 0.0
            else:
                value, path, edge, _ = s.opened
                word, chosen, left_out = where[i]
                old, old_ends = s.paths[path], s.ends[path]
                before = float(view.log_p[old[:edge]].sum())
                left = sum(math.exp(view.log_p[e]) for e in (*left_out, chosen))
                out = (*left_out, chosen)
                a, b = view.range(chosen)
                if len(out) < b - a and left < 1:
                    u = uniform(mix(np.array([s.key], np.uint64) ^ np.uint64(sample << 8 | 5)))
                    again = float(below(np.array([before + math.log1p(-left)]), np.array([value]), u)[0])
                    s.closed.append((again, path, edge, out))
                s.paths.append(np.concatenate((old[:edge], [chosen], new)))
                s.ends.append(np.concatenate((old_ends[:word], edge + 1 + np.cumsum(own_count))))
                start, before = edge + 1, before + float(view.log_p[chosen])
            s.log_p.append(before + float(log_p[edge_at[i] : edge_at[i + 1]].sum()))
            s.value.append(value)
            fresh.append(new)
            base.append(before)
            bound.append(value)
            from_edge.append(start)
        if active:
            _close(view, active, fresh, np.array(base), np.array(bound), sample, k, from_edge)
        following = []
        for s in active:
            s.closed.sort(reverse=True)
            if s.closed and sample + 1 < k:
                entry = s.closed.pop(0)
                s.opened = _open_rest(view, s, entry, sample << 8 | 9, k) if entry[2] < 0 else entry
                following.append(s)
        active = following
    found = []
    for s in searches:
        s.closed.sort(reverse=True)
        threshold = s.closed[0][0] if s.closed else -math.inf
        inclusion = [1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(700.0, lp - threshold))) for lp in s.log_p]
        found.append([(view.ids(p), lp, v, q) for p, lp, v, q in zip(s.paths, s.log_p, s.value, inclusion, strict=True)])
    return found


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str], np.ndarray]]:
    at, n = 0, batch.num_rows
    while at < n:
        texts, chars, to = [], 0, at
        while to < n and to - at < BATCH_DOCS and chars < BATCH_CHARS:
            texts.append((batch.column(1)[to].as_py() or b"").decode("utf-8", "replace"))
            chars += len(texts[-1])
            to += 1
        own = batch.column(0).slice(at, to - at)
        yield own, texts, own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        at = to


def _sampled(batches: Iterator[pa.RecordBatch], model: str, k: int, seed: int, names: list[str], own: bool = False, digest: bool = False) -> Iterator[pa.RecordBatch]:
    """The work of `sample` on batches of (doc_id, text); with `own`, rank 0 and the column source as `round_trip` needs them."""
    graph = worker_graph(model)
    vocabulary = graph.vocabulary
    for whole in batches:
        for ids, texts, key in _batches(whole):
            known = chunks(graph, texts)
            found = search(graph, texts, mix(key ^ mix(np.array([seed], np.uint64))), k, known)
            if own:
                found = [[first, *samples] for first, samples in zip(encode(graph, known), found, strict=True)]
            owner, rank, scores, content = [], [], [], []
            for i, (text, samples) in enumerate(zip(texts, found, strict=True)):
                plain = text.replace(MARK, " ").encode("utf-8", "replace") if digest else b""
                for r, (pieces, *rest) in enumerate(samples, 0 if own else 1):
                    owner.append(i)
                    rank.append(r)
                    scores.append(rest)
                    content.append((len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), vocabulary.decode(pieces.tolist()) == plain) if digest else pieces.astype(np.int32))
            owner = pa.array(owner, pa.int64())
            cols = [ids.take(owner), pa.array(rank, pa.int32())]
            if digest:
                cols += [pa.array(c, t) for c, t in zip(zip(*content, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            else:
                offsets = np.cumsum([0, *map(len, content)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(content) if content else [], pa.int32())))
            cols += [pa.array(c, pa.float64()) for c in zip(*scores, strict=True)]
            if own:
                cols.append(pa.array([t.replace(MARK, " ") for t in texts], pa.string()).take(owner))
            yield pa.RecordBatch.from_arrays(cols, names=names)
    graph.forget(KEPT_NODES // 16)  # what runs next in this worker may be no sampling


def sample(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED, digest: bool = False) -> DataFrame:
    """Up to `k` segmentations of every row of `docs` (doc_id, text): doc_id, rank, ids, log_prob, perturbed, inclusion.

    With `digest`, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and decoded (whether decoding the
    ids gives the text back) in place of the ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    what = "n_pieces long, ids_crc32 long, decoded boolean" if digest else "ids array<int>"
    schema = f"doc_id long, rank int, {what}, log_prob double, perturbed double, inclusion double"
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(lambda batches: _sampled(batches, model, k, seed, names, digest=digest), schema)


@cache
def piece_bytes(model: str) -> tuple[pa.Array, np.ndarray]:
    """What each id stands for, and after those what it stands for at a text's start; whether that is anything."""
    inside = worker_graph(model).vocabulary.bytes_of
    pieces = pa.array([*inside, *(b.removeprefix(b" ") for b in inside)], pa.binary())
    return pieces, np.array([b != b"" for b in inside])


def _decoded(lists: pa.Array, model: str) -> pa.Array:
    """The text that each list of ids stands for."""
    pieces, says = piece_bytes(model)
    ids, at = _flat(lists)
    which, heard = ids.copy(), np.append(np.flatnonzero(says[ids]), len(ids))
    head = heard[np.searchsorted(heard, at[:-1])]
    which[head[head < at[1:]]] += len(says)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), pieces.take(pa.array(which))), b"")
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:  # ids that no text has
        return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists in order, and where each list begins (and the last ends); null is no number."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)


def decode(samples: DataFrame, model: str) -> DataFrame:
    """`samples` (doc_id, rank, ids) with the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _decoded(batch.column(2), model)], names=["doc_id", "rank", "text"])

    return samples.select("doc_id", "rank", "ids").mapInArrow(run, "doc_id long, rank int, text string")


def round_trip(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Each row of `docs` encoded and decoded again: as SentencePiece does (rank 0), and in up to `k` sampled segmentations.

    doc_id, rank, ids, ids_crc32 (of the ids as little-endian 32-bit integers), log_prob, perturbed, inclusion (rank 0:
    null both) and decoded, whether the text that the ids stand for is the row's. `decode` gives those texts; here one
    worker does both steps, so that neither ids nor texts go through the JVM between them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, rank int, ids array<int>, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sampled(batches, model, k, seed, [*names[:3], *names[4:7], "source"], own=True):
            *columns, source = batch.columns
            ids, at = _flat(columns[2])
            raw, places = memoryview(ids.astype("<u4").tobytes()), (4 * at.astype(np.int64)).tolist()
            columns.insert(3, pa.array([zlib.crc32(raw[a:b]) for a, b in zip(places, places[1:], strict=False)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, pc.equal(_decoded(columns[2], model), source)], names=names)

    return rows.mapInArrow(run, schema)
