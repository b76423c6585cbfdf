"""Vocabularies of piece models: a reader of the serialised model, an
Aho-Corasick Viterbi encoder and a longest-match token counter.

The file's path is a parameter and is opened by the driver; executors get the
bounded vocabulary itself.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import deque
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathshade.llm.ship import shipped

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE = 200_000  # words a worker remembers, at most about 80 MB


def _fields(data: bytes):
    """(number, value) of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    squeeze: bool = False  # extra white space is removed

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Models that map characters or force user-defined pieces are refused:
        neither is done here, and ids would silently differ."""
        pieces, scores, kinds, spec = [], [], [], {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    p = dict(_fields(value))
                    pieces.append(p[1].decode())
                    scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                    kinds.append(p.get(3, NORMAL))
                elif number == 3:
                    spec = dict(_fields(value))
        if spec.get(2):
            raise ValueError(f"{path}: the model maps characters (normaliser {spec.get(1, b'').decode()!r})")
        if USER in kinds:
            raise ValueError(f"{path}: the model has user-defined pieces")
        return cls(pieces, scores, kinds, bool(spec.get(3, 1)), bool(spec.get(4, 1)))

    def matched(self) -> list[tuple[str, int, float]]:
        """(piece, id, score) of the pieces that occur in texts."""
        return [(p, i, s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True)) if k in (NORMAL, UNUSED) and p]


class Remembered(dict):
    """Results of ``make`` by word; short words are kept, up to a bound."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        found = self.make(word)
        if len(word) < 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found


class ViterbiEncoder:
    """The best-scoring segmentation into pieces.

    One pass of an Aho-Corasick automaton over a chunk reports, at each position,
    every piece that ends there (its output links); each relaxes the best score
    at that position from the one where it begins. Characters without a piece of
    their own cost ``min score - 10`` and become bytes, or the unknown piece where
    the model has no bytes. Ties go to the piece that begins first. Texts are cut
    where no piece can span, so chunks repeat and are encoded once.
    """

    def __init__(self, model: PieceModel):
        import ahocorasick

        self.model, self.cache = model, Remembered(self.encode_chunk)
        self.auto = ahocorasick.Automaton()
        low = 0.0
        singles, inner = set(), False
        for p, i, s in model.matched():
            self.auto.add_word(p, (len(p), i, s))
            low = min(low, s)
            if len(p) == 1:
                singles.add(p)
            inner |= SPACE in p.lstrip(SPACE)
        self.auto.make_automaton()
        self.penalty, self.singles, self.known = low - 10, singles, singles.issuperset
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        used = set("".join(p for p, _, _ in model.matched()))
        # no piece crosses from a word into the next's space mark, or holds a line break
        breaks = "".join(re.escape(c) for c in "\n\t\r" if c not in used)
        chars = f"[{breaks}]|" if breaks else ""
        self.chunk = re.compile(".+" if inner else f"{chars}{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+", re.S)
        # pieces and bytes alike as UTF-8, so that runs of bytes join to characters
        self.raw = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in self.byte.items():
            self.raw[i] = bytes((b,))

    def encode_chunk(self, chunk: str) -> tuple[tuple[int, ...], float]:
        n = len(chunk)
        best, piece, size = [0.0] + [-math.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        matches = self.auto.iter(chunk)
        if not self.known(chunk):  # a position of its own for each unknown character
            lone = [(k, (1, -1, self.penalty)) for k, c in enumerate(chunk) if c not in self.singles]
            matches = sorted([*matches, *lone], key=itemgetter(0))
        for last, (length, i, score) in matches:
            end = last + 1
            score += best[end - length]
            if score > best[end] or (score == best[end] and length > size[end]):
                best[end], piece[end], size[end] = score, i, length
        ids: list[int] = []
        end = n
        while end:
            i = piece[end]
            if i >= 0:
                ids.append(i)
            elif self.byte:
                ids += [self.byte[b] for b in reversed(chunk[end - 1].encode())]
            else:
                ids.append(self.unknown)
            end -= size[end]
        ids.reverse()
        return tuple(ids), best[n]

    def encode(self, text: str) -> tuple[list[int], float]:
        """Ids and total score. An empty text has no ids."""
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return [], 0.0
        text = (" " if self.model.dummy_prefix else "") + text
        found = list(map(self.cache.__getitem__, self.chunk.findall(text.replace(" ", SPACE))))
        return list(chain.from_iterable([f[0] for f in found])), math.fsum([f[1] for f in found])

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _mapped(docs: DataFrame, make, columns: list[tuple[str, str, pa.DataType]], id_col: str) -> DataFrame:
    """Rows (id, *columns) from ``make()(text)`` for each text, in small batches."""
    schema = pa.schema([(id_col, pa.int64()), *((n, t) for n, _, t in columns)])

    def run(batches):
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [f(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array([r[j] for r in rows], t) for j, (_, _, t) in enumerate(columns))], schema=schema)

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} long, " + ", ".join(f"{n} {s}" for n, s, _ in columns))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids, score of every whole text. A null text is empty and has no ids,
    repeated rows are encoded alike, texts of any length whole; null ids stay null, an empty table
    gives no rows, and other columns are not looked at, whatever their names."""
    model = shipped(docs.sparkSession, PieceModel.load(path))

    def make():
        return ViterbiEncoder(model()).encode

    return _mapped(docs, make, [("ids", "array<int>", pa.list_(pa.int32())), ("score", "double", pa.float64())], id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text from doc_id, ids (null ids: an empty text). Repeated rows are
    decoded alike, an empty table gives no rows, other columns are not looked at."""
    model = shipped(tokens.sparkSession, PieceModel.load(path))
    schema = pa.schema([(id_col, pa.int64()), ("text", pa.string())])

    def run(batches):
        f = ViterbiEncoder(model()).decode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([f(x or ()) for x in part.column(1).to_pylist()], pa.string())], schema=schema)

    return tokens.select(id_col, "ids").mapInArrow(run, f"{id_col} long, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, score, ids_sha256 (of the ids as little-endian 32-bit
    integers) and whether decoding gives the text again, for every row as ``encode`` treats it."""
    model = shipped(docs.sparkSession, PieceModel.load(path))

    def make():
        coder = ViterbiEncoder(model())

        def one(text: str):
            ids, score = coder.encode(text)
            return len(ids), score, hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), coder.decode(ids) == text

        return one

    return _mapped(docs, make, [("n_tokens", "long", pa.int64()), ("score", "double", pa.float64()), ("ids_sha256", "string", pa.string()), ("round_trip", "boolean", pa.bool_())], id_col)


class LongestMatchCounter:
    """Greedy longest-match word-piece counts in one linear pass.

    A trie holds the pieces that begin a word and, below a second root, those
    that continue one. A node's failure link leads to the node reached once the
    longest pieces that match are popped off; only their number is kept. A piece that
    begins words and is empty is the mark of a word's beginning alone.

    With ``bytes_`` a character at which no piece begins becomes its UTF-8 bytes, so
    every word has a count; else a word that cannot be segmented is one unknown token.
    """

    def __init__(self, first: list[str], inner: list[str], bytes_: bool = False):
        self.bytes_ = bytes_
        self.go: list[dict[str, int]] = [{}, {}]
        ends: dict[int, int] = {}

        def add(root: int, word: str, pieces: int) -> None:
            node = root
            for c in word:
                nxt = self.go[node].get(c)
                if nxt is None:
                    nxt = self.go[node][c] = len(self.go)
                    self.go.append({})
                node = nxt
            ends.setdefault(node, pieces)

        for w in first:
            add(0, w, 1)
        for w in inner:
            if w:
                add(1, w, 1)
        if bytes_:
            add(0, "", len(SPACE.encode()))
            for c in set("".join([*first, *inner])):
                add(1, c, len(c.encode()))
        size = len(self.go)
        self.fail: list[int] = [-1] * size
        self.pops: list[int] = [0] * size
        if 0 in ends:
            self.fail[0], self.pops[0] = 1, ends[0]
        todo = deque((0, 1))
        while todo:
            u = todo.popleft()
            for c, v in self.go[u].items():
                if v in ends:
                    self.fail[v], self.pops[v] = 1, ends[v]
                else:
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.go[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.go[z][c], n
                todo.append(v)

    @classmethod
    def of(cls, model: PieceModel) -> LongestMatchCounter:
        words = [p for p, _, _ in model.matched()]
        return cls([p[1:] for p in words if p.startswith(SPACE)], [p for p in words if not p.startswith(SPACE)], model.kinds.count(BYTE) == 256)

    def count(self, word: str) -> int:
        """Pieces of the word; 0: it cannot be segmented."""
        go, fail, pops = self.go, self.fail, self.pops
        node = n = 0
        for c in word:
            while (nxt := go[node].get(c)) is None:
                if node == 1 and self.bytes_:
                    n += len(c.encode())
                    nxt = 1
                    break
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = nxt
        while node != 1:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


WORD = re.compile("[^\x20\x09-\x0d]+")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens (an unknown word is one token), n_unknown of
    every whole text; null and empty texts have none. Repeated rows are counted alike, texts of any
    length whole; null ids stay null, an empty table gives no rows, other columns are not looked at."""
    counter = shipped(docs.sparkSession, LongestMatchCounter.of(PieceModel.load(path)))

    def make():
        cache = Remembered(counter().count)

        def one(text: str):
            words = WORD.findall(text)
            counts = list(map(cache.__getitem__, words))
            unknown = counts.count(0)
            return len(words), sum(counts) + unknown, unknown

        return one

    return _mapped(docs, make, [("n_words", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("n_unknown", "long", pa.int64())], id_col)
