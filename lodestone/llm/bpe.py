"""BPE encoding and decoding with a contiguous rank array.

The vocabulary and merges come from a tokenizer file (a parameter, never
copied here): NFC, lower case, a split into contractions, letters, single
digits and other signs, bytes as symbols, and a word-end mark. White space is
dropped.

New words of a batch are encoded together, those of one length in one matrix:
a row holds the parts of a word (its boundaries are implied by the parts left)
and beside them the ranks of adjacent parts. A step finds each row's minimum
rank, leftmost first, deletes that boundary, and refreshes the two neighbouring
ranks. Known words are kept in a table of bounded size per Python worker, which
goes when the worker turns to other work.

Scale: a map over the documents, nothing is shuffled; the vocabulary is read
once per worker from the path given to it, or from the broadcast bytes of the
file (a fixed size of a few MB).

Defined results
- Null and empty texts have no tokens and decode to the empty text.
- Special tokens written in a text become their ids; what is between them is encoded by itself.
- Rows that repeat give the same result each; an empty table gives an empty result.
- Extra columns pass through unchanged; where one has a name of a result column, it is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the tokenizer's format: Unicode's white space (code points, ranges as pairs) and the split pattern.
SPACES = [(0x09, 0x0D), 0x20, 0x85, 0xA0, 0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = "".join(f"{chr(x[0])}-{chr(x[1])}" if isinstance(x, tuple) else chr(x) for x in SPACES)
# Letters and numbers that Unicode 16 added to version 15.1, which Python's tables have.
NEWER = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), 0x1138B, 0x1138E, (0x11390, 0x113B5), 0x113B7, 0x113D1, 0x113D3, (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), 0x18CFF, (0x1E5D0, 0x1E5ED), 0x1E5F0],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}


def members(kind: str, top: int = 0x110000) -> str:
    """The characters below ``top`` of a general category (its first letter), for a character class."""
    ranges: list[list[int]] = []
    for c in range(top):
        if unicodedata.category(chr(c))[0] == kind:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


@functools.cache
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """Contractions, runs of letters, single numbers, runs of other signs: for characters below U+0250 (fast), and for all."""

    def split(letter: str, number: str) -> re.Pattern:
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+")

    newer = {k: "".join(f"{chr(x[0])}-{chr(x[1])}" if isinstance(x, tuple) else chr(x) for x in v) for k, v in NEWER.items()}
    return split(members("L", 0x250), members("N", 0x250)), split(members("L") + newer["L"], members("N") + newer["N"])


def split_words(text: str) -> list[str]:
    """The words of a normalised text."""
    return patterns()[max(text, default="") >= "\u0250"].findall(text)


SPACE_RUN = re.compile(f"[{SPACE}]+")
CONTROL = re.compile("[\x1c-\x1f]")


WORD_END = "</w>"
NONE = np.int64(2**40)
#: Chunks that a worker remembers; beyond, the tables are started anew.
REMEMBERED = 200_000
#: Words of more bytes are merged by a heap, as scanning for the minimum takes the square of the length.
LONG = 256
#: Rows that are encoded, and handed on, together.
ROWS = 200
#: Parts in a matrix of words at most, unless one word has more.
CELLS = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 is itself, the rest follows from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file (its bytes)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([self.vocab[s + WORD_END] for s in symbols], dtype=np.int64)
        self.size = len(self.token)
        pairs = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append((self.vocab[a] * self.size + self.vocab[b], rank, self.vocab[a + b]))
        table = np.array(sorted(pairs), dtype=np.int64)
        # An open-addressed table: one gather finds nearly every pair.
        self.bits = 19
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int64)
        at = self._slot(table[:, 0])
        left = np.arange(len(table))
        self.probes = 0
        while len(left):
            free = self.keys[at[left]] == -1
            first = np.unique(at[left][free], return_index=True)[1]
            done = left[free][first]
            self.keys[at[done]], self.ranks[at[done]] = table[done, 0], table[done, 1]
            left = np.setdiff1d(left, done)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.merged = np.zeros(len(table), dtype=np.int64)
        self.merged[table[:, 1]] = table[:, 2]
        self.number = [str(i) for i in range(max(self.token) + 1)]
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pairs: dict[int, tuple[int, int]] = {}
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, NONE where there is no merge; an id below 0 is no part."""
        key = left * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at, out = self._slot(key), np.full(key.shape, NONE)
        todo = np.ones(key.shape, dtype=bool)
        for _ in range(self.probes):
            hit = self.keys[at]
            found = todo & (hit == key)
            out[found] = self.ranks[at[found]]
            todo &= (hit != key) & (hit != -1)
            if not todo.any():
                break
            at = (at + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, parts: np.ndarray) -> np.ndarray:
        """Merge rows of part ids (all of one length) to the end; free places are -1, at the end of a row."""
        parts = parts.copy()
        n, width = parts.shape
        ranks = np.full((n, width), NONE)
        if width > 1:
            ranks[:, :-1] = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        rows = np.arange(n)
        places = np.arange(width)
        while len(rows):
            p, r = parts[rows], ranks[rows]
            at = r.argmin(axis=1)
            k = np.arange(len(rows))
            best = r[k, at]
            go = best < NONE
            if not go.all():
                rows, p, r, at, best = rows[go], p[go], r[go], at[go], best[go]
                k = np.arange(len(rows))
                if not len(rows):
                    break
            # delete the boundary behind ``at``: what follows moves up by one place
            source = np.minimum(places + (places > at[:, None]), width - 1)
            p, r = np.take_along_axis(p, source, 1), np.take_along_axis(r, source, 1)
            p[:, -1], r[:, -1] = -1, NONE
            p[k, at] = self.merged[best]
            after = np.where(at + 1 < width, p[k, np.minimum(at + 1, width - 1)], -1)
            before = np.where(at > 0, p[k, np.maximum(at - 1, 0)], -1)
            fresh = self.rank(np.concatenate([p[k, at], before]), np.concatenate([after, p[k, at]]))
            r[k, at] = fresh[: len(k)]
            inside = at > 0
            r[k[inside], at[inside] - 1] = fresh[len(k) :][inside]
            parts[rows], ranks[rows] = p, r
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """As ``merge`` for one long word: a heap of adjacent ranks over linked parts, so that time grows with n log n."""
        if not self.pairs:
            some = np.flatnonzero(self.keys >= 0)
            self.pairs = {k: (r, m) for k, r, m in zip(self.keys[some].tolist(), self.ranks[some].tolist(), self.merged[self.ranks[some]].tolist())}
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(got[0], i, x, y) for i, (x, y) in enumerate(zip(parts, parts[1:])) if (got := self.pairs.get(x * self.size + y))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if j == n or parts[i] != x or parts[j] != y:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = self.pairs[x * self.size + y][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (got := self.pairs.get(parts[a] * self.size + parts[b])):
                    heapq.heappush(heap, (got[0], a, parts[a], parts[b]))
        return [x for x in parts if x >= 0]

    def encode_words(self, words: list[str]) -> dict[str, tuple[str, str]]:
        """Ids and tokens of each word, joined by blanks."""
        out = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            by_length.setdefault(len(b), []).append((w, b))
        for length, group in by_length.items():
            if length > LONG:
                for w, b in group:
                    row = self.merge_long([*self.inner[list(b[:-1])].tolist(), int(self.final[b[-1]])])
                    out[w] = (" ".join([self.number[x] for x in row]), " ".join([self.token[x] for x in row]))
                continue
            step = max(1, CELLS // length)
            for i in range(0, len(group), step):
                some = group[i : i + step]
                raw = np.frombuffer(b"".join([b for _, b in some]), dtype=np.uint8).reshape(len(some), length)
                parts = self.inner[raw]
                parts[:, -1] = self.final[raw[:, -1]]
                parts = self.merge(parts)
                sizes = (parts >= 0).sum(axis=1).tolist()
                for (w, _), row, n in zip(some, parts.tolist(), sizes):
                    out[w] = (" ".join([self.number[x] for x in row[:n]]), " ".join([self.token[x] for x in row[:n]]))
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks of text without white space and remember them."""
        if len(self.ids) + len(chunks) > REMEMBERED:
            self.ids, self.tokens = {}, {}
        # a special token's key starts with a blank, which no chunk of text holds
        for content, i in self.special.items():
            self.ids[f" {content}"], self.tokens[f" {content}"] = str(i), content
        split = {c: split_words(c) for c in chunks if c not in self.ids}
        words = self.encode_words(list({w for ws in split.values() for w in ws}))
        for c, ws in split.items():
            got = [words[w] for w in ws]
            self.ids[c] = " ".join([g[0] for g in got])
            self.tokens[c] = " ".join([g[1] for g in got])

    def chunks(self, text: str) -> list[str]:
        """Runs without white space of the normalised text, and the keys of special tokens between them."""
        if not any(s in text for s in self.special):
            return self.cut(self.normal(text))
        out = []
        for i, piece in enumerate(self.specials.split(text)):
            out += [f" {piece}"] if i % 2 else self.cut(self.normal(piece))
        return out

    @staticmethod
    def cut(text: str) -> list[str]:
        return text.split() if not CONTROL.search(text) else [x for x in SPACE_RUN.split(text) if x]

    @staticmethod
    def normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "\u03a3" not in text else "".join([c.lower() for c in text])

    def encode_batch(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by blanks, decoded text) of each text."""
        split = [self.chunks(t) if t else [] for t in texts]
        new: set[str] = set()
        for cs in split:
            new.update(itertools.filterfalse(self.ids.__contains__, cs))
        if new:
            self.learn(new)
            if len(self.ids) <= len(new) + len(self.special):  # started anew: the batch's known chunks are gone too
                self.learn({c for cs in split for c in cs})
        out = []
        for cs in split:
            ids = " ".join(map(self.ids.__getitem__, cs))
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(map(self.tokens.__getitem__, cs))))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of known ids, joined by blanks, special tokens too."""
        return " ".join(self.token[i] for i in ids if i in self.token)


class Shared:
    """The bytes of a tokenizer file, for a broadcast. A worker makes its encoder once and keeps it, with what it remembers,
    as long as the broadcast: until its first task that does not use it."""

    def __init__(self, data: bytes):
        self.data = data

    @functools.cached_property
    def encoder(self) -> WordBpe:
        return WordBpe(self.data)


def _mapped(docs: DataFrame, tokenizer_path: str, text_col: str, fields: list[T.StructField], make) -> DataFrame:
    """Add ``fields`` to every row; ``make`` turns (n, ids, decoded) into their values."""
    with open(tokenizer_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(Shared(f.read()))
    names = [f.name for f in fields]
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value.encoder
        kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.string() for f in fields]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                got = [make(*x) for x in bpe.encode_batch(batch.column(1).to_pylist())]
                columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *names])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *fields])
    return rows.mapInArrow(run, schema).select("row.*", *names)


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids`` (array of int) and ``decoded``."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return _mapped(docs, tokenizer_path, text_col, fields, lambda n, ids, text: (n, [int(x) for x in ids.split()], text))


def digests(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; the ids and texts stay in the tasks."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, tokenizer_path, text_col, fields, lambda n, ids, text: (n, sha(ids), sha(text)))
