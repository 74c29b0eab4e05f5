"""LM scoring by a hierarchical Pitman-Yor model of word triples.

Three levels of Chinese restaurants. The last two words (u, v) are a context
whose customers are the words that follow in the training texts; its tables are
customers of the parent that all contexts ending in v share; the tables of the
parents are customers of the one root, whose base measure is uniform over the
known words and one unknown word. The end token stands before a text's start.

Seating is sampled by Gibbs: in a sweep every customer leaves its table and sits
down again by the Chinese-restaurant rule. A dish is known by its customers c
and tables t; a customer sits alone with the probability S(c-1, t-1) / S(c, t)
of generalised Stirling numbers. Most moves change nothing, so the sampler draws
how many moves pass until the number of tables changes (a geometric number) and
takes c moves in all: the law is that of one move after the other. The dishes of
a restaurant move side by side. After a burn-in the predictive probabilities of
some sweeps are averaged; their logarithms are summed up per document.

On Spark: documents become parts of about a million tokens; a part sends each
bucket the triples whose contexts the bucket holds, packed. All contexts ending
in v are in one bucket, with their parent. A very frequent v is dealt over more
buckets by a hash of u; then each of them has a parent of its own for v. The
buckets seat their contexts once, with their own words standing in for the root,
and send the tables to the words' buckets, which seat the root for all and
answer each bucket. With this shared root the buckets seat anew, sample and sum
up. The triples are shuffled once and read twice; no document, word or context
passes through the driver but the list of very frequent words.

Defined results
- Null and empty texts are one end token. Rows with a null id are training rows.
- Rows that repeat are scored, and learnt from, one by one.
- Without training rows the base measure gives one word, the unknown one, probability 1.
- An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import functools
import threading
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens and documents of a part, tokens of a bucket, and tokens that are seated in one go (they bound a task's memory).
PART_TOKENS, PART_DOCS, BUCKET_TOKENS, SEATED_TOKENS = 2_000_000, 60_000, 2_800_000, 600_000
#: A word of more tokens than this is dealt over several buckets; at most so many words are.
CLASS_TOKENS, FREQUENT_WORDS = 250_000, 200_000
#: Discounts and strengths of the root, the parents and the contexts.
DISCOUNTS, STRENGTHS = (0.7, 0.8, 0.85), (1.0, 1.0, 1.0)
#: Sweeps before sampling, and sampled sweeps.
BURN_IN, SAMPLES = 2, 3
#: Up to so many customers the Stirling ratios are exact; beyond they follow the tilted limit law.
STIRLING = 1024
REMEMBERED = 300_000
#: Buckets that a corpus gets if it has some tokens for each, however few.
SPREAD = 16
U = np.uint64


# --- packed arrays -------------------------------------------------------------------------------

_own = threading.local()


def squeezed(x: np.ndarray) -> bytes:
    """The bytes of an array, place by place, compressed."""
    if not hasattr(_own, "deflate"):
        _own.deflate, _own.inflate = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return _own.deflate.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes())


def spread(data: bytes, kind: str) -> np.ndarray:
    if not hasattr(_own, "inflate"):
        _own.deflate, _own.inflate = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    flat = np.frombuffer(_own.inflate.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: unsigned integers in the smallest type that holds them, hashes as differences, of which sorted ones have a byte or two less."""
    out = []
    for x in arrays:
        if x.dtype == U:
            kind, raw = b"hash", squeezed(np.diff(x.astype("<u8"), prepend=U(0))) if len(x) else b""
        else:
            if x.dtype.kind != "f" and len(x) and x.min() >= 0:
                x = x.astype(np.min_scalar_type(int(x.max())))
            kind, raw = x.dtype.str.encode().ljust(4), squeezed(x) if len(x) else b""
        out += [kind, len(raw).to_bytes(8, "little"), raw]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 12], "little")
        at += 12
        if kind == b"hash":
            out.append(np.cumsum(spread(data[at : at + size], "<u8"), dtype=U) if size else np.empty(0, dtype=U))
        elif size:
            out.append(spread(data[at : at + size], kind.decode().strip()))
        else:
            out.append(np.empty(0, dtype=kind.decode().strip()))
        at += size
    return out


# --- words ---------------------------------------------------------------------------------------


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


#: The end token's hash is that of a string no word can be.
END = hash_of(b" ")


class WordNumbers(dict):
    """Words in the order of their first use; the end token is 0."""

    def __init__(self):
        self[b" "] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(values)]]).astype(np.int64)


# --- Chinese restaurants -------------------------------------------------------------------------


@functools.lru_cache(maxsize=4)
def stirling_ratios(d: float, top: int) -> np.ndarray:
    """[c, t]: S(c-1, t-1) / S(c, t) for generalised Stirling numbers of discount d."""
    out = np.zeros((top + 1, top + 1), dtype=np.float32)
    last = np.full(top + 1, -np.inf)
    last[0] = 0
    with np.errstate(divide="ignore"):
        for c in range(1, top + 1):
            t = np.arange(1, c + 1)
            new = np.full(top + 1, -np.inf)
            new[1 : c + 1] = np.logaddexp(last[:c], np.log(np.maximum(c - 1 - d * t, 0)) + last[1 : c + 1])
            out[c, 1 : c + 1] = np.exp(last[:c] - new[1 : c + 1])
            last = new
    return out


@functools.lru_cache(maxsize=4)
def sibuya_ones(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Of Sibuya's law of discount d, tilted: logarithms of the mean, ascending, and the probability of 1."""
    y = np.exp(np.linspace(-1e-4, -80, 4000))
    return np.log((1 - y) * d * y ** (d - 1) / (1 - y**d)), d * (1 - y) / (1 - y**d)


def limit_ratios(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for many customers: table sizes follow Sibuya's law, tilted to the mean c / t."""
    mean, ones = sibuya_ones(d)
    return np.minimum(1.0, (t - 1) * np.interp(np.log(c / np.maximum(t, 1)), mean, ones) / (c - 1))


class Seats:
    """Dishes of restaurants: ``c`` customers and ``t`` tables of each, in the restaurant ``where``."""

    def __init__(self, c: np.ndarray, where: np.ndarray, n_places: int, d: float, strength: float, rng: np.random.Generator):
        self.c, self.where, self.d, self.strength, self.rng = c, where, d, strength, rng
        self.t = np.minimum(c, 1)
        self.customers = np.bincount(where, c, minlength=n_places)
        self.tables = np.bincount(where, self.t, minlength=n_places)

    def alone(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        few = c <= STIRLING
        table = stirling_ratios(self.d, STIRLING)
        if few.all():
            return table[c, t].astype(np.float64)
        out = np.empty(len(c))
        out[few] = table[c[few], t[few]]
        out[~few] = limit_ratios(c[~few], t[~few], self.d)
        return out

    def sweep(self, parent: np.ndarray) -> None:
        """Each customer moves once. ``parent``: the probability of each dish in the parent restaurant."""
        rows = np.flatnonzero(self.c >= 2)
        left = self.c[rows].astype(np.float64)
        while len(rows):
            c, t, p, at = self.c[rows], self.t[rows], parent[rows], self.where[rows]
            alone, tables = self.alone(c, t), self.tables[at]
            fresh, stay = (self.strength + self.d * (tables - 1)) * p, c - 1 - self.d * (t - 1)
            down = alone * stay / (fresh + stay)
            fresh, stay = (self.strength + self.d * tables) * p, c - 1 - self.d * t
            # at one customer more than tables, all but one sit alone; nobody joins a table that is not there
            up = np.where(t < c, (1 - alone) * fresh / (fresh + np.maximum(stay, 1e-12)), 0.0)
            change = np.minimum(down + up, 1.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                wait = np.ceil(np.log(1 - self.rng.random(len(rows))) / np.log1p(-np.minimum(change, 1 - 1e-12)))
            left -= np.where(change > 0, np.maximum(wait, 1), np.inf)
            step = np.where(self.rng.random(len(rows)) * change < up, 1, -1)
            go = left >= 0
            rows, left, step = rows[go], left[go], step[go]
            self.t[rows] += step
            np.add.at(self.tables, at[go], step)

    def become(self, c: np.ndarray, parent: np.ndarray) -> None:
        """Customers come and go, one at a time at each dish, until there are ``c``."""
        down, up = np.flatnonzero(c < self.c), np.flatnonzero(c > self.c)
        while len(down):
            gone = self.rng.random(len(down)) < self.alone(self.c[down], self.t[down])
            self.t[down] -= gone
            np.subtract.at(self.tables, self.where[down[gone]], 1)
            self.c[down] -= 1
            down = down[c[down] < self.c[down]]
        while len(up):
            at = self.where[up]
            fresh, stay = (self.strength + self.d * self.tables[at]) * parent[up], np.maximum(self.c[up] - self.d * self.t[up], 0)
            new = (self.t[up] == 0) | (self.rng.random(len(up)) * (fresh + stay) < fresh)
            self.t[up] += new
            np.add.at(self.tables, at[new], 1)
            self.c[up] += 1
            up = up[c[up] > self.c[up]]
        self.customers = np.bincount(self.where, self.c, minlength=len(self.tables))

    def predictive(self, parent: np.ndarray) -> np.ndarray:
        own = np.maximum(self.c - self.d * self.t, 0)
        return (own + (self.strength + self.d * self.tables[self.where]) * parent) / (self.strength + self.customers[self.where])


class Contexts:
    """The distinct triples of a bucket, and the restaurants of (u, v) and of v."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, learnt: np.ndarray, n_words: int):
        """Tokens as numbers below ``n_words``; ``learnt`` marks those of training texts."""
        if n_words < 1 << 20:
            key = (v * n_words + u) * n_words + w
        else:  # the pairs' numbers, so that a key fits into 63 bits
            key = np.unique(v * n_words + u, return_inverse=True)[1] * n_words + w
        keys, at, self.of_token = np.unique(key, return_index=True, return_inverse=True)
        self.count = np.bincount(self.of_token, learnt, minlength=len(keys)).astype(np.int64)
        pairs = keys // n_words
        self.context = np.cumsum(np.diff(pairs, prepend=pairs[0]) != 0)
        dishes, self.up = np.unique(v[at] * n_words + w[at], return_inverse=True)
        self.word = dishes % n_words
        self.parent = np.cumsum(np.diff(dishes // n_words, prepend=dishes[0] // n_words) != 0)
        self.n_contexts, self.n_parents = int(self.context[-1]) + 1, int(self.parent[-1]) + 1

    def sample(self, root: np.ndarray | None, seed: list[int], burn_in: int, samples: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean predictive probabilities of the triples, and the parents' tables by word. Without a ``root`` (by word) the own tables stand in."""
        rng = np.random.default_rng(seed)
        low = Seats(self.count, self.context, self.n_contexts, DISCOUNTS[2], STRENGTHS[2], rng)
        high = Seats(np.bincount(self.up, low.t, minlength=len(self.word)).astype(np.int64), self.parent, self.n_parents, DISCOUNTS[1], STRENGTHS[1], rng)
        mean = np.zeros(len(self.count))
        for sweep in range(burn_in + samples):
            base = (self.own_root(high, n_words) if root is None else root)[self.word]
            low.sweep(high.predictive(base)[self.up])
            high.become(np.bincount(self.up, low.t, minlength=len(self.word)).astype(np.int64), base)
            high.sweep(base)
            if sweep >= burn_in:
                mean += low.predictive(high.predictive(base)[self.up]) / samples
        return mean, np.bincount(self.word, high.t, minlength=n_words).astype(np.int64)

    def own_root(self, high: Seats, n_words: int) -> np.ndarray:
        tables = np.bincount(self.word, high.t, minlength=n_words)
        known = max(1, int((tables > 0).sum()))
        d, strength = DISCOUNTS[0], STRENGTHS[0]
        return (np.maximum(tables - d, 0) + (strength + d * known) / (known + 1)) / (strength + tables.sum())


FIXED = 1 << 24


def fixed(x: np.ndarray) -> np.ndarray:
    """Sums of logarithms (0 or less) as whole numbers, which pack well."""
    return np.round(x * -FIXED).astype(np.int64)


# --- stages --------------------------------------------------------------------------------------

SENT = "bucket long, part long, payload binary"
ASKED = "wb long, bucket long, payload binary"
ROOT = "bucket long, wb long, payload binary, n long, v long, customers long, tables double"


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def frequent_words(docs: DataFrame, least: int) -> tuple[list[tuple[bytes, int]], int]:
    """The words of over ``least`` tokens (at most ``FREQUENT_WORDS``) with their counts, and the number of all tokens.

    All words are counted: a task adds up what it remembers and hands it on when it is too much, so the list does not depend on how rows are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = Counter(), 0
        handed = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                total += len(words) + 1
                found.update(words)
                if len(found) > REMEMBERED:
                    yield handed(found)
                    found.clear()
        yield handed(found + Counter({b"": total}))

    counts = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    all_ = F.col("word") == F.lit(b"")
    most = counts.filter(all_ | (F.col("n") > least)).orderBy(all_.desc(), F.desc("n"), "word").limit(FREQUENT_WORDS + 1).collect()
    return [(bytes(r.word), r.n) for r in most if len(r.word)], next((r.n for r in most if not len(r.word)), 0)


def _send(part: int, ids: list, lens: list[int], known: dict[bytes, int], tokens: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray], n_buckets: int) -> Iterator[tuple]:
    """What a part sends to the buckets; the first message also carries what is known of its documents."""
    lens_ = np.array(lens, dtype=np.int64)
    hashes = np.fromiter(map(hash_of, known), dtype=U, count=len(known))
    hashes[0] = END
    words, rank = np.unique(hashes, return_inverse=True)
    w, end = rank.astype(np.int32)[np.concatenate(tokens)], np.int32(rank[0])
    starts = np.cumsum(lens_) - lens_
    v = np.roll(w, 1)
    v[starts] = end
    u = np.roll(v, 1)
    u[starts] = end
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), lens_)
    classes = np.ones(len(words), dtype=U)
    at = np.searchsorted(frequent[0], words)
    hit = np.flatnonzero(frequent[0][np.minimum(at, len(frequent[0]) - 1)] == words) if len(frequent[0]) else []
    classes[hit] = frequent[1][at[hit]]
    mixed = scattered(words)
    bucket = (scattered(mixed[v] + mixed[u] % classes[v]) % U(n_buckets)).astype(np.int32)
    order = np.argsort((v.astype(np.int64) * len(words) + u) * len(words) + w) if len(words) < 1 << 20 else np.lexsort((w, u, v))
    if n_buckets > 1:
        order = order[np.argsort(bucket[order], kind="stable")]
    u, v, w, doc, bucket = (x[order] for x in (u, v, w, doc, bucket))
    held = np.array([is_held_out(i) for i in ids], dtype=np.uint8)
    meta = pack(np.array([i or 0 for i in ids], dtype=np.int64), np.array([i is not None for i in ids], dtype=np.uint8), lens_)
    for i, j in zip(*runs(bucket)):
        own, number = numbered(len(words), u[i:j], v[i:j], w[i:j])
        a, b = runs(number[1])
        docs, (of_doc,) = numbered(len(ids), doc[i:j])
        payload = pack(words[own], number[0], number[1][a], b - a, number[2], np.diff(docs, prepend=0), held[docs], of_doc)
        yield int(bucket[i]), part, len(meta).to_bytes(8, "little") + meta + payload
        meta = b""


def numbered(n: int, *arrays: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values (below n) of some arrays, ascending, and the arrays as numbers of these."""
    if 32 * len(arrays[0]) < n:
        own, number = np.unique(np.concatenate(arrays), return_inverse=True)
        return own, list(number.reshape(len(arrays), -1))
    seen = np.zeros(n, dtype=bool)
    for x in arrays:
        seen[x] = True
    number = np.cumsum(seen, dtype=np.int32) - 1
    return np.flatnonzero(seen), [number[x] for x in arrays]


def sent(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], n_buckets: int, part_tokens: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, lens, tokens, n, number = WordNumbers(), [], [], [], 0, TaskContext.get().partitionId() << 24

        def send() -> Iterator[pa.RecordBatch]:
            for row in _send(number, ids, lens, known, tokens, shared.value, n_buckets):
                yield from _rows(["bucket", "part", "payload"], [pa.int64(), pa.int64(), pa.binary()], [row]).to_batches()

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                words.append(b" ")
                ids.append(i)
                lens.append(len(words))
                tokens.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
                n += len(words)
                if n >= part_tokens or len(ids) >= PART_DOCS:
                    yield from send()
                    known, ids, lens, tokens, n, number = WordNumbers(), [], [], [], 0, number + 1
        if ids:
            yield from send()

    return docs.select("id", "text").mapInArrow(run, SENT)


class Bucket:
    """The messages to a bucket: its tokens as numbers of its words, and of the documents of all its messages."""

    def __init__(self, table: pa.Table):
        rows = table.select(["part", "payload"]).sort_by("part").to_pylist()
        self.parts, self.meta, self.docs, held, local = [], [], [], [], []
        for r in rows:
            cut = 8 + int.from_bytes(r["payload"][:8], "little")
            self.parts.append(r["part"])
            self.meta.append(r["payload"][8:cut])
            own, u, v, n, w, docs, out, of_doc = unpack(r["payload"][cut:])
            r["payload"] = None
            self.docs.append(np.cumsum(docs.astype(np.int64)))
            held.append(out)
            local.append((own, u, np.repeat(v, n), w, of_doc))
        self.words, numbers = np.unique(np.concatenate([x[0] for x in local]), return_inverse=True)
        numbers = numbers.astype(np.int32)
        size = sum(len(x[3]) for x in local)
        self.u, self.v, self.w, self.of_doc = (np.empty(size, dtype=np.int32) for _ in range(4))
        at = token = self.n_docs = 0
        for i, docs in enumerate(self.docs):
            (own, *of), local[i] = local[i], None
            to, number = token + len(of[3]), numbers[at : at + len(own)]
            for x, y in zip((self.u, self.v, self.w), of):
                x[token:to] = number[y]
            self.of_doc[token:to] = of[3].astype(np.int32) + self.n_docs
            at, token, self.n_docs = at + len(own), to, self.n_docs + len(docs)
        self.learnt = (1 - np.concatenate(held))[self.of_doc]
        self.followers = np.unique(self.w)

    def contexts(self) -> Iterator[tuple[np.ndarray, Contexts]]:
        """The contexts by some of the last words at a time, and the tokens' places."""
        n = -(-len(self.w) // SEATED_TOKENS)
        some = (scattered(self.words + U(2)) % U(n)).astype(np.int32)[self.v]
        for k in range(n):
            rows = np.flatnonzero(some == k)
            if len(rows):
                yield rows, Contexts(*(x[rows].astype(np.int64) for x in (self.u, self.v, self.w)), self.learnt[rows], len(self.words))

    def asks(self, n_word_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The words that follow a context, by the words' buckets: numbers in order, and the bucket of each."""
        wb = (scattered(self.words[self.followers] + U(1)) % U(n_word_buckets)).astype(np.int64)
        order = np.argsort(wb, kind="stable")
        return self.followers[order], wb[order]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_tokens: int = PART_TOKENS, bucket_tokens: int = BUCKET_TOKENS, class_tokens: int = CLASS_TOKENS, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 7) -> DataFrame:
    """A row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    most, total = frequent_words(docs, class_tokens)
    most = sorted((hash_of(w), n) for w, n in most)
    frequent = np.array([h for h, _ in most], dtype=U), np.array([-(-n // class_tokens) for _, n in most], dtype=U)
    # the corpus alone decides, so that one corpus gives one model; a small one is dealt to some buckets, too
    n_buckets = max(1, -(-total // bucket_tokens), min(-(-total // SEATED_TOKENS), SPREAD))
    n_word_buckets = -(-n_buckets // 2)
    messages = sent(docs, frequent, n_buckets, part_tokens)

    def seat(key, table):
        bucket = Bucket(table)
        tables = np.zeros(len(bucket.words), dtype=np.int64)
        for k, (_, contexts) in enumerate(bucket.contexts()):
            tables += contexts.sample(None, [seed, key[0].as_py(), k], burn_in, 0, len(bucket.words))[1]
        seen = np.bincount(bucket.w, bucket.learnt, minlength=len(bucket.words)).astype(np.int64)
        asked, wb = bucket.asks(n_word_buckets)
        cuts = np.searchsorted(wb, np.arange(n_word_buckets + 1))
        rows = []
        for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):  # each words' bucket is asked: its sums are needed
            rows.append((k, key[0].as_py(), pack(bucket.words[asked[i:j]], tables[asked[i:j]], seen[asked[i:j]])))
        return _rows(["wb", "bucket", "payload"], [pa.int64(), pa.int64(), pa.binary()], rows)

    def seat_root(key, table):
        rows = table.select(["bucket", "payload"]).sort_by("bucket").to_pylist()
        got = [unpack(r["payload"]) for r in rows]
        words, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        customers, seen = (np.bincount(at, np.concatenate([g[i] for g in got]), minlength=len(words)).astype(np.int64) for i in (1, 2))
        d, strength = DISCOUNTS[0], STRENGTHS[0]
        seats = Seats(customers, np.zeros(len(words), dtype=np.int64), 1, d, strength, np.random.default_rng([seed, key[0].as_py(), 1]))
        base = np.full(len(words), 1 / (max(1, int((seen > 0).sum())) * n_word_buckets + 1))
        mean = np.zeros(len(words))
        for sweep in range(burn_in + samples):
            seats.tables[:] = seats.t.sum() * n_word_buckets  # the root's tables, of which this bucket has its share
            seats.sweep(base)
            if sweep >= burn_in:
                mean += seats.t / samples
        weight = np.maximum(customers - d * mean, 0).astype(np.float32)
        sums = int(seen.sum()), int((seen > 0).sum()), int(customers.sum()), float(mean.sum())
        out, i = [], 0
        for r, g in zip(rows, got):
            own = at[i : i + len(g[0])]
            out.append((r["bucket"], key[0].as_py(), pack(weight[own], seen[own]), *sums))
            i += len(g[0])
        return _rows([x.split()[0] for x in ROOT.split(", ")], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()], out)

    def finish(key, table, answers):
        bucket = Bucket(table)
        rows = answers.sort_by("wb").to_pylist()
        n, v, customers, tables = (sum(r[x] for r in rows) for x in ("n", "v", "customers", "tables"))
        got = [unpack(r["payload"]) for r in rows]
        asked, _ = bucket.asks(n_word_buckets)
        d, strength = DISCOUNTS[0], STRENGTHS[0]
        root, seen = np.zeros(len(bucket.words)), np.zeros(len(bucket.words), dtype=np.int64)
        root[asked] = np.concatenate([g[0] for g in got])
        seen[asked] = np.concatenate([g[1] for g in got])
        root = (root + (strength + d * tables) / (v + 1)) / (strength + customers)
        own = np.zeros(bucket.n_docs)
        for k, (at, contexts) in enumerate(bucket.contexts()):
            p, _ = contexts.sample(root, [seed, key[0].as_py(), k, 1], burn_in, samples, len(bucket.words))
            own += np.bincount(bucket.of_doc[at], np.log10(p)[contexts.of_token], minlength=bucket.n_docs)
        base = np.bincount(bucket.of_doc, np.log10((seen + 1) / (n + v + 1))[bucket.w], minlength=bucket.n_docs)
        known = np.bincount(bucket.of_doc, seen[bucket.w] > 0, minlength=bucket.n_docs).astype(np.int64)
        out, at = [], 0
        for part, meta, docs in zip(bucket.parts, bucket.meta, bucket.docs):
            to = at + len(docs)
            out.append((part, n, meta, pack(np.diff(docs, prepend=0), fixed(own[at:to]), fixed(base[at:to]), known[at:to])))
            at = to
        return _rows(["part", "n", "meta", "payload"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], out)

    def add_up(key, table):
        rows = table.select(["n", "meta", "payload"]).to_pylist()
        ids, known, lens = unpack(next(r["meta"] for r in rows if r["meta"]))
        sums = np.zeros((3, len(ids)))
        for r in sorted(rows, key=lambda r: r["payload"]):  # whatever order they come in, the sums are the same
            docs, *values = unpack(r["payload"])
            docs = np.cumsum(docs.astype(np.int64))
            for total, x in zip(sums, values):
                total[docs] += x
        sums[:2] /= -FIXED
        ids, mask = ids.astype(np.int64), known == 0
        held = [is_held_out(None if m else i) for i, m in zip(ids.tolist(), mask.tolist())]
        return pa.table({
            "id": pa.array(ids, mask=mask), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(lens.astype(np.int64)), "n_known": pa.array(sums[2].astype(np.int64)),
            "train_tokens": pa.array(np.full(len(ids), rows[0]["n"], dtype=np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[0]),
        })

    asked = messages.groupBy("bucket").applyInArrow(seat, ASKED)
    answers = asked.groupBy("wb").applyInArrow(seat_root, ROOT)
    summed = messages.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(finish, "part long, n long, meta binary, payload binary")
    return summed.groupBy("part").applyInArrow(add_up, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
