"""Suffix-array dedup: remove every byte that a string of 200 bytes covers which also starts anywhere else.

A shard is sorted by induced sorting. The LMS suffixes (the leftmost ones of
each ascending run) are sorted first, by recursion on the names of the strings
between them; all other suffixes are then induced from them, first the
descending ones from left to right, then the ascending ones from right to left.
The queue of each first byte is a priority queue in the order of induction: it
takes tuples of a suffix and its common prefix with the one before, and goes to
disk beyond a bound. A tuple's common prefix is one more than the minimum over
the tuples passed since the last one for the same queue, so the common-prefix
array comes with the suffix array. The recursion's alphabet is large, so it
ranks names by doubling, which ends where ranks are unique or cover 200 bytes.

Shards are cut by content. Each window of 200 bytes has an anchor, the place
of the least hash among the 64-byte strings in it; equal windows have equal
anchors. The windows of one anchor are a segment (about 270 bytes). Anchors
that occur once are dropped, equal segments are counted and collapse into one,
and the segments of an anchor that has different ones meet in a shard. So all
windows that could be equal are sorted together, and only what differs is.

Defined results
- Null and empty texts, and those under 200 bytes, lose nothing.
- Matches never cross documents; the other start may be in the same document, and may overlap.
- Rows that repeat are copies: all their bytes go, if there are 200.
- Null ids are kept as they are: ids take no part in what is removed.
- An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved

LENGTH, ANCHOR = 200, 64
#: Bytes of text that are anchored in one go, and about the bytes of segments of a shard.
CHUNK, SHARD = 1 << 18, 1_500_000
#: Tuples that the queues of a shard hold in memory, and the most that are taken out in one go.
HELD, TAKEN = 2_000_000, 1 << 18
#: Most rows, and bytes, that are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# --- induced sorting of one shard ---------------------------------------------------------------


class Queues:
    """A queue of (position, common prefix) for each byte, in memory up to a bound, then in a file that goes with the object."""

    def __init__(self, n: int, held: int = HELD):
        self.blocks: list[list] = [[] for _ in range(n)]
        self.held, self.left, self.file = held, held, None

    def put(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if self.left < len(pos):
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(pos.astype(np.int64).tobytes())
            self.file.write(lcp.astype(np.int16).tobytes())
            self.blocks[c].append((at, len(pos)))
        else:
            self.left -= len(pos)
            self.blocks[c].append((pos, lcp))

    def get(self, c: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.blocks[c][i]
        if isinstance(a, np.ndarray):
            return a, b
        self.file.seek(a)
        return np.frombuffer(self.file.read(8 * b), dtype=np.int64), np.frombuffer(self.file.read(2 * b), dtype=np.int16)

    def some(self, c: int, i: int, step: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """Tuples of the blocks from i on, about TAKEN at most, in the queue's order; and the next block. step -1: down from i."""
        got, n, stop = [], 0, self.size(c) if step > 0 else -1
        while i != stop and (not got or n < TAKEN):
            got.append(self.get(c, i))
            n += len(got[-1][0])
            i += step
        pos, lcp = zip(*got[::step])
        return (np.concatenate(pos), np.concatenate(lcp), i) if len(got) > 1 else (pos[0], lcp[0], i)

    def size(self, c: int) -> int:
        return len(self.blocks[c])


class RangeMin:
    """Minima of ranges [a, b] of an array."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        step = 1
        while 2 * step <= len(x):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.log2(np.maximum(b - a + 1, 1) + 0.5).astype(np.int64)
        out = np.empty(len(a), dtype=self.levels[0].dtype)
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.levels[k][a[m]], self.levels[k][b[m] - (1 << k) + 1])
        return out


class Inducer:
    """One pass: takes sources in sorted order, puts what they induce into queues with the common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, cap: int):
        self.text, self.wanted, self.queues, self.cap = text, wanted, queues, cap
        #: least common prefix since the last tuple of each queue; 0 where there was none
        self.since = np.zeros(len(queues.blocks), dtype=np.int16)

    def take(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Sources in order, each with the common prefix with the source before."""
        for at in range(0, len(pos), TAKEN):
            self._take(pos[at : at + TAKEN], lcp[at : at + TAKEN])

    def _take(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1
        use = np.flatnonzero((pos > 0) & self.wanted[np.maximum(before, 0)])
        low = lcp.min()
        if not len(use):
            np.minimum(self.since, low, out=self.since)
            return
        target = self.text[before[use]]
        order = np.argsort(target, kind="stable")
        use, target = use[order], target[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1, [len(target)]])
        first = np.zeros(len(use), dtype=bool)
        first[cut[:-1]] = True
        start = np.concatenate([[0], use[:-1] + 1])
        start[first] = 0
        least = RangeMin(lcp)
        found = least.of(start, use)
        firsts, kinds = cut[:-1], target[cut[:-1]]
        found[firsts] = np.minimum(found[firsts], self.since[kinds])
        got = np.minimum(found + np.int16(1), np.int16(self.cap))
        got[firsts[[not self.queues.size(c) for c in kinds.tolist()]]] = 0
        np.minimum(self.since, low, out=self.since)
        for c, a, b in zip(kinds.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            self.queues.put(c, before[use[a:b]], got[a:b])
            last = use[b - 1]
            self.since[c] = lcp[last + 1 :].min() if last + 1 < len(lcp) else np.int16(self.cap)


def kinds_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one (ascending), and the length of its first run, up to the end."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=np.int16(-1)))
    turn = np.where(step != 0, np.arange(n), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    return step[turn] > 0, turn - np.arange(n) + 1


def lms_order(text: np.ndarray, lms: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The LMS suffixes in order, with common prefixes (in symbols, up to ``cap``); equal ones up to ``cap`` stand in any order."""
    m = len(lms)
    if not m:
        return lms, np.empty(0, dtype=np.int16)
    ends = np.append(lms[1:] + 1, len(text))
    ascending, _ = kinds_of(text)
    symbol = (text.astype(">u2") * 2 + ascending).astype(">u2")
    # names: the strings up to the next LMS place, in order; distinct ones are few
    weight = mix(np.arange(1, 2 * 512 + 1, dtype=U))[symbol.astype(np.int64)]
    length = ends - lms
    power, inverse = powers(len(text) + 1)
    total = np.concatenate([np.zeros(1, dtype=U), np.cumsum(weight * power[: len(text)], dtype=U)])
    finger = mix((total[ends] - total[lms]) * inverse[lms]) + length.astype(U)
    _, first, name = np.unique(finger, return_index=True, return_inverse=True)
    raw = symbol.tobytes()
    strings = [raw[2 * a : 2 * b] for a, b in zip(lms[first].tolist(), ends[first].tolist())]
    order = sorted(range(len(strings)), key=strings.__getitem__)
    rank_of = np.empty(len(strings), dtype=np.int64)
    rank_of[order] = np.arange(len(order))
    ranks, covers = [rank_of[name]], [1]
    while ranks[-1].max() + 1 < m and covers[-1] < cap:  # a name stands for two symbols or more
        last, step = ranks[-1], covers[-1]
        bits = int(last.max() + 1).bit_length()
        per = max(2, min(63 // bits, -(-cap // step)))  # as many ranks as a key holds
        key = last + 1
        for k in range(1, per):
            after = np.zeros(m, dtype=np.int64)
            after[: max(0, m - k * step)] = last[k * step :] + 1
            key = (key << bits) | after
        ranks.append(np.unique(key, return_inverse=True)[1].reshape(-1))
        covers.append(step * per)
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    same = np.zeros(len(a), dtype=np.int64)  # equal names
    for rank, step in zip(ranks[::-1], covers[::-1]):
        go = np.arange(len(a))
        while len(go):
            x, y = a[go] + same[go], b[go] + same[go]
            go = go[(x < m) & (y < m)]
            go = go[rank[a[go] + same[go]] == rank[b[go] + same[go]]]
            same[go] += step
            go = go[same[go] < cap]
    start = np.append(lms, len(text))
    prefix = np.minimum(start[np.minimum(a + same, m)] - start[a], cap)
    # and symbols of the first names that differ
    open_ = np.flatnonzero(prefix < cap)
    while len(open_):
        x, y = lms[a[open_]] + prefix[open_], lms[b[open_]] + prefix[open_]
        ok = (x < len(text)) & (y < len(text))
        ok[ok] = text[x[ok]] == text[y[ok]]
        open_ = open_[ok]
        prefix[open_] += 1
        open_ = open_[prefix[open_] < cap]
    return lms[order], np.concatenate([[0], prefix]).astype(np.int16)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, dtype=U), np.full(n, pow(base, -1, 1 << 64), dtype=U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    return _powers(1 << max(20, (n - 1).bit_length()))


def suffix_order(text: np.ndarray, cap: int = LENGTH, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (symbols 0 to 256) in order, and common prefixes with the one before, up to ``cap``."""
    n, n_chars = len(text), 257
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int16)
    text = text.astype(np.int16)
    ascending, run = kinds_of(text)
    lms = np.flatnonzero(ascending[1:] & ~ascending[:-1]) + 1
    top, top_lcp = lms_order(text, lms, cap)
    bounds = np.searchsorted(text[top], np.arange(n_chars + 1))
    cut = lambda x: np.minimum(x, cap).astype(np.int16)
    down = Queues(n_chars, held)
    pass_ = Inducer(text, ~ascending, down, cap)
    down.put(int(text[n - 1]), np.array([n - 1]), np.zeros(1, dtype=np.int16))
    for c in range(n_chars):
        pass_.since[:] = 0  # suffixes of another first byte share nothing
        i, last = 0, None
        while i < down.size(c):
            pos, lcp, i = down.some(c, i)
            pass_.take(pos, lcp)
            last = pos[-1]
        pos, lcp = top[bounds[c] : bounds[c + 1]], top_lcp[bounds[c] : bounds[c + 1]].copy()
        if len(pos):
            lcp[0] = 0 if last is None else cut(np.minimum(run[last], run[pos[0]]))
            pass_.take(pos, lcp)
    up = Queues(n_chars, held)
    pass_ = Inducer(text, ascending, up, cap)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(n_chars - 1, -1, -1):
        pass_.since[:] = 0
        i, last = 0, None
        while i < up.size(c):
            pos, lcp, i = up.some(c, i)
            pass_.take(pos, lcp)
            out.append((pos, lcp))
            last = pos[-1]
        i, above = down.size(c) - 1, None
        while i >= 0:
            pos, lcp, i = down.some(c, i, -1)
            # backwards, a suffix shares with the one before (above) what that shares with it
            if above is None:
                above = np.int16(0) if last is None else cut(min(run[last], run[pos[-1]]))
            pos, lcp, above = pos[::-1], np.concatenate([[above], lcp[:0:-1]]).astype(np.int16), lcp[0]
            pass_.take(pos, lcp)
            out.append((pos, lcp))
            last = pos[-1]
    pos = np.concatenate([x for x, _ in out])[::-1]
    lcp = np.concatenate([x for _, x in out])[::-1]
    return pos, np.concatenate([[0], lcp[:-1]]).astype(np.int16)


def repeated_starts(segments: list[bytes], length: int = LENGTH, held: int = HELD) -> list[np.ndarray]:
    """For each segment the starts of strings of ``length`` bytes that start anywhere else in the segments."""
    text = np.frombuffer(b"".join([s + b"\0" for s in segments]), dtype=np.uint8).astype(np.int16) + 1
    stops = np.cumsum([len(s) + 1 for s in segments])
    text[stops - 1] = 0
    pos, lcp = suffix_order(text, length, held)
    full = lcp >= length
    near = full | np.append(full[1:], False)
    flag = np.zeros(len(text), dtype=bool)
    flag[pos[near]] = True
    begins = np.concatenate([[0], stops[:-1]])
    out = []
    for a, b in zip(begins.tolist(), stops.tolist()):
        out.append(np.flatnonzero(flag[a : max(a, b - length)]))
    return out


def as_ranges(starts: np.ndarray) -> list[int]:
    """Sorted starts as flat pairs of the first and the last of each run."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]], axis=1).ravel().tolist()


# --- anchors ---------------------------------------------------------------------------------


@functools.cache
def byte_weights() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def anchored(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Segments of the texts: text number, first and last window start, hash of the anchor, hash of the segment."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    none = np.empty(0, dtype=np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(U), none.astype(U)
    power, inverse = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, dtype=U), np.cumsum(byte_weights()[raw] * power[: len(raw)], dtype=U)])
    n = len(raw) - anchor + 1
    grams = mix((total[anchor:] - total[:n]) * inverse[:n])
    # the least hash of each window, leftmost first: the place stands in the low bits
    bits = max(1, int(n - 1).bit_length())
    low = U((1 << bits) - 1)
    key = (grams & ~low) | np.arange(n, dtype=U)
    span, width = length - anchor + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if span > width:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    at = (key & low).astype(np.int64)
    stops = np.cumsum(sizes)
    begins = stops - sizes
    long = np.flatnonzero(sizes >= length)
    first, count = begins[long], sizes[long] - length + 1
    starts = np.arange(int(count.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    owner = np.repeat(long, count)
    place = at[starts]
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(owner) != 0)) + 1
    if not len(starts):
        return none, none, none, none.astype(U), none.astype(U)
    a = starts[np.concatenate([[0], cut])]
    b = starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    doc = owner[np.concatenate([[0], cut])]
    whole = mix((total[b + length] - total[a]) * inverse[a] + (b - a).astype(U) * U(0xD6E8FEB86659FD93))
    return doc, a - begins[doc], b - begins[doc], grams[at[a]], whole


def chunks_of(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def segments(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``tk`` (text hash), ``a``, ``b`` (first and last window start), ``h`` (anchor), ``s`` (segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            for i, j in chunks_of(texts):
                doc, a, b, h, s = anchored(texts[i:j], length, anchor)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc + i)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(s.view(np.int64))], names=["tk", "a", "b", "h", "s"]
                )

    return keyed(docs).filter(F.octet_length("raw") >= length).select("tk", "raw").mapInArrow(run, "tk binary, a int, b int, h long, s long")


def keyed(docs: DataFrame, id_col: str | None = None, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ids = [F.col(f"`{id_col}`").alias("id")] if id_col else []
    return docs.select(*ids, F.unhex(F.md5(text)).alias("tk"), text.cast("binary").alias("raw"))


def small(df: DataFrame, size: str | None = None) -> DataFrame:
    """``df`` for a join: broadcast if its rows, and the sum of ``size`` over them, are within the bounds."""
    rows, bytes_ = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr(size or "0")), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and bytes_ <= BROADCAST_BYTES else df


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD, held: int = HELD) -> DataFrame:
    """``tk`` and ``ranges`` (flat pairs: first and last start) of strings that also start elsewhere; of texts that have any."""
    docs = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    every = saved(segments(docs, length, anchor), "segments")
    # written, so that the join has two plain sides and a hot anchor's rows are split
    anchors = saved(every.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).filter("n > 1"), "shared-anchors")
    shared = saved(every.join(anchors, "h").select("tk", "a", "b", "h", "s", (F.col("low") < F.col("high")).alias("mixed")), "shared-segments")
    distinct = saved(
        shared.filter("mixed").groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tk", "a", "b")).alias("at")).select("h", "s", "n", "at.tk", "at.a", "at.b"), "distinct-segments"
    )
    total = distinct.agg(F.sum(F.col("b") - F.col("a") + length)).first()[0] or 0
    n_shards = max(1, -(-total // shard))
    # the bytes of the distinct segments, cut from one text each
    cuts = distinct.groupBy("tk").agg(F.collect_list(F.struct("h", "s", "a", "b")).alias("cuts"))
    texts = keyed(docs).join(small(cuts.select("tk")), "tk", "left_semi")
    once = texts.groupBy("tk").agg(F.first("raw").alias("raw")).join(cuts, "tk")
    pieces = once.select("raw", F.explode("cuts").alias("c")).select("c.h", "c.s", F.substring(F.col("raw"), F.col("c.a") + 1, F.col("c.b") - F.col("c.a") + length).alias("piece"))

    def sort_shard(key, table):
        found = repeated_starts(table.column("piece").to_pylist(), length, held)
        some = [i for i, x in enumerate(found) if len(x)]
        picked = table.select(["h", "s"]).take(pa.array(some, pa.int64()))
        ranges = pa.array([as_ranges(found[i]) for i in some], pa.list_(pa.int32()))
        return pa.Table.from_arrays([picked.column(0), picked.column(1), ranges], names=["h", "s", "own"])

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(n_shards)))
    sorted_ = saved(sharded.groupBy("shard").applyInArrow(sort_shard, "h long, s long, own array<int>"), "sorted-segments")
    copied = distinct.filter("n > 1").select("h", "s", F.lit(True).alias("whole"))
    known = sorted_.join(copied, ["h", "s"], "full_outer")
    partly = shared.filter("mixed").join(known, ["h", "s"])
    own = F.when(F.col("whole"), F.array(F.col("a"), F.col("b"))).otherwise(F.transform("own", lambda x: x + F.col("a")))
    ranges = partly.select("tk", own.alias("own")).unionByName(shared.filter("not mixed").select("tk", F.array("a", "b").alias("own")))
    pairs = ranges.select("tk", F.explode(F.sequence(F.lit(0), F.size("own") - 1, F.lit(2))).alias("i"), "own")
    pairs = pairs.select("tk", F.struct(F.get("own", F.col("i")).alias("a"), F.get("own", F.col("i") + 1).alias("b")).alias("x"))
    return pairs.groupBy("tk").agg(F.sort_array(F.collect_set("x")).alias("ranges"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """A row per input row: id, n_bytes, n_removed, n_spans, kept (the bytes left)."""
    return _finish(docs, id_col, text_col, length, options, lambda kept: kept, pa.binary(), "kept binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """As ``remove_repeats``, with the SHA-256 of the bytes left."""
    return _finish(docs, id_col, text_col, length, options, lambda kept: hashlib.sha256(kept).hexdigest(), pa.string(), "kept_sha256 string")


def _finish(docs: DataFrame, id_col: str, text_col: str, length: int, options: dict, make, kind: pa.DataType, field: str) -> DataFrame:
    found = saved(repeats(docs, text_col, length, **options), "repeats")
    rows = keyed(docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").alias("text")), id_col).join(small(found, "40 + 24 * size(ranges)"), "tk", "left").select("id", "raw", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, spans, removed, end = [], 0, 0, -1
                last = 0
                for r in ranges or ():
                    a, b = r["a"], r["b"] + length
                    if a > end:
                        spans += 1
                        kept.append(raw[max(last, 0) : a])
                        removed += b - a
                    else:
                        removed += max(0, b - end)
                    end = max(end, b)
                    last = end
                kept.append(raw[last:])
                out.append((len(raw), removed, spans, make(b"".join(kept))))
            cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([x[3] for x in out], kind)], names=[id_col, "n_bytes", "n_removed", "n_spans", field.split()[0]])

    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, {field}")
