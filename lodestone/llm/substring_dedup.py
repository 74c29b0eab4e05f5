"""Substring dedup by seeds that are extended: repeated runs of words leave all places but the first.

Seeds. Runs of ``GRAM`` words are hashed and winnowed: of ``LENGTH - GRAM + 1`` neighbouring hashes the least one (the last of
equals) is an anchor. A window of ``LENGTH`` words holds exactly that many runs, so every window holds an anchor, and
windows of the same words hold it at the same place. An anchor with the up to ``LENGTH - GRAM`` words on either side is an
occurrence; whatever windows hold the anchor lie within it.

Occurrences of the same words are one kind: all but the earliest are repeats, as long as they are. What is left, the
earliest of each kind of an anchor, is joined with the earliest of all (the leader) and extended from the anchor both
ways, word by word. Where a match is ``LENGTH`` words long or more, its words are a repeat. Windows that the leader does not
decide reach over its first differing word on the left, or else on the right; only occurrences that go on with the same
word there can hold them, and these form the groups of the next round, each with its own leader. So each round joins a row
with one row; no pairs within a group are made, and after ``LENGTH - GRAM + 1`` rounds at most nothing is left. A group of at
most ``SMALL`` occurrences goes through its rounds in one task; a larger one is joined with its leader over all tasks.

Longer repeats hold several anchors: the covered pieces of a document, put together, are the maximal repeats.

Leaders of large groups are broadcast, at most 2,000 of them, as a group counts as large from a two-thousandth of the rows on.

Defined results
- Words are runs of bytes other than the ASCII white space; null texts hold none. Order: by id (null first), then, for repeated ids, by a
  64-bit hash of the text, then by place. Rows that repeat an id and a text are one document, and get the same result.
- Words are compared by 64-bit hashes. Texts below ``LENGTH`` words stay whole. An empty table gives an empty result.
- Extra columns are kept unless their names are those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved

LENGTH, GRAM = 20, 8
#: Bytes of text that a task works on at a time (a longer text alone).
CHUNK = 2_000_000
#: Most occurrences of a group that one task takes through all rounds; larger groups are dealt out, a round at a time.
SMALL = 1000
OUTPUT = ("n_words", "n_removed", "kept_text", "spans")


def mix(h: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers, well mixed."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]."""
    up, down = powers(_BASE, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Words:
    """The words of some texts: bounds in the joined bytes, hashes, and for each text its first word and the one past its last."""

    def __init__(self, texts: list[bytes], hashed: bool = True):
        self.data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
        space = _SPACE[self.data]
        turn = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = turn[0::2], turn[1::2]
        at = np.cumsum([1, *[len(t) + 1 for t in texts]])
        cut = np.searchsorted(self.starts, at)
        self.first, self.last = cut[:-1], cut[1:]
        self.hashes = run_hashes(_BYTES[self.data], self.starts, self.ends) if hashed else None


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of about ``CHUNK`` bytes, with the place of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHUNK:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def winnowed(w: Words, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors: text, first word (counted over all texts), and hash."""
    n, width = len(w.starts), length - gram + 1
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    at = np.arange(n - gram + 1)
    h = run_hashes(w.hashes, at, at + gram)
    text = np.repeat(np.arange(len(w.first)), w.last - w.first)
    begin, end = w.first[text[at]], w.last[text[at]] - gram  # the first and last run of the text
    left, right = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    on_left = on_right = at <= end
    for s in range(1, width):
        on_left = on_left & (at - s >= begin)
        on_left[s:] &= h[:-s] >= h[s:]
        left += on_left
        on_right = on_right & (at + s <= end)
        on_right[:-s] &= h[s:] > h[:-s]
        right += on_right
    chosen = np.flatnonzero((left + right + 1 >= width) & (at <= end))
    return text[chosen], chosen, h[chosen]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """id, th, pos (of the anchor), anchor, around (a hash of the words on both sides), before and after (how many these are)."""
    side = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in chunks(_texts(batch.column(2))):
                w = Words(texts)
                text, at, h = winnowed(w, length, gram)
                before, after = np.minimum(side, at - w.first[text]), np.minimum(side, w.last[text] - at - gram)
                around = run_hashes(w.hashes, at - before, at + gram + after) ^ mix(before.astype(np.uint64) * np.uint64(257) + after.astype(np.uint64) + np.uint64(1))
                own = pa.array(text + i)
                cols = [batch.column(0).take(own), batch.column(1).take(own), pa.array(at - w.first[text], pa.int32()), pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(before, pa.int32()), pa.array(after, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "th", "pos", "anchor", "around", "before", "after"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, pos int, anchor long, around long, before int, after int")


def sides(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``docs``: id, th, text, seeds (pos, anchor). Each seed with the hashes of the words before it (nearest first) and after it."""
    side = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(3).to_pylist()
            for i, texts in chunks(_texts(batch.column(2))):
                w = Words(texts)
                h = w.hashes.view(np.int64)
                rows: list[list] = [[], [], [], [], []]
                for k, (first, last) in enumerate(zip(w.first.tolist(), w.last.tolist())):
                    for s in seeds[i + k]:
                        p = first + s["pos"]
                        row = (i + k, s["pos"], s["anchor"], h[max(first, p - side) : p][::-1], h[p + gram : min(last, p + gram + side)])
                        for column, x in zip(rows, row):
                            column.append(x)
                own = pa.array(rows[0], pa.int64())
                cols = [batch.column(0).take(own), batch.column(1).take(own), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.int64())), pa.array(rows[4], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "th", "pos", "key", "before", "after"])

    return docs.select("id", "th", "text", "seeds").mapInArrow(run, "id long, th long, pos int, key long, before array<long>, after array<long>")


def joined(rows: DataFrame, leaders: DataFrame, on: list[str], n_rows: int) -> DataFrame:
    """``rows`` with the leader of their group (``leaders`` is stored; ``n``: the rows of the group). Large groups stay where they are."""
    large = max(200, n_rows // 2000)
    hot = leaders.filter(F.col("n") >= large).drop("n")
    if hot.isEmpty():
        return rows.join(leaders.drop("n"), on)
    hot = F.broadcast(hot)  # at most n_rows / large of them
    rest = rows.join(hot.select(*on), on, "left_anti").join(leaders.filter(F.col("n") < large).drop("n"), on)
    return rows.join(hot, on).unionByName(rest)


def shared(a: Column, b: Column) -> Column:
    """How many leading values two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    return F.when(differs > 0, differs - 1).otherwise(n).cast("int")


def released(df: DataFrame) -> None:
    """Let go of shuffle files that nothing needs any more: Spark deletes them once the driver's memory is collected."""
    df.sparkSession._jvm.java.lang.System.gc()


def place() -> Column:
    """What orders occurrences: null ids come first."""
    return F.struct(F.col("id").isNotNull().alias("some"), F.coalesce("id", F.lit(0)).alias("at"), "th", "pos")


def alike(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extended(group: list[tuple], length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """All rounds of a group: ``group`` holds before, after, lo, hi in the order of places. Gives (row, from, to) for windows that are repeats."""
    side = length - gram
    open_ = [[(i, lo, hi) for i, (_, _, lo, hi) in enumerate(group)]]
    while open_:
        (leader, _, _), *others = open_.pop()
        before, after = group[leader][:2]
        parts: dict[tuple, list] = {}
        for i, lo, hi in others:
            left, right = alike(group[i][0], before), alike(group[i][1], after)
            if max(lo, side - right) <= min(hi, left):
                yield i, max(lo, side - right), min(hi, left)
            if left < hi:
                parts.setdefault(("left", left, group[i][0][left]), []).append((i, max(lo, left + 1), hi))
            if lo <= (end := min(hi, left, side - 1 - right)):
                parts.setdefault(("right", right, group[i][1][right]), []).append((i, lo, end))
        open_ += [x for x in parts.values() if len(x) > 1]


def walked(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """id, th, a, b from groups that are small enough for a task; groups come by one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "th", "pos", "key", "before", "after", "lo", "hi"]
        group: list[tuple] = []
        key = None

        def spans(found: list[list]) -> None:
            places = list(dict.fromkeys(r[:3] for r in group))  # rows that repeat a place are one
            once = dict(zip((r[:3] for r in group), group))
            for i, a, b in extended([once[p][3:] for p in places], length, gram):
                id_, th, pos = places[i]
                for column, x in zip(found, (id_, th, pos - b, pos - a + length)):
                    column.append(x)

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for batch in batches:
            found: list[list] = [[], [], [], []]
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            for id_, th, pos, k, *rest in zip(*columns):
                if k != key:
                    if len(group) > 1:
                        spans(found)
                    key, group = k, []
                group.append((id_, th, pos, *rest))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds)], names=["id", "th", "a", "b"])
        found = [[], [], [], []]
        if len(group) > 1:
            spans(found)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds)], names=["id", "th", "a", "b"])

    order = ["key", F.col("id").asc_nulls_first(), "th", "pos"]
    return rows.repartition("key").sortWithinPartitions(*order).mapInArrow(run, "id long, th long, a int, b int")


def covered(docs: DataFrame, length: int, gram: int, small: int = SMALL) -> DataFrame:
    """id, th, a, b: the words [a, b) of a document are a repeat of earlier ones. ``docs``: id, th, text."""
    side = length - gram
    every = occurrences(docs, length, gram).filter(F.col("before") + F.col("after") >= side)
    # anchors first, alone: texts are read again rather than all occurrences stored, most of which stand alone
    repeated = saved(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchors")
    n_found = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = saved(joined(every, repeated, ["anchor"], n_found), "seeds")
    released(docs)
    kinds = saved(found.groupBy("anchor", "around").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("n")), "kinds")
    again = joined(found, kinds.filter("n > 1"), ["anchor", "around"], n_found)
    out = [again.filter(place() > F.col("first")).select("id", "th", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after") + gram).alias("b"))]

    # the earliest of each kind, where an anchor has several
    several = saved(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchors")
    seeds = joined(kinds.select("anchor", "first"), several, ["anchor"], kinds.count()).select(F.when(F.col("first.some"), F.col("first.at")).alias("id"), "first.th", "first.pos", "anchor")
    seeds = seeds.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "anchor")).alias("seeds")).withColumnsRenamed({"id": "i", "th": "t"})
    texts = docs.join(seeds, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select("id", "th", "text", "seeds")
    rows = sides(texts, length, gram).withColumn("lo", F.greatest(F.lit(0), side - F.size("after"))).withColumn("hi", F.size("before"))
    rows = saved(rows, "sides")
    released(docs)
    while n_rows := rows.count():
        leaders = rows.groupBy("key").agg(F.min(place()).alias("first"), F.min_by(F.struct("before", "after"), place()).alias("own"), F.count(F.lit(1)).alias("n"))
        leaders = saved(leaders.filter(F.col("n") > small), "leaders")
        if leaders.isEmpty():
            out.append(walked(rows, length, gram))
            break
        out.append(walked(rows.join(leaders.select("key"), "key", "left_anti"), length, gram))
        # windows begin lo to hi words before the anchor
        met = joined(rows, leaders, ["key"], n_rows).filter(place() > F.col("first"))
        met = met.withColumn("left", shared(F.col("before"), F.col("own.before"))).withColumn("right", shared(F.col("after"), F.col("own.after"))).drop("first", "own")
        met = saved(met.withColumn("from", F.greatest("lo", side - F.col("right"))).withColumn("to", F.least("hi", "left")), "extended")
        out.append(met.filter("from <= to").select("id", "th", (F.col("pos") - F.col("to")).alias("a"), (F.col("pos") - F.col("from") + length).alias("b")))
        plain = ["id", "th", "pos", "before", "after"]
        next_ = lambda way, n, words: F.xxhash64("key", F.lit(way), n, F.get(words, n)).alias("key")
        on_left = met.filter("left < hi").select(*plain, next_("left", F.col("left"), F.col("before")), F.greatest("lo", F.col("left") + 1).alias("lo"), "hi")
        on_right = met.select(*plain, next_("right", F.col("right"), F.col("after")), "lo", F.least("hi", "left", side - 1 - F.col("right")).alias("hi")).filter("lo <= hi")
        rows = saved(on_left.unionByName(on_right), "sides")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the words that are covered."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, small: int = SMALL) -> DataFrame:
    """The columns to ``keep`` (all), then n_words, n_removed, kept_text (words joined by one space) and spans (a, b: runs of removed words)."""
    kept = [c for c in keep or docs.columns if c not in OUTPUT]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    spans = covered(rows.select("id", "th", "text"), length, gram, small)
    spans = spans.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")).withColumnsRenamed({"id": "i", "th": "t"})
    whole = rows.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left").select("row", "text", "spans")
    kind = rows.schema["row"].dataType.simpleString()
    cuts = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            for i, texts in chunks(_texts(batch.column(1))):
                w = Words(texts, hashed=False)
                n, removed, left, cut = [], [], [], []
                for k, (first, last) in enumerate(zip(w.first.tolist(), w.last.tolist())):
                    runs = merged(spans[i + k] or [])
                    stays = np.ones(last - first, dtype=bool)
                    for a, b in runs:
                        stays[a:b] = False
                    own = np.flatnonzero(stays) + first
                    data = w.data.data
                    left.append(b" ".join([bytes(data[a:b]) for a, b in zip(w.starts[own].tolist(), w.ends[own].tolist())]))
                    n.append(last - first)
                    removed.append(last - first - len(own))
                    cut.append([{"a": a, "b": b} for a, b in runs])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string()), pa.array(cut, cuts)], names=["row", *OUTPUT])

    found = whole.mapInArrow(run, f"row {kind}, n_words long, n_removed long, kept_text string, spans array<struct<a:int,b:int>>")
    return found.select(F.col("row").cast(kind).alias("row"), *OUTPUT).select("row.*", *OUTPUT)
