"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine of the whole texts.

Terms are runs of three bytes of the lower-cased text, in which each run of
ASCII characters other than letters is one blank: insults are found inside of
other words and behind decorations, and there are 2^24 terms at most. A term
weighs (1 + ln n) ln((N + 1) / (df + 0.5)); the document frequencies are those
over all documents, and a text's norm is that of all its terms. Labelled
examples (at most ``max_examples``, chosen by a hash of their id) are indexed
over all their terms.

The index holds posting lists: the examples are dealt into blocks, and a block
has for each term its examples and weights, and their maximum. A batch of texts
asks all blocks for a bound (the sum of weights times maxima) and goes to the
blocks in the order of their bounds; a text leaves out a block whose bound is
below its k-th best cosine so far. The cosines are exact. Examples of the same
most frequent term stand together, which keeps languages apart and bounds low.

The neighbours vote with weights that fall with their distance. The share of
votes is calibrated on the examples themselves, each without its own vote, by
isotonic regression; the nearest neighbours are the evidence.

Scale: examples are a bounded sample (a documented parameter), all else covers
all rows. The index and the frequencies are broadcast; both have a fixed bound.

Defined results
- Null and empty texts hold no terms, and get the base rate of the label. Rows with a null id are never examples and never held out.
- A score depends on the text alone: an example that is scored meets itself as a neighbour, as its copies meet it. Only in the calibration is it left out.
  Of rows of labels that repeat an id the largest label counts; null labels don't. Of documents that repeat an example's id the least text is the example.
- Without any example the score is 0. Rows that repeat get the same result each. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_EXAMPLES = 4_000
NEIGHBOURS, EVIDENCE = 60, 10
#: Examples of a block, texts and bytes of text that are searched in one go.
BLOCK, BATCH, BATCH_BYTES = 128, 256, 1 << 21
TERMS = 1 << 24
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """The letters of a text: lower case, single blanks between words and at both ends."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []
    return b" " + b" ".join(words) + b" " if words else b""


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term and count of the distinct terms of each text, in order."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
    if not len(raw):
        return (np.empty(0, dtype=np.int64),) * 3
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    key = (owner[:-2] << 24) | (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    key = np.sort(key[owner[:-2] == owner[2:]])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] >> 24, key[first] & (TERMS - 1), np.diff(np.append(first, len(key)))


def in_batches(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Numbers of the first texts, and texts ready to be counted, bounded in number and bytes."""
    held, size, at = [], 0, 0
    for i, t in enumerate(t for k in range(0, len(texts), BATCH) for t in texts.slice(k, BATCH).to_pylist()):
        held.append(plain(t))
        size += len(held[-1])
        if len(held) == BATCH or size > BATCH_BYTES:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


def starts_of(groups: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(groups, np.arange(n + 1))

#: Weights are whole numbers of its inverse.
EXACT = 1 << 20


@dataclass
class Index:
    """Frequencies of all terms, and the examples' posting lists: postings in the order of block, term, example."""

    n_docs: int
    terms: np.ndarray
    df: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    size: int = BLOCK
    block: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    #: Of each list (a term in a block): its term's number, where its postings begin, and its maximum.
    list_term: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int32))
    list_start: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    list_top: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.float32))
    row: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.float32))
    #: Calibration: votes, ascending, and the rate of the label there.
    votes: np.ndarray = field(default_factory=lambda: np.zeros(1))
    rates: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @property
    def base_rate(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "idf")}

    def weights(self, text: np.ndarray, term: np.ndarray, n: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term's number and weight in a vector of length 1, from text, term and count. Weights are multiples of 2^-20,
        so that sums of their products are exact in 64-bit floats: a cosine does not depend on what stands beside a text."""
        if not hasattr(self, "number"):
            self.number = np.zeros(TERMS, dtype=np.int32)  # only the pages of known terms are ever touched
            self.number[self.terms] = np.arange(len(self.terms))
            self.idf = np.log((self.n_docs + 1) / (self.df + 0.5))
        term = self.number[term]
        w = (1 + np.log(n)) * self.idf[term]
        norm = np.sqrt(np.bincount(text, w * w, minlength=n_texts))
        return text, term, (np.round(w / np.where(norm > 0, norm, 1)[text] * EXACT) / EXACT).astype(np.float32)

    def invert(self, text: np.ndarray, term: np.ndarray, n: np.ndarray) -> None:
        """Make the lists from the counts of the examples, which are in the order of ids and labels."""
        n_texts = len(self.ids)
        text, term, w = self.weights(text, term, n, n_texts)
        # examples of the same most frequent term stand together
        first = np.zeros(n_texts, dtype=np.int64)
        order = np.lexsort((term, n, text))
        first[text[order]] = term[order]
        place = np.empty(n_texts, dtype=np.int32)
        by_first = np.lexsort((self.ids, np.bincount(text, minlength=n_texts), first))
        place[by_first] = np.arange(n_texts)
        self.ids, self.labels = self.ids[by_first], self.labels[by_first]
        row = place[text]
        order = np.lexsort((row, term, row // self.size))
        row, term, w = row[order], term[order], w[order]
        block = row // self.size
        begin = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.empty(0, dtype=np.int64)
        self.row, self.weight = (row % self.size).astype(np.int32), w
        self.list_term, self.list_start = term[begin].astype(np.int32), np.append(begin, len(row))
        self.list_top = np.maximum.reduceat(w, begin) if len(begin) else np.empty(0, dtype=np.float32)
        self.block = starts_of(block[begin], -(-n_texts // self.size))
        del self.number, self.idf  # made again where texts are searched

    def cosines(self, texts: list[bytes], own: list, k: int) -> np.ndarray:
        """Cosines of the texts with all examples; -1 where a bound shows that one is not among the k best."""
        out = np.full((len(texts), len(self.ids)), -1.0, dtype=np.float32)
        text, term, w = self.weights(*counted(texts), len(texts))
        if not len(text) or not len(self.ids):
            return out
        used, column = np.unique(term, return_inverse=True)
        asked = np.zeros((len(texts), len(used)))
        asked[text, column] = w
        where = np.full(len(self.terms), -1, dtype=np.int32)
        where[used] = np.arange(len(used))
        n_blocks = len(self.block) - 1
        tops = np.zeros((len(used), n_blocks), dtype=np.float32)
        of_list = where[self.list_term]
        of_block = np.repeat(np.arange(n_blocks), np.diff(self.block))
        tops[of_list[of_list >= 0], of_block[of_list >= 0]] = self.list_top[of_list >= 0]
        bounds = asked.astype(np.float32) @ tops * (1 + 1e-5)
        mine = {i: np.flatnonzero(self.ids == i) for i in set(own) if i is not None}
        best = np.full((len(texts), k), -1.0, dtype=np.float32)
        for b in np.argsort(-bounds.sum(axis=0), kind="stable"):
            open_ = np.flatnonzero(bounds[:, b] >= best.min(axis=1))
            if not len(open_):
                continue
            lists = slice(self.block[b], self.block[b + 1])
            posts = slice(self.list_start[self.block[b]], self.list_start[self.block[b + 1]])
            at = np.repeat(of_list[lists], np.diff(self.list_start[self.block[b] : self.block[b + 1] + 1]))
            size = min(self.size, len(self.ids) - b * self.size)
            held = np.zeros((len(used), size))
            held[at[at >= 0], self.row[posts][at >= 0]] = self.weight[posts][at >= 0]
            got = (asked[open_] @ held).astype(np.float32)
            for r, i in enumerate(open_.tolist()):
                rows = mine.get(own[i], ())
                if len(rows):
                    got[r, rows[(rows >= b * self.size) & (rows < b * self.size + size)] - b * self.size] = -1
            out[open_, b * self.size : b * self.size + size] = got
            both = np.concatenate([best[open_], got], axis=1)
            best[open_] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        return out

    def nearest(self, texts: list[bytes], own: list, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the rows and cosines (above 0) of the k nearest examples, best first; ties to the earlier row."""
        for got in self.cosines(texts, own, k):
            least = np.partition(got, len(got) - k)[len(got) - k] if len(got) > k else 0.0
            rows = np.flatnonzero(got >= max(least, 1e-7))
            rows = rows[np.argsort(-got[rows], kind="stable")][:k]
            yield rows, np.minimum(got[rows].astype(float), 1.0)

    def vote(self, rows: np.ndarray, cosine: np.ndarray) -> float:
        """The share of the label among the neighbours, by weights that fall with the distance, drawn towards the base rate."""
        w = 1 / (1.05 - cosine)
        return float(((w * self.labels[rows]).sum() + 0.5 * self.base_rate) / (w.sum() + 0.5))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression of the labels on the votes: neighbouring blocks are pooled until rates rise."""
        pools: list[list[float]] = []
        for v, y in sorted(zip(votes.tolist(), labels.tolist())):
            pools.append([v, y, 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                v, y, n = pools.pop()
                pools[-1] = [pools[-1][0] + v, pools[-1][1] + y, pools[-1][2] + n]
        self.votes = np.array([v / n for v, _, n in pools] or [0.0])
        self.rates = np.array([(y + self.base_rate) / (n + 1) for _, y, n in pools] or [0.0])


def held_out(id_col: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == 0, F.lit(False))


def examples(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """id and label of the rows to learn from: a sample of fixed size, by a hash of the id."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("ex_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    return rows.orderBy(F.md5(F.col("ex_id").cast("string")), "ex_id").limit(max_examples)


def frequencies(texts: DataFrame) -> DataFrame:
    """``term`` and ``df`` over all rows; the number of rows under term -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, texts in in_batches(batch.column(0)):
                _, term, _ = counted(texts)
                found, times = np.unique(term, return_counts=True)
                df[found] += times
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))], names=["term", "df"])

    return texts.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS, block: int = BLOCK) -> Index:
    spark = docs.sparkSession
    chosen = spark.createDataFrame(examples(labels, id_col, label_col, max_examples).collect(), "ex_id long, label int")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("ex_id")).groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    found = frequencies(texts).toArrow().sort_by("term")
    terms, df = found["term"].to_numpy(), found["df"].to_numpy()
    n_docs = int(df[terms < 0].sum())
    terms, df = terms[terms >= 0], df[found["term"].to_numpy() >= 0]

    def plain_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # distinct terms and their counts stand for the text, however long it is
            for at, some in in_batches(batch.column(2)):
                text, term, n = counted(some)
                cut = starts_of(text, len(some))
                got = [np.stack([term[i:j], n[i:j]]).astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:])]
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.binary())], names=["id", "label", "terms"])

    # the driver keeps each form of the examples only until the next is made
    rows = sample.select("id", "label", "text").mapInArrow(plain_texts, "id long, label int, terms binary").toArrow().sort_by("id")
    index = Index(n_docs, terms, df, rows["id"].to_numpy(), rows["label"].to_numpy().astype(float), block)
    stored = [np.frombuffer(x, dtype=np.int32).reshape(2, -1) for x in rows["terms"].to_pylist()]
    del rows
    if stored:
        text = np.repeat(np.arange(len(stored), dtype=np.int32), [x.shape[1] for x in stored])
        counts = np.concatenate(stored, axis=1)
        del stored
        index.invert(text, *counts)
        del text, counts
        got = _searched(sample.select(F.struct("id", "label").alias("row"), "id", "text"), index, k, "struct<id:bigint,label:int>").select("row.label", "vote").toArrow()
        index.calibrate(got["vote"].to_numpy(), got["label"].to_numpy())
    return index


def _searched(rows: DataFrame, index: Index, k: int, kind: str, keep: int = EVIDENCE) -> DataFrame:
    """``row``, ``vote`` (null without terms) and ``evidence`` for row, id, text."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    near = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            own = batch.column(1).to_pylist()
            for at, texts in in_batches(batch.column(2)):
                votes, shown = [], []
                for text, (found, cosine) in zip(texts, index.nearest(texts, own[at : at + len(texts)], k)):
                    votes.append(index.vote(found, cosine) if text else None)
                    shown.append([{"id": int(index.ids[r]), "cosine": float(c), "label": int(index.labels[r])} for r, c in zip(found[:keep], cosine)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(votes, pa.float64()), pa.array(shown, near)], names=["row", "vote", "evidence"])

    return rows.mapInArrow(run, f"row {kind}, vote double, evidence array<struct<id:bigint,cosine:double,label:int>>")


def score(docs: DataFrame, index: Index, text_col: str = "text", k: int = NEIGHBOURS, keep: list[str] | None = None) -> DataFrame:
    """A score of the text alone: equal texts score the same, whatever else their rows say. The columns to ``keep`` (all) of each row, then ``tox_score`` and ``tox_evidence`` (id, cosine, label of the nearest)."""
    kept = [c for c in keep or docs.columns if c not in ("tox_score", "tox_evidence")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.lit(None).cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    found = _searched(rows, index, k, kind).withColumn("row", F.col("row").cast(kind))
    # between the points of the calibration its rate runs straight
    v, y = index.votes.tolist(), index.rates.tolist()
    points = F.array(*[F.struct(F.lit(a).alias("v"), F.lit(b).alias("y")) for a, b in zip(v, y)])
    low = F.try_element_at(F.filter(points, lambda p: p["v"] <= F.col("vote")), F.lit(-1))
    high = F.try_element_at(F.filter(points, lambda p: p["v"] > F.col("vote")), F.lit(1))
    between = low["y"] + (high["y"] - low["y"]) * (F.col("vote") - low["v"]) / (high["v"] - low["v"])
    rate = F.coalesce(between, low["y"], high["y"])
    return found.select("row.*", F.when(F.col("vote").isNull(), F.lit(index.base_rate)).otherwise(rate).alias("tox_score"), F.col("evidence").alias("tox_evidence"))
