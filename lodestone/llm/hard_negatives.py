"""Hard-negative mining by bit-sliced integer products.

Rows are dealt into blocks. A block holds its vectors as bit-planes: plane j holds bit j of x - min(x) of every
component of every row, packed along the components. An anchor is cut into bits as well, so that the product of anchor
and plane is a weighted sum of population counts. Planes are taken most significant first: what the planes below could
still add lies between two numbers that the anchor alone gives, so every row has an interval that holds its score, and
the interval halves with each plane. Rows are dropped as soon as their interval cannot qualify; who is left after the
last plane has an exact score.

Two passes: the best rows of the anchor's own label (positives), dropped below the k-th best lower end; then rows of
other labels whose score lies between two shares of a positive's score (negatives), dropped when their interval misses
all ranges, or when enough rows are certain to be better. The stated anchors meet all rows in blocks; blocks answer
with a few rows each, which are merged.

Defined results
- Rows with a null label, a null id, a vector that is null, empty, or holds null or non-finite components take no part.
- A row meets only rows of its own length, and never rows with its own id. Rows that repeat an id count as rows of their own.
- Higher scores come first, ties by smaller id.
- Positives below 0 have no negatives, as their range is empty. Anchors without positives give no rows.
- Scores that could go beyond 62 bits are an error. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import saved
from lodestone.llm.topk import narrow, wide
from lodestone.llm.vectors import integer_vectors

BLOCK_ROWS = 16384
ANCHOR_ROWS = 128


class Planes:
    """The bit-planes of the rows of a block, most significant first."""

    def __init__(self, x: np.ndarray):
        self.x, self.low = x, x.min(axis=0)
        up = (x - self.low).astype(np.uint64)
        self.bits = int(up.max()).bit_length()
        self.words = -(-x.shape[1] // 64)
        self.planes = [packed((up >> np.uint64(j)) & np.uint64(1)) for j in range(self.bits)]

    def product(self, weights: list[tuple[int, np.ndarray]], j: int, rows: np.ndarray) -> np.ndarray:
        """An anchor, given as weighted bits, times bit j of the rows' components."""
        plane = self.planes[j][rows]
        out = np.zeros(len(plane), dtype=np.int64)
        for weight, bits in weights:
            n = np.bitwise_count(plane & bits).sum(axis=1, dtype=np.int64) if self.words > 1 else np.bitwise_count(plane[:, 0] & bits[0]).astype(np.int64)
            out += n * weight
        return out

    def screen(self, q: np.ndarray, rows: np.ndarray, useful: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows that stay ``useful`` (given lower and upper ends of their scores) to the last plane, and their exact scores."""
        least, most = int(q[q < 0].sum()), int(q[q > 0].sum())
        known = np.full(len(rows), int(q @ self.low), dtype=np.int64)
        weights = weighted_bits(q)
        for j in reversed(range(self.bits)):
            known = known + (self.product(weights, j, rows) << j)
            rest = (1 << j) - 1
            stays = useful(known + rest * least, known + rest * most)
            if not stays.all():
                rows, known = rows[stays], known[stays]
            if not len(rows):
                break
        if not self.bits:
            stays = useful(known, known)
            rows, known = rows[stays], known[stays]
        return rows, known


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.ascontiguousarray(np.packbits(wide, axis=1, bitorder="little")).view(np.uint64)


def weighted_bits(q: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The bits of q in two's complement, packed, with what each counts; the last is the sign."""
    width = int(np.abs(q).max()).bit_length()
    cut = [(-(1 << i) if i == width else 1 << i, packed(((q >> i) & 1)[None, :].astype(np.uint8))[0]) for i in range(width + 1)]
    return [(weight, bits) for weight, bits in cut if bits.any()]


def kth(values: np.ndarray, k: int) -> int | None:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def among_best(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Useful: not surely below the k-th best."""

    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        edge = kth(low, k)
        return np.ones(len(low), dtype=bool) if edge is None else high >= edge

    return useful


def in_ranges(ranges: list[tuple[int, int]], k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Useful: for one of the ranges at least, maybe inside and not surely below the k best that are surely inside."""

    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low), dtype=bool)
        for a, b in ranges:
            edge = kth(low[(low >= a) & (high <= b)], k)
            out |= (low <= b) & (high >= (a if edge is None else edge))
        return out

    return useful


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by place (rows of a block are in the order of ids)."""
    return np.lexsort((np.arange(len(ids)), -scores))[:k]


def _get(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _met(blocks: DataFrame, chunks: DataFrame, n_blocks: int, copies: int, answer: Callable, schema: str) -> DataFrame:
    """``answer(block, anchor)`` for each block and each anchor that comes by: a block comes first, then chunks of anchors."""
    met = blocks.unionByName(chunks, allowMissingColumns=True).repartition(n_blocks * copies, "block", "copy", "dim").sortWithinPartitions("block", "copy", "dim", "kind", "part")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                take = lambda name: _get(batch, name)[r].as_py()
                key, ids = (take("block"), take("copy"), take("dim")), np.frombuffer(take("ids"), dtype=np.int64)
                x = wide(take("v"), len(ids) * key[2]).reshape(len(ids), -1)
                labels, uids = np.frombuffer(take("labels"), dtype=np.int64), np.frombuffer(take("uids"), dtype=np.int64)
                if take("kind") == 0:
                    last, block = key, (ids, labels, Planes(x))
                elif last == key:  # else the block holds no vector of this length
                    if 2 * (int(np.abs(block[2].x).max()) + 1) * (int(np.abs(x).max()) + 1) * key[2] >= 1 << 61:
                        raise OverflowError("scores go beyond 62 bits")
                    positives = take("positives") or [None] * len(ids)
                    got = [row for one in zip(uids.tolist(), ids.tolist(), labels.tolist(), x, positives) for row in answer(block, *one)]
                    yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(len(names))], names=names)

    return met.mapInArrow(run, schema)


def mine(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: float = 256.0, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, for the rows where ``anchors`` holds.

    Negatives of a positive have ``low`` to ``high`` hundredths of its score; ``label`` is an integer column.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = integer_vectors(df.filter(label.isNotNull()), id_col, vec_col, scale, 1 << 60, {"label": label.cast("long"), "anchor": F.coalesce(anchors, F.lit(False))})
    rows = saved(rows.withColumn("dim", F.size("v")).withColumn("uid", F.monotonically_increasing_id()), "labelled")
    asked = rows.filter("anchor")
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_blocks, n_chunks = max(1, -(-rows.count() // block_rows)), max(1, -(-asked.count() // anchor_rows))
    # blocks stand once each; only where they are fewer than the cores, copies share the anchors
    copies = min(n_chunks, max(1, -(-2 * cores // n_blocks)))

    def pack(rows: DataFrame, n: int, kind: int) -> DataFrame:
        """A row per part and vector length; parts are bounded in rows, whatever ids and vectors are."""

        def run(key: tuple, t: pa.Table) -> pa.Table:
            v = t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            ids, labels, uids = (t[c].to_numpy() for c in ("id", "label", "uid"))
            order = np.lexsort((labels, *v.T[::-1], ids))
            cols = [pa.array([kind], pa.int32()), pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32())]
            cols += [pa.array([x[order].tobytes()], pa.binary()) for x in (ids, labels, uids)] + [pa.array([narrow(v[order])], pa.binary())]
            names = ["kind", "part", "dim", "ids", "labels", "uids", "v"]
            if "positives" in t.column_names:
                cols.append(pa.array([t["positives"].take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64()))))
                names.append("positives")
            return pa.Table.from_arrays(cols, names=names)

        kinds = "kind int, part int, dim int, ids binary, labels binary, uids binary, v binary" + (", positives array<array<long>>" if "positives" in rows.columns else "")
        return rows.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")).groupBy("part", "dim").applyInArrow(run, kinds)

    blocks = pack(rows.select("id", "uid", "label", "dim", "v"), n_blocks, 0).withColumn("block", F.col("part")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    blocks = blocks.withColumn("positives", F.lit(None).cast("array<array<long>>"))
    spread = lambda c: c.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("copy", F.col("part") % copies)

    def nearest(block, uid, id_, label, q, _) -> Iterator[tuple]:
        ids, labels, planes = block
        at, score = planes.screen(q, np.flatnonzero((labels == label) & (ids != id_)), among_best(positives))
        for p in best(at, score, positives):
            yield uid, id_, int(ids[at[p]]), int(score[p]), int(at[p])

    chunks = spread(pack(asked.select("id", "uid", "label", "dim", "v"), n_chunks, 1))
    near = _met(blocks, chunks, n_blocks, copies, nearest, "uid long, anchor_id long, positive_id long, positive_score long, place long")
    first = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id", "place")
    near = saved(near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives), "positives")
    # each anchor carries the scores of its positives, a fixed number
    scores = near.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))

    def between(block, uid, id_, label, q, mine_) -> Iterator[tuple]:
        ids, labels, planes = block
        ranges = [(-(-low * p // 100), high * p // 100) for p in mine_]
        open_ = [r for r in ranges if r[0] <= r[1]]
        if open_:
            at, score = planes.screen(q, np.flatnonzero((labels != label) & (ids != id_)), in_ranges(open_, negatives))
            for n, (a, b) in enumerate(ranges):
                inside = np.flatnonzero((score >= a) & (score <= b))
                for p in best(at[inside], score[inside], negatives):
                    yield uid, n + 1, int(ids[at[inside[p]]]), int(score[inside[p]]), int(at[inside[p]])

    again = spread(pack(asked.select("id", "uid", "label", "dim", "v").join(scores, "uid"), n_chunks, 1))
    far = _met(blocks, again, n_blocks, copies, between, "uid long, n long, negative_id long, negative_score long, place long")
    order = Window.partitionBy("uid", "n").orderBy(F.desc("negative_score"), "negative_id", "place")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return far.join(near.select("uid", F.col("n").cast("long").alias("n"), "anchor_id", "positive_id", "positive_score"), ["uid", "n"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
