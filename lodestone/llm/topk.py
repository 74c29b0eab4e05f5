"""Exact top-k search on a bit-sliced index.

Rows are dealt into blocks. In a block the integer attribute d is stored as bit
slices: bitmap j holds bit j of x[d] - min(x[d]) for every row. The score of a
query is the sum over d of q[d] * x[d]; with complemented slices for negative
weights all terms are positive, so the score is a sum of shifted bitmaps, added
by carry-save adders into the bit slices of the score. The k best rows are then
taken from the most significant slice downward; rows equal to the boundary
score are resolved exactly, smaller ids first. Blocks answer independently, and
the k best of a query over all blocks are the result.

The stated query set meets all rows in blocks: a task builds the index of one
block of rows, once, and the queries pass by in chunks.

Defined results
- Scores that could go beyond 64 bits are an error, and so are components beyond 2^63.
- Vectors that are null, hold null or non-finite components, or are empty take no part.
- A query meets only rows of its own length, and never the rows with its own id.
- Ties go to the smaller id. Rows that repeat an id count as rows of their own, but queries of one id share one ranking. Null ids take no part.
- An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 16384
QUERY_ROWS = 128


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float = 64.0) -> DataFrame:
    """id, dim, v (floor(scale * x) as longs) of the rows that take part."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    large = F.exists(x, lambda v: F.abs(v * scale) >= F.lit(2.0**63))
    sure = F.assert_true(~F.coalesce(large & good, F.lit(False)), F.lit("a component goes beyond 64 bits")).isNull()
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & good & sure)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))


def slices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit slices (dims, bits, words) of x - min, and min: rows are padded with zeros to whole words."""
    low = x.min(axis=0)
    up = (x - low).astype(np.uint64)
    bits = max(1, int(up.max()).bit_length())
    rows = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), dtype=np.uint64)
    rows[: len(x)] = up
    out = np.empty((x.shape[1], bits, len(rows) // 64), dtype=np.uint64)
    for j in range(bits):
        bit = np.ascontiguousarray(((rows >> np.uint64(j)) & np.uint64(1)).astype(np.uint8).T)
        out[:, j] = np.ascontiguousarray(np.packbits(bit, axis=1, bitorder="little")).view(np.uint64)
    return out, low


def add_columns(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps, each of weight 2^key, as bit slices: full adders turn three of a weight into a sum and a carry."""
    out, weight = [], 0
    while columns:
        stack = columns.pop(weight, [])
        rows = np.concatenate(stack) if stack else np.empty((0, 0), dtype=np.uint64)
        while len(rows) > 1:
            n = len(rows) // 3
            if n:
                a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                half = a ^ b
                carry = half & c
                carry |= a & b
                half ^= c
                rows = np.concatenate([half, rows[3 * n :]]) if len(rows) > 3 * n else half
            else:
                carry, rows = (rows[:1] & rows[1:2]), (rows[:1] ^ rows[1:2])
            columns.setdefault(weight + 1, []).append(carry)
        out.append(rows[0] if len(rows) else None)
        weight += 1
    return out


def best_rows(total: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest sums among ``valid``; of equal sums the smallest row numbers."""
    sure, open_ = np.zeros_like(valid), valid
    n_sure = 0
    for s in reversed(total):
        if s is None:
            continue
        high = open_ & s
        n = int(np.bitwise_count(high).sum())
        if n_sure + n > k:
            open_ = high
        else:
            sure, n_sure = sure | high, n_sure + n
            open_ = open_ & ~s
            if n_sure == k:
                break
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if n_sure < k:
        edge = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
        rows = np.concatenate([rows, edge[: k - n_sure]])
    return rows


def search_block(ids: np.ndarray, x: np.ndarray, index: np.ndarray, q_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a block; rows are in the order of ids, which settles ties."""
    columns: dict[int, list[np.ndarray]] = {}
    size = np.abs(q)
    for sign in (1, -1):
        for i in range(int(size.max()).bit_length()):
            dims = np.flatnonzero(((size >> i) & 1 == 1) & (np.sign(q) == sign))
            for j in range(index.shape[1]) if len(dims) else ():
                part = index[dims, j]
                columns.setdefault(i + j, []).append(part if sign > 0 else ~part)
    words = index.shape[2]
    mask = np.zeros(words * 64, dtype=bool)
    mask[: len(ids)] = ids != q_id
    valid = np.packbits(mask, bitorder="little").view(np.uint64)
    rows = best_rows(add_columns(columns), valid, k)
    return ids[rows], x[rows] @ q


def narrow(x: np.ndarray) -> bytes:
    """Integers in the smallest signed type that holds them."""
    least = np.result_type(np.min_scalar_type(int(x.min())), np.min_scalar_type(int(x.max())))
    return x.astype(least if least.kind == "i" else np.dtype(f"i{min(8, 2 * least.itemsize)}")).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"i{len(data) // n}").astype(np.int64)


def top_k(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), id, score: for the rows where ``queries`` holds, against all other rows."""
    found = quantised(df, id_col, vec_col, scale)
    asked = quantised(df.filter(queries), id_col, vec_col, scale)
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-found.count() // BLOCK_ROWS))
    n_chunks = max(1, -(-asked.count() // QUERY_ROWS))
    # blocks stand once each; only where they are fewer than the cores, copies share the queries
    copies = min(n_chunks, max(1, -(-2 * cores // n_blocks)))

    def packed(rows: DataFrame, n: int, kind: int) -> DataFrame:
        """A row per part and vector length: ids and vectors as bytes. Parts are bounded in rows, whatever the ids are."""
        part = F.pmod(F.xxhash64("id", "v"), F.lit(2**31 - 1)) % n
        sliced = rows.withColumn("part", part.cast("int")).groupBy("part", "dim")

        def pack(key, t):
            ids = t["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            v = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            cols = [pa.array([kind], pa.int32()), pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([narrow(v[order])], pa.binary())]
            return pa.Table.from_arrays(cols, names=["kind", "part", "dim", "ids", "v"])

        return sliced.applyInArrow(pack, "kind int, part int, dim int, ids binary, v binary")

    blocks = packed(found, n_blocks, 0).withColumn("block", F.col("part")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    chunks = packed(asked, n_chunks, 1).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("copy", F.col("part") % copies)
    rows = blocks.unionByName(chunks)
    # a block comes first, its index is built once, and the queries pass by one chunk at a time
    met = rows.repartition(n_blocks * copies, "block", "copy", "dim").sortWithinPartitions("block", "copy", "dim", "kind", "part")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[r].as_py()
                key, ids = (get("block"), get("copy"), get("dim")), np.frombuffer(get("ids"), dtype=np.int64)
                x = wide(get("v"), len(ids) * key[2]).reshape(len(ids), -1)
                if get("kind") == 0:
                    last, block = key, (ids, x, slices(x)[0], int(np.abs(x).max()))
                elif last == key:  # else the block holds no vector of this length
                    if block[3] * int(np.abs(x).max()) * key[2] >= 1 << 62:
                        raise OverflowError("scores go beyond 64 bits")
                    got = [search_block(*block[:3], i, q, k) for i, q in zip(ids, x)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids, [len(g[0]) for g in got])), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))],
                        names=["query_id", "id", "score"],
                    )

    near = met.mapInArrow(answer, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
