"""N-gram Jaccard join by chosen paths: documents whose word shingles have a Jaccard similarity of 0.8 or more.

A document is the set of its runs of five words (words are what stands between
blanks and the control characters 09-0D, A-Z lower-cased; a text of one to four
words is one shingle). Equal sets are one record with a multiplicity.

Chosen path: a record carries a signature, the minimum of its tokens under 128
hash functions, so that two records have the same token in a coordinate with a
probability of their similarity. In a run each node of the recursion tree samples
coordinates by the hash of its own path, one always and a second one in a quarter
of the nodes (1/similarity on average), and a record goes into the bucket of its
token in each of them. A bucket of more than ``limit`` records is split again;
smaller ones are brute-forced. Two records that agree in a share p of the
coordinates meet below a node with a probability of at least
q(d) = 1 - (1 - p q(d-1)) (1 - p q(d-1) / 4) within d levels (the second
coordinate is another one than the first, which can only help), so runs are added
until the bound, weighed over p, reaches the target recall for every record,
whatever the depth was; where it can't be reached that is an error. What is still
too large at the last depth is compared in blocks, a pair of blocks a task.

A node's place in the tree of its run is its slot, the same for all its records.
A pair is looked at in the first slot only whose bucket holds both, which each
record's list of buckets tells; so links are counted exactly once without a
table of pairs. Sizes and 1-bit minwise sketches (5 standard deviations below
the threshold pass) leave out hopeless pairs; what is left is compared by its
whole sets of 64-bit shingle hashes. A bucket passes on a count of links for
each record and a spanning forest, never all pairs.

Defined results
- Null, empty and blank texts have no shingle and no link; each is a class by itself.
- A class is a connected component of links; its id is its smallest document id (null where all are null).
- Rows that repeat are copies: they are linked, and counted, like any others. Empty tables give empty results.
- Extra columns pass through ``deduplicate`` whatever their names are; ``classes`` leaves them out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved

SHINGLE, SIMILARITY = 5, 0.8
COORDINATES = 128
LIMIT, DEPTH = 2048, 6
RUNS, MOST_RUNS, RECALL = 8, 240, 0.9999
#: Share of nodes that sample a second coordinate.
SECOND = 0.25
#: Rows of buckets of a task, about; Spark's own number of partitions is the least.
TASK_ROWS = 2_000_000
#: Largest number of rows (of a few bytes each) that is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 200_000
#: Pairs that are looked at in one go.
PAIRS = 1 << 20
M64 = (1 << 64) - 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h


def shingle_sets(texts: list[str | None], words: WordHashes, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    factors = constants(size, 17)
    out = []
    for text in texts:
        tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not tokens:
            out.append(np.empty(0, dtype=U))
            continue
        h = np.fromiter(map(words.__getitem__, tokens), dtype=U, count=len(tokens))
        n = max(1, len(h) - size + 1)
        got = np.full(n, len(h) if len(h) < size else size, dtype=U)
        for k in range(min(size, len(h))):
            got = got + mix(h[k : k + n] * factors[k])
        out.append(np.unique(mix(got)))
    return out


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray], n: int = COORDINATES) -> np.ndarray:
    """The minimum of each (not empty) set under n hash functions, (sets, n)."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    x = np.concatenate(sets)
    out = np.empty((len(sets), n), dtype=U)
    for j, a in enumerate(constants(n, 29)):
        out[:, j] = np.minimum.reduceat(x * a, starts)
    return out


def children(sig: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each coordinate that the nodes ``at`` sample: its number (0 or 1), the rows that it concerns, and the nodes they go to."""
    n = U(sig.shape[1])
    first = mix(at + U(1)) % n
    second = (first + U(1) + mix(at + U(2)) % (n - U(1))) % n
    some = np.flatnonzero(mix(at + U(3)) < U(int(SECOND * 2**64)))
    for which, coordinate, rows in ((0, first, np.arange(len(at))), (1, second, some)):
        token = sig[rows, coordinate[rows].astype(np.int64)].astype(U)
        yield which, rows, mix(at[rows] * U(3) + token + (U(which + 1) << U(40)))


def meets(share: float, depth: int) -> float:
    """The least probability that a pair that agrees in this share of the coordinates is together in a node of this depth."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - share * q) * (1 - SECOND * share * q)
    return q


def records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, rk (a digest of id and text), key (of the set), n (its size), sig and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(2).to_pylist(), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list[bytes | None] = [None] * len(sets)
                sketch: list[bytes | None] = [None] * len(sets)
                if full:
                    whole = mix(signatures([sets[i] for i in full]))
                    bits = np.packbits((whole >> U(63)).astype(np.uint8), axis=1)
                    for i, s, b in zip(full, whole.astype(np.uint32), bits):
                        sig[i], sketch[i] = s.tobytes(), b.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())],
                    names=["id", "rk", "key", "n", "sig", "sketch"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(id_col, text_col).alias("rk"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, rk binary, key binary, n long, sig binary, sketch binary")


def row_key(id_col: str, text_col: str):
    """128 bits that tell rows of different ids or texts apart."""
    part = lambda c, kind: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast(kind).cast("string")), F.lit("~"))
    return F.unhex(F.md5(F.concat(part(id_col, "long"), part(text_col, "string"))))


def small(df: DataFrame) -> DataFrame:
    """``df`` for a join: broadcast if it is within the bound, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def buckets(recs: DataFrame, first: int, n_runs: int, limit: int = LIMIT, depth: int = DEPTH) -> tuple[DataFrame, DataFrame | None]:
    """Leaves (key, slot, leaf, blocks) that hold two records or more, and how deep records went (key, run, depth over 1)."""
    width = 2 << depth

    def below(key: pa.Array, sig: np.ndarray, run: np.ndarray, code: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        for which, rows, nodes in children(sig, at):
            yield pa.RecordBatch.from_arrays([key.take(pa.array(rows)), pa.array(run[rows]), pa.array(code[rows] * 2 + which), pa.array(nodes.view(np.int64))], names=["key", "run", "code", "leaf"])

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = matrix(batch)
                ones = np.ones(batch.num_rows, dtype=np.int32)
                for r in range(first, first + n_runs):
                    root = mix(np.full(batch.num_rows, r + 1, dtype=U) * U(0x9E3779B97F4A7C15))
                    yield from below(batch.column(0), sig, ones * np.int32(r), ones, root)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                run, code, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                yield from below(batch.column(0), matrix(batch), run, code, at.view(U))

    # key, and a node: run, code (its place in the tree, the root's is 1), leaf (its hash)
    fields = "key binary, run int, code int, leaf long"
    rows = recs.select("key", "sig").mapInArrow(start, fields)
    leaves, deep = [], []
    for level in range(depth):
        counts = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        held = saved(rows.join(counts, "leaf"), "chosen-path")
        last = level == depth - 1
        done = held if last else held.filter(F.col("size") <= limit)
        blocks = F.ceil(F.col("size") / limit).cast("int") if last else F.lit(1)
        leaves.append(done.select("key", (F.col("run") * width + F.col("code")).alias("slot"), "leaf", blocks.alias("blocks")))
        large = held.filter(F.col("size") > limit)
        if last or large.isEmpty():
            break
        deep.append(large.select("key", "run", F.lit(level + 2).alias("depth")))
        rows = large.join(recs.select("key", "sig"), "key").select("key", "sig", "run", "code", "leaf").mapInArrow(split, fields)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    down = None
    for x in deep:
        down = x if down is None else down.unionByName(x)
    return out, down


def missed(similarity: float, bits: int = COORDINATES) -> list[tuple[float, float, float]]:
    """Of a pair of this similarity: (probability, share of coordinates that agree, share that the sketches let pass), for each number of coordinates."""
    agree = (1 + similarity) / 2
    apart = math.ceil(bits * (1 - agree) + 5 * math.sqrt(bits * agree * (1 - agree)))
    out = []
    for k in range(bits + 1):
        passes = sum(math.comb(bits - k, x) for x in range(min(apart, bits - k) + 1)) / 2 ** (bits - k)
        out.append((math.comb(bits, k) * similarity**k * (1 - similarity) ** (bits - k), k / bits, passes))
    return out


def all_leaves(recs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n_runs: int = RUNS, limit: int = LIMIT) -> DataFrame:
    """Leaves of as many runs as the target recall takes.

    The bound is that of the record that went deepest. All runs share the coordinates, so it is taken for each
    number of coordinates in which a pair can agree, and weighed by the probability of that number.
    """
    leaves, deep, total = None, None, 0
    cases = missed(similarity)
    while True:
        more, down = buckets(recs, total, n_runs, limit)
        total += n_runs
        leaves = more if leaves is None else leaves.unionByName(more)
        if down is not None:
            deep = down if deep is None else deep.unionByName(down)
        profiles = [{1: total}]
        if deep is not None:
            deepest = deep.groupBy("key", "run").agg(F.max("depth").alias("depth"))
            per_key = deepest.groupBy("key").agg(*[F.sum((F.col("depth") == d).cast("int")).alias(str(d)) for d in range(2, DEPTH + 1)])
            worst = F.lit(0.0)
            for d in range(2, DEPTH + 1):  # nearly in the order of the bound: the chance to meet in no run at all
                worst = worst + F.col(str(d)) * math.log((1 - meets(similarity, d)) / (1 - meets(similarity, 1)))
            row = per_key.orderBy(worst.desc()).first()
            if row:
                runs = {d: int(row[str(d)]) for d in range(2, DEPTH + 1)}
                profiles.append(runs | {1: total - sum(runs.values())})
        lost = max(1 - sum(p * (1 - math.prod((1 - meets(share, d)) ** n for d, n in runs.items())) * passes for p, share, passes in cases) for runs in profiles)
        if lost <= 1 - recall:
            return leaves
        if total >= MOST_RUNS:
            raise ValueError(f"recall {1 - lost:.5f} after {total} runs; take more coordinates or a larger limit")


def slices_of_pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) of rows inside groups [start, end), in slices of about PAIRS."""
    rows = np.concatenate([np.arange(a, b - 1) for a, b in zip(starts, ends)]) if len(starts) else np.empty(0, dtype=np.int64)
    stop = np.repeat(ends, np.maximum(ends - starts - 1, 0))
    per_row = stop - rows - 1
    total = np.cumsum(per_row)
    at = 0
    while at < len(rows):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        n = per_row[at:to]
        i = np.repeat(rows[at:to], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
        yield i, j
        at = to


class Block:
    """Rows of whole buckets as arrays."""

    def __init__(self, batch: pa.RecordBatch, similarity: float):
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        self.key = col("key").to_pylist()
        self.leaf, self.slot, self.part, self.n = (col(x).to_numpy(zero_copy_only=False) for x in ("leaf", "slot", "part", "n"))
        # each row's bucket in every slot that occurs here, 0 for none
        slots = col("slots")
        self.slots, place = np.unique(slots.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self.leaves = np.zeros((batch.num_rows, len(self.slots)), dtype=np.int64)
        row = np.repeat(np.arange(batch.num_rows), slots.value_lengths().to_numpy(zero_copy_only=False))
        self.leaves[row, place] = col("leaves").flatten().to_numpy(zero_copy_only=False)
        self.sketch = np.frombuffer(b"".join(col("sketch").to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
        self.similarity = similarity
        bits = self.sketch.shape[1] * 64
        agree = (1 + similarity) / 2
        self.apart = math.ceil(bits * (1 - agree) + 5 * math.sqrt(bits * agree * (1 - agree)))
        cut = np.flatnonzero(np.diff(self.leaf)) + 1
        self.starts, self.ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(self.leaf)]])

    def new_pairs(self, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that can be similar and did not meet in an earlier slot."""
        for i, j in slices_of_pairs(starts, ends):
            lo, hi = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
            good = (lo >= self.similarity * hi - 1e-9) & ((self.part[i] != self.part[j]) | (self.part[i] < 0))
            i, j = i[good], j[good]
            good = np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(axis=1, dtype=np.int64) <= self.apart
            i, j = i[good], j[good]
            last = self.slot[i].max() if len(i) else -1
            for r, slot in enumerate(self.slots.tolist()):
                if slot >= last or not len(i):
                    break
                a = self.leaves[i, r]
                good = ~((self.slot[i] > slot) & (a != 0) & (a == self.leaves[j, r]))
                i, j = i[good], j[good]
            if len(i):
                yield i, j


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by leaf, cut so that no bucket is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        leaf = batch.column(batch.schema.get_field_index("leaf")).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(leaf != leaf[-1])
        same_as_held = bool(held) and held[-1].column(held[-1].schema.get_field_index("leaf"))[-1].as_py() == leaf[0]
        if len(cut):
            end = int(cut[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, end)]).combine_chunks().to_batches(max_chunksize=None)[0]
            held = [batch.slice(end)]
        elif held and not same_as_held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of one bucket; many pairs of few rows by matrix products."""
    rows = np.unique(np.concatenate([i, j]))
    if len(i) < 6 * len(rows):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], dtype=np.int64)
    own = [sets[r] for r in rows.tolist()]
    row = np.repeat(np.arange(len(rows)), [len(s) for s in own])
    tokens, col, df = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = df > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], number[col[keep]]
    width = max(64, (1 << 22) // len(rows))
    a, b = np.searchsorted(rows, i), np.searchsorted(rows, j)
    total = np.zeros((len(rows), len(rows)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [at, at + width])
        dense = np.zeros((len(rows), width), dtype=np.float32)
        dense[row[lo:hi], col[lo:hi] - at] = 1
        total += dense @ dense.T
    return total[a, b].astype(np.int64)


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the pairs into ``root`` (each row's smallest known relative)."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def links(docs: DataFrame, recs: DataFrame, leaves: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """``key``, ``links`` (to other sets, by rows) and ``other`` (an edge of a spanning forest, or null)."""
    per_key = leaves.groupBy("key").agg(F.collect_list(F.struct("slot", "leaf", "blocks")).alias("at"))  # its size depends on the runs and the depth only
    rows = per_key.join(recs.select("key", "n", "sketch", "rows", "rk"), "key")
    rows = rows.select("key", "n", "sketch", "rows", "rk", F.col("at.slot").alias("slots"), F.col("at.leaf").alias("leaves"), F.explode("at").alias("x"))
    # a bucket too large at the last depth: pairs of blocks
    own = F.pmod(F.xxhash64("key", F.lit(5)), F.col("x.blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("x.blocks") - 1)))
    pair = F.xxhash64("x.leaf", F.least("own", "with"), F.greatest("own", "with"))
    leaf = F.when(F.col("x.blocks") == 1, F.col("x.leaf")).otherwise(pair)
    part = F.when(F.col("own") == F.col("with"), -1 - F.col("own")).otherwise(F.col("own"))
    rows = rows.select("key", "n", "sketch", "rows", "rk", "slots", "leaves", F.col("x.slot").alias("slot"), leaf.alias("leaf"), part.cast("int").alias("part"))
    # rows of a block that meet only in their own block's bucket have a negative part
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // TASK_ROWS))
    sorted_rows = rows.repartition(n_parts, "leaf").sortWithinPartitions("leaf", "key")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_buckets(batches):
            block = Block(batch, similarity)
            use = np.zeros(batch.num_rows, dtype=bool)
            for i, j in block.new_pairs(block.starts, block.ends):
                use[i] = True
                use[j] = True
            yield batch.filter(pa.array(use))

    some = saved(sorted_rows.mapInArrow(needed, rows.schema), "jaccard-buckets")
    wanted = some.select("rk").distinct()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = shingle_sets(batch.slice(at, 500).column(0).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])

    texts = docs.select(row_key(id_col, text_col).alias("rk"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = texts.join(small(wanted), "rk", "left_semi").select("text").mapInArrow(sets_of, "key binary, set binary")
    ready = some.drop("rk").join(sets, "key").repartition(n_parts, "leaf").sortWithinPartitions("leaf", "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_buckets(batches):
            block = Block(batch, similarity)
            raw = batch.column(batch.schema.get_field_index("set"))
            sets = [np.frombuffer(x.as_buffer(), dtype=U) for x in raw]
            weight = batch.column(batch.schema.get_field_index("rows")).to_numpy(zero_copy_only=False)
            # rows that repeat id and text bring their set twice
            keep = np.ones(batch.num_rows, dtype=bool)
            same = [a == b for a, b in zip(block.key[1:], block.key)]
            keep[1:] = ~(np.array(same, dtype=bool) & (np.diff(block.leaf) == 0))
            count = np.zeros(batch.num_rows, dtype=np.int64)
            root = np.arange(batch.num_rows)
            for start, end in zip(block.starts, block.ends):
                for i, j in block.new_pairs(np.array([start]), np.array([end])):
                    good = keep[i] & keep[j]
                    i, j = i[good], j[good]
                    if not len(i):
                        continue
                    both = overlaps(sets, i, j)
                    near = both >= similarity * (block.n[i] + block.n[j] - both) - 1e-9
                    i, j = i[near], j[near]
                    np.add.at(count, i, weight[j])
                    np.add.at(count, j, weight[i])
                    root = joined(root, i, j)
            out = np.flatnonzero(count)
            other = [block.key[r] if r != k else None for k, r in zip(out.tolist(), root[out].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([block.key[k] for k in out.tolist()], pa.binary()), pa.array(count[out]), pa.array(other, pa.binary())], names=["key", "links", "other"])

    return saved(ready.mapInArrow(verify, "key binary, links long, other binary"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for edges (a, b): smallest neighbour and pointer jumping, until nothing changes."""
    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("seen"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "seen").alias("new"), F.col("root").alias("old"))
        top = new.select(F.col("node").alias("up"), F.col("new").alias("higher"))
        new = new.join(top, F.col("new") == F.col("up"), "left").select("node", F.least("new", F.coalesce("higher", "new")).alias("root"), "old")
        new = saved(new, "labels")
        if new.filter("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, limit: int = LIMIT, n_runs: int = RUNS) -> DataFrame:
    """A row per input row: id, rk, class_id, n_links (rows linked to it, copies too), class_size, set_rk (the row that stands for its set)."""
    every = saved(records(docs, id_col, text_col), "jaccard-records")
    recs = every.filter("n > 0").groupBy("key").agg(
        F.min(F.struct(F.col("id"), F.col("rk"))).alias("first"), F.count(F.lit(1)).alias("rows"), F.min("id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")
    )
    recs = saved(recs.withColumn("rk", F.col("first.rk")), "jaccard-sets")
    leaves = all_leaves(recs, similarity, recall, n_runs, limit)
    found = links(docs, recs, leaves, id_col, text_col, similarity)
    roots = components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    per_set = recs.join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    per_set = per_set.select("key", "rows", "low", "rk", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"))
    groups = per_set.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("rows").alias("class_size"), F.min(F.struct("low", "rk")).alias("keep"))
    per_set = per_set.join(groups, "root").select("key", "class_id", "class_size", F.col("links").alias("n_links"), F.col("keep.rk").alias("keep_rk"))
    per_set = saved(per_set, "jaccard-classes")
    rows = every.select("id", "rk", "key", "n").join(per_set, "key", "left")
    return rows.select(
        "id", "rk", F.coalesce("class_id", F.when(F.col("n") == 0, F.col("id"))).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("keep_rk", "rk").alias("keep_rk"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one of each class left, that of the smallest id; texts without shingles stay."""
    found = saved(classes(docs, id_col, text_col, **options), "jaccard-rows")
    gone = found.filter("rk <> keep_rk").select("rk").distinct()
    name = "_rk"
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    keyed = lambda df: small(df.select(F.col("rk").alias(name)))
    kept = docs.withColumn(name, row_key(id_col, text_col)).join(keyed(gone), name, "left_anti")
    twice = found.filter("rk = keep_rk and class_size > 1").groupBy("rk").agg(F.count(F.lit(1)).alias("x")).filter("x > 1")
    if not twice.isEmpty():  # whole rows that repeat: one of them stays
        again = kept.join(keyed(twice), name, "left_semi").dropDuplicates([name])
        kept = kept.join(keyed(twice), name, "left_anti").unionByName(again)
    return kept.select(*[f"`{c}`" for c in docs.columns])
