"""The folder that driver and executors share, for cutting lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Largest number of narrow rows that is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 100_000
#: Rows that a task sorts or keeps in a map, about, and the most partitions to which a task writes without keeping rows in memory
#: (Spark's ``spark.shuffle.sort.bypassMergeThreshold``); beyond these, tasks are allowed more rows before there are more partitions.
TASK_ROWS, PLAIN_WRITERS = 1 << 19, 200
#: Bits of a filter for each id, and the most words of 64 bits that a filter has (24 MB of rows to broadcast); with more ids it only lets more rows through.
FILTER_BITS, FILTER_WORDS = 10, 1 << 20
#: Whether Spark deletes the shuffle files of an action when it ends, and the values of it that the writers under way have found.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING, _HELD = threading.Lock(), []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset and Spark runs in one process (tests), a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is written in here frees its shuffle files when it is done, rather than when the driver next collects garbage: no one reads them again."""
    with _FREEING:
        _HELD.append(spark.conf.get(CLEANUP))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _FREEING:  # the last of several writers at a time puts back what the first one found
            first = _HELD[0]
            _HELD.pop()
            if not _HELD:
                spark.conf.set(CLEANUP, first)


def saved(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write and read again: iterations stay short and survive lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def written(df: DataFrame, name: str) -> str:
    """The path of a new table in the shared folder that holds ``df``. It is deleted when the application ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    passing(df.sparkSession, path)
    return path


def side_by_side(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """What independent actions give, run at the same time: one fills the cores that the last tasks of another leave idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def passing(spark: SparkSession, path: str) -> str:
    """Mark a folder that is there as one that goes with the application (results may read it until then)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def saved_counted(df: DataFrame, name: str = "stage") -> tuple[DataFrame, int]:
    """``saved``, and the number of its rows, which is counted while it is written."""
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("n"))
    return saved(watched, name), seen.get["n"]


def firsts(df: DataFrame, *order: str) -> DataFrame:
    """The first row of each id in ``order``. Only ids are counted; whole rows move where an id occurs more than once, others stay as they are."""
    twice, n = saved_counted(df.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("id").alias("_id")), "twice")
    if not n:
        return df
    ids = sized(twice, n)
    same = F.col("id").eqNullSafe(F.col("_id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    first = df.join(ids, same, "left_semi").withColumn("_n", place).filter("_n = 1").drop("_n")
    return df.join(ids, same, "left_anti").unionByName(first)


def sized(df: DataFrame, n_rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as one side of a join: broadcast if its rows (counted, or known) are within the bound."""
    return F.broadcast(df) if (df.count() if n_rows is None else n_rows) <= bound else df


def without(df: DataFrame, **sets: tuple[DataFrame, int]) -> DataFrame:
    """The rows of ``df`` none of whose named columns is in its set (``id``, and the number of rows). Few ids are broadcast; of many, only the rows
    that filters of the sets let through move, to be joined with them."""
    few = {c: x for c, x in sets.items() if x[1] <= BROADCAST_ROWS}
    for c, (ids, _) in few.items():
        df = df.join(F.broadcast(ids.withColumnRenamed("id", c)), c, "left_anti").select(*df.columns)
    many = {c: x for c, x in sets.items() if c not in few}
    if not many:
        return df
    columns, held, hit = df.columns, df, F.lit(False)
    for c, (ids, n) in many.items():
        held = _marked(held, c, ids, n)
        hit = hit | F.col(f"_in_{c}")
    rest = held.filter(hit).select(*columns)
    for c, (ids, _) in many.items():
        rest = rest.join(ids.withColumnRenamed("id", c), c, "left_anti").select(*columns)
    return held.filter(~hit).select(*columns).unionByName(rest)


def within(df: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``df`` whose ``column`` is one of ``ids`` (``id``, ``n`` rows), moved as by ``without``."""
    one = ids.withColumnRenamed("id", column)
    if n <= BROADCAST_ROWS:
        return df.join(F.broadcast(one), column, "left_semi").select(*df.columns)
    return marked(df, column, ids, n).join(one, column, "left_semi").select(*df.columns)


def marked(df: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``df`` whose ``column`` is one of ``ids`` (``id``, ``n`` rows), and a few others; nothing but a filter of the ids moves."""
    return _marked(df, column, ids, n).filter(f"_in_{column}").select(*df.columns)


def known_of(df: DataFrame, rows: DataFrame, n: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``id`` is one of those of ``rows`` (stored, ``n`` in all): these few are what a join of the two needs to move."""
    ids = rows.select("id")
    return within(df, "id", ids, ids.count() if n is None else n)


def _marked(df: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """``df`` with ``_in_<column>``: true where ``column`` is one of ``ids``, and in a few other rows. Each id sets two bits of one word."""
    words = 1 << (min(FILTER_WORDS, -(-n * FILTER_BITS // 64)) - 1).bit_length()

    def place(c: str) -> tuple[Column, Column]:
        h = F.xxhash64(c)
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
        return h.bitwiseAND(F.lit(words - 1)), bit(40).bitwiseOR(bit(50))

    word, bits = place("id")
    marks = saved(ids.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")), "marks")
    word, bits = place(column)
    held = df.withColumns({"_at": word, "_own": bits}).join(F.broadcast(marks), F.col("_at") == F.col("_word"), "left")
    return held.withColumn(f"_in_{column}", F.coalesce(F.col("_bits").bitwiseAND(F.col("_own")) == F.col("_own"), F.lit(False))).drop("_at", "_own", "_word", "_bits")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` for a join or a grouping that keeps about ``rows`` rows in all: their number decides on the partitions, so a
    task's memory does not grow with the table. What is grouped after this is not grouped before it, by tasks that read as much as a file holds."""
    n = -(-rows // TASK_ROWS)
    if n <= 1:
        return df.repartition(*keys)  # Spark may take fewer partitions
    n = n if n <= PLAIN_WRITERS else max(PLAIN_WRITERS, -(-rows // (8 * TASK_ROWS)))
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with the place of each row (from 1) in ``order``: partitions are ranges, and meet only in their counts."""
    keys = [F.col(x) for x in order]
    held = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = saved(held.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
