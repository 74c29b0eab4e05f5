"""Edges stored in both directions, in buckets of the node that they are walked from.

A level of a traversal joins them without moving them: a small frontier is broadcast, a large one is dealt out to the buckets,
and the ids of a very small one prune buckets and row groups.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import freeing, saved, saved_counted, side_by_side, without
from lodestone.sources import folders

COLUMNS = "a string, b string, side int, edge_seq long, edge_type string"
#: Edges of a bucket (about 150 MB to sort, so that a task need not spill), and the fewest buckets.
BUCKET_EDGES = 1 << 20
FEWEST = 8


@dataclass(frozen=True)
class Adjacency:
    """``a``, ``b``, ``side``, ``edge_seq``, ``edge_type``: ``out`` walks edges from their sources (side 0), ``back`` from their targets (1)."""

    out: DataFrame
    back: DataFrame
    #: Whether the steps lie in buckets and have known ends; else they are the edges as they are.
    stored: bool = True

    def steps(self, direction: str) -> list[DataFrame]:
        return {"outbound": [self.out], "inbound": [self.back], "both": [self.out, self.back]}[direction]


def walked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The steps of plain edges, out and back."""
    rest = [F.col("seq").alias("edge_seq"), F.col("type").alias("edge_type")]
    ends = F.col("source"), F.col("target")
    out = edges.select(ends[0].alias("a"), ends[1].alias("b"), F.lit(0).alias("side"), *rest)
    return out, edges.select(ends[1].alias("a"), ends[0].alias("b"), F.lit(1).alias("side"), *rest)


def loose(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """``id``: the ends of edges that are no nodes, and their number. Only the ends' ids move, each once a task."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return saved_counted(ends.join(nodes.select("id"), "id", "left_anti"), "loose")


def known(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose ends are both known. Edges move only if some ends are unknown, and too many to broadcast, and then those alone that a filter lets through."""
    found = loose(nodes, edges)
    return bound(edges, found) if found[1] else edges


def bound(edges: DataFrame, unknown: tuple[DataFrame, int], **sets: tuple[DataFrame, int]) -> DataFrame:
    """The edges that have both ends, neither of them unknown; ``sets`` may say more ids for an end, instead."""
    return without(edges.filter("source is not null and target is not null"), **{"source": unknown, "target": unknown} | sets)


def build(nodes: DataFrame, edges: DataFrame, path: str, bucket_edges: int = BUCKET_EDGES) -> Adjacency:
    """Store the steps under ``path``; edges with an unknown end are left out, once, here."""
    sound = saved(known(nodes, edges.select("seq", "source", "target", "type")), "edges")
    side_by_side(nodes.sparkSession, *[functools.partial(store, sound, path, name, bucket_edges) for name in ("out", "back")])
    return attach(nodes.sparkSession, path)


def store(edges: DataFrame, path: str, name: str, bucket_edges: int = BUCKET_EDGES) -> None:
    """Store the steps of one direction (``out`` or ``back``) of edges that are stored and have known ends."""
    n = max(FEWEST, -(-edges.count() // bucket_edges))
    rows = dict(zip(("out", "back"), walked(edges)))[name]
    # the writer sorts the rows of a task, once
    made = rows.repartition(n, "a").write.format("parquet").option("compression", "zstd").bucketBy(n, "a").sortBy("a", "edge_seq")
    with freeing(edges.sparkSession):
        made.option("path", f"{path}/{name}-{n}").saveAsTable(f"steps_{uuid.uuid4().hex}")


def attach(spark: SparkSession, path: str) -> Adjacency:
    """What ``build`` has stored, as tables of this session's catalog; nothing is read."""
    return Adjacency(*[opened(spark, path, name) for name in ("out", "back")])


def opened(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What ``store`` has stored of one direction."""
    (folder,) = [x for x in folders.names(spark, path) if x.startswith(f"{name}-")]
    table = f"steps_{uuid.uuid4().hex}"
    spark.sql(f"create table {table} ({COLUMNS}) using parquet clustered by (a) sorted by (a, edge_seq) into {folder.split('-')[1]} buckets location '{path}/{folder}'")
    return spark.table(table)
