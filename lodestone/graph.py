"""The property graph: two DataFrames, and set operations in place of record-at-a-time updates.

``seq`` is the insertion order; whatever returns a list ranks by it. Metadata is a JSON string.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.scratch import firsts, numbered
from lodestone.sources.adjacency import Adjacency


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    #: The same edges, stored for traversal (``sources.adjacency``); without it each level reads the edges as they are.
    adjacency: Adjacency | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    # --- points -------------------------------------------------------------------------------

    def node(self, id_: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == id_)

    def has_node(self, id_: str) -> bool:
        return not self.node(id_).isEmpty()

    def edge(self, id_: str) -> DataFrame:
        return self.edges.filter(F.col("id") == id_)

    def has_edge(self, id_: str) -> bool:
        return not self.edge(id_).isEmpty()

    def counts(self) -> DataFrame:
        """One row: nodes, edges, files (distinct ones that hold a node)."""
        n = self.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file").alias("files"))
        return n.crossJoin(self.edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each

    def files(self) -> DataFrame:
        return self.nodes.filter("file is not null").select("file").distinct()

    # --- adjacency ----------------------------------------------------------------------------

    def out_edges(self, id_: str, types: list[str] | None = None) -> DataFrame:
        """An empty list of types matches nothing."""
        return self.edges.filter((F.col("source") == id_) & of_types(types))

    def in_edges(self, id_: str, types: list[str] | None = None) -> DataFrame:
        return self.edges.filter((F.col("target") == id_) & of_types(types))

    def successors(self, id_: str, types: list[str] | None = None) -> DataFrame:
        """A node per edge: parallel edges repeat it."""
        ends = self.out_edges(id_, types).select(F.col("target").alias("id"), F.col("seq").alias("edge_seq"))
        return self.nodes.join(ends, "id")

    def predecessors(self, id_: str, types: list[str] | None = None) -> DataFrame:
        ends = self.in_edges(id_, types).select(F.col("source").alias("id"), F.col("seq").alias("edge_seq"))
        return self.nodes.join(ends, "id")

    def neighbors(self, id_: str, types: list[str] | None = None) -> DataFrame:
        """Successors, then predecessors, each node once; ``ord`` is its place."""
        out = self.out_edges(id_, types).select(F.col("target").alias("id"), F.struct(F.lit(0).alias("side"), "seq").alias("k"))
        back = self.in_edges(id_, types).select(F.col("source").alias("id"), F.struct(F.lit(1).alias("side"), "seq").alias("k"))
        once = out.unionByName(back).groupBy("id").agg(F.min("k").alias("k"))
        return self.nodes.join(numbered(once, "ord", "k").drop("k"), "id")

    # --- changes ------------------------------------------------------------------------------

    def add_nodes(self, new: DataFrame) -> Graph:
        """The first of an id wins, what is there already before what is new."""
        both = schema.complete(self.nodes).withColumn("_new", F.lit(0)).unionByName(schema.complete(new).withColumn("_new", F.lit(1)))
        return Graph(firsts(both, "_new", "seq").drop("_new"), self.edges)

    def add_edges(self, new: DataFrame) -> Graph:
        """Both ends must exist and ids be new; otherwise ValueError."""
        known = self.nodes.select("id")
        loose = new.join(known.withColumnRenamed("id", "source"), "source", "left_anti").select("id")
        loose = loose.unionByName(new.join(known.withColumnRenamed("id", "target"), "target", "left_anti").select("id")).limit(1).collect()
        if loose:
            raise ValueError(f"edge {loose[0][0]} has an unknown end")
        twice = new.groupBy("id").count().filter("count > 1").select("id").unionByName(new.join(self.edges.select("id"), "id", "left_semi").select("id")).limit(1).collect()
        if twice:
            raise ValueError(f"edge {twice[0][0]} exists")
        return Graph(self.nodes, self.edges.unionByName(new))

    def remove_nodes(self, gone: DataFrame) -> Graph:
        """``gone``: ids; their edges go too."""
        gone = gone.select("id").distinct()
        ends = lambda c: gone.withColumnRenamed("id", c)
        return Graph(self.nodes.join(gone, "id", "left_anti"), self.edges.join(ends("source"), "source", "left_anti").join(ends("target"), "target", "left_anti").select(*self.edges.columns))

    def remove_edges(self, gone: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(gone.select("id").distinct(), "id", "left_anti"))

    def remove_file(self, path: str) -> Graph:
        return self.remove_nodes(self.nodes.filter(F.col("file") == path))

    def update_nodes(self, changes: DataFrame, now: int | None = None) -> Graph:
        """``changes``: id and any of the columns to overwrite, each beside a boolean ``set_<column>``; one row an id, or ValueError.
        Types and times of creation stay; ``updated_at`` becomes ``now`` (milliseconds)."""
        fixed = {"set_type", "set_created_at"} & set(changes.columns)
        if fixed:
            raise ValueError(f"can't be changed: {', '.join(sorted(fixed))}")
        twice = changes.groupBy("id").count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"two changes of {twice[0]['id']}")
        missing = changes.join(self.nodes.select("id"), "id", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"Node not found: {missing[0]['id']}")
        touched = [c for c in changes.columns if f"set_{c}" in changes.columns]
        new = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in touched], *[f"set_{c}" for c in touched])
        value = lambda c: F.when(F.coalesce(f"set_{c}", F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        time_ = F.lit(int(time.time() * 1000) if now is None else now)
        new = new.withColumns({"new_updated_at": time_, "set_updated_at": F.lit(True)})
        touched = [*touched, "updated_at"]
        out = schema.complete(self.nodes).join(new, "id", "left").select(*[value(c) if c in touched else F.col(c) for c in schema.NAMES])
        return Graph(out.withColumn("name_lc", F.lower("name")), self.edges)

    def clear(self) -> Graph:
        return Graph(self.nodes.limit(0), self.edges.limit(0))

    # --- names --------------------------------------------------------------------------------

    def resolve(self, refs: DataFrame) -> DataFrame:
        """``refs``: ref, and file (may be null). Adds ``id``: that of the node with this id, else of a node of this name
        (whatever its case), in ``file`` if it can be, the earliest otherwise; null if there is none."""
        asked = refs.select(F.col("ref").alias("r"), F.col("file").alias("f")).distinct()
        # the earliest node of each name, and of each name in each file, before any ref is met: a common name multiplies nothing
        by_id = self.nodes.select(F.col("id").alias("i"))
        by_name = self.nodes.groupBy(F.col("name_lc").alias("n1")).agg(F.min_by("id", "seq").alias("first"))
        by_file = self.nodes.filter("file is not null").groupBy(F.col("name_lc").alias("n2"), F.col("file").alias("f2")).agg(F.min_by("id", "seq").alias("near"))
        best = asked.join(by_id, F.col("r") == F.col("i"), "left").join(by_file, (F.lower("r") == F.col("n2")) & (F.col("f") == F.col("f2")), "left").join(by_name, F.lower("r") == F.col("n1"), "left")
        best = best.select("r", "f", F.coalesce("i", "near", "first").alias("id"))
        return refs.join(best, (F.col("ref") == F.col("r")) & F.col("file").eqNullSafe(F.col("f")), "left").drop("r", "f")


def of_types(types: list[str] | None) -> Column:
    return F.lit(True) if types is None else F.col("type").isin(types) if types else F.lit(False)


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], schema.NODES), spark.createDataFrame([], schema.EDGES))


def created_nodes(rows: DataFrame, now: int | None = None) -> DataFrame:
    """Nodes from rows that say only what differs from the defaults: a name, and maybe seq, type, qualified_name, id, ...

    A qualified name is the name unless it is given, and an id the qualified name; times are ``now`` (milliseconds).
    """
    time_ = F.lit(int(time.time() * 1000) if now is None else now)
    full = F.coalesce(*[F.col(c) for c in ("qualified_name", "name") if c in rows.columns])
    known = {"seq": F.monotonically_increasing_id(), "id": full, "type": F.lit("function"), "qualified_name": full, "content": F.lit(""), "signature": F.lit(""), "metadata": F.lit("{}"), "created_at": time_, "updated_at": time_}
    return schema.complete(rows, **known).withColumn("name_lc", F.lower("name"))


def from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> Graph:
    """Small graphs from plain rows, with the defaults of each column; the order of the lists is the insertion order."""
    rows, seen = [], set()
    for i, n in enumerate(nodes):
        id_ = n.get("id") or n.get("qualified_name") or n["name"]
        if id_ not in seen:
            seen.add(id_)
            name = n.get("name", id_)
            rest = [n.get(c) for c in schema.NAMES[schema.NAMES.index("embedding") :]]
            rows.append((i, id_, n.get("type", "function"), name, name.lower(), n.get("qualified_name") or name, n.get("content", ""), n.get("signature", ""), n.get("file"), n.get("start_line"), n.get("metadata", "{}"), *rest))
    links = [(i, e.get("id") or f"{e['source']}-{e.get('type', 'calls')}-{e['target']}-{i}", e["source"], e["target"], e.get("type", "calls"), float(e.get("weight", 1.0)), e.get("metadata", "{}")) for i, e in enumerate(edges)]
    return Graph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame(links, schema.EDGES))
