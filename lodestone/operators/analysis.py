"""Impact, dead symbols, change review, project status, and the queries behind a file-level view."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.graph import Graph, of_types
from lodestone.operators.context import build_context
from lodestone.operators.traverse import bfs, reach
from lodestone.scratch import dealt, known_of, numbered, saved_counted

#: Ids (some 10 MB of them) that a task counts before they move.
COUNTED = 1 << 19
# Edge types that carry an impact, edges that count as use, and kinds of symbols.
IMPACT_EDGES = ["calls", "imports", "depends_on", "references", "extends", "implements"]
USES = ["calls", "imports", "references"]
SYMBOLS = ["function", "variable", "type", "class"]
# Entry files, whose symbols are never reported as unused.
ENTRY_FILES = [
    "index.ts",
    "index.tsx",
    "index.js",
    "index.jsx",
    "main.ts",
    "main.js",
    "cli.ts",
    "cli.js",
    "server.ts",
    "server.js",
    "app.ts",
    "app.js",
    "setup.ts",
    "setup.js",
]


def impact(graph: Graph, ids: list[str] | DataFrame, max_depth: int = 10, edge_types: list[str] | None = None, direction: str = "dependents", paths: bool = True, ordered: bool = False) -> DataFrame:
    """Who depends on the seeds (or, ``dependencies``, on whom they depend): ``seed_ord``, ``id``, ``distance``, ``ord``, and paths from the seed. Depth 1 is always looked at."""
    found = bfs(graph, ids, max(1, max_depth), "inbound" if direction == "dependents" else "outbound", IMPACT_EDGES if edge_types is None else edge_types, ordered, paths)
    return found.filter("depth > 0").withColumnRenamed("depth", "distance")


def impact_of(graph: Graph, id_: str, **options) -> DataFrame:
    if not graph.has_node(id_):
        raise ValueError(f"Node not found: {id_}")
    return impact(graph, [id_], **options)


def impact_stats(graph: Graph, found: DataFrame) -> DataFrame:
    """One row: total, files, max_depth."""
    found, n = saved_counted(found.select("id", "distance"), "impact")
    rows = found.join(known_of(graph.nodes.select("id", "file"), found, n), "id")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("file").alias("files"), F.coalesce(F.max("distance"), F.lit(0)).alias("max_depth"))


def unused(graph: Graph, types: list[str] | None = None, path_prefix: str | None = None, entry_files: list[str] | None = None) -> DataFrame:
    """Symbols that nothing calls, imports or references: ``id``, ``reason``, ``confidence``, and the sort key ``unsure``."""
    entries = ENTRY_FILES if entry_files is None else entry_files
    rows = graph.nodes.filter(F.col("type").isin(SYMBOLS) & (F.col("name") != "constructor"))
    is_entry = F.lit(False)
    for e in entries:
        is_entry = is_entry | (F.col("file") == e) | F.col("file").endswith("/" + e)
    rows = rows.filter(~F.coalesce(is_entry, F.lit(False)))
    if types is not None:
        rows = rows.filter(of_types(types))
    if path_prefix is not None:  # nodes without a file pass
        rows = rows.filter(F.col("file").isNull() | F.col("file").startswith(path_prefix))
    ends = lambda kinds: graph.edges.filter(F.col("type").isin(kinds)).select(F.col("target").alias("id"))
    rows = rows.join(ends(USES), "id", "left_anti")
    rows = rows.join(ends(["exports"]).distinct().withColumn("exported", F.lit(True)), "id", "left")
    exported = F.coalesce("exported", F.lit(False))
    reason = F.when(exported, "no-importers").when(F.col("type") == "function", "no-callers").otherwise("no-references")
    return rows.select("id", "type", "name", "file", "seq", reason.alias("reason"), F.when(exported, "medium").otherwise("high").alias("confidence"), exported.alias("unsure"))


@dataclass(frozen=True)
class Review:
    """A review of changed files: ``changed`` symbols (id, name, type, file, change_ord), and all that these ``reach``
    within three steps (id, distance, via, first), each by its nearest and then earliest change."""

    graph: Graph
    changed: DataFrame
    reached: DataFrame

    def top(self, most: int = 50) -> DataFrame:
        """The nearest of what is reached, with ``rank``: a report of ``most`` rows."""
        rows = self.reached.orderBy("distance", "first", "id").limit(most)
        return numbered(rows, "rank", "distance", "first", "id").select("id", "distance", "via", F.col("rank").cast("int").alias("rank"))

    def totals(self) -> DataFrame:
        """One row over all that is reached: total, files, max_depth."""
        return impact_stats(self.graph, self.reached)

    def context(self, max_tokens: int = 8000, seeds: int = 20) -> DataFrame:
        """What to read, around the first ``seeds`` changed symbols."""
        first = [r.id for r in self.changed.orderBy("change_ord").select("id").limit(seeds).collect()]
        return build_context(self.graph, first, max_tokens, depth=2)


def review(graph: Graph, files: list[str]) -> Review:
    order = graph.spark.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(files))], "file string, file_ord int")
    changed = graph.nodes.filter("type <> 'file'").join(F.broadcast(order), "file").select("id", "name", "type", "file", "file_ord", "seq")
    changed = numbered(changed, "place", "file_ord", "seq").withColumn("change_ord", F.col("place") - 1).drop("place", "file_ord", "seq")
    # two labels a node: one may be the node's own, as a change does not reach itself
    found = reach(graph, changed.select(F.col("change_ord").alias("seed_ord"), "id"), 3, "inbound", IMPACT_EDGES, best=2).filter("depth > 0").withColumnRenamed("depth", "distance")
    near = found.groupBy("id").agg(F.min(F.struct("distance", "seed_ord")).alias("best"), F.min("seed_ord").alias("first"))
    near = near.select("id", F.col("best.distance").alias("distance"), F.col("best.seed_ord").alias("change_ord"), "first")
    via = changed.select("change_ord", F.col("id").alias("via"))
    return Review(graph, changed, near.join(via, "change_ord").select("id", "distance", "via", "first"))


def degrees(graph: Graph) -> DataFrame:
    """``id``, ``degree``: edges at each node that is not a file; a self-loop counts twice."""
    most = COUNTED

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often an id occurs in each run of ``most`` rows. A task keeps one run, however many rows it reads."""
        held, n = [], 0
        for b in itertools.chain(batches, [None]):
            if held and (b is None or n + b.num_rows > most):
                found = pa.Table.from_batches(held).group_by("id").aggregate([([], "count_all")])
                yield from pa.table({"id": found["id"], "n": found["count_all"]}).to_batches()
                held, n = [], 0
            if b is not None:
                held.append(b)
                n += b.num_rows

    ends = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).mapInArrow(counted, "id string, n long")
    ends = dealt(ends, graph.nodes.count(), "id").groupBy("id").agg(F.sum("n").alias("degree"))
    return graph.nodes.filter("type <> 'file'").select("id", "seq").join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def status(graph: Graph) -> DataFrame:
    """One row: nodes, edges, files, isolated, average edges a node (2 digits)."""
    isolated = degrees(graph).agg(F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("isolated"))
    one = graph.counts().crossJoin(isolated)  # one row each
    return one.withColumn("edges_per_node", F.when(F.col("nodes") > 0, F.round(F.col("edges") / F.col("nodes"), 2)).otherwise(0.0))


def parents(graph: Graph) -> DataFrame:
    """``id``, ``parent``: the last ``contains`` edge decides."""
    return graph.edges.filter("type = 'contains'").groupBy(F.col("target").alias("id")).agg(F.max_by("source", "seq").alias("parent"))


def file_graph(graph: Graph) -> Graph:
    """Files and documents, and the edges among them that are not containment."""
    nodes = graph.nodes.filter("type in ('file', 'doc')")
    ids = nodes.select("id")
    edges = graph.edges.filter("type <> 'contains'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(nodes, edges.select(*graph.edges.columns))


def file_children(graph: Graph, file_id: str) -> Graph:
    """Nodes whose parent is the file, contents over 500 characters cut and marked, and all edges that touch one."""
    held = graph.edges.filter("type = 'contains'")
    near = held.filter(F.col("source") == file_id).select("target").distinct()  # only these can have it as a parent
    own = parents(Graph(graph.nodes, held.join(near, "target", "left_semi"))).filter((F.col("parent") == file_id) & (F.col("id") != file_id)).select("id")
    cut = F.when(F.length("content") > 500, F.concat(F.substring("content", 1, 500), F.lit("..."))).otherwise(F.col("content"))
    nodes = graph.nodes.join(own, "id").withColumn("content", cut).select(*graph.nodes.columns)
    at = lambda end: graph.edges.join(own.withColumnRenamed("id", end), end, "left_semi").select(*graph.edges.columns)
    return Graph(nodes, at("source").unionByName(at("target").join(own.withColumnRenamed("id", "source"), "source", "left_anti").select(*graph.edges.columns)))


def child_counts(graph: Graph) -> DataFrame:
    # dealt out before they are sorted for their last rows: a table of edges may hold very many in a file
    held = graph.edges.filter("type = 'contains'").select("type", "seq", "source", "target")
    held = dealt(held, graph.nodes.count(), "target")
    rows = graph.nodes.select("id").join(parents(Graph(graph.nodes, held)), "id", "left")
    return rows.groupBy(F.coalesce("parent", "id").alias("id")).agg(F.count(F.lit(1)).alias("children"))


def file_diff(known: DataFrame, found: DataFrame) -> DataFrame:
    """``path``, ``state`` (new, changed, deleted, fresh) from manifests (path, mtime)."""
    both = known.select("path", F.col("mtime").alias("old")).join(found.select("path", F.col("mtime").alias("now")), "path", "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("old") != F.col("now"), "changed").otherwise("fresh")
    return both.select("path", state.alias("state"))
