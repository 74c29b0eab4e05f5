"""Traversal: level-by-level breadth-first search for many seeds at once, and what is built on it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import scratch
from lodestone.graph import Graph, of_types
from lodestone.scratch import dealt, known_of, marked, numbered, saved, saved_counted, sized, within
from lodestone.sources.adjacency import Adjacency, walked

UNBOUNDED = 1_000_000
#: Most rows of a frontier whose ids prune the edges that are read, and most tables of visited nodes.
FEW, MERGED = 64, 8
#: Rows of a range in which depth-first search orders the edges of its core.
AT_ONCE = 1 << 18


def steps(graph: Graph, direction: str = "outbound", edge_types: list[str] | None = None) -> list[DataFrame]:
    """``a``, ``b``, ``side``, ``edge_seq``, ``edge_type``: each edge in the direction in which it is walked, a table a direction."""
    known = graph.adjacency or Adjacency(*walked(graph.edges), stored=False)
    kept = F.lit(True) if edge_types is None else F.col("edge_type").isin(edge_types) if edge_types else F.lit(False)
    return [x.filter(kept) for x in known.steps(direction)]


def level(graph: Graph, moves: list[DataFrame], now: DataFrame, size: int, width: int = 1) -> DataFrame:
    """The steps (``pruned`` ones) that leave the frontier ``now`` (``a`` and what goes along), whose ``size`` in rows is known. It is the frontier
    that moves: broadcast if it is small (a row counts ``width`` times), else dealt out to the buckets of the edges."""
    return leaving(graph, moves, now, size, width)[0]


def indexed(graph: Graph) -> bool:
    """Whether steps are stored in buckets."""
    return graph.adjacency is not None and graph.adjacency.stored


def leaving(graph: Graph, moves: list[DataFrame], now: DataFrame, size: int, width: int = 1) -> tuple[DataFrame, int | None]:
    """``level``, and its number of rows, which is known where edges are walked that are not in buckets: of these only the ones move that leave
    the frontier (or that a filter of it lets through), and nodes only if they are their ends."""
    side = sized(now, size * width)
    if indexed(graph):
        return union([x.join(side, "a") for x in moves]), None
    if size * width > scratch.BROADCAST_ROWS:
        ids = now.select(F.col("a").alias("id"))
        moves = [marked(x, "a", ids, size) for x in moves]
    out, n = saved_counted(union([x.join(side, "a") for x in moves]), "level")
    ends = graph.nodes.select(F.col("id").alias("b"))
    if n <= scratch.BROADCAST_ROWS:
        ends = F.broadcast(ends.join(F.broadcast(out.select("b").distinct()), "b", "left_semi"))
    return out.join(ends, "b", "left_semi"), n


def pruned(graph: Graph, moves: list[DataFrame], now: DataFrame, size: int) -> list[DataFrame]:
    """The steps, or, of stored ones, those alone that leave a very small frontier."""
    if not indexed(graph) or size > FEW:
        return moves
    ids = [r.a for r in now.select("a").distinct().collect()]
    return [x.filter(F.col("a").isin(ids)) for x in moves]


def seeds_of(graph: Graph, ids: list[str] | DataFrame) -> DataFrame:
    """``seed_ord``, ``id`` of the seeds that exist, in the order given."""
    if isinstance(ids, list):
        ids = graph.spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "seed_ord long, id string")
    ids, n = saved_counted(ids.select("seed_ord", "id"), "seeds")
    return ids.join(sized(known_of(graph.nodes.select("id"), ids, n).distinct(), n), "id", "left_semi").select("seed_ord", "id")


def bfs(graph: Graph, ids: list[str] | DataFrame, max_depth: int = UNBOUNDED, direction: str = "outbound", edge_types: list[str] | None = None, ordered: bool = False, paths: bool = False) -> DataFrame:
    """``seed_ord``, ``id``, ``depth``, ``ord``, ``parent_id``, ``edge_type``, and, if asked, ``path`` and ``edge_path``.

    With ``ordered``, ``ord`` is the place in the level in first-in-first-out order, with edges in insertion order and
    outbound ones before inbound ones; levels are numbered by ranges. Without, it is 0, and parents are chosen by edge order alone.
    A level is one join of the edges with the frontier, written once; its rows are counted from the files' footers.
    """
    moves = steps(graph, direction, edge_types)
    start = seeds_of(graph, ids).select("seed_ord", "id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("edge_type"))
    if paths:
        start = start.withColumn("path", F.array("id")).withColumn("edge_path", F.array().cast("array<string>"))
    frontier, size = saved_counted(start, "bfs")
    levels, visited, n_visited = [frontier], [frontier.select("seed_ord", "id")], [size]
    depth = 0
    while depth < max_depth and size:
        now = frontier.withColumnRenamed("id", "a").withColumnRenamed("ord", "from_ord").drop("edge_type", "parent_id", "depth")
        moves_now = pruned(graph, moves, now, size)
        reached, n = leaving(graph, moves_now, now, size, 1 + depth if paths else 1)
        # a node of many edges has them in one bucket, and they meet all its seeds there: rows are dealt out before they are sorted
        if n is None:
            ends = sized(now.select("a"), size)
            n = union([x.select("a").join(ends, "a") for x in moves_now]).count()
        reached = dealt(reached.withColumnRenamed("b", "id"), n, "seed_ord", "id")
        k = F.struct(*(["seed_ord", "from_ord"] if ordered else []), "side", "edge_seq", F.col("a").alias("via"))
        carry = F.struct("a", "edge_type", *(["path", "edge_path"] if paths else []))
        new = reached.groupBy("seed_ord", "id").agg(F.min_by(carry, k).alias("c"), F.min(k).alias("k"))
        new = new.join(sized(union(visited), sum(n_visited)), ["seed_ord", "id"], "left_anti")
        new = numbered(new, "place", "k") if ordered else new.withColumn("place", F.lit(0))
        cols = ["seed_ord", "id", F.lit(depth + 1).alias("depth"), F.col("place").cast("long").alias("ord"), F.col("c.a").alias("parent_id"), F.col("c.edge_type").alias("edge_type")]
        if paths:
            cols += [F.concat("c.path", F.array("id")).alias("path"), F.concat("c.edge_path", F.array("c.edge_type")).alias("edge_path")]
        frontier, size = saved_counted(new.select(*cols), "bfs")
        levels.append(frontier)
        visited.append(frontier.select("seed_ord", "id"))
        n_visited.append(size)
        if direction == "both":  # steps go both ways, so nothing older than the last level can be met
            visited, n_visited = visited[-2:], n_visited[-2:]
        elif len(visited) > MERGED:
            visited, n_visited = [saved(union(visited), "visited")], [sum(n_visited)]
        depth += 1
    return union(levels)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def reach(graph: Graph, ids: list[str] | DataFrame, max_depth: int, direction: str = "outbound", edge_types: list[str] | None = None, best: int = 1) -> DataFrame:
    """``id``, ``depth``, ``seed_ord``: which seeds get to a node, as far as no ``best`` earlier seeds get there in as few steps.

    So a node has at most ``best`` rows a level, however many seeds reach it: its earliest seed, with its distance, is among them, and so
    is its nearest one (the earliest of these); with ``best`` of 2 also the earliest and the nearest of the seeds other than the node itself.
    """
    moves = steps(graph, direction, edge_types)
    frontier, size = saved_counted(seeds_of(graph, ids).groupBy("id", "seed_ord").agg(F.lit(0).alias("depth")), "reach")
    if best < 2:
        frontier, size = saved_counted(frontier.groupBy("id").agg(F.min("seed_ord").alias("seed_ord"), F.lit(0).alias("depth")), "reach")
    levels = [frontier]
    for depth in range(1, max_depth + 1):
        if not size:
            break
        now = frontier.select(F.col("id").alias("a"), "seed_ord")
        reached = level(graph, pruned(graph, moves, now, size), now, size).select(F.col("b").alias("id"), "seed_ord")
        if best == 1:
            new = reached.groupBy("id").agg(F.min("seed_ord").alias("seed_ord"))
        else:
            new = reached.distinct()
            new = new.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("seed_ord"))).filter(F.col("n") <= best).drop("n")
        # a seed is left out where it has been, or where enough earlier ones are as near
        old = union(levels).select("id", F.col("seed_ord").alias("there"))
        fewer = new.join(old, "id", "left").groupBy("id", "seed_ord").agg(F.coalesce(F.bool_or(F.col("there") == F.col("seed_ord")), F.lit(False)).alias("same"), F.count_distinct(F.when(F.col("there") < F.col("seed_ord"), F.col("there"))).alias("less"))
        new = fewer.filter((F.col("less") < best) & ~F.col("same")).select("id", "seed_ord", "less")
        new = new.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("seed_ord")) + F.col("less")).filter(F.col("n") <= best)
        frontier, size = saved_counted(new.select("id", "seed_ord", F.lit(depth).alias("depth")), "reach")
        levels.append(frontier)
    return union(levels)


def dfs(graph: Graph, start: str, max_depth: int = UNBOUNDED, direction: str = "outbound", edge_types: list[str] | None = None, most: int = 1_000_000) -> DataFrame:
    """``ord``, ``id``, ``depth``, ``parent_id`` in depth-first order, nodes marked when they are taken off the stack.

    Depth-first order is sequential by nature, but only where a node decides on others. A node that leads nowhere decides on none, so
    of a ball of more than ``most`` edges such nodes are set aside by joins, again and again, until the core is no larger; the core is
    walked in one group, and the others take their places in its order by joins, last ones first. Only a core that has more than
    ``most`` edges and no such nodes left is an error rather than a silent overload.

    A place is an array of numbers, and arrays in their order are the walk: of a core node its number; of another one the number of core nodes
    before it, its core parent's depth (deeper ones are done with earlier), and the edges from there.
    """
    ball = bfs(graph, [start], max_depth, direction, edge_types, ordered=False).select("id")
    moves = union(steps(graph, direction, edge_types)).join(ball.withColumnRenamed("id", "a"), "a", "left_semi").join(ball.withColumnRenamed("id", "b"), "b", "left_semi")
    # of edges from a node to the same other one the first decides
    first = moves.filter("a <> b").groupBy("a", "b").agg(F.min(F.struct("side", "edge_seq")).alias("k")).select("a", "b", "k.side", "k.edge_seq")
    core, size = saved_counted(first, "dfs")
    aside: list[DataFrame] = []  # edges into the nodes that each round sets aside
    while size > most:
        inner = core.select("a").distinct()
        out, n_out = saved_counted(core.join(inner.withColumnRenamed("a", "b"), "b", "left_anti").filter(F.col("b") != start).select(*core.columns), "dfs-aside")
        if not n_out:
            raise ValueError(f"more than {most} edges around {start} lead on")
        core, size = saved_counted(core.join(inner.withColumnRenamed("a", "b"), "b", "left_semi").select(*core.columns), "dfs") if n_out < size else (core.limit(0), 0)
        aside.append(out)
    rows = core.withColumn("group", F.lit(1)).unionByName(seeds_of(graph, [start]).select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).alias("side"), F.lit(-1).cast("long").alias("edge_seq"), F.lit(1).alias("group")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[tuple[str, int, int]]] = {}
        for r in pdf[pdf.b.notna()].sort_values(["side", "edge_seq"]).itertuples():
            after.setdefault(r.a, []).append((r.b, r.side, r.edge_seq))
        place: dict[str, int] = {}
        out = []
        stack = [(start, 0, None, 0, 0)]
        while stack:
            node, depth, parent, side, edge = stack.pop()
            if node in place:
                continue
            place[node] = len(out)
            out.append((len(out), node, depth, parent, side, edge))
            if depth < max_depth:
                stack += [(x, depth + 1, node, s, e) for x, s, e in reversed(after.get(node, [])) if x not in place]
        found = pd.DataFrame(out, columns=["ord", "id", "depth", "parent_id", "side", "edge"])
        end = [x[0] + 1 for x in out]  # the number after a node's last descendant
        for n, _, _, parent, _, _ in reversed(out):
            if parent is not None:
                end[place[parent]] = max(end[place[parent]], end[n])
        found["end"] = end
        return found

    found = rows.groupBy("group").applyInPandas(walk, "ord long, id string, depth int, parent_id string, side int, edge long, end long")
    if not aside:
        return found.select("ord", "id", "depth", "parent_id")
    found = saved(found, "dfs-core")
    long_ = lambda *c: F.array(*[F.col(x).cast("long") if isinstance(x, str) else x.cast("long") for x in c])
    walked_ = found.select("id", "depth", "parent_id", long_("ord", F.lit(1)).alias("place"))
    # an edge of a core node that is taken after those of some core children: the last of these children ends where it begins
    hung = union(aside).join(found.filter(F.col("depth") < max_depth).select(F.col("id").alias("a"), "depth", "ord"), "a")
    hung = hung.select("a", "b", "depth", (F.col("ord") + 1).alias("at"), F.struct(F.col("side"), F.col("edge_seq").alias("edge"), F.lit(1).alias("late")).alias("k"))
    ends = found.filter("parent_id is not null").select(F.col("parent_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("int").alias("depth"), F.col("end").alias("at"), F.struct("side", "edge", F.lit(0).alias("late")).alias("k"))
    hung = _after_siblings(hung, ends)
    near = saved(hung.select("a", "b", F.col("depth") + 1, long_("at", -F.col("depth"), "k.side", "k.edge").alias("place")).toDF("parent_id", "id", "depth", "place"), "dfs-near")
    placed: list[DataFrame] = []
    for edges in reversed(aside):
        ids = edges.select(F.col("b").alias("id")).distinct()
        reached = near.join(ids, "id", "left_semi").select("id", "depth", "parent_id", "place")
        if placed:
            known = union(placed).filter(F.col("depth") < max_depth).select(F.col("id").alias("a"), "depth", F.col("place").alias("from"))
            reached = reached.unionByName(edges.join(known, "a").select(F.col("b").alias("id"), (F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_id"), F.concat("from", long_("side", "edge_seq")).alias("place")))
        best = reached.groupBy("id").agg(F.min(F.struct("place", "depth", "parent_id")).alias("x"))
        placed.append(saved(best.select("id", "x.depth", "x.parent_id", "x.place"), "dfs-placed"))
    return numbered(union([walked_, *placed]), "n", "place").select((F.col("n") - 1).alias("ord"), "id", "depth", "parent_id")


def _after_siblings(hung: DataFrame, ends: DataFrame) -> DataFrame:
    """``hung`` with ``at`` raised to the largest ``at`` of the rows of ``ends`` of the same ``a`` that come before it by ``k``. All rows are
    put in one order and meet in ranges, so that a node with many edges is no single task."""
    both = numbered(hung.unionByName(ends), "n", "a", "k").withColumn("range", F.floor(F.col("n") / AT_ONCE))
    before = Window.partitionBy("range").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = F.when(F.col("b").isNull(), F.struct("n", "a", "at"))
    both = saved(both.withColumn("last", F.max(last).over(before)), "dfs-ranges")
    tails = both.groupBy("range").agg(F.max("last").alias("tail"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    tails = tails.select("range", F.max("tail").over(earlier).alias("tail"))
    last = F.coalesce("last", "tail")
    at = F.when(last["a"] == F.col("a"), F.greatest("at", last["at"])).otherwise(F.col("at"))
    return both.filter("b is not null").join(tails, "range").select("a", "b", "depth", "k", at.alias("at"))


def k_hop(graph: Graph, ids: list[str] | DataFrame, k: int, edge_types: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """``id`` and ``first`` (seed_ord, depth, ord of the first time; ord is 0 unless ``ordered``) of nodes within k steps of any seed, either way."""
    if not ordered:
        found = reach(graph, ids, k, "both", edge_types).withColumn("ord", F.lit(0).cast("long"))
    else:
        found = bfs(graph, ids, k, "both", edge_types, ordered)
    return found.groupBy("id").agg(F.min(F.struct("seed_ord", "depth", "ord")).alias("first"))


def subgraph(graph: Graph, ids: list[str] | DataFrame, max_depth: int = 3, edge_types: list[str] | None = None, node_types: list[str] | None = None, direction: str = "both") -> Graph:
    """What is within ``max_depth`` of the seeds; node types filter the result, not the walk."""
    seeds = seeds_of(graph, ids).select(F.lit(0).cast("long").alias("seed_ord"), "id").distinct()  # one label for all
    inside = reach(graph, seeds, max_depth, direction, edge_types).select("id")
    nodes = known_of(graph.nodes, inside)
    if node_types:
        nodes = nodes.filter(of_types(node_types))
    kept = saved_counted(nodes.select("id"), "inside")
    return Graph(nodes, within(within(graph.edges.filter(of_types(edge_types)), "source", *kept), "target", *kept))


def file_structure(graph: Graph, file: str) -> DataFrame:
    """``id``, ``children`` (ids in insertion order) of the nodes of a file that have children or are files."""
    own = graph.nodes.filter(F.col("file") == file).select("id", "type")
    held = graph.edges.filter("type = 'contains'").groupBy(F.col("source").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "target"))), lambda x: x["target"]).alias("children"))
    out = own.join(held, "id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    return out.filter((F.size("children") > 0) | (F.col("type") == "file")).select("id", "children")


def as_iterator(rows: DataFrame) -> Iterator:
    """Rows one by one, a partition at a time on the driver."""
    return rows.toLocalIterator()
