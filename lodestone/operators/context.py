"""Vectors, relevance, and packing of context into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.graph import Graph
from lodestone.operators.traverse import bfs
from lodestone.scratch import known_of, numbered, saved, saved_counted

# How much each edge type counts, and the weights of proximity, edge and meaning.
PRIORITY = {
    "contains": 1.0,
    "calls": 0.9,
    "imports": 0.8,
    "extends": 0.85,
    "implements": 0.85,
    "references": 0.7,
    "exports": 0.6,
    "depends_on": 0.75,
    "documents": 0.5,
    "tagged_with": 0.3,
}
WEIGHTS = (0.4, 0.3, 0.3)
#: Most neighbours that the packing of context reads at a time.
BLOCK = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is next to nothing; vectors of different lengths are an error; null if one is null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length")).isNull()
    return F.when(a.isNotNull() & b.isNotNull() & ok, F.when(norm < 1e-10, 0.0).otherwise(dot(a, b) / norm))


def find_similar(graph: Graph, query: list[float], k: int, threshold: float = 0.0) -> DataFrame:
    """The ``k`` nodes of the largest cosine, from ``threshold`` on; the earlier node first among equals."""
    if k <= 0:
        raise ValueError("k must be positive")
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = graph.nodes.filter("embedding is not null").withColumn("score", cosine(F.col("embedding"), q)).filter(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), "seq").limit(k)


def set_embeddings(graph: Graph, vectors: DataFrame) -> Graph:
    """``vectors``: ref, file (may be null), embedding, and maybe ord; refs that resolve to nothing are left out.

    Of several vectors of a node the last one stays, by ord, or else in the order of the rows."""
    at = F.col("ord") if "ord" in vectors.columns else F.monotonically_increasing_id()
    asked = saved(vectors.select("ref", "file", "embedding", at.alias("ord")), "vectors")
    found = graph.resolve(asked).filter("id is not null").groupBy("id").agg(F.max_by("embedding", "ord").alias("embedding"))
    return graph.update_nodes(found.withColumn("set_embedding", F.lit(True)))


def relevance(distance: Column, edge_type: Column, similarity: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Proximity, edge and meaning, each in [0, 1]; unknown edges and meanings count half."""
    priority = F.coalesce(*[F.when(edge_type == k, v) for k, v in PRIORITY.items()], F.lit(0.5))
    near = F.when(similarity.isNull(), 0.5).otherwise(F.greatest(similarity, F.lit(0.0)))
    return weights[0] / (1 + distance) + weights[1] * priority + weights[2] * near


def rank_by_relevance(graph: Graph, ids: list[str], max_depth: int = 3, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """``id``, ``score``, ``rank`` of what is around the seeds, without them; each node counts by its best seed."""
    found = bfs(graph, ids, max(1, max_depth), "both", ordered=True)
    n = graph.nodes
    first = found.filter("depth = 0")
    seeds = first.join(known_of(n.select("id", F.col("embedding").alias("seed_vector")), first), "id").select("seed_ord", "seed_vector")
    near = found.filter("depth > 0")
    rows = near.join(F.broadcast(seeds), "seed_ord").join(known_of(n.select("id", "embedding"), near), "id")
    rows = rows.withColumn("s", relevance(F.col("depth"), F.col("edge_type"), cosine(F.col("embedding"), F.col("seed_vector")), weights))
    best = rows.groupBy("id").agg(F.max("s").alias("score"), F.min(F.struct("seed_ord", "depth", "ord")).alias("first"))
    best = best.filter(~F.col("id").isin(ids))
    return numbered(best.withColumn("far", -F.col("score")), "rank", "far", "first").select("id", "score", F.col("rank").cast("int").alias("rank"))


def units(c: Column) -> Column:
    """Length in UTF-16 units; null counts 0."""
    return (F.octet_length(F.encode(F.coalesce(c, F.lit("")), "UTF-16BE")) / 2).cast("long")


def full_tokens() -> Column:
    return F.greatest(F.lit(1).cast("long"), F.shiftright(units(F.col("content")), 2) + F.shiftright(units(F.col("signature")), 2))


def short_tokens() -> Column:
    return F.greatest(F.lit(1).cast("long"), F.shiftright(units(F.col("signature")), 2) + F.shiftright(units(F.col("name")), 2))


def build_context(graph: Graph, ids: list[str], max_tokens: int = 4000, signatures: bool = True, docs: bool = True, depth: int = 3) -> DataFrame:
    """``id``, ``place``, ``tokens``, ``role`` (target or context) of what fits: seeds in order up to the first that does
    not fit (the first always does), then neighbours by relevance, where one too large is passed over for smaller ones.

    A symbol costs a token at least, so what is chosen has ``max_tokens`` rows at most. The ranked neighbours stay in a
    written table; of those that could still fit the driver reads ``BLOCK`` rows at most at a time, next ranks first.
    """
    n = graph.nodes.withColumn("full", full_tokens()).withColumn("short", short_tokens())
    seeds = graph.spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "ord long, id string")
    got, used = [], 0
    for r in n.join(F.broadcast(seeds), "id").select("id", "full", "ord").orderBy("ord").collect():
        if got and used + r.full > max_tokens:
            break
        got.append((r.id, len(got), r.full, "target"))
        used += r.full
    cost = F.when((F.col("signature") != "") & F.lit(signatures), F.col("short")).otherwise(F.col("full"))
    later = n.select("id", "type", cost.alias("cost")).filter(F.col("cost") <= max_tokens - used)
    if not docs:
        later = later.filter("type <> 'doc'")
    ranked, n_ranked = saved_counted(rank_by_relevance(graph, ids, depth).select("id", "rank"), "ranked")
    later = saved(ranked.join(known_of(later, ranked, n_ranked), "id").select("id", "rank", "cost"), "context")
    after = -1
    while used < max_tokens:
        most = min(max_tokens - used, BLOCK)
        block = later.filter((F.col("rank") > after) & (F.col("cost") <= max_tokens - used)).orderBy("rank").limit(most).collect()
        for r in block:
            if used + r.cost <= max_tokens:
                got.append((r.id, len(got), r.cost, "context"))
                used += r.cost
        if len(block) < most:
            break
        after = block[-1]["rank"]
    return graph.spark.createDataFrame(got, "id string, place int, tokens long, role string")


def context_for(graph: Graph, symbol: str | None = None, file: str | None = None, max_tokens: int = 4000) -> DataFrame | None:
    """Context of a symbol (narrowed by ``file``), or of a file: its node, else its first three. None if nothing is found."""
    if symbol:
        asked = graph.spark.createDataFrame([(symbol, file)], "ref string, file string")
        found = graph.resolve(asked).first()["id"]
        return build_context(graph, [found], max_tokens) if found else None
    rows = graph.nodes.filter(F.col("file") == file)
    own = [r.id for r in rows.orderBy(F.col("type") != "file", "seq").select("id", "type").limit(3).collect()]
    if not own:
        return None
    is_file = not rows.filter("type = 'file'").isEmpty()
    return build_context(graph, own[:1] if is_file else own, max_tokens)
