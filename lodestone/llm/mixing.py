"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

With q the token shares of the sources, the weights are q^a / sum(q^a). The
exponent a in [0, 1] is found by bisection: it is the largest one whose weights
reach a target entropy (a share of the largest possible, ln k), raised where
needed until no source is repeated more than ``max_repeats`` times. The total
budget is ``budget`` tokens, or, when None, the least one that gives every
source one whole pass, so that no document is lost.

A source's documents are dealt into blocks by a hash: ``n_blocks``, or more
where a block would hold over ``block_rows`` rows. Each pass over a source is a
permutation of its blocks (by a hash of source, pass and block). A budget of t
tokens takes whole passes as long as they fit; the last pass takes blocks in its
order until the budget is reached, and inside the block that crosses it,
documents in hash order as long as they fit wholly; rows of the same id stand or
fall together there.

Scale: each text is counted once; the counts are written beside the rows. Sums
per source and per block are aggregated before they meet; a running sum goes
over the blocks of a source and over the ids (not the rows) of one boundary
block of it, never over a source. What it yields is a hash up to which the block
is taken, so no row moves. The bisection is a few aggregations over the table of
sources, which is never collected.

Defined results
- Tokens are runs of characters other than blank, tab, line feed and return. Null texts have none.
- A null source is a source of its own. Sources without tokens get weight 0 and one pass.
- Rows that repeat an id are dealt as separate rows. An empty table gives an empty result.
- Extra columns pass through ``mix`` whatever their names are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import saved

STEPS = 40
#: Rows of a block, about.
BLOCK_ROWS = 100_000
#: Largest table of blocks that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def token_count(text: Column) -> Column:
    for c in "\t\n\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.coalesce(F.size(F.array_remove(F.split(text, " "), "")), F.lit(0)).cast("long")


def hash_int(*parts: Column) -> Column:
    """60 bits of the md5 of the parts, which SQL engines agree on; null parts count as '~'."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def exponent(sources: DataFrame, target_entropy: float, max_repeats: float, budget: int | None = None) -> float:
    """Bisect the exponent over ``sources`` (``tokens`` > 0); rounded to 6 digits.

    One aggregation asks 255 exponents for each target, which makes eight binary steps.
    """
    stats = sources.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi")).first()
    if not stats["k"]:
        return 1.0
    share = F.col("tokens") / F.lit(float(stats["t"]))
    lo_share, hi_share = (stats[x] / float(stats["t"]) for x in ("lo", "hi"))
    goal = target_entropy * math.log(stats["k"]) - 1e-12

    def entropy_and_repeats(xs: list[float]) -> dict[float, tuple[float, float]]:
        asked = sources.select(share.alias("q"), F.explode(F.lit(xs)).alias("a"))
        z = F.pow("q", "a")
        out = {}
        for r in asked.groupBy("a").agg(F.sum(z).alias("z"), F.sum(z * F.log("q") * F.col("a")).alias("s")).collect():
            whole = budget if budget is not None else stats["hi"] / (hi_share ** r["a"] / r["z"])
            out[r["a"]] = (math.log(r["z"]) - r["s"] / r["z"], whole * lo_share ** r["a"] / r["z"] / stats["lo"])
        return out

    # Where in [0, 1] exponents stop to give entropy enough, and where they stop to repeat too much.
    low = [lambda h, _: h >= goal, lambda _, r: r > max_repeats + 1e-12]
    ends = [(0.0, 1.0), (0.0, 1.0)]
    for _ in range(STEPS // 8):
        grids = [[lo + (hi - lo) * i / 256 for i in range(257)] for lo, hi in ends]
        got = entropy_and_repeats(sorted({x for g in grids for x in g[1:-1]}))
        for i, g in enumerate(grids):
            n = sum(low[i](*got[x]) for x in g[1:-1])
            ends[i] = (g[n], g[n + 1])
    return round(max((lo + hi) / 2 for lo, hi in ends), 6)


def counted(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns to keep, or all), source, id, n_tokens of every document, written once."""
    return saved(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"), token_count(F.col(f"`{text_col}`").cast("string")).alias("n_tokens")),
        "mix-counted",
    )


def plan(docs: DataFrame, source_col: str = "source", text_col: str = "text", target_entropy: float = 0.99, max_repeats: float = 2.0, budget: int | None = None) -> DataFrame:
    """A row per source: source, tokens, n_rows, weight, exponent, budget (tokens to draw)."""
    rows = docs.select(F.col(f"`{source_col}`").alias("source"), token_count(F.col(f"`{text_col}`").cast("string")).alias("n_tokens"))
    return weights(rows, target_entropy, max_repeats, budget)


def weights(rows: DataFrame, target_entropy: float = 0.99, max_repeats: float = 2.0, budget: int | None = None) -> DataFrame:
    """The same from source and n_tokens of the documents."""
    per_source = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    per_source = saved(per_source, "mix-sources")
    some = per_source.filter("tokens > 0")
    a = exponent(some, target_entropy, max_repeats, budget)
    total = some.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("hi")).first()
    t = float(total["t"] or 1)
    z = some.agg(F.sum(F.pow(F.col("tokens") / t, F.lit(a)))).first()[0] or 1.0
    # one pass of the largest source: its share of the budget is its own size
    hi = float(total["hi"] or 1)
    whole = float(budget) if budget is not None else hi / ((hi / t) ** a / z)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / t, F.lit(a)) / z).otherwise(0.0)
    return per_source.select(
        "source",
        "tokens",
        "n_rows",
        F.round(weight, 9).alias("weight"),
        F.lit(a).alias("exponent"),
        F.when(F.col("tokens") > 0, F.greatest(F.round(weight * whole).cast("long"), F.lit(0) if budget is not None else F.col("tokens"))).otherwise(0).alias("budget"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", n_blocks: int = 256, block_rows: int = BLOCK_ROWS, keep: list[str] | None = None, **targets) -> DataFrame:
    """A row per draw: a struct ``row`` of all columns of the document (or of those to keep), and source, n_tokens, block, pass, weight."""
    rows = counted(docs, id_col, source_col, text_col, keep)
    sources = saved(
        weights(rows, **targets).select(
            F.col("source").alias("s"),
            "weight",
            F.greatest(F.lit(n_blocks), F.ceil(F.col("n_rows") / block_rows)).cast("long").alias("blocks"),
            F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int").alias("passes"),
            F.when(F.col("tokens") > 0, F.col("budget") - F.floor(F.col("budget") / F.col("tokens")) * F.col("tokens")).otherwise(0).alias("rest"),
        ),
        "mix-weights",
    )
    n_blocks_in_all = sources.agg(F.sum("blocks")).first()[0] or 0
    small = F.broadcast if n_blocks_in_all <= BROADCAST_ROWS else lambda df: df
    rows = rows.join(small(sources.select("s", "blocks")), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("block", (hash_int(F.lit("block"), F.col("source"), F.col("id")) % F.col("blocks")).cast("int")).drop("s", "blocks")
    blocks = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    blocks = blocks.join(small(sources), F.col("source").eqNullSafe(F.col("s")))
    order = Window.partitionBy("source").orderBy(hash_int(F.lit("order"), F.col("source"), F.col("passes"), F.col("block")), "block")
    blocks = blocks.withColumn("before", F.sum("block_tokens").over(order) - F.col("block_tokens"))
    # tokens of the block that the last, partial pass may take
    room = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("block_tokens"))
    blocks = saved(blocks.select(F.col("source").alias("bs"), F.col("block").alias("b"), "weight", "passes", room.alias("room"), "block_tokens"), "mix-blocks")
    same_block = F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("b"))
    # The blocks that cross a budget: ids in hash order, as long as they fit.
    edges = blocks.filter("room > 0 and room < block_tokens")
    place = F.struct(hash_int(F.lit("doc"), F.col("id"), F.col("passes")).alias("h"), F.col("id").cast("string").alias("i"))
    inside = rows.drop("row").join(small(edges), same_block).groupBy("bs", "b", "room", place.alias("place")).agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("bs", "b").orderBy("place"))
    last = inside.withColumn("upto", upto).filter("upto <= room").groupBy("bs", "b").agg(F.max("place").alias("last"))
    last = saved(last.select(F.col("bs").alias("ls"), F.col("b").alias("lb"), "last"), "mix-edges")
    blocks = blocks.join(small(last), F.col("bs").eqNullSafe(F.col("ls")) & (F.col("b") == F.col("lb")), "left").drop("ls", "lb")
    drawn = rows.join(small(blocks), same_block)
    # Whole passes, whole blocks of the last one, and the beginning of one block: nothing moves.
    more = ((F.col("room") >= F.col("block_tokens")) & (F.col("block_tokens") > 0)) | F.coalesce(place <= F.col("last"), F.lit(False))
    copies = F.col("passes") + F.when(more, 1).otherwise(0)
    return drawn.filter(copies > 0).select("row", "source", "n_tokens", "block", "weight", F.explode(F.sequence(F.lit(1), copies)).alias("pass"))
