"""Text summaries by aggregation: a header, then a piece of text for each file, in the order of its first row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.graph import Graph
from lodestone.operators.analysis import Review
from lodestone.scratch import known_of, numbered, saved


def by_file(rows: DataFrame, line: Column, *order: str) -> DataFrame:
    """``file``, ``first`` (the order of its first row), ``text`` of the rows of each file, lines in order."""
    rows = rows.select(F.coalesce("file", F.lit("(unknown)")).alias("file"), F.struct(*order).alias("k"), line.alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    return rows.groupBy("file").agg(F.min("k").alias("first"), F.concat_ws("\n", F.concat(F.lit("  "), F.col("file"), F.lit(":")), F.array_join(lines, "\n")).alias("text"))


def impact_summary(graph: Graph, source_id: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The header (one row), and the files' pieces, of an impact with paths."""
    source = graph.node(source_id).select(F.format_string("Impact analysis for: %s (%s)", "name", "type").alias("a"))
    named = found.join(graph.nodes.select("id", "name", "type", "file"), "id")
    stats = named.agg(F.format_string("Total impacted: %d nodes across %d files", F.count(F.lit(1)), F.count_distinct("file")).alias("b"))
    head = source.crossJoin(stats).select(F.concat_ws("\n", "a", "b").alias("text"))  # one row each
    line = F.format_string("    %s (%s) - distance: %d, via: %s", F.col("name"), F.col("type"), F.col("distance"), F.array_join("edge_path", " → "))
    return head, by_file(named, line, "distance", "ord", "id")


def unused_summary(found: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The header, and the files' pieces, of unused symbols: sure ones first, then by file and insertion."""
    n = F.count(F.lit(1))
    head = found.agg(F.when(n == 0, "No unused symbols found.").otherwise(F.format_string("Found %d potentially unused symbol%s:", n, F.when(n == 1, "").otherwise("s"))).alias("text"))
    rows = found.join(nodes.select("id", "start_line"), "id")
    line = F.concat(
        F.format_string("    %s [%s] :%s — %s", F.col("name"), F.col("type"), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.col("reason")),
        F.when(F.col("confidence") == "high", "").otherwise(" (low confidence)"),
    )
    return head, by_file(rows, line, "unsure", "file", "seq")


def context_text(graph: Graph, chosen: DataFrame, signatures: bool = True) -> DataFrame:
    """``ord`` and ``text``: a piece for each file of what was chosen (id, place, role), in the order of its first row, then one for all
    that has no file. Targets are marked and whole; others too, unless ``signatures`` says that a signature stands for them.
    Pieces in order, a line break between them, are the text for a reader."""
    rows = chosen.select("id", "place", (F.col("role") == "target").alias("target")).join(known_of(graph.nodes.select("id", "type", "name", "content", "signature", "file", "start_line"), chosen), "id")
    head = F.concat(F.when(F.col("target"), "[TARGET] ").otherwise(""), "type", F.lit(" "), "name", F.when(F.col("file").isNotNull(), F.concat(F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("0")))).otherwise(""))
    signed = F.when(F.col("signature") != "", F.concat(F.lit("  signature: "), "signature"))
    body = F.when((F.col("target") | F.lit(not signatures)) & (F.col("content") != ""), F.col("content"))
    apart = F.concat_ws("\n", F.concat("type", F.lit(": "), "name"), "content", F.lit(""))
    rows = rows.select("file", F.struct("place", F.when(F.col("file").isNull(), apart).otherwise(F.concat_ws("\n", head, signed, body, F.lit(""))).alias("t")).alias("x"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n")
    title = F.when(F.col("file").isNull(), "--- Related Documentation ---").otherwise(F.format_string("--- %s ---", "file"))
    pieces = rows.groupBy("file").agg(F.min("x.place").alias("first"), text.alias("text")).withColumn("text", F.concat_ws("\n", title, "text"))
    return numbered(pieces.withColumn("apart", F.col("file").isNull()), "ord", "apart", "first").select("ord", "file", "text")


def review_text(result: Review, max_tokens: int = 8000, most: int = 50) -> DataFrame:
    """``part``, ``ord`` and ``text``: a review for a reader, in pieces: changes, impact, and the code around the changes."""
    changed, head, hit = review_summary(result, most)
    chosen = result.context(max_tokens)
    line = lambda part, ord_, text: result.graph.spark.createDataFrame([(part, ord_, text)], "part int, ord long, text string")
    tokens = chosen.agg(F.format_string("(~%d tokens)\n", F.coalesce(F.sum("tokens"), F.lit(0))).alias("text"))
    pieces = [line(0, 0, "## Changes"), numbered(changed, "n", "first").select(F.lit(0).alias("part"), F.col("n").alias("ord"), F.concat(F.lit("\n"), "text").alias("text"))]
    pieces += [line(1, 0, "\n## Impact"), head.select(F.lit(1), F.lit(1).cast("long"), F.when(F.col("text").startswith("No "), F.col("text")).otherwise(F.concat("text", F.lit("\n")))), numbered(hit, "n", "first").select(F.lit(1), F.col("n") + 1, "text")]
    pieces += [line(2, 0, "\n## Code Context"), tokens.select(F.lit(2), F.lit(1).cast("long"), "text"), context_text(result.graph, chosen).select(F.lit(2), F.col("ord") + 1, "text")]
    out = pieces[0]
    for x in pieces[1:]:
        out = out.union(x)
    return out


def review_summary(result: Review, most: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces of the changed files, the impact's header, and pieces of the impacted files, of a review."""
    nodes = result.graph.nodes.select("id", "signature", "start_line")
    at = F.when(F.coalesce("start_line", F.lit(0)) != 0, F.concat(F.lit(":"), "start_line")).otherwise("")
    sign = F.when(F.col("signature") != "", F.concat(F.lit(" — "), "signature")).otherwise("")
    changed = by_file(result.changed.join(known_of(nodes, result.changed), "id"), F.concat(F.lit("  "), "type", F.lit(" "), "name", at, sign), "change_ord")
    changed = changed.withColumn("text", F.regexp_replace("text", r"^  ([^\n]*):\n", "### $1\n"))
    text = F.format_string("%d symbols affected across %d files (max depth: %d)", "total", "files", "max_depth")
    head = result.totals().select(F.when(F.col("total") > 0, text).otherwise("No downstream impact detected.").alias("text"))
    names = result.graph.nodes.select("id", "name", "type", "file")
    top = saved(result.top(most), "top")
    by = top.select(F.col("via").alias("id"))
    via = known_of(names, by).select(F.col("id").alias("via"), F.col("name").alias("via_name"))
    rows = top.join(known_of(names, top), "id").join(via, "via")
    return changed, head, by_file(rows, F.format_string("    %s [%s] — distance: %d, via: %s", "name", "type", "distance", "via_name"), "rank")
