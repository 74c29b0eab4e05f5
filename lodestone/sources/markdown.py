"""Markdown to graph rows: sections under headings, and links from sections to the symbols they mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import schema
from lodestone.graph import Graph
from lodestone.scratch import numbered

HEADING = r"^(#{1,6})\s+(.+)$"
MENTION = r"`([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)`"


def sections(files: DataFrame) -> DataFrame:
    """``files``: path, text. ``path``, ``section`` (from 1), ``level``, ``title``, ``body``, ``start_line`` and ``end_line`` (from 1).

    Text before the first heading belongs to no section; sections without text are left out. Windows run over one file each.
    """
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.withColumn("mark", F.length(F.regexp_extract("line", HEADING, 1)))
    so_far = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum(F.when(F.col("mark") > 0, 1).otherwise(0)).over(so_far)).filter("section > 0")
    head = F.when(F.col("mark") > 0, F.struct("pos", F.col("mark").alias("level"), F.trim(F.regexp_extract("line", HEADING, 2)).alias("title")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("mark") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    got = lines.groupBy("path", "section").agg(F.max(head).alias("h"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"), (F.max("pos") + 1).alias("end_line"))
    out = got.select("path", F.col("section").cast("int").alias("section"), F.col("h.level").alias("level"), F.col("h.title").alias("title"), "body", (F.col("h.pos") + 1).alias("start_line"), "end_line")
    return out.filter("body <> ''")


def index(files: DataFrame) -> Graph:
    """Documents as graph rows: a node for each file and each section, ``contains`` edges between them.

    ``seq`` orders them by path and section; ids are the paths, and the paths with the number of the section.
    """
    found = sections(files)
    name = F.element_at(F.split("path", "/"), -1)
    whole = files.select("path", F.lit(0).alias("section"), F.lit(0).alias("level"), name.alias("name"), F.col("path").alias("qualified_name"), F.coalesce("text", F.lit("")).alias("content"), F.lit(1).alias("start_line"))
    part = found.select("path", "section", "level", F.col("title").alias("name"), F.concat("path", F.lit("#"), "title").alias("qualified_name"), F.col("body").alias("content"), "start_line")
    rows = numbered(whole.unionByName(part), "seq", "path", "section")
    id_ = F.when(F.col("section") == 0, F.col("path")).otherwise(F.concat("path", F.lit("#"), "section"))
    kind = F.when(F.col("section") == 0, F.to_json(F.create_map(F.lit("format"), F.lit("markdown")))).otherwise(F.to_json(F.struct("level")))
    nodes = rows.select(
        "seq", id_.alias("id"), F.lit("doc").alias("type"), "name", F.lower("name").alias("name_lc"), "qualified_name", "content", F.lit("").alias("signature"),
        F.col("path").alias("file"), F.col("start_line").cast("long").alias("start_line"), kind.alias("metadata"), F.lit(None).cast("array<double>").alias("embedding"),
    )
    edges = rows.filter("section > 0").select(
        "seq", F.concat(F.lit("contains-"), "path", F.lit("#"), "section").alias("id"), F.col("path").alias("source"), id_.alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"), F.lit("{}").alias("metadata"),
    )
    return Graph(schema.complete(nodes), edges)


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files``: path, text. The rows that an index keeps of markdown: nodes of files and sections, and references.

    ``place`` orders the rows of a file. A file refers to its sections (by id), a section to all symbols that it mentions (by name).
    """
    found = sections(files)
    name = F.element_at(F.split("path", "/"), -1)
    none = F.lit("").alias("signature"), F.lit(None).cast("array<double>").alias("embedding"), F.col("end_line").cast("long").alias("end_line")
    files = files.withColumn("end_line", F.size(F.split(F.coalesce("text", F.lit("")), "\n")))
    whole = files.select("path", F.lit(0).cast("long").alias("place"), F.col("path").alias("id"), F.lit("doc").alias("type"), name.alias("name"), F.col("path").alias("qualified_name"), F.coalesce("text", F.lit("")).alias("content"), F.lit(1).cast("long").alias("start_line"), F.to_json(F.create_map(F.lit("format"), F.lit("markdown"))).alias("metadata"), *none)
    id_ = F.concat("path", F.lit("#"), "section").alias("id")
    part = found.select("path", F.col("section").cast("long").alias("place"), id_, F.lit("doc").alias("type"), F.col("title").alias("name"), F.concat("path", F.lit("#"), "title").alias("qualified_name"), F.col("body").alias("content"), F.col("start_line").cast("long").alias("start_line"), F.to_json(F.struct("level")).alias("metadata"), *none)
    held = found.select("path", F.col("section").alias("s"), F.lit(-1).alias("p"), F.col("path").alias("source"), F.concat("path", F.lit("#"), "section").alias("ref"), F.lit("one").alias("scope"), F.lit("contains").alias("type"))
    said = found.select("path", "section", F.posexplode(F.array_distinct(F.regexp_extract_all("body", F.lit(MENTION), F.lit(1)))).alias("p", "name"))
    said = said.select("path", F.col("section").alias("s"), "p", id_.alias("source"), F.col("name").alias("ref"), F.lit("all").alias("scope"), F.lit("documents").alias("type"))
    place = (F.row_number().over(Window.partitionBy("path").orderBy("s", "p")) - 1).cast("long")  # within a file
    refs = held.unionByName(said).withColumn("place", place)
    return whole.unionByName(part), refs.select("path", "place", "source", "ref", F.lit(None).cast("string").alias("ref_file"), "scope", "type", F.lit(1.0).alias("weight"), F.lit("{}").alias("metadata"))


def documents_edges(docs: Graph, code: Graph) -> DataFrame:
    """``documents`` edges from sections to the symbols that they mention: source, target."""
    found = docs.nodes.filter("id <> file").select(F.col("file").alias("path"), F.col("id").alias("section"), F.col("content").alias("body"))
    return links(found, code).select(F.col("section").alias("source"), F.col("id").alias("target"))


def mentions(found: DataFrame) -> DataFrame:
    """``path``, ``section``, ``name``: identifiers in back-ticks, each once a section."""
    return found.select("path", "section", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(MENTION), F.lit(1)))).alias("name"))


def links(found: DataFrame, graph: Graph) -> DataFrame:
    """``path``, ``section``, ``id``: every node that is no document and has a mentioned name, whatever its case."""
    names = mentions(found).withColumn("name_lc", F.lower("name")).select("path", "section", "name_lc")
    return names.join(graph.nodes.filter("type <> 'doc'").select("id", "name_lc"), "name_lc").select("path", "section", "id").distinct()
