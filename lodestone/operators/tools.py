"""Queries over several projects: the plan carries a ``project`` column, and the first project that answers wins where one must."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.graph import Graph
from lodestone.operators import analysis, context, query

Projects = dict[str, Graph]


def text_argument(args: dict, key: str, needed: bool = False) -> str | None:
    """A text of a request's arguments. One that is needed must be a text that is not empty; others are turned into text."""
    value = args.get(key)
    if needed and (not isinstance(value, str) or not value):
        raise ValueError(f'Invalid or missing parameter: "{key}" must be a non-empty string')
    return None if value is None else value if isinstance(value, str) else str(value)


def number_argument(args: dict, key: str, otherwise: float) -> float:
    """A number of a request's arguments; texts that are numbers count, what is none (or not finite) gives ``otherwise``."""
    value = args.get(key)
    try:
        number = otherwise if value is None else 0.0 if isinstance(value, str) and not value.strip() else float(value)
    except (TypeError, ValueError):
        return otherwise
    return number if math.isfinite(number) else otherwise


def chosen(projects: Projects, project: str | None) -> Projects:
    if project and project not in projects:
        raise ValueError(f"Project not found: {project}")
    return {project: projects[project]} if project else projects


def together(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of all projects with ``project`` and ``project_ord``."""
    out = None
    for i, (name, rows) in enumerate(parts.items()):
        rows = rows.withColumn("project", F.lit(name)).withColumn("project_ord", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def search(projects: Projects, text: str, type_: str | None = None, file: str | None = None, project: str | None = None) -> DataFrame:
    """Matches of all projects by score; ``*`` in ``file`` stands for anything. Order: score, project_ord, seq."""
    regex = file.replace("*", ".*") if file and "*" in file else None
    found = {name: query.search(g, text, [type_] if type_ else None, None if regex else file, regex) for name, g in chosen(projects, project).items()}
    return together(found).select("project", "project_ord", "id", "name", "type", "file", F.col("start_line").alias("line"), F.nullif("signature", F.lit("")).alias("signature"), "score", "seq")


def first_symbol(projects: Projects, symbol: str, file: str | None = None) -> tuple[str, str] | None:
    """The first project that knows a symbol, and the node's id there (as ``Graph.resolve`` finds it): one job, however many projects."""
    named = F.col("name_lc") == F.lower(F.lit(symbol))
    hits = {name: g.nodes.filter((F.col("id") == symbol) | named).select("id", "file", "seq") for name, g in projects.items()}
    near = F.when(F.col("id") == symbol, 0).when(F.coalesce(F.col("file") == F.lit(file), F.lit(False)), 1).otherwise(2)
    found = together(hits).orderBy("project_ord", near, "seq").limit(1).select("project", "id").collect() if hits else []
    return (found[0].project, found[0].id) if found else None


def first_of_files(projects: Projects, paths: list[str], types: str = "true") -> str | None:
    """The first project that has nodes (that meet ``types``) in one of the files: one job."""
    hits = {name: g.nodes.filter(F.col("file").isin(paths)).filter(types).select("seq") for name, g in projects.items()}
    found = together(hits).agg(F.min_by("project", "project_ord").alias("project")).collect() if hits else []
    return found[0].project if found else None


def similar(projects: Projects, symbol: str, file: str | None = None, k: int = 10, project: str | None = None) -> DataFrame:
    """Of the first project that knows the symbol: the nodes among its ``k`` nearest (itself among them, then left out), scores to 3 digits."""
    found = first_symbol(chosen(projects, project), symbol, file)
    if not found:
        raise ValueError(f"Symbol not found: {symbol}")
    name, own = found
    g = projects[name]
    vector = g.node(own).first()["embedding"]
    if vector is None:
        raise ValueError(f"No embedding available for: {symbol}")
    rows = context.find_similar(g, vector, k).filter(F.col("id") != own)
    return rows.select(F.lit(name).alias("project"), "id", "name", "type", "file", F.round("score", 3).alias("score"))


def structure(projects: Projects, path: str, project: str | None = None) -> DataFrame:
    """Of the first project that has symbols in the file: these, with their direct children (name, type, signature) in order."""
    name = first_of_files(chosen(projects, project), [path], "type <> 'file'")
    if not name:
        raise ValueError(f"No indexed file found: {path}")
    g = projects[name]
    own = g.nodes.filter((F.col("file") == path) & (F.col("type") != "file"))
    child = g.nodes.select(F.col("id").alias("target"), F.struct("name", "type", F.nullif("signature", F.lit("")).alias("signature")).alias("child"))
    held = g.edges.filter("type = 'contains'").select(F.col("source").alias("id"), "target", F.col("seq").alias("k")).join(own.select("id"), "id", "left_semi").join(child, "target")
    held = held.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "child"))), lambda x: x["child"]).alias("children"))
    return own.join(held, "id", "left").select(F.lit(name).alias("project"), "id", "name", "type", F.col("start_line").alias("line"), F.nullif("signature", F.lit("")).alias("signature"), "children", "seq")


def unused(projects: Projects, path: str | None = None, type_: str | None = None, project: str | None = None) -> DataFrame:
    """Unused symbols of all projects."""
    return together({name: analysis.unused(g, [type_] if type_ else None, path) for name, g in chosen(projects, project).items()})


def review(projects: Projects, files: list[str], project: str | None = None) -> tuple[str, analysis.Review]:
    """Of the first project that has one of the files."""
    name = first_of_files(chosen(projects, project), files)
    if not name:
        raise ValueError(f"No indexed files found matching: {', '.join(files)}")
    return name, analysis.review(projects[name], files)


def impact(projects: Projects, symbol: str, file: str | None = None, project: str | None = None, **options) -> tuple[str, DataFrame]:
    """Of the first project that knows the symbol."""
    found = first_symbol(chosen(projects, project), symbol, file)
    if not found:
        raise ValueError(f"Symbol not found: {symbol}")
    return found[0], analysis.impact(projects[found[0]], [found[1]], **options)


def context_for(projects: Projects, symbol: str | None = None, file: str | None = None, max_tokens: int = 4000, project: str | None = None) -> tuple[str, DataFrame]:
    """Of the first project that knows the symbol, or the file."""
    known = chosen(projects, project)
    if symbol:
        found = first_symbol(known, symbol, file)
        if not found:
            raise ValueError(f"Symbol not found: {symbol}")
        return found[0], context.build_context(known[found[0]], [found[1]], max_tokens)
    name = first_of_files(known, [file])
    if not name:
        raise ValueError(f"No indexed file found: {file}")
    return name, context.context_for(known[name], file=file, max_tokens=max_tokens)
