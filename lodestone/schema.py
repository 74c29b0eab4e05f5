"""Vocabulary and schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The node and edge vocabularies.
NODE_TYPES = ["file", "module", "class", "function", "variable", "type", "export", "doc", "snippet"]
EDGE_TYPES = ["contains", "calls", "imports", "extends", "implements", "references", "exports", "depends_on", "documents", "tagged_with"]

NODES = (
    "seq long, id string, type string, name string, name_lc string, qualified_name string, content string, signature string, "
    "file string, start_line long, metadata string, embedding array<double>, "
    "end_line long, start_column long, end_column long, created_at long, updated_at long"
)
NAMES = [x.split()[0] for x in NODES.split(", ")]
EDGES = "seq long, id string, source string, target string, type string, weight double, metadata string"


def complete(rows: DataFrame, **defaults: Column) -> DataFrame:
    """Rows with all columns of nodes, in order; a missing one has its default, or is null. Lines count from 1, columns from 0, times are milliseconds."""
    kinds = [x.split() for x in NODES.split(", ")]
    return rows.select(*[(F.coalesce(c, defaults[c]) if c in rows.columns and c in defaults else F.col(c) if c in rows.columns else defaults.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in kinds])
