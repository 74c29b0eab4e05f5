"""Chainable node filters, the combined finder, and ranked text search."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.graph import Graph, of_types


def pattern(text: str, ignore_case: bool = False) -> str:
    return f"(?i){text}" if ignore_case else text


class Query:
    """Filters are and-ed; each call gives a new query. Regular expressions are Java's, found anywhere in the value."""

    def __init__(self, graph: Graph, rows: DataFrame | None = None):
        self.graph, self.rows = graph, graph.nodes if rows is None else rows

    def _with(self, condition: Column | str) -> Query:
        return Query(self.graph, self.rows.filter(condition))

    def of_type(self, *types: str) -> Query:
        return self._with(of_types(list(types)))

    def in_file(self, path: str | None = None, regex: str | None = None, ignore_case: bool = False) -> Query:
        return self._with(F.col("file") == path if regex is None else F.col("file").rlike(pattern(regex, ignore_case)))

    def with_name(self, name: str | None = None, regex: str | None = None, ignore_case: bool = False) -> Query:
        """A plain name is compared without regard to case."""
        return self._with(F.col("name_lc") == name.lower() if regex is None else F.col("name").rlike(pattern(regex, ignore_case)))

    def with_content(self, regex: str, ignore_case: bool = False) -> Query:
        return self._with(F.col("content").rlike(pattern(regex, ignore_case)))

    def with_embedding(self) -> Query:
        return self._with("embedding is not null")

    def with_metadata(self, key: str, *value: str | float | bool | None) -> Query:
        """Nodes that have the key, whatever its value; or those whose value is the given one, of the same type (None: null)."""
        quote = '"' if "'" in key else "'"
        if quote in key:
            raise ValueError(f"both kinds of quotes in a key: {key}")
        got = F.try_variant_get(F.try_parse_json("metadata"), f"$[{quote}{key}{quote}]", "variant")
        held = self._with(got.isNotNull())
        if not value:
            return held
        (want,) = value
        kind = F.schema_of_variant(got)
        if want is None:
            return held._with(F.is_variant_null(got))
        if isinstance(want, bool):
            return held._with((kind == "BOOLEAN") & (F.try_variant_get(got, "$", "boolean") == want))
        if isinstance(want, str):
            return held._with((kind == "STRING") & (F.try_variant_get(got, "$", "string") == want))
        return held._with(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (F.try_variant_get(got, "$", "double") == float(want)))

    def with_out_edge(self, *types: str) -> Query:
        return self._joined("source", types)

    def with_in_edge(self, *types: str) -> Query:
        return self._joined("target", types)

    def _joined(self, end: str, types: tuple[str, ...]) -> Query:
        ends = self.graph.edges.filter(of_types(list(types))).select(F.col(end).alias("id"))
        return Query(self.graph, self.rows.join(ends, "id", "left_semi"))

    def where(self, condition: Column | str | Callable[[pd.DataFrame], pd.Series], columns: list[str] | None = None) -> Query:
        """A column, SQL, or a function of the ``columns`` (all) in batches, for what neither can say: only these go to Python."""
        if not callable(condition) or isinstance(condition, Column):
            return self._with(condition)
        used = columns or self.rows.columns

        @F.pandas_udf("boolean")
        def holds(batch: pd.DataFrame) -> pd.Series:
            return condition(batch).astype(bool)

        return self._with(holds(F.struct(*used)))

    def results(self) -> DataFrame:
        return self.rows

    def count(self) -> int:
        return self.rows.count()

    def first(self) -> DataFrame:
        return self.rows.orderBy("seq").limit(1)


def find_nodes(graph: Graph, types: list[str] | None = None, name: str | None = None, name_regex: str | None = None, file: str | None = None, file_regex: str | None = None, has_embedding: bool | None = None) -> DataFrame:
    """Empty values mean no filter."""
    rows = graph.nodes
    if types:
        rows = rows.filter(of_types(types))
    if name:
        rows = rows.filter(F.col("name_lc") == name.lower())
    if name_regex:
        rows = rows.filter(F.col("name").rlike(name_regex))
    if file:
        rows = rows.filter(F.col("file") == file)
    if file_regex:
        rows = rows.filter(F.col("file").rlike(file_regex))
    if has_embedding is not None:
        rows = rows.filter(F.col("embedding").isNotNull() == has_embedding)
    return rows


# What a node's type adds to its search score.
TYPE_SCORE = {"class": 10, "function": 9, "type": 8, "export": 7, "variable": 5, "file": 3, "doc": 2}


def search(graph: Graph, term: str, types: list[str] | None = None, file: str | None = None, file_regex: str | None = None) -> DataFrame:
    """Nodes whose name, qualified name or file holds ``term``, with ``score``; no rank, so that nothing is sorted in one task."""
    t = term.lower()
    holds = lambda c: F.contains(F.lower(c), F.lit(t))
    rows = find_nodes(graph, types=types, file=file, file_regex=file_regex)
    rows = rows.filter(holds("name") | holds("qualified_name") | F.coalesce(holds("file"), F.lit(False)))
    by_name = 30 + F.when(F.col("name_lc") == t, 20).when(F.col("name_lc").startswith(t), 10).otherwise(0)
    text = F.when(holds("name"), by_name).when(holds("qualified_name"), 15).otherwise(5)
    kind = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in TYPE_SCORE.items()], F.lit(1))
    exported = graph.edges.filter("type = 'exports'").select(F.col("target").alias("id")).distinct().withColumn("exported", F.lit(5))
    return rows.join(exported, "id", "left").withColumn("score", (text + kind + F.coalesce("exported", F.lit(0))).cast("int")).drop("exported")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of a search with ``rank``; earlier nodes first among equals."""
    top = found.orderBy(F.desc("score"), "seq").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "seq")))  # of k rows
