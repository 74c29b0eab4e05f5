"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one stable id.

Two texts are equal when they are identical after lower-casing A-Z. Only
DataFrame functions are used.

Defined results
- A null text counts as the empty text; all empty texts are one group.
- Of a group the row with the largest id stays (null ids are the smallest; a
  group of null ids only keeps the rows with a null id).
- Rows that repeat both id and text cannot be told apart by ``report`` and are
  marked alike there; ``deduplicate`` returns one row of a group always.
- An empty table gives an empty result. Extra columns pass through
  ``deduplicate`` whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(norm))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: ``h``, ``sha``, ``keep_id``, ``group_size``.

    The text itself is a grouping key beside its hash, so rows are joined only
    when their bytes are equal. Copies collapse before the shuffle (partial
    aggregation), so a hot group costs one row per input partition.
    """
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), content_hash(norm).alias("h"))
    same = rows.groupBy("h", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return same.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows find their group by both digests; a join on a hot group is split by
    adaptive execution, as it moves digests only.
    """
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias(id_col), content_hash(norm).alias("h"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    return rows.join(groups(docs, id_col, text_col), ["h", "sha"]).select(
        id_col,
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one per distinct text, in one shuffle."""
    norm = ascii_lower(F.col(text_col))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(id_col))
    kept = (
        docs.select(content_hash(norm).alias("h"), norm.alias("norm"), row.alias("row"), order.alias("o"))
        .groupBy("h", "norm")
        .agg(F.max_by("row", "o").alias("row"))
    )
    return kept.select("row.*")
