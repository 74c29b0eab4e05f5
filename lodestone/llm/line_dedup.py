"""Line dedup: overlapping windows of three lines, hashed; later occurrences of a repeated window go.

Lines are what stands between line feeds, compared as they are. A window is
three consecutive lines of one document; its 128-bit hash is taken over the
lines joined by a line feed, which no line holds. The first occurrence in the
order of (id, text hash, line number) stays; every line that some later
occurrence covers is removed, so overlapping windows merge. Only DataFrame
functions are used.

Defined results
- Null and empty texts have one empty line and no window: nothing is removed.
- Documents of fewer than three lines have no window.
- Rows that repeat both id and text are one document for the choice of the
  first occurrence, and get the same result. Null ids sort first.
- An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """A row per window: ``key`` (id, text hash), ``pos`` (0-based first line), ``w`` (128-bit hash)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("t")).alias("key"), lines.alias("lines"))
    rows = rows.filter(F.size("lines") >= width)
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (width - 1)),
        lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, width), "\n"))),
    )
    return rows.select("key", F.posexplode(hashes).alias("pos", "w"))


def removed_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``key`` and ``starts``: first lines of the later occurrences of repeated windows."""
    all_windows = windows(docs, id_col, text_col, width)
    repeated = (
        all_windows.groupBy("w")
        .agg(F.min(F.struct("key", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("w", "first")
    )
    later = all_windows.join(repeated, "w").filter(~F.struct("key", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("key").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """A row per input row: id, n_lines, n_removed, kept_text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias(id_col), text.alias("text"), F.struct(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("t")).alias("key")
    )
    gone = removed_positions(docs, id_col, text_col, width)
    joined = rows.join(gone.withColumnRenamed("key", "k2"), F.col("key").eqNullSafe(F.col("k2")), "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (width - 1)))))
    joined = joined.select(id_col, F.split("text", "\n").alias("lines"), F.coalesce(covered, F.array().cast("array<int>")).alias("covered"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    return joined.select(
        id_col,
        F.size("lines").cast("long").alias("n_lines"),
        F.size("covered").cast("long").alias("n_removed"),
        F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n").alias("kept_text"),
    )
