"""Vectors of integers: what the clustering and the mining of hard negatives start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float, largest: int, keep: dict | None = None) -> DataFrame:
    """``id``, ``v`` (floor(scale * x), x as double, as longs) and the columns of ``keep`` (name: column).

    Vectors that are null, empty or hold null or non-finite components are left out, and so are null ids; a component
    of ``largest`` or more in size is an error.
    """
    x = F.transform(vec_col, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    large = F.exists(x, lambda v: F.abs(F.floor(v * scale)) >= F.lit(float(largest)))
    sure = F.assert_true(~F.coalesce(large & good, F.lit(False)), F.lit(f"a component goes beyond {largest}")).isNull()
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & good & sure)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"), *[c.alias(name) for name, c in (keep or {}).items()])
