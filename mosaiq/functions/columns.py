"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def lookup(column: str, table: Mapping, default=None) -> Column:
    """Value of a fixed table for ``column`` as one CASE expression."""
    expr = None
    for key, value in table.items():
        hit = F.col(column) == F.lit(key)
        expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def codes(*pairs: tuple[str | Column, Column]) -> Column:
    """Array of the codes whose condition holds, in the given order.

    A null condition counts as "not raised".
    """
    items = [F.when(cond, F.lit(code) if isinstance(code, str) else code) for code, cond in pairs]
    return F.array_compact(F.array(*items))


def finite(column: str) -> Column:
    """Measured and finite: neither null, NaN nor infinite."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))


def is_digest(column: str) -> Column:
    return F.coalesce(F.col(column).rlike("^[0-9a-f]{64}$"), F.lit(False))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column (reports and comparisons)."""
    return df.select(
        *[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where ``condition`` holds, tested on the finished columns.

    A plain filter would be pushed below the projections that build a deeply
    derived column and copy that whole expression; a generator stays in place.
    """
    return df.withColumn("_keep", F.explode(F.when(condition, F.array(F.lit(1))))).drop("_keep")
