"""Set grouped rows against the totals they are part of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of ``totals`` to every row of ``df``.

    ``totals`` has one row per ``by``, or a single row, which is then read as one scalar subquery.
    """
    if by:
        return df.join(totals, list(by))
    one = totals.select(F.struct("*").alias("_totals")).scalar()
    return (
        df.withColumn("_totals", one)
        .select("*", *[F.col("_totals")[c].alias(c) for c in totals.columns])
        .drop("_totals")
    )
