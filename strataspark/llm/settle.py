"""Columns that are computed once, whatever the optimizer does with what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, which later filters and lambdas only refer to.

    A projection may be merged into its consumer, and an array used inside a
    lambda is then computed again for every element.  Nothing is merged across a
    generator, so the columns are passed through one (the outer kind, for which
    no filter on its size is inferred).
    """
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")
    return df.select("*", made).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_settled.{n}").alias(n) for n in columns])
