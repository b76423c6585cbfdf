"""Positions and running sums over a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

#: Values of the ordering column that share a range, as a power of two.
BITS = 16


def running(df: DataFrame, order: str, out: str, amount: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: the sum of ``amount`` (a row counts 1 without one) over the rows that
    come before in order of the integer column ``order``. Sums run within ranges of 2**BITS
    values; only a row a range goes through one task."""
    amount = F.lit(1).cast("long") if amount is None else amount
    ranged = df.withColumns({"_range": F.shiftright(F.col(order), BITS), "_amount": amount})
    totals = ranged.groupBy("_range").agg(F.sum("_amount").alias("_total"))
    offsets = totals.select("_range", (F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_total")).alias("_before"))
    inside = W.partitionBy("_range").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)
    rows = ranged.join(offsets, "_range").withColumn(out, F.col("_before") + F.sum("_amount").over(inside) - F.col("_amount"))
    return rows.drop("_range", "_amount", "_before")
