"""Sample statistics with normal confidence limits."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F


def normal_quantile(p: float) -> float:
    if p <= 0:
        return float("-inf")
    if p >= 1:
        return float("inf")
    return NormalDist().inv_cdf(p)


def summary(samples: DataFrame, value: str | Column, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """mean, var (sample), se, ci_low, ci_high, m. One sample has no variance, no
    samples give zeros, an alpha outside (0, 1) is read as 0.05."""
    z = normal_quantile(1 - (alpha if 0 < alpha < 1 else 0.05) / 2)
    v = F.col(value) if isinstance(value, str) else value
    base = samples.groupBy(*(by or [])).agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var"), F.count(v).alias("m"))
    base = base.withColumn("se", F.when(F.col("m") > 0, F.sqrt(F.col("var") / F.greatest("m", F.lit(1)))).otherwise(0.0))
    return base.select(*(by or []), "mean", "var", "se", (F.col("mean") - z * F.col("se")).alias("ci_low"), (F.col("mean") + z * F.col("se")).alias("ci_high"), "m")
