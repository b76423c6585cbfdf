"""Aggregates of agents' paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def agent_nodes(path_nodes: DataFrame, corridors: DataFrame | None = None) -> DataFrame:
    """agent_nodes(agent, v): the union of an agent's paths, or its corridor."""
    return (path_nodes if corridors is None else corridors).select("agent", "v").distinct()


def agent_lengths(paths: DataFrame) -> DataFrame:
    return paths.groupBy("agent").agg(F.min("len").alias("lmin"), F.max("len").alias("lmax"), F.count(F.lit(1)).alias("npaths"))


def union_counts(nodes: DataFrame) -> DataFrame:
    """coef(v, c): agents whose union holds v."""
    return nodes.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("c"))


def average_agents(coef: DataFrame, n: int) -> DataFrame:
    """Agents whose union holds a node, on average over all n nodes."""
    return coef.agg((F.coalesce(F.sum("c"), F.lit(0.0)) / F.lit(float(max(1, n)))).alias("avg_agents_per_node"))


def corridor_stats(path_nodes: DataFrame, r: int) -> DataFrame:
    """(v, b_r, in_union, c_total): sum of min(r, visits) over agents, agents, visits
    of distinct paths. Two levels, both merged before the shuffle."""
    visits = path_nodes.select("agent", "path", "v").distinct().groupBy("agent", "v").agg(F.count(F.lit(1)).alias("n"))
    return visits.groupBy("v").agg(F.sum(F.least(F.col("n"), F.lit(r))).alias("b_r"), F.count(F.lit(1)).alias("in_union"), F.sum("n").alias("c_total"))


def corridor_scalars(paths: DataFrame, r: int) -> DataFrame:
    """lsum_r, lmin1, lsum_all: sums over agents of min(r, K) Lmin, Lmin and all lengths."""
    own = paths.groupBy("agent").agg(F.min("len").alias("lmin"), F.count(F.lit(1)).alias("k"), F.sum("len").alias("all"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return own.agg(zero(F.least(F.col("k"), F.lit(r)) * F.col("lmin")).alias("lsum_r"), zero(F.col("lmin")).alias("lmin1"), zero(F.col("all")).alias("lsum_all"))
