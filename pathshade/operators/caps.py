"""Per-agent caps of the capped upper bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from pathshade.functions.psi import Psi
from pathshade.operators import dense
from pathshade.session import written


def resolve(mode: str, psi: Psi, topk: int, budget: int) -> tuple[str, int]:
    """auto: by path length if psi is bounded, else the k largest weights; an
    unbounded psi has no cap by path length. k is the budget unless given."""
    if mode == "auto":
        mode = "pathlen" if psi.bounded else "topk"
    if mode == "pathlen" and not psi.bounded:
        mode = "topk"
    if mode not in ("pathlen", "topk", "global"):
        raise ValueError(f"unknown cap: {mode}")
    return mode, topk or budget


def node_topk(weights: DataFrame, k: int) -> DataFrame:
    """(v, m): sum of the k largest weights that reach v."""
    rank = F.row_number().over(W.partitionBy("v").orderBy(F.desc("w"), "u"))
    return weights.select("v", "w", rank.alias("r")).where(F.col("r") <= k).groupBy("v").agg(F.sum("w").alias("m"))


def node_global(weights: DataFrame) -> DataFrame:
    return weights.groupBy("v").agg(F.sum("w").alias("m"))


#: Node sums by application and key, as written tables.
_node_sums: dict[tuple[str, str], DataFrame] = {}


def node_sums(mode: str, weights: DataFrame, k: int, key: str | None = None) -> DataFrame:
    """(v, m) of the k largest or of all weights. With a key, which must say all that
    they depend on, they are computed once for an application."""
    make = lambda: node_topk(weights, k) if mode == "topk" else node_global(weights)
    if key is None:
        return make()
    at = (weights.sparkSession.sparkContext.applicationId, key)
    if at not in _node_sums:
        _node_sums[at] = written(make(), "node-sums")
    return _node_sums[at]


def forget_node_sums() -> None:
    """To be called where scratch tables are deleted."""
    _node_sums.clear()


def caps(mode: str, paths: DataFrame, path_nodes: DataFrame, weights: DataFrame, psi: Psi, k: int, key: str | None = None) -> DataFrame:
    """caps(agent, cap): psi(k) (longest + 1), or the best path's sum of psi of
    the largest reachable weights."""
    if mode == "pathlen":
        return paths.groupBy("agent").agg((F.lit(psi.value(float(k))) * (F.max("len") + 1)).alias("cap"))
    sums = path_nodes.join(node_sums(mode, weights, k, key), "v").groupBy("agent", "path").agg(F.sum(psi(F.col("m"))).alias("x"))
    return paths.join(sums, ["agent", "path"], "left").groupBy("agent").agg(F.max(F.coalesce("x", F.lit(0.0))).alias("cap"))


def packed_caps(mode: str, agents: DataFrame, weights: DataFrame, psi: Psi, k: int, key: str | None = None) -> DataFrame:
    """``caps`` of agents' rows of ``dense``, of weights that fit it."""
    if mode == "pathlen":
        return dense.paths(agents).select("agent", (F.lit(psi.value(float(k))) * (F.col("lmax") + 1)).alias("cap"))
    sums = node_sums(mode, weights, k, key).select("v", psi(F.col("m")).alias("y"))
    return dense.best(agents, sums).withColumnRenamed("value", "cap")


def total(caps_: DataFrame) -> DataFrame:
    return caps_.agg(F.coalesce(F.sum("cap"), F.lit(0.0)).alias("total_cap"))


def cap_summary(caps_: DataFrame) -> DataFrame:
    return caps_.agg(F.min("cap").alias("cap_min"), F.median("cap").alias("cap_median"), F.max("cap").alias("cap_max"))
