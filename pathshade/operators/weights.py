"""Neighbourhood weights: candidates and the nodes within reach of them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pathshade.operators.graph import hops


@dataclass(frozen=True)
class SoftDecay:
    alpha: float
    radius: int
    epsilon: float = 0.0


def parse_soft_decay(spec: str) -> SoftDecay:
    """``exp:alpha:R:eps``, or ``gauss:sigma`` for alpha = 1 / sigma**2, R =
    max(1, ceil(3 sigma)), eps = 1e-4; both decay exponentially with the hops."""
    kind, *args = spec.strip().lower().split(":")
    x = [float(a) for a in args]
    if kind == "exp" and len(x) == 3 and x[0] > 0 and x[1] > 0 and x[2] >= 0:
        return SoftDecay(x[0], int(x[1]), x[2])
    if kind == "gauss" and len(x) == 1 and x[0] > 0:
        return SoftDecay(1 / x[0] ** 2, max(1, math.ceil(3 * x[0])), 1e-4)
    raise ValueError(f"not a soft decay: {spec!r}")


def hard_weights(edges: DataFrame, candidates: DataFrame, radius: int) -> DataFrame:
    """weights(u, cpos, v, w): 1 within ``radius`` hops, the candidate included."""
    near = hops(edges, candidates, key="u", start="u", limit=radius)
    return near.join(candidates, "u").select("u", "cpos", "v", F.lit(1.0).alias("w"))


def soft_weights(edges: DataFrame, candidates: DataFrame, decay: SoftDecay, include_self: bool = True) -> DataFrame:
    """weights(u, cpos, v, w): exp(-alpha d) where that is epsilon or more."""
    near = hops(edges, candidates, key="u", start="u", limit=decay.radius).where(F.lit(include_self) | (F.col("d") > 0))
    out = near.join(candidates, "u").select("u", "cpos", "v", F.exp(-decay.alpha * F.col("d")).alias("w"))
    return out.where(F.col("w") >= decay.epsilon)
