"""Objectives of a set S of picked candidates, and their marginal gains.

S is a short list held by the driver. State is recomputed from it: m(v) sums the
weights of S at v, so no table grows from round to round, and a gains table needs
one join and one aggregation by candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from pathshade.functions.psi import Psi
from pathshade.operators import dense
from pathshade.session import written


def state(weights: DataFrame, picked: Sequence[int]) -> DataFrame:
    """state(v, m) of the nodes that S reaches."""
    return weights.where(F.col("u").isin([int(x) for x in picked])).groupBy("v").agg(F.sum("w").alias("m"))


def levels(weights: DataFrame, picked: Sequence[int], psi: Psi) -> DataFrame:
    """levels(v, y): what S gives at the nodes that it reaches."""
    return state(weights, picked).select("v", psi(F.col("m")).alias("y"))


def gain(psi: Psi) -> Column:
    m = F.coalesce("m", F.lit(0.0))
    return psi(m + F.col("w")) - psi(m)


def rises(weights: DataFrame, picked: Sequence[int], psi: Psi) -> DataFrame:
    """delta(u, cpos, v, g): what a candidate adds at a node, where that is something."""
    return weights.join(state(weights, picked), "v", "left").select("u", "cpos", "v", gain(psi).alias("g")).where("g > 0")


#: A table of fewer rows is broadcast: weights of 40 bytes, 80 MB at most.
BROADCAST_ROWS = 2_000_000


def beside(weights: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How a table of at most as many rows as ``weights`` is joined: by broadcast if
    they are few, else by shuffle."""
    return F.broadcast if weights.count() <= BROADCAST_ROWS else lambda df: df


@dataclass
class Linear:
    """sum of c psi(m) - lambda const: certified unions, proxies and lower bounds
    differ only in the table coef(v, c)."""

    weights: DataFrame
    coef: DataFrame
    psi: Psi
    lam: float = 0.0
    const: float = 0.0

    @cached_property
    def near(self) -> DataFrame:
        return written(self.weights.join(self.coef.where("c <> 0"), "v"), "near")

    def gains(self, picked: Sequence[int]) -> DataFrame:
        rows = self.near.join(state(self.weights, picked), "v", "left")
        return rows.groupBy("u", "cpos").agg(F.sum(F.col("c") * gain(self.psi)).alias("gain"))

    def value(self, picked: Sequence[int]) -> DataFrame:
        total = F.coalesce(F.sum(F.col("c") * self.psi(F.col("m"))), F.lit(0.0))
        return self.coef.join(state(self.weights, picked), "v").agg((total - self.lam * self.const).alias("value"))


@dataclass
class Capped:
    """sum over agents of min(cap, sum over its union of psi(m)) - lambda sum Lmin.

    Where candidates and nodes are few, rounds read the agents' rows of ``dense``. Else the
    agents' nodes are dealt out by agent once a round, state and rises beside them; what follows
    stays there until rows are summed by candidate."""

    weights: DataFrame
    nodes: DataFrame
    caps: DataFrame
    psi: Psi
    lam: float = 0.0
    const: float = 0.0
    packed: DataFrame | None = None  # the agents' paths, as ``dense.packed``

    @cached_property
    def beside(self) -> Callable[[DataFrame], DataFrame]:
        return beside(self.weights)

    def current(self, picked: Sequence[int]) -> DataFrame:
        if self.packed is not None and dense.fits(self.weights):
            return dense.union_sums(self.packed, levels(self.weights, picked, self.psi))
        reached = self.nodes.repartition("agent").join(self.beside(state(self.weights, picked)), "v")
        return reached.groupBy("agent").agg(F.sum(self.psi(F.col("m"))).alias("cur"))

    @cached_property
    def agents(self) -> DataFrame | None:
        if not dense.fits(self.weights):
            return None
        capped = self.nodes.repartition("agent").join(self.caps, "agent")
        return written(dense.packed(capped.select("agent", F.lit(0).alias("path"), "v", F.col("cap").alias("x"))), "agents")

    def gains(self, picked: Sequence[int]) -> DataFrame:
        delta = rises(self.weights, picked, self.psi)
        if self.agents is not None:
            rising = lambda rise, cur, _, first, cap: np.minimum(np.maximum(cap - cur, 0.0)[:, None], rise).sum(axis=0)
            return dense.gains(self.agents, delta, levels(self.weights, picked, self.psi), rising)
        own = self.nodes.repartition("agent").join(self.beside(delta), "v").groupBy("agent", "u", "cpos").agg(F.sum("g").alias("delta"))
        room = self.caps.join(self.current(picked), "agent", "left").select("agent", F.greatest(F.col("cap") - F.coalesce("cur", F.lit(0.0)), F.lit(0.0)).alias("room"))
        return own.join(room, "agent").groupBy("u", "cpos").agg(F.sum(F.least("room", "delta")).alias("gain"))

    def value(self, picked: Sequence[int]) -> DataFrame:
        own = self.caps.join(self.current(picked), "agent", "left").select(F.least(F.col("cap"), F.coalesce("cur", F.lit(0.0))).alias("x"))
        return own.agg((F.coalesce(F.sum("x"), F.lit(0.0)) - self.lam * self.const).alias("value"))


@dataclass
class Original:
    """sum over agents of the best path's score: sum of psi(m) - lambda len.

    Where candidates and nodes are few, rounds read the agents' rows of ``dense``. Else path
    nodes are dealt out by agent once a round; scores, rises and the agent's best are
    all found there, and only an agent's gain by candidate leaves its task, summed."""

    weights: DataFrame
    path_nodes: DataFrame
    paths: DataFrame
    psi: Psi
    lam: float = 0.0
    packed: DataFrame | None = None  # written, as ``dense.packed``

    @cached_property
    def beside(self) -> Callable[[DataFrame], DataFrame]:
        return beside(self.weights)

    @cached_property
    def agents(self) -> DataFrame | None:
        if not dense.fits(self.weights):
            return None
        return self.packed if self.packed is not None else written(dense.packed(self.path_nodes.select("agent", "path", "v", F.lit(0.0).alias("x"))), "agents")

    def scored(self, picked: Sequence[int]) -> DataFrame:
        """(agent, path, v, score): each path node with its path's score."""
        nodes = self.path_nodes.select("agent", "path", "v").repartition("agent").join(self.beside(state(self.weights, picked)), "v", "left")
        path = W.partitionBy("agent", "path")
        score = F.sum(F.coalesce(self.psi(F.col("m")), F.lit(0.0))).over(path) - self.lam * (F.count(F.lit(1)).over(path) - 1)
        return nodes.select("agent", "path", "v", score.alias("score"))

    def scores(self, picked: Sequence[int]) -> DataFrame:
        """(agent, path, score), from the nodes that are reached alone."""
        got = self.path_nodes.join(state(self.weights, picked), "v").groupBy("agent", "path").agg(F.sum(self.psi(F.col("m"))).alias("x"))
        return self.paths.join(got, ["agent", "path"], "left").select("agent", "path", (F.coalesce("x", F.lit(0.0)) - self.lam * F.col("len")).alias("score"))

    def agent_values(self, picked: Sequence[int]) -> DataFrame:
        if self.packed is not None and self.agents is not None:
            return dense.best(self.packed, levels(self.weights, picked, self.psi), self.lam)
        return self.scores(picked).groupBy("agent").agg(F.max("score").alias("value"))

    def value(self, picked: Sequence[int]) -> DataFrame:
        return self.agent_values(picked).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))

    def gains(self, picked: Sequence[int]) -> DataFrame:
        """An agent gains what its best touched path rises above its best path;
        untouched paths do not change, so they need no rows of their own."""
        delta = rises(self.weights, picked, self.psi)
        if self.agents is not None:
            lam = self.lam

            def rising(rise, score, lens, first, _):
                score = score - lam * (lens - 1)
                best = np.repeat(np.maximum.reduceat(score, first), np.diff(np.append(first, len(score))))
                return np.maximum(np.maximum.reduceat(rise + (score - best)[:, None], first, axis=0), 0.0).sum(axis=0)

            return dense.gains(self.agents, delta, levels(self.weights, picked, self.psi), rising)
        nodes = self.scored(picked).withColumn("best", F.max("score").over(W.partitionBy("agent")))
        rise = nodes.join(self.beside(delta), "v").groupBy("agent", "path", "u", "cpos").agg(F.sum("g").alias("delta"), F.max("score").alias("score"), F.max("best").alias("best"))
        above = rise.groupBy("agent", "u", "cpos").agg(F.max(F.col("score") + F.col("delta")).alias("top"), F.max("best").alias("best"))
        return above.groupBy("u", "cpos").agg(F.sum(F.greatest(F.col("top") - F.col("best"), F.lit(0.0))).alias("gain"))


def mixture(paths: DataFrame, kind: str = "uniform") -> DataFrame:
    """mix(agent, path, alpha): ``first`` path alone, or ``uniform`` over all."""
    if kind == "first":
        least = paths.groupBy("agent").agg(F.min("path").alias("path"))
        return least.withColumn("alpha", F.lit(1.0))
    counts = paths.groupBy("agent").agg((1.0 / F.count(F.lit(1))).alias("alpha"))
    return paths.join(counts, "agent").select("agent", "path", "alpha")


def softmax_mixture(scores: DataFrame, eta: float) -> DataFrame:
    """mix(agent, path, alpha) in proportion to exp(eta score), shifted by the
    agent's largest score."""
    best = scores.groupBy("agent").agg(F.max(eta * F.col("score")).alias("top"))
    z = scores.join(best, "agent").withColumn("e", F.exp(eta * F.col("score") - F.col("top")))
    total = z.groupBy("agent").agg(F.sum("e").alias("z"))
    return z.join(total, "agent").select("agent", "path", (F.col("e") / F.col("z")).alias("alpha"))


def mixture_coef(path_nodes: DataFrame, mix: DataFrame) -> DataFrame:
    """coef(v, c) of a lower bound; a path that visits a node twice counts twice."""
    return path_nodes.join(mix, ["agent", "path"]).groupBy("v").agg(F.sum("alpha").alias("c"))


def mixture_const(paths: DataFrame, mix: DataFrame) -> DataFrame:
    return paths.join(mix, ["agent", "path"]).agg(F.coalesce(F.sum(F.col("alpha") * F.col("len")), F.lit(0.0)).alias("const"))
