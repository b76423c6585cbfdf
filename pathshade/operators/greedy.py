"""Greedy selection and baselines. A round is one distributed aggregation and one
collected row. Ties go to the earlier candidate, so gains are compared rounded, but a
gain stops the search only if it is none: LEAST is what sums of doubles leave of one."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathshade.functions.psi import Psi
from pathshade.functions.uniforms import uniform
from pathshade.operators.objectives import Linear

DIGITS, LEAST = 6, 1e-12


def greedy(objective, k: int, times: list[float] | None = None) -> list[tuple[int, float]]:
    """At most k (candidate, gain); stops when nothing gains."""
    picked: list[tuple[int, float]] = []
    for _ in range(k):
        began = time.perf_counter()
        taken = [u for u, _ in picked]
        rows = objective.gains(taken).where(~F.col("u").isin(taken) if taken else F.lit(True)).where(F.col("gain") > LEAST)
        near = F.round("gain", DIGITS)
        best = rows.agg(F.max(F.struct(F.when(near > 0, near).otherwise(F.col("gain")).alias("gain"), (-F.col("cpos")).alias("first"), "u")).alias("b")).first().b
        if times is not None:
            times.append(time.perf_counter() - began)
        if best is None:
            break
        picked.append((best.u, best.gain))
    return picked


def lazy_greedy(objective, k: int, batch: int = 8) -> list[tuple[int, float]]:
    """Greedy over stale gains kept by the driver (a row per candidate): the best
    ``batch`` are evaluated again until the best is fresh. Exact for submodular objectives; a
    heuristic for the original one. Stops at gains below LEAST."""
    stale = {r.u: (r.gain, r.cpos) for r in objective.gains([]).collect()}
    picked: list[tuple[int, float]] = []
    while len(picked) < k and stale:
        taken = [u for u, _ in picked]
        fresh: set[int] = set()
        while True:
            order = sorted(stale, key=lambda u: (-round(stale[u][0], DIGITS), stale[u][1]))
            if order[0] in fresh or not picked:
                break
            top = [u for u in order if u not in fresh][:batch]
            seen = {r.u: r.gain for r in objective.gains(taken).where(F.col("u").isin(top)).collect()}
            stale |= {u: (seen.get(u, 0.0), stale[u][1]) for u in top}
            fresh |= set(top)
        best = order[0]
        if stale[best][0] < LEAST:
            break
        picked.append((best, round(stale.pop(best)[0], DIGITS)))
    return picked


def picks(spark: SparkSession, chosen: list[tuple[int, float]]) -> DataFrame:
    """(round, u, gain), rounds from 1."""
    return spark.createDataFrame([(i + 1, int(u), float(g)) for i, (u, g) in enumerate(chosen)], "round long, u long, gain double")


def coverage(weights: DataFrame, demand: DataFrame | None, psi: Psi) -> Linear:
    """Static coverage: demand(v, c), negative demand is none; without it every node counts 1."""
    if demand is None:
        coef = weights.select("v").distinct().withColumn("c", F.lit(1.0))
    else:
        coef = demand.select("v", F.greatest("c", F.lit(0.0)).alias("c"))
    return Linear(weights, coef, psi)


def random_k(candidates: DataFrame, k: int, seed: int) -> DataFrame:
    return candidates.orderBy(uniform(seed, F.col("u")), "cpos").limit(k)


def regular_spacing(nodes: DataFrame, rows: int, cols: int, k: int, blocked: DataFrame | None = None) -> DataFrame:
    """Picks (v, rank) at every step-th row and column from step / 2 on, step =
    round(sqrt(n / k)); then row-major until there are k."""
    step = max(1, math.floor(math.sqrt(rows * cols / max(1, k)) + 0.5))
    half = step // 2
    free = nodes if blocked is None else nodes.join(blocked, "v", "left_anti")
    r, c = F.floor(F.col("v") / cols), F.col("v") % cols
    on = (r >= half) & (c >= half) & (F.pmod(r - half, F.lit(step)) == 0) & (F.pmod(c - half, F.lit(step)) == 0)
    return free.select("v", (~on).cast("int").alias("fill")).orderBy("fill", "v").limit(k)


def brute_force(weights: DataFrame, candidates: DataFrame, coef: DataFrame, psi: Psi, k: int, guard: int | None = None) -> DataFrame:
    """(members, value) of every k-subset of the candidates in lexicographic
    order of positions: k - 1 increasing self-joins, then one aggregation. The
    number of subsets is checked against ``guard`` first."""
    n = candidates.count()
    if guard is not None and math.comb(n, k) > guard:
        raise ValueError(f"{math.comb(n, k)} subsets exceed the guard of {guard}")
    sets = candidates.select(F.array("cpos").alias("members"), F.col("cpos").alias("last"))
    for _ in range(k - 1):
        nxt = candidates.select(F.col("cpos").alias("next"))
        sets = sets.join(nxt, F.col("next") > F.col("last")).select(F.concat("members", F.array("next")).alias("members"), F.col("next").alias("last"))
    each = sets.select("members", F.explode("members").alias("cpos"))
    m = each.join(weights.select("cpos", "v", "w"), "cpos").groupBy("members", "v").agg(F.sum("w").alias("m"))
    got = m.join(coef, "v").groupBy("members").agg(F.sum(F.col("c") * psi(F.col("m"))).alias("value"))
    return sets.select("members").join(got, "members", "left").select("members", F.coalesce("value", F.lit(0.0)).alias("value"))
