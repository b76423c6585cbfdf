"""Exact top-k inner-product search by columnar branch and bound.

Candidates lie in blocks of bounded size, each held dimension-major. A query
accumulates its partial inner product one block of dimensions at a time. After
each block the Cauchy-Schwarz bound on the remaining mass of both vectors gives
an interval for every candidate; those whose upper end lies below the k-th best
lower end are dropped and the survivors are compacted.

Query blocks meet candidate blocks in a grid, so no task holds more than one
block of each, whatever the size of the table. A first pass over one candidate block
gives each query a floor, its k-th best score there; the other blocks return nothing
below it. Blocks are chosen by a hash of the row, so a task that runs again finds the
same rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from pathshade.session import written

EXACT = float(2**53)


def usable(vector: str) -> F.Column:
    """True for vectors that are not null and hold finite components only."""
    bad = F.exists(F.col(vector), lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.coalesce(~bad, F.lit(False))


def quantised(vector: str, scale: float = 256.0) -> F.Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(scale)))


def search_block(q_ids, q, c_ids, c, k: int, floors=None, step: int = 8):
    """Top k of one query block in one candidate block, of those at ``floors`` or
    above; the vectors are integer matrices. Yields (query number, candidate numbers, scores)."""
    exact = float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(c).max(initial=0)) < EXACT
    if not exact:  # arbitrary precision; the bound is not worth it here
        q, c = q.astype(object), c.astype(object)
        for i in range(len(q)):
            s = c.dot(q[i])
            keep = np.array([x != q_ids[i] for x in c_ids], dtype=bool)
            yield i, np.flatnonzero(keep), s[keep]
        return
    q, c = q.astype(np.float64), c.astype(np.float64)
    order = np.argsort(-(c * c).sum(0) * (q * q).sum(0), kind="stable")
    columns = np.ascontiguousarray(c[:, order].T)  # vertical layout
    q = q[:, order]
    cuts = list(range(0, len(order), step)) or [0]
    mass = [np.sqrt((columns[cut + step :] ** 2).sum(0)) for cut in cuts]
    rest = [np.sqrt((q[:, cut + step :] ** 2).sum(1)) for cut in cuts]
    for i in range(len(q)):
        alive = np.flatnonzero(c_ids != q_ids[i])
        score = np.zeros(len(alive))
        whole = len(alive) == len(c_ids)
        for b, cut in enumerate(cuts):
            part = columns[cut : cut + step]
            score += q[i, cut : cut + step] @ (part if whole else part[:, alive])
            if len(alive) <= k or b == len(cuts) - 1:
                continue
            slack = rest[b][i] * mass[b][alive] * (1 + 1e-9) + 1e-6
            low = score - slack
            bar = np.partition(low, -k)[-k]
            kept = score + slack >= (bar if floors is None else max(bar, floors[i]))
            if kept.sum() <= 0.8 * len(kept):
                alive, score, whole = alive[kept], score[kept], False
        yield i, alive, score


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = 4096, candidate_block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score) from tables of (vec_id, vector of integers).

    Candidates with the query's own vec_id are its own rows and take no part.
    Missing trailing components count as 0. Ties go to the smaller vec_id, null
    ids last; a query with a null id asks for nothing; repeated query rows are
    answered once and repeated candidate rows each count (k of them can reach a top
    k, so k are kept). Scores beyond a long are saturated. Vectors of any length are
    used whole. Empty tables give no rows; other columns are not looked at.
    """
    queries = queries.where("vec_id is not null").select("vec_id", "vector").distinct()
    alike = candidates.groupBy("vec_id", "vector").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    candidates = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    nq = max(1, math.ceil(queries.count() / query_block))
    nc = max(1, math.ceil(candidates.count() / candidate_block))
    deal = lambda blocks, *key: F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")
    candidates = candidates.select("vec_id", "vector", deal(nc, "vec_id", "vector", "copy").alias("cb"))
    queries = queries.select("vec_id", "vector", deal(nq, "vec_id", "vector").alias("qb"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out = []
        if len(left) and len(right):
            width = max(len(v) for v in pdf.vector)
            m = np.zeros((len(pdf), width), dtype=np.int64)
            for i, v in enumerate(pdf.vector):
                m[i, : len(v)] = v
            is_q = pdf.side.to_numpy() == 0
            c_ids = right.vec_id.astype("Int64").to_numpy(dtype=object, na_value=None)
            keys = np.array([2**63 - 1 if x is None else x for x in c_ids], dtype=np.int64)
            missing = np.array([x is None for x in c_ids])
            q_ids = left.vec_id.to_numpy(dtype=np.int64)
            floors = left.floor.astype("Int64").to_numpy(dtype=object, na_value=-math.inf)
            for i, alive, score in search_block(q_ids, m[is_q], np.where(missing, -(2**63), keys), m[~is_q], k, floors):
                score = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in score]) if score.dtype == object else score.astype(np.int64)
                kept = score >= floors[i] if len(score) else np.zeros(0, bool)
                alive, score = alive[kept], score[kept]
                if len(alive) > k:  # keep every row tied with the k-th
                    kept = score >= np.partition(score, -k)[-k]
                    alive, score = alive[kept], score[kept]
                top = np.lexsort((missing[alive], keys[alive], -score))[:k]
                out += [(int(q_ids[i]), c_ids[alive[t]], int(score[t])) for t in top]
        return pd.DataFrame({"query_id": pd.Series([x[0] for x in out], dtype="int64"), "vec_id": pd.Series([x[1] for x in out], dtype="Int64"), "score": pd.Series([x[2] for x in out], dtype="int64")})

    def met(queries: DataFrame, candidates: DataFrame, blocks: Column) -> DataFrame:
        left = queries.select("vec_id", "vector", "floor", "qb", F.explode(blocks).alias("cb"), F.lit(0).alias("side"))
        right = candidates.select("vec_id", "vector", F.lit(None).cast("long").alias("floor"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), "cb", F.lit(1).alias("side"))
        return left.unionByName(right).groupBy("qb", "cb").applyInPandas(run, "query_id long, vec_id long, score long")

    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = met(queries.withColumn("floor", F.lit(None).cast("long")), candidates.where("cb = 0"), F.array(F.lit(0)))
    if nc > 1:
        found = written(found, "topk-first")
        floors = top(found).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        found = found.unionByName(met(queries.join(floors, "vec_id", "left"), candidates.where("cb > 0"), F.sequence(F.lit(1), F.lit(nc - 1))))
    return top(found).select("query_id", "rank", "vec_id", "score")
