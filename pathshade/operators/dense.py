"""Rounds over agents' nodes where candidates and nodes are few: an agent is one row, written once,
and a block of paths meets all candidates in one product of matrices. Joins would make a row
for each path node and each weight that reaches it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Cells of a table of gains by node and candidate, 2 MB, and its nodes, which a path costs;
#: larger ones are joined.
CELLS, NODES = 2**18, 1024
#: Paths of a block.
BLOCK = 1024


def fits(weights: DataFrame) -> bool:
    us, vs = weights.agg(F.countDistinct("u"), F.countDistinct("v")).first()
    return us * (vs + 1) <= CELLS and vs < NODES


def starts(*keys: np.ndarray) -> np.ndarray:
    """Positions at which one of the keys changes, the first included."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


PACKED = "agent long, x double, lens array<int>, nodes array<long>"


def by_agent(a: np.ndarray, p: np.ndarray, v: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """A row of PACKED an agent, of whole agents' path nodes in order."""
    at, own = starts(a, p), starts(a)
    of = lambda begin, end: pa.array(np.append(begin, end).astype(np.int32))
    lens = pa.ListArray.from_arrays(of(np.searchsorted(at, own), len(at)), pa.array(np.diff(np.append(at, len(a))).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(x[own]), lens, pa.ListArray.from_arrays(of(own, len(a)), pa.array(v))], ["agent", "x", "lens", "nodes"])


def packed(rows: DataFrame) -> DataFrame:
    """rows(agent, path, v, x) -> (agent, x, lens, nodes): a row an agent, x one of its own, the nodes of its
    paths one after another and how many each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last agent, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("agent", "path", "v", "x")]
            new = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            cut = starts(new[0])[-1]
            held = [c[cut:] for c in new]
            if cut:
                yield by_agent(*[c[:cut] for c in new])
        if held is not None:
            yield by_agent(*held)

    dealt = rows.select(*[F.col(c).cast("long").alias(c) for c in ("agent", "path", "v")], F.col("x").cast("double").alias("x"))
    return dealt.repartition("agent").sortWithinPartitions("agent", "path").mapInArrow(run, PACKED)


def gains(agents: DataFrame, delta: DataFrame, scores: DataFrame, of_block: Callable) -> DataFrame:
    """(u, cpos, gain) of the candidates that touch a node of an agent.

    agents: as ``packed``. delta(u, cpos, v, g): what a candidate adds at a node, g > 0.
    scores(v, y): what the picked ones give there. of_block(rises, scores, lens, firsts, x): the gain
    by candidate of a block, given its paths' rises (a row each), scores and lengths, each agent's
    first path and x."""
    d, y = delta.select("u", "cpos", "v", "g").toPandas(), scores.select("v", "y").toPandas()  # CELLS rows at most
    nodes = np.unique(np.concatenate([d["v"].to_numpy(np.int64), y["v"].to_numpy(np.int64)]))
    who = d[["u", "cpos"]].drop_duplicates().reset_index(drop=True)
    spark, n, m = delta.sparkSession, len(nodes), len(who)
    schema = "u long, cpos long, gain double"
    if not m:
        return spark.createDataFrame([], schema)
    u, cpos = who["u"].to_numpy(np.int64), who["cpos"].to_numpy(np.int64)
    place = d.merge(who.reset_index(), on=["u", "cpos"])
    table, level = np.zeros((n + 1, m)), np.zeros(n + 1)  # the last row is that of other nodes
    table[np.searchsorted(nodes, place["v"]), place["index"]] = place["g"]
    level[np.searchsorted(nodes, y["v"])] = y["y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met, place = np.zeros(m), np.zeros(n + 1, bool), np.zeros(n + 1, np.int64)
        for batch in batches:
            lists, ids = batch.column("lens"), batch.column("nodes")
            lens, x = lists.flatten().to_numpy(), batch.column("x").to_numpy()
            v, count = ids.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            at = np.minimum(np.searchsorted(nodes, v), n - 1)
            at = np.where(nodes[at] == v, at, n)
            met[at] = True
            first, ends = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(lens))
            a = 0
            while a < len(count):
                b = max(a + 1, int(np.searchsorted(first, first[a] + BLOCK, "right")) - 1)
                p, q = first[a], first[b]
                size, own = lens[p:q], at[ends[p] : ends[q]]
                path = np.repeat(np.arange(q - p), size)
                on = np.flatnonzero(np.bincount(own, minlength=n + 1))
                near = table[on]
                rising = np.flatnonzero((near > 0).any(axis=0))  # the others gain nothing here
                place[on] = np.arange(len(on))
                visits = np.bincount(path * len(on) + place[own], minlength=(q - p) * len(on)).reshape(q - p, len(on)).astype(float)
                total[rising] += of_block(visits @ near[:, rising], np.bincount(path, level[own], q - p), size, first[a:b] - p, x[a:b])
                a = b
        hit = np.flatnonzero((table[met] > 0).any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(u[hit]), pa.array(cpos[hit]), pa.array(total[hit])], ["u", "cpos", "gain"])

    return agents.mapInArrow(run, schema).groupBy("u", "cpos").agg(F.sum("gain").alias("gain"))


def _leveled(levels: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """What levels(v, y), of few rows, gives at each of some nodes; 0 elsewhere."""
    y = levels.select("v", "y").toPandas().sort_values("v")
    nodes, level = y["v"].to_numpy(np.int64), np.append(y["y"].to_numpy(float), 0.0)

    def of(v: np.ndarray) -> np.ndarray:
        at = np.searchsorted(nodes, v)
        at[np.append(nodes, -1)[at] != v] = len(nodes)
        return level[at]

    return of


def best(agents: DataFrame, levels: DataFrame, lam: float = 0.0) -> DataFrame:
    """(agent, value): the best path's sum of levels(v, y), less lam a step."""
    of = _leveled(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("lens")
            lens, first = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            got = np.bincount(np.repeat(np.arange(len(lens)), lens), of(batch.column("nodes").flatten().to_numpy()), len(lens))
            top = np.maximum.reduceat(got - lam * (lens - 1), first[:-1] - first[0])
            yield pa.RecordBatch.from_arrays([batch.column("agent"), pa.array(top)], ["agent", "value"])

    return agents.select("agent", "lens", "nodes").mapInArrow(run, "agent long, value double")


def _unions(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(place of the agent in the batch, v): the nodes of each agent once."""
    ids = batch.column("nodes")
    v, own = ids.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(ids.offsets.to_numpy()))
    if not len(v):
        return own, v
    least, span = v.min(), int(v.max() - v.min()) + 1
    if span > NODES:
        order = np.lexsort((v, own))
        own, v = own[order], v[order]
        once = starts(own, v)
        return own[once], v[once]
    met = np.zeros(batch.num_rows * span, bool)
    met[own * span + (v - least)] = True
    own, v = np.divmod(np.flatnonzero(met), span)
    return own, v + least


def union_counts(agents: DataFrame) -> DataFrame:
    """coef(v, c): agents whose union holds v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, c = np.unique(_unions(batch)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(c.astype(float))], ["v", "c"])

    return agents.select("nodes").mapInArrow(run, "v long, c double").groupBy("v").agg(F.sum("c").alias("c"))


def union_sums(agents: DataFrame, levels: DataFrame) -> DataFrame:
    """(agent, cur): the sum of levels(v, y) over an agent's union."""
    of = _leveled(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, v = _unions(batch)
            yield pa.RecordBatch.from_arrays([batch.column("agent"), pa.array(np.bincount(own, of(v), batch.num_rows))], ["agent", "cur"])

    return agents.select("agent", "nodes").mapInArrow(run, "agent long, cur double")


def paths(agents: DataFrame) -> DataFrame:
    """(agent, lmin, lmax, k): the lengths of agents' paths."""
    return agents.select("agent", (F.array_min("lens") - 1).cast("long").alias("lmin"), (F.array_max("lens") - 1).cast("long").alias("lmax"), F.size("lens").alias("k"))
