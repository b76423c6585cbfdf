"""Hop distances, shortest-path graphs, corridors and obstacles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pathshade.functions.uniforms import uniform
from pathshade.operators import csr
from pathshade.session import written, written_count


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


UNROLLED, COMPACT = 3, 8


def _step(front: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, v): the neighbours of a frontier; links(_from, _to) are distinct edges."""
    return front.join(links, F.col("v") == F.col("_from")).select(key, F.col("_to").alias("v")).distinct()


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").cast("long").alias("_from"), F.col("v").cast("long").alias("_to")).distinct()


def hops(edges: DataFrame, sources: DataFrame, key: str = "src", start: str = "src", limit: int | None = None, symmetric: bool = False) -> DataFrame:
    """(key, v, d): hop distances up to ``limit`` from each source.

    ``sources`` has the key and its start node (several rows for a multi-source
    search). Parallel edges do not change distances, so edges are distinct once. A short
    radius is one lazy plan: walks of each length, then the shortest per node. A
    longer search goes frontier by frontier, against what its key has seen; each frontier is
    written and counted in one job, so no lineage grows. In a ``symmetric`` graph a
    neighbour of a frontier lies in it, in the one before, or is new, so two frontiers are
    all that is looked at; else the visited set is compacted every few rounds.
    """
    links = _links(edges)
    at = lambda df, d: df.select(key, "v", F.lit(d).cast("long").alias("d"))
    front = at(sources.select(key, F.col(start).cast("long").alias("v")).distinct(), 0)
    if limit is not None and limit <= UNROLLED:
        seen = front
        for d in range(1, limit + 1):
            front = at(_step(front, links, key), d)
            seen = seen.unionByName(front)
        return seen.groupBy(key, "v").agg(F.min("d").alias("d"))
    links, front = written(links, "links"), written(front, "frontier")
    seen, recent, d = front, [front], 0
    while limit is None or d < limit:
        d += 1
        known = reduce(DataFrame.unionByName, recent) if symmetric else seen
        front, new = written_count(at(_step(front, links, key).join(known.select(key, "v"), [key, "v"], "left_anti"), d), "frontier")
        if not new:
            break
        seen, recent = seen.unionByName(front), [recent[-1], front]
        if d % COMPACT == 0 and not symmetric:
            seen = written(seen, "visited")
    return seen


class _Side:
    """The levels of the searches from one end of pairs, each with columns (end, v, d)."""

    def __init__(self, edges: DataFrame, pairs: DataFrame, end: str, symmetric: bool):
        self.edges, self.end, self.symmetric = edges, end, symmetric
        self.links = written(_links(edges), "links")
        self.levels = [written(pairs.select(end, F.col(end).alias("v"), F.lit(0).cast("long").alias("d")).distinct(), "frontier")]

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    @property
    def front(self) -> DataFrame:
        return self.levels[-1].select(self.end, "v")

    def advance(self, open_: DataFrame) -> None:
        """A level more, of the searches that pairs of ``open_`` still ask for."""
        known = reduce(DataFrame.unionByName, self.levels[-2:] if self.symmetric else self.levels)
        front = self.front.join(open_.select(self.end).distinct(), self.end, "left_semi")
        new = _step(front, self.links, self.end).join(known.select(self.end, "v"), [self.end, "v"], "left_anti")
        self.levels.append(written(new.withColumn("d", F.lit(self.depth + 1).cast("long")), "frontier"))


def _met(edges: DataFrame, pairs: DataFrame, symmetric: bool) -> tuple[_Side, _Side, DataFrame]:
    """Searches from both ends of pairs(s, t), level by level, the one with the smaller frontier first, until
    they meet or one ends: both sides, and met(s, t, v, d, left) of the nodes at which a pair's
    searches meet, d hops from s and ``left`` from t. A pair's d + left is its distance, and all its
    shortest paths go through one of its rows."""
    pairs = written(pairs.select(F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t")).distinct(), "pairs")
    there, back = _Side(edges, pairs, "s", symmetric), _Side(reversed_edges(edges), pairs, "t", symmetric)
    open_, met = pairs, []
    while True:
        # pairs one of whose searches has ended lie apart
        for side, n in ((there, "_s"), (back, "_t")):
            open_ = open_.join(side.front.groupBy(side.end).agg(F.count(F.lit(1)).alias(n)), side.end)
        open_ = written(open_, "open")
        by_s, by_t = open_.agg(F.sum("_s"), F.sum("_t")).first()
        if by_s is None:
            break
        near, far = (there, back) if by_s <= by_t else (back, there)
        meet = open_.select("s", "t").join(near.front, near.end).join(far.front, [far.end, "v"])
        meet, found = written_count(meet.select("s", "t", "v", F.lit(there.depth).cast("long").alias("d"), F.lit(back.depth).cast("long").alias("left")), "met")
        if found:
            met.append(meet)
            open_ = open_.join(meet.select("s", "t").distinct(), ["s", "t"], "left_anti")
        sizes = [open_.select(side.end, n).distinct().agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] for side, n in ((there, "_s"), (back, "_t"))]
        if not min(sizes):
            break
        open_ = open_.select("s", "t")
        (there if sizes[0] <= sizes[1] else back).advance(open_)
    return there, back, reduce(DataFrame.unionByName, met) if met else pairs.select("s", "t", *[F.lit(None).cast("long").alias(c) for c in ("v", "d", "left")]).where(F.lit(False))


def _traced(side: _Side, met: DataFrame, d: str) -> list[DataFrame]:
    """steps(s, t, near, v, d): from where the searches met, level by level, the edges that lead
    back to the side's own end; ``near`` lies d hops from it, v one more."""
    out, back = [], reversed_edges(side.edges).select(F.col("u").alias("v"), F.col("v").alias("near"))
    for depth in range(side.depth, 0, -1):
        level = side.levels[depth - 1].select(side.end, F.col("v").alias("near"))
        at = met.where(F.col(d) == depth).select("s", "t", "v")  # a pair joins in at its own depth
        if out:
            at = at.unionByName(out[-1].select("s", "t", F.col("near").alias("v"))).distinct()
        steps = at.join(back, "v").join(level, [side.end, "near"])
        out.append(written(steps.select("s", "t", "near", "v", F.lit(depth - 1).cast("long").alias("d")), "steps"))
    return out


def reachable(edges: DataFrame, pairs: DataFrame, symmetric: bool = False) -> DataFrame:
    """The pairs (.., s, t) of which t can be reached from s."""
    whole, edges = csr.graph(edges, pairs, symmetric)
    if whole:
        return pairs.join(whole.met(pairs.select("s", "t").distinct()), ["s", "t"], "left_semi")
    _, _, met = _met(edges, pairs, symmetric)
    return pairs.join(met.select("s", "t").distinct(), ["s", "t"], "left_semi")


def shortest_steps(edges: DataFrame, pairs: DataFrame, symmetric: bool = False) -> tuple[DataFrame, DataFrame]:
    """steps(s, t, u, v, d) on the shortest paths of pairs, d hops from s to u, and met(s, t, v, d, left)."""
    there, back, met = _met(edges, pairs, symmetric)
    first = [x.select("s", "t", F.col("near").alias("u"), "v", "d") for x in _traced(there, met, "d")]
    total = met.groupBy("s", "t").agg(F.min(F.col("d") + F.col("left")).alias("total"))
    last = [x.join(total, ["s", "t"]).select("s", "t", F.col("v").alias("u"), F.col("near").alias("v"), (F.col("total") - 1 - F.col("d")).alias("d")) for x in _traced(back, met, "left")]
    none = met.select("s", "t", F.col("v").alias("u"), "v", "d").where(F.lit(False))
    return reduce(DataFrame.unionByName, [*first, *last] or [none]), met


def shortest_path_dag(edges: DataFrame, agents: DataFrame, allowed: DataFrame | None = None, symmetric: bool = False) -> DataFrame:
    """dag(agent, u, v, d): for agents(agent, s, t) the edges with
    dist(v) = dist(u) + 1 that lie on a shortest path; d is dist(u). Parallel
    edges stay, they count as different paths. allowed(agent, v) masks nodes."""
    whole, edges = csr.graph(edges, agents, symmetric)
    if whole:
        dag = whole.dag(agents)
    else:
        steps, _ = shortest_steps(edges, agents, symmetric)
        dag = agents.join(steps, ["s", "t"]).select("agent", "u", "v", "d")
    if allowed is not None:
        dag = dag.join(allowed, ["agent", "v"], "left_semi").join(allowed.withColumnRenamed("v", "u"), ["agent", "u"], "left_semi").select("agent", "u", "v", "d")
    return dag


def corridor(edges: DataFrame, agents: DataFrame, radius: int, symmetric: bool = False) -> DataFrame:
    """corridor(agent, v): nodes within ``radius`` hops of a node that lies on a
    shortest path of the agent."""
    whole, edges = csr.graph(edges, agents, symmetric)
    if whole:
        return whole.corridor(agents, radius).select("agent", "v")
    steps, met = shortest_steps(edges, agents, symmetric)
    nodes = reduce(DataFrame.unionByName, [steps.select("s", "t", F.col("u").alias("v")), steps.select("s", "t", "v"), met.select("s", "t", "v")]).distinct()
    line = agents.join(nodes, ["s", "t"]).select("agent", "v")
    return hops(edges, line, key="agent", start="v", limit=radius, symmetric=symmetric).select("agent", "v").distinct()


def random_obstacles(nodes: DataFrame, count: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """blocked(v): ``count`` nodes in order of a seeded hash."""
    pool = nodes if exclude is None else nodes.join(exclude, "v", "left_anti")
    return pool.orderBy(uniform(seed, F.col("v")), "v").limit(count)


def without_obstacles(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    return edges.join(blocked.withColumnRenamed("v", "u"), "u", "left_anti").join(blocked, "v", "left_anti").select("u", "v")


def walkable(nodes: DataFrame, blocked: DataFrame) -> DataFrame:
    return nodes.join(blocked, "v", "left_anti")


def graph_summary(nodes: DataFrame, edges: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    out = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("directed_edges")))  # two single rows
    return out if blocked is None else out.crossJoin(blocked.agg(F.count(F.lit(1)).alias("n_blocked")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(out, "v", "left").select("v", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def path_summary(paths: DataFrame) -> DataFrame:
    return paths.agg(F.count(F.lit(1)).alias("paths"), F.min("len").alias("min_len"), F.avg("len").alias("avg_len"), F.max("len").alias("max_len"))
