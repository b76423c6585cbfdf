"""Uniform shortest paths, on lattices and on general graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from pathshade.functions.uniforms import uniform
from pathshade.operators import csr, dense, graph as gr
from pathshade.session import written
from pathshade.sources.grid import col_of, row_of


def lattice_draws(agents: DataFrame, cols: int, draws: int, seed: int = 1) -> DataFrame:
    """path_nodes(agent, path, pos, v): uniform monotone lattice paths.

    Each step of a draw has a hash; the R smallest of R + C are the vertical
    ones, which is uniform over all C(R + C, R) paths. Sums along the steps give
    coordinates. No loop, one shuffle, by (agent, draw).
    """
    a, b = F.col("s"), F.col("t")
    rows = agents.select("agent", "s", "t", (row_of(b, cols) - row_of(a, cols)).alias("dr"), (col_of(b, cols) - col_of(a, cols)).alias("dc"))
    steps = rows.withColumn("len", F.abs("dr") + F.abs("dc")).withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    steps = steps.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), "len")))
    own = W.partitionBy("agent", "path")
    rank = F.row_number().over(own.orderBy(F.when(F.col("pos") == 0, 2.0).otherwise(uniform(seed, F.col("agent"), F.col("path"), F.col("pos"))), "pos"))
    steps = steps.withColumn("down", ((F.col("pos") > 0) & (rank <= F.abs("dr"))).cast("long"))
    r = F.sum("down").over(own.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    v = (row_of(a, cols) + F.signum("dr").cast("long") * r) * cols + col_of(a, cols) + F.signum("dc").cast("long") * (F.col("pos") - r)
    return steps.select("agent", F.col("path").cast("long").alias("path"), "pos", v.alias("v"))


#: Agents of a task of ``lattice_packed``.
SHARE = 50_000


def lattice_packed(agents: DataFrame, cols: int, draws: int, seed: int = 1) -> DataFrame:
    """The agents of ``lattice_draws`` as rows of ``dense.packed``. An agent's hashes come one after
    another, so steps are ranked where they are made, and only agents are dealt out: in order of
    their ends, so that a block of them touches few nodes."""
    rows = agents.select(*[F.col(c).cast("long").alias(c) for c in ("agent", "s", "t")])
    rows = rows.repartitionByRange(max(1, -(-agents.count() // SHARE)), "s", "t", "agent").sortWithinPartitions("s", "t", "agent")
    size = F.abs(row_of(F.col("t"), cols) - row_of(F.col("s"), cols)) + F.abs(col_of(F.col("t"), cols) - col_of(F.col("s"), cols))
    steps = rows.withColumn("len", size).withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    steps = steps.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), "len")))
    steps = steps.select("agent", "s", "t", "pos", F.when(F.col("pos") == 0, 2.0).otherwise(uniform(seed, F.col("agent"), F.col("path"), F.col("pos"))).alias("x"))

    def packed(a, s, t, pos, x) -> pa.RecordBatch:
        starts = np.flatnonzero(pos == 0)
        path = np.cumsum(pos == 0) - 1
        order = np.lexsort((x, path))
        rank = np.empty(len(a), np.int64)
        rank[order] = np.arange(len(a)) - starts[path]
        dr, dc = t // cols - s // cols, t % cols - s % cols
        down = (pos > 0) & (rank < np.abs(dr))
        r = np.cumsum(down)
        r -= r[starts][path]
        v = (s // cols + np.sign(dr) * r) * cols + s % cols + np.sign(dc) * (pos - r)
        return dense.by_agent(a, path, v, np.zeros(len(a)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last agent, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            cut = dense.starts(new[0])[-1]
            held = [c[cut:] for c in new]
            if cut:
                yield packed(*[c[:cut] for c in new])
        if held is not None:
            yield packed(*held)

    return steps.mapInArrow(run, dense.PACKED)


def exploded(arrays: DataFrame) -> DataFrame:
    """(agent, drawn) -> path_nodes(agent, path, pos, v)."""
    paths = arrays.select("agent", F.posexplode("drawn").alias("path", "nodes"))
    return paths.select("agent", F.col("path").cast("long").alias("path"), F.posexplode("nodes").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long"))


def distinct_arrays(arrays: DataFrame, k: int) -> DataFrame:
    """At most k distinct paths per agent in order of their first draw."""
    return arrays.select("agent", F.slice(F.array_distinct("drawn"), 1, k).alias("drawn"))


def arrays_of(draws: DataFrame) -> DataFrame:
    """path_nodes(agent, path, pos, v) -> (agent, drawn), paths and nodes in order."""
    nodes = draws.groupBy("agent", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("nodes"))
    return nodes.groupBy("agent").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "nodes"))), lambda x: x["nodes"]).alias("drawn"))


def lattice_arrays(agents: DataFrame, cols: int, draws: int, seed: int = 1) -> DataFrame:
    """(agent, drawn) of ``lattice_draws``. Array expressions on the agent's row would need
    no shuffle, but are not compiled: on 450,000 paths they took twice the time."""
    return arrays_of(lattice_draws(agents, cols, draws, seed))


def distinct_paths(draws: DataFrame, k: int) -> DataFrame:
    """At most k distinct paths per agent in order of their first draw, renumbered."""
    return exploded(distinct_arrays(arrays_of(draws), k))


def log_choose(n: Column, k: Column) -> Column:
    """Logarithm of the binomial coefficient, a sum of logarithms; k at most n / 2 is
    quickest."""
    n, k = n.cast("long"), k.cast("long")
    terms = F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0)
    return F.aggregate(terms, F.lit(0.0), lambda s, i: s + F.log((n - k + i).cast("double")) - F.log(i.cast("double")))


def path_lengths(path_nodes: DataFrame) -> DataFrame:
    """paths(agent, path, len): edges, nodes less one."""
    return path_nodes.groupBy("agent", "path").agg((F.count(F.lit(1)) - 1).alias("len"))


def dag_counts(dag: DataFrame, agents: DataFrame) -> DataFrame:
    """counts(agent, u, cnt): shortest paths from u to the agent's t, as doubles,
    layer by layer from the end."""
    deep = dag.agg(F.max("d")).first()[0]
    layer = agents.select("agent", F.col("t").alias("u"), F.lit(1.0).alias("cnt"))
    out = layer
    total = dag.groupBy("agent").agg((F.max("d") + 1).alias("len"))
    placed = dag.join(total, "agent").withColumn("layer", F.col("len") - F.col("d"))
    for step in range(1, (deep if deep is not None else -1) + 2):
        near = placed.where(F.col("layer") == step)
        layer = near.join(layer.select("agent", F.col("u").alias("v"), "cnt"), ["agent", "v"]).groupBy("agent", "u").agg(F.sum("cnt").alias("cnt"))
        if step % 4 == 0:
            layer = written(layer, "layer")
        out = out.unionByName(layer)
    return out


def dag_draws(dag: DataFrame, counts: DataFrame, agents: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """path_nodes(agent, path, pos, v) of uniform shortest paths: at each node
    the next is drawn in proportion to the paths that go on from it. Parallel
    edges count as often as they occur."""
    deep = dag.agg(F.max("d")).first()[0]
    options = dag.join(counts.select("agent", F.col("u").alias("v"), "cnt"), ["agent", "v"]).groupBy("agent", "u", "v").agg(F.sum("cnt").alias("cnt"))
    upto = W.partitionBy("agent", "u").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    options = written(options.select("agent", "u", "v", F.sum("cnt").over(upto).alias("high"), F.sum("cnt").over(W.partitionBy("agent", "u")).alias("total"), "cnt"), "options")
    at = agents.join(dag.select("agent").distinct(), "agent", "left_semi").withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("agent", F.col("path").cast("long").alias("path"), F.lit(0).cast("long").alias("pos"), F.col("s").alias("v"))
    out = at
    for step in range(1, (deep if deep is not None else -1) + 2):
        draw = at.select("agent", "path", F.col("v").alias("u"), uniform(seed, F.col("agent"), F.col("path"), F.lit(step)).alias("r"))
        at = draw.join(options, ["agent", "u"]).where((F.col("r") * F.col("total") < F.col("high")) & (F.col("r") * F.col("total") >= F.col("high") - F.col("cnt")))
        at = at.select("agent", "path", F.lit(step).cast("long").alias("pos"), "v")
        if step % 3 == 0:
            at = written(at, "walk")
        out = out.unionByName(at)
    return out


def shortest_counts(edges: DataFrame, agents: DataFrame, symmetric: bool = False) -> DataFrame:
    """``dag_counts`` of the agents' shortest paths."""
    whole, edges = csr.graph(edges, agents, symmetric)
    if whole:
        return whole.counts(agents)
    return dag_counts(written(gr.shortest_path_dag(edges, agents, symmetric=symmetric), "dag"), agents)


def shortest_draws(edges: DataFrame, agents: DataFrame, draws: int, seed: int = 1, symmetric: bool = False) -> DataFrame:
    """``dag_draws`` of the agents' shortest paths."""
    whole, edges = csr.graph(edges, agents, symmetric)
    if whole:
        return whole.draws(agents, draws, seed)
    dag = written(gr.shortest_path_dag(edges, agents, symmetric=symmetric), "dag")
    return dag_draws(dag, written(dag_counts(dag, agents), "counts"), agents, draws, seed)
