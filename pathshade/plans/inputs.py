"""The engine's inputs, derived from whole tables: a 16 x 16 lattice whose agents
are the orders, and a sparse graph of the customers, one edge per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathshade.functions.psi import Psi
from pathshade.operators import weights as wt
from pathshade.operators.paths import lattice_draws, path_lengths
from pathshade.sources.grid import Grid, grid_edges, nodes
from pathshade.sources.text import edges_of

GRID = Grid(16, 16)
DRAWS = 3
SEED = 7
PICKED = (119, 153, 101, 34, 200)
OTHER = (17, 68, 136, 187, 238)
CLIP, LOG = Psi("clip", 1.0), Psi("log1p", 0.0)
LAMBDA = 0.25
SOFT = wt.SoftDecay(0.5, 3, 0.01)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def agents(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("agent"), (F.col("o_custkey") % GRID.n).alias("s"), ((F.col("o_orderkey") * 31 + 7) % GRID.n).alias("t"))
    return o.where("s <> t")


def path_nodes(spark: SparkSession, sf: str, draws: int = DRAWS) -> DataFrame:
    return lattice_draws(agents(spark, sf), GRID.cols, draws, SEED)


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return path_lengths(path_nodes(spark, sf))


def candidates(spark: SparkSession) -> DataFrame:
    return nodes(spark, GRID).select(F.col("v").alias("u"), F.col("v").alias("cpos"))


def hard(spark: SparkSession) -> DataFrame:
    return wt.hard_weights(grid_edges(spark, GRID), candidates(spark), 2)


def soft(spark: SparkSession) -> DataFrame:
    return wt.soft_weights(grid_edges(spark, GRID), candidates(spark), SOFT)


def customers(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "customer").count()


def edge_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lines ``u v`` of the sparse graph, as a file would hold them."""
    n = customers(spark, sf)
    return table(spark, sf, "orders").select(F.concat_ws(" ", "o_custkey", (F.col("o_orderkey") * 37 + 11) % n).alias("value"))


def sparse(spark: SparkSession, sf: str) -> DataFrame:
    return edges_of(edge_text(spark, sf), customers(spark, sf))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select((F.col("n_nationkey").cast("long") * 37 % customers(spark, sf)).alias("src")).distinct()


def sparse_agents(spark: SparkSession, sf: str) -> DataFrame:
    n = customers(spark, sf)
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("agent"), (k % n).alias("s"), ((k * 17 + 5) % n).alias("t")).where("s <> t")


def blocked(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes under a supplier, in every third column."""
    return table(spark, sf, "supplier").select((F.col("s_suppkey") * 3 % GRID.n).alias("v")).distinct()


def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' positive balances, in cents, by node."""
    c = table(spark, sf, "customer")
    return c.select((F.col("c_custkey") % GRID.n).alias("node"), F.round(F.col("c_acctbal") * 100).cast("long").alias("weight")).where("weight > 0")
