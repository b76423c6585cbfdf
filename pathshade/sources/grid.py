"""Lattices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Grid:
    rows: int
    cols: int
    diag: bool = False
    torus: bool = False
    wrap_rows: bool = False
    wrap_cols: bool = False

    @property
    def n(self) -> int:
        return self.rows * self.cols

    @property
    def offsets(self) -> list[tuple[int, int]]:
        reach = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
        return [x for x in reach if self.diag or 0 in x]


def parse_grid(spec: str) -> Grid:
    """``rows=R,cols=C[,diag=0|1][,torus=0|1]``."""
    from pathshade.functions.text import parse_bool, parse_int, parse_pairs

    given = parse_pairs(spec)
    if unknown := set(given) - {"rows", "cols", "diag", "torus"}:
        raise ValueError(f"unknown grid keys: {sorted(unknown)}")
    grid = Grid(parse_int(given["rows"]), parse_int(given["cols"]), parse_bool(given.get("diag", "0")), parse_bool(given.get("torus", "0")))
    if grid.rows < 1 or grid.cols < 1:
        raise ValueError("a grid needs rows and columns")
    return grid


def row_of(v: Column, cols: int) -> Column:
    return F.floor(v / cols)


def col_of(v: Column, cols: int) -> Column:
    return v % cols


def manhattan(a: Column, b: Column, cols: int) -> Column:
    return F.abs(row_of(a, cols) - row_of(b, cols)) + F.abs(col_of(a, cols) - col_of(b, cols))


def nodes(spark: SparkSession, grid: Grid) -> DataFrame:
    return spark.range(grid.n).withColumnRenamed("id", "v")


def grid_edges(spark: SparkSession, grid: Grid) -> DataFrame:
    """edges(u, v), both directions, row-major ids. A torus wraps rows and columns,
    wrap_rows and wrap_cols one of them. A torus of one or two rows or columns has loops
    and parallel edges, as its neighbourhoods say."""
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in grid.offsets])
    at = nodes(spark, grid).select(F.col("v").alias("u"), F.explode(steps).alias("s"))
    r, c = row_of(F.col("u"), grid.cols) + F.col("s.dr"), col_of(F.col("u"), grid.cols) + F.col("s.dc")
    inside = F.lit(True)
    if grid.torus or grid.wrap_rows:
        r = F.pmod(r, F.lit(grid.rows))
    else:
        inside = inside & r.between(0, grid.rows - 1)
    if grid.torus or grid.wrap_cols:
        c = F.pmod(c, F.lit(grid.cols))
    else:
        inside = inside & c.between(0, grid.cols - 1)
    return at.where(inside).select("u", (r * grid.cols + c).alias("v"))
