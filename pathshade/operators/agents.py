"""Origin-destination sampling.

The rejection loop becomes numbered attempts and tries: every draw is a hash of
(seed, attempt, try, role), filters are plain predicates, the first good try of an
attempt is kept, and the first M attempts are the agents. Any number of tasks
gives the same agents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pathshade.functions.order import running
from pathshade.functions.uniforms import normal, uniform
from pathshade.sources.grid import col_of, manhattan, row_of

TRIES = 50


@dataclass(frozen=True)
class OD:
    """kind: uniform, band (dmin, dmax), gaussian (sigma), hotspot, gravity (beta).
    All but uniform and hotspot measure on a grid of ``cols`` columns."""

    kind: str = "uniform"
    dmin: int = 0
    dmax: int = 0
    sigma: float = 0.0
    beta: float = 0.0
    rows: int = 0
    cols: int = 0

    def __post_init__(self):
        if self.kind not in ("uniform", "band", "gaussian", "hotspot", "gravity"):
            raise ValueError(f"unknown distribution: {self.kind}")
        if self.kind in ("band", "gaussian", "gravity") and not (self.rows > 0 and self.cols > 0):
            raise ValueError(f"{self.kind} needs the grid's rows and columns")
        if self.kind == "band" and not 0 <= self.dmin <= self.dmax:
            raise ValueError("band needs 0 <= dmin <= dmax")
        if self.kind == "gaussian" and not self.sigma > 0:
            raise ValueError("gaussian needs sigma > 0")
        if self.kind == "gravity" and self.beta < 0:
            raise ValueError("gravity needs beta >= 0")


# Fixed names that a distribution goes by, in any case.
OD_NAMES = {"": "uniform", "uniformwithdistband": "band", "gaussianaroundstart": "gaussian", "hotspots": "hotspot", "hotspotmixture": "hotspot"}


def parse_od(name: str) -> str:
    kind = name.strip().lower()
    kind = OD_NAMES.get(kind, kind)
    if kind not in ("uniform", "band", "gaussian", "hotspot", "gravity"):
        raise ValueError(f"unknown distribution: {name!r}")
    return kind


def indexed(ids: DataFrame, column: str) -> DataFrame:
    """(idx, node): distinct ids, numbered by value."""
    return running(ids.select(F.col(column).alias("node")).distinct(), "node", "idx").select("idx", "node")


def hotspot_ranges(hotspots: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(node, low, high) of the cumulative weights in order of node; weights of 0
    or less and blocked nodes drop out, repeated nodes add up."""
    good = hotspots.where("weight > 0 and node >= 0").groupBy("node").agg(F.sum("weight").alias("weight"))
    if blocked is not None:
        good = good.join(blocked.withColumnRenamed("v", "node"), "node", "left_anti")
    return running(good, "node", "low", F.col("weight")).select("node", "low", (F.col("low") + F.col("weight")).alias("high"))


#: A table of fewer rows is broadcast beside the tries.
FEW = 500_000


def _looked_up(frame: DataFrame, table: DataFrame, count: int, on: str) -> DataFrame:
    """Tries joined with a table of ``count`` rows. The planner takes the tries for as small as
    the attempts that they are exploded from, and would broadcast them, so it is told."""
    return frame.join(F.broadcast(table), on) if count <= FEW else frame.hint("merge").join(table, on)


def _pick(frame: DataFrame, walk: DataFrame, count: int, out: str, draw: Column) -> DataFrame:
    """Add column ``out``: the walkable node at a uniform index."""
    return _looked_up(frame.withColumn("_i", F.floor(draw * count)), walk.select(F.col("idx").alias("_i"), F.col("node").alias(out)), count, "_i").drop("_i")


def _hot(frame: DataFrame, ranges: DataFrame, total: float, cells: int, out: str, draw: Column) -> DataFrame:
    """Add column ``out`` by inverse CDF: the equi-join on a cell of the cumulative
    weight keeps the range condition local. There are as many cells as ranges, so a cell
    holds a range or two, on average."""
    cell = lambda c: F.least(F.floor(c * cells / total), F.lit(cells - 1))
    wide = ranges.withColumn("_cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    drawn = frame.withColumn("_r", draw * total).withColumn("_cell", cell(F.col("_r")))
    return _looked_up(drawn, wide, 2 * cells, "_cell").where((F.col("_r") >= F.col("low")) & (F.col("_r") < F.col("high"))).withColumn(out, F.col("node")).drop("_r", "_cell", "node", "low", "high")


def sample_od(attempts: DataFrame, walkable: DataFrame, od: OD, seed: int = 1, tries: int = TRIES, hotspots: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """(attempt, s, t, try): each attempt's first try with s <> t (and, in a
    band, a distance in it). ``walkable`` holds column v. Without a hotspot that is not
    blocked no attempt has a pair."""
    walk = indexed(walkable, "v")
    count = walk.count()
    # dealt out before they grow, by what they are grouped by in the end
    tasks = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = attempts.select("attempt").repartition(tasks, "attempt").withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    u = lambda role: uniform(seed, F.col("attempt"), F.col("try"), role)
    if od.kind == "hotspot":
        ranges = hotspot_ranges(hotspots, blocked)
        total, cells = ranges.agg(F.max("high"), F.count(F.lit(1))).first()
        if not cells:
            node = F.lit(None).cast(ranges.schema["node"].dataType)
            return attempts.where(F.lit(False)).select("attempt", node.alias("s"), node.alias("t"), F.lit(None).cast("long").alias("try"))
        pairs = _hot(_hot(rows, ranges, float(total), cells, "s", u("s")), ranges, float(total), cells, "t", u("t"))
    else:
        pairs = _pick(rows, walk, count, "s", u("s"))
        if od.kind == "gaussian":
            r = row_of(F.col("s"), od.cols) + F.round(od.sigma * normal(seed, F.col("attempt"), F.col("try"), "dr")).cast("long")
            c = col_of(F.col("s"), od.cols) + F.round(od.sigma * normal(seed, F.col("attempt"), F.col("try"), "dc")).cast("long")
            pairs = pairs.withColumns({"_r": r, "_c": c}).where(F.col("_r").between(0, od.rows - 1) & F.col("_c").between(0, od.cols - 1))
            pairs = pairs.withColumn("t", F.col("_r") * od.cols + F.col("_c")).drop("_r", "_c")
            if blocked is not None:
                pairs = pairs.join(blocked.withColumnRenamed("v", "t"), "t", "left_anti")
        else:
            pairs = _pick(pairs, walk, count, "t", u("t"))
    good = F.col("s") != F.col("t")
    if od.kind == "band":
        good &= manhattan(F.col("s"), F.col("t"), od.cols).between(od.dmin, od.dmax)
    pairs = pairs.where(good)
    rank = F.col("try")
    if od.kind == "gravity":  # the last try stands if none is accepted
        accepted = u("accept") < F.exp(-od.beta * manhattan(F.col("s"), F.col("t"), od.cols))
        rank = F.when(accepted, F.col("try")).otherwise(2 * tries - F.col("try"))
    first = pairs.groupBy("attempt").agg(F.min(F.struct(rank.alias("rank"), "s", "t", "try")).alias("x"))
    return first.select("attempt", F.col("x.s").alias("s"), F.col("x.t").alias("t"), F.col("x.try").cast("long").alias("try"))


def first_agents(sampled: DataFrame, m: int) -> DataFrame:
    """agents(agent, s, t): the first m attempts that gave a pair, renumbered."""
    return running(sampled.orderBy("attempt").limit(m), "attempt", "agent").select("agent", "s", "t")
