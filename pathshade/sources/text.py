"""Text sources and sinks of graphs, node sets and paths."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathshade.functions.order import running
from pathshade.functions.text import compact, fnv1a, joined


def fields(line: str = "value") -> Column:
    return F.split(F.trim(F.col(line)), "\\s+")


def content(lines: DataFrame, comment: str = "#") -> DataFrame:
    """Lines that are neither blank nor begin with the comment mark."""
    return lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit(comment)))


def edges_of(lines: DataFrame, n: int | Column | None = None, undirected: bool = True, one_based: bool = False, comment: str = "#", distinct: bool = False) -> DataFrame:
    """edges(u, v) from ``u v ...`` lines. Lines without two integers and pairs
    outside 0..n-1 are dropped, repeated edges are kept unless asked otherwise."""
    shift = 1 if one_based else 0
    part = content(lines, comment).select(fields().alias("f"))
    pairs = part.select(*[(F.get("f", F.lit(i)).try_cast("long") - shift).alias(c) for i, c in enumerate("uv")]).where("u is not null and v is not null and u >= 0 and v >= 0")
    if n is not None:
        pairs = pairs.where((F.col("u") < n) & (F.col("v") < n))
    if undirected:
        pairs = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return pairs.distinct() if distinct else pairs


def node_count(edges: DataFrame) -> DataFrame:
    """n = the largest id and one; null without edges."""
    return edges.agg((F.max(F.greatest("u", "v")) + 1).alias("n"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with a number in file order (files are read in order of their path)."""
    return lines.withColumn("line", F.monotonically_increasing_id())


def ids_of(lines: DataFrame, n: int | None = None, one_based: bool = False, comment: str = "#", distinct: bool = True, order: str = "line") -> DataFrame:
    """candidates(u, cpos): one id per line, first occurrences, in file order.

    ``lines`` has value and the integer column that orders it. Positions are dense over
    the ids that are kept.
    """
    shift = 1 if one_based else 0
    ids = content(lines, comment).select((F.get(fields(), F.lit(0)).try_cast("long") - shift).alias("u"), order).where("u >= 0")
    if n is not None:
        ids = ids.where(F.col("u") < n)
    if distinct:
        ids = ids.groupBy("u").agg(F.min(order).alias(order))
    return running(ids, order, "cpos", ties=("u",)).select("u", "cpos")


def blocked_of(lines: DataFrame, n: int | None = None, one_based: bool = False) -> DataFrame:
    shift = 1 if one_based else 0
    ids = content(lines).select((F.get(fields(), F.lit(0)).try_cast("long") - shift).alias("v")).where("v >= 0")
    return (ids if n is None else ids.where(F.col("v") < n)).distinct()


def load_blocked(spark: SparkSession, path: str, n: int, one_based: bool = False, allow_empty: bool = False) -> DataFrame:
    """blocked(v) of a file; one without a valid id is an error unless allowed."""
    out = blocked_of(read_lines(spark, path), n, one_based)
    if not allow_empty and out.isEmpty():
        raise ValueError(f"{path} holds no valid node id")
    return out


def blocked_metadata(spark: SparkSession, path: str) -> dict:
    """blocked_source, blocked_seed and blocked_fraction of the blocked_meta.json beside
    a file of blocked nodes, as far as it names them with values of their types."""
    types = {"blocked_source": str, "blocked_seed": int, "blocked_fraction": (int, float)}
    text = read_text(spark, f"{path.rstrip('/').rpartition('/')[0]}/blocked_meta.json")
    try:
        given = json.loads(text or "{}")
    except json.JSONDecodeError:
        return {}
    return {k: given[k] for k, t in types.items() if isinstance(given.get(k), t) and not isinstance(given[k], bool)}


def hotspots_of(lines: DataFrame) -> DataFrame:
    """hotspots(node, weight) from ``node weight`` lines; an id below 0 or a
    weight of 0 or less is an error."""
    part = content(lines).select(fields().alias("f")).select(F.get("f", F.lit(0)).try_cast("long").alias("node"), F.get("f", F.lit(1)).try_cast("double").alias("weight"))
    bad = F.col("node").isNull() | (F.col("node") < 0) | F.col("weight").isNull() | (F.col("weight") <= 0)
    return part.select(F.when(bad, F.raise_error(F.lit("bad hotspot line")).cast("long")).otherwise(F.col("node")).alias("node"), "weight")


def hotspots_hash(lines: DataFrame) -> str:
    """Of the trimmed lines of a hotspot file, in their order."""
    rows = content(lines).select(F.trim("value").alias("t"), "line").orderBy("line").toLocalIterator()
    return f"{fnv1a(b for r in rows for b in (r.t + chr(10)).encode()):016x}"


def parse_hotspots(spec: str) -> list[tuple[int, float]]:
    """``0:3,7:1``."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        node, colon, weight = part.partition(":")
        if not colon or int(node) < 0 or not float(weight) > 0:
            raise ValueError(f"bad hotspot: {part!r}")
        out.append((int(node), float(weight)))
    if not out:
        raise ValueError("no hotspots")
    return out


def paths_of(lines: DataFrame, n: int | None = None, one_based: bool = False, separator: str = "|", agent: str = "line") -> DataFrame:
    """path_nodes(agent, path, pos, v): an agent a line, its paths apart by the
    separator, their nodes by white space. Paths of fewer than two nodes or with
    a bad id are dropped, the rest keep their number."""
    shift = 1 if one_based else 0
    paths = content(lines).select(F.col(agent).alias("agent"), F.posexplode(F.split("value", f"[{separator}]")).alias("path", "p"))
    nodes = paths.select("agent", "path", F.transform(F.split(F.trim("p"), "\\s+"), lambda x: x.try_cast("long") - shift).alias("nodes"))
    good = lambda x: F.coalesce((x >= 0) & (F.lit(True) if n is None else x < n), F.lit(False))
    return nodes.where((F.size("nodes") >= 2) & F.forall("nodes", good)).select("agent", F.col("path").cast("long").alias("path"), F.posexplode("nodes").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long"))


def coordinates_of(lines: DataFrame, rows: int, cols: int, one_based: bool = False) -> DataFrame:
    """blocked(v) from ``r c`` lines; cells outside the grid are dropped."""
    shift = 1 if one_based else 0
    rc = content(lines).select(fields().alias("f")).select(*[(F.get("f", F.lit(i)).try_cast("long") - shift).alias(c) for i, c in enumerate("rc")])
    return rc.where((F.col("r").between(0, rows - 1)) & (F.col("c").between(0, cols - 1))).select((F.col("r") * cols + F.col("c")).alias("v")).distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.text(path))


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, (smaller, larger), without loops."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(" ", "u", "v").alias("value"))


def id_lines(ids: DataFrame, column: str) -> DataFrame:
    return ids.select(F.col(column).cast("string").alias("value"))


def coordinate_lines(blocked: DataFrame, cols: int) -> DataFrame:
    return blocked.select(F.concat_ws(" ", F.expr(f"v div {cols}"), F.col("v") % cols).alias("value"))


def path_lines(path_nodes: DataFrame) -> DataFrame:
    """agent, value: nodes by spaces, paths by `` | ``."""
    nodes = path_nodes.groupBy("agent", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"].cast("string")), " ").alias("p"))
    return nodes.groupBy("agent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "p"))), lambda x: x["p"]), " | ").alias("value"))


def solution_lines(picked: list[int], value: float, gains: list[float] | None = None) -> list[str]:
    """A solution's file: its value, its ids and, if given, the gain of each step."""
    out = ["# value", compact(value), "# selected (NodeId)", joined(picked)]
    return out + (["# gains_per_step", " ".join(map(compact, gains))] if gains is not None else [])


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file on any file system that Spark writes; folders are made."""
    system, target = _path(spark, path)
    out = system.create(target, True)
    try:
        out.write(data)
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text, or None without one."""
    system, target = _path(spark, path)
    if not system.exists(target):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.select("value").write.mode(mode).text(path)
