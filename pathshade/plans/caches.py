"""Tables kept for later runs. What a table depends on is kept beside it, and a
table that depends on something else is refused, never used."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathshade.functions.psi import Psi
from pathshade.functions.text import compact
from pathshade.sources.text import read_text, write_bytes


class Stale(ValueError):
    """The table was made for other parameters."""


def fingerprint(df: DataFrame, *columns: str) -> str:
    """Hash of a table as a multiset of rows, whatever their order: the sum of 48 bits
    of each row's MD5 digest, modulo 2**60, in hex. Doubles count to 6 digits."""
    plain = [F.round(c, 6).cast("decimal(30,6)").cast("string") if t == "double" else F.col(c).cast("string") for c, t in df.select(*columns).dtypes]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *plain)), 1, 12), 16, 10).cast("decimal(38,0)")
    total = df.agg(F.coalesce(F.sum(bits), F.lit(0).cast("decimal(38,0)")).alias("x")).select((F.col("x") % F.lit(1 << 60)).cast("long").alias("x"))
    return f"{total.first().x:x}"


def save(df: DataFrame, path: str, **parameters) -> DataFrame:
    """Write the table and what it depends on; returns it as read back."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    write_bytes(df.sparkSession, f"{path}/parameters.json", json.dumps(parameters, sort_keys=True).encode())
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def load(spark: SparkSession, path: str, **parameters) -> DataFrame:
    """The table at ``path``, made for these parameters; None stands for any value."""
    text = read_text(spark, f"{path}/parameters.json")
    if text is None:
        raise FileNotFoundError(f"no table at {path}")
    had, wanted = json.loads(text), json.loads(json.dumps({k: v for k, v in parameters.items() if v is not None}))
    had = {k: v for k, v in had.items() if parameters.get(k, v) is not None}
    if other := sorted(k for k in had.keys() | wanted.keys() if had.get(k) != wanted.get(k)):
        raise Stale(f"{path} was made for another {', '.join(other)}: {[had.get(k) for k in other]}, not {[wanted.get(k) for k in other]}")
    return spark.read.parquet(f"{path}/rows")


def load_or_make(spark: SparkSession, path: str, make, **parameters) -> DataFrame:
    """The table at ``path`` if it was made for these parameters, else a new one there."""
    try:
        return load(spark, path, **parameters)
    except (FileNotFoundError, Stale):
        return save(make(), path, **parameters)


def weights_parameters(n: int, kernel: str, candidates: DataFrame) -> dict:
    return {"n": n, "kernel": kernel, "candidates": fingerprint(candidates, "u", "cpos")}


def cap_key(weights: DataFrame, mode: str, k: int, psi: Psi) -> str:
    """What caps' node sums depend on: the weights, the mode and, for the k largest, k and psi."""
    base = fingerprint(weights, "u", "v", "w")
    if mode != "topk":
        return f"{base}:{mode}"
    return f"{base}:topk:{k}:psi {psi.kind}" + ("" if psi.kind == "log1p" else f":{compact(psi.p)}")
