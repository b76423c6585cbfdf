"""Bounded models for Python workers, free column names, and what names a document."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shipped(spark: SparkSession, model):
    """A function that gives a copy of ``model`` on a worker. Its attributes are
    broadcast (plain containers and arrays of bounded size); its class travels
    with the function."""
    state, kind = spark.sparkContext.broadcast(model.__dict__), type(model)

    def copy():
        out = kind.__new__(kind)
        out.__dict__.update(state.value)
        return out

    return copy


@contextmanager
def lent(spark: SparkSession, model):
    """As ``shipped``, for plans that end inside: the copies' files are deleted."""
    state, kind = spark.sparkContext.broadcast(model.__dict__), type(model)

    def copy():
        out = kind.__new__(kind)
        out.__dict__.update(state.value)
        return out

    try:
        yield copy
    finally:
        state.destroy()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, prefixed until none is a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def identity() -> Column:
    """With doc_id, names a document: different texts under one id, or none, are
    different documents."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")
