"""Sinks: kept nodes of a slice as Parquet, graphs as DOT text, relations beside the nodes they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_slice(nodes: DataFrame, marked: DataFrame, path: str) -> None:
    """The kept nodes, by function."""
    nodes.join(marked.select("fn", "node").distinct(), ["fn", "node"], "left_semi").write.mode("overwrite").parquet(path)


def write_dot(lines: DataFrame, path: str) -> None:
    """dot()'s lines(fn, o, line) as text, each function's lines together and in order."""
    ordered = lines.repartition("fn").sortWithinPartitions("fn", "o", "line")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def annotated(nodes: DataFrame, **relations: DataFrame) -> DataFrame:
    """nodes with a column for each relation(fn, node, value): the sorted values, as text."""
    out = nodes
    for name, rel in relations.items():
        told = rel.groupBy("fn", "node").agg(F.array_join(F.array_sort(F.collect_set(F.col("value").cast("string"))), ",").alias(name))
        out = out.join(told, ["fn", "node"], "left")
    return out
