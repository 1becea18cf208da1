"""Least fixpoints over relations: semi-naive iteration in the driver, every round a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_table, materialize


class NotConverged(RuntimeError):
    pass


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], name: str = "fix", hops: int = 2, max_rounds: int = 10_000) -> DataFrame:
    """The least relation that holds anchor and is closed under step, a linear rule over the rows added last.

    A round applies step hops times before it compares with what is known, which divides the number of rounds. Only new
    rows are joined (semi-naive). The known rows are a union of round tables, compacted every eighth round.
    """
    cols = anchor.columns
    known = delta = materialize(anchor.distinct(), name)
    tables = [delta]
    for round_ in range(1, max_rounds + 1):
        front, found = delta, None
        for _ in range(hops):
            front = step(front).select(cols)
            found = front if found is None else found.unionByName(front)
        on = [known[c].eqNullSafe(F.col(f"n.{c}")) for c in cols]
        new = found.distinct().alias("n").join(known, on, "left_anti")
        delta = materialize(new, name)
        if delta.isEmpty():
            return known
        known = known.unionByName(delta)
        tables.append(delta)
        if round_ % 8 == 0:
            known = materialize(known, name)
            for table in tables[:-1]:  # the last one is still joined
                drop_table(table)
            tables = [delta, known]
    raise NotConverged(f"{name}: {max_rounds} rounds")


def closure(edges: DataFrame, keys: Sequence[str], name: str = "closure", max_rounds: int = 40) -> DataFrame:
    """Transitive closure of edges(keys, src, dst) by path doubling: as many rounds as the logarithm of the longest path."""
    keys = list(keys)
    paths = materialize(edges.select(*keys, "src", "dst").distinct(), name)
    n = paths.count()
    for _ in range(max_rounds):
        left = paths.select(*keys, "src", F.col("dst").alias("mid"))
        right = paths.select(*keys, F.col("src").alias("mid"), "dst")
        paths = materialize(paths.unionByName(left.join(right, [*keys, "mid"]).select(*keys, "src", "dst")).distinct(), name)
        m = paths.count()
        if m == n:
            return paths
        n = m
    raise NotConverged(f"{name}: {max_rounds} rounds")


def reach(edges: DataFrame, seeds: DataFrame, keys: Sequence[str], hops: int = 3) -> DataFrame:
    """Nodes reachable from seeds(keys, node and more), the seeds included, over edges(keys, src, dst)."""
    keys = list(keys)
    cols = seeds.columns

    def step(front: DataFrame) -> DataFrame:
        return front.withColumnRenamed("node", "src").join(edges, [*keys, "src"]).withColumn("node", F.col("dst")).select(cols)

    return fixpoint(seeds, step, "reach", hops)
