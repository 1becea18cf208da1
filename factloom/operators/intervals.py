"""Interval algebra over byte ranges: sites(module, obj, lo, hi, val) with closed bounds; a null hi is unbounded.

Maps of disjoint intervals are segment tables (module, obj, lo, hi, val): the elementary segments between all bounds, one
row for each value of a segment. Every join is an equi-join on the object first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["module", "obj"]
MAX = (1 << 62) - 1


def bounded(sites: DataFrame) -> DataFrame:
    return sites.withColumn("hi", F.coalesce("hi", F.lit(MAX)))


def overlap(a: str, b: str) -> str:
    """Condition: two closed intervals share a byte."""
    return f"{a}.lo <= {b}.hi AND {b}.lo <= {a}.hi"


def elementary(sites: DataFrame) -> DataFrame:
    """(module, obj, lo, hi): the object cut at every bound; pieces that no site covers are among them."""
    cuts = bounded(sites).select(*KEY, F.explode(F.array("lo", F.col("hi") + 1)).alias("lo")).distinct()
    nxt = F.lead("lo").over(Window.partitionBy(*KEY).orderBy("lo"))
    return cuts.withColumn("hi", nxt - 1).where("hi is not null")


def add(sites: DataFrame) -> DataFrame:
    """Weak update with every site: (module, obj, lo, hi, val), the values whose sites cover each segment."""
    s, e = bounded(sites).alias("s"), elementary(sites).alias("e")
    on = F.expr("e.module = s.module AND e.obj = s.obj AND s.lo <= e.lo AND e.hi <= s.hi")
    return e.join(s, on).select("e.module", "e.obj", "e.lo", "e.hi", "s.val").distinct()


def update(sites: DataFrame) -> DataFrame:
    """Updates in the order of pos: a strong site replaces what a segment holds, a weak one is added.
    sites(module, obj, lo, hi, val, pos, strong)."""
    s, e = bounded(sites).alias("s"), elementary(sites).alias("e")
    on = F.expr("e.module = s.module AND e.obj = s.obj AND s.lo <= e.lo AND e.hi <= s.hi")
    seg = e.join(s, on).select("e.module", "e.obj", "e.lo", "e.hi", "s.val", "s.pos", "s.strong")
    last = F.max(F.when(F.col("strong"), F.col("pos"))).over(Window.partitionBy(*KEY, "lo"))
    return seg.withColumn("last", last).where("last is null OR pos >= last").select(*KEY, "lo", "hi", "val").distinct()


def add_all(segments: DataFrame, val) -> DataFrame:
    """val added to every interval of a map."""
    return segments.unionByName(segments.withColumn("val", val)).distinct()


def gather(segments: DataFrame, queries: DataFrame) -> DataFrame:
    """(module, q, val): values of the intervals that each query(module, q, obj, lo, hi) overlaps."""
    m, q = segments.alias("m"), bounded(queries).alias("q")
    return q.join(m, F.expr(f"m.module = q.module AND m.obj = q.obj AND {overlap('m', 'q')}")).select("q.module", "q.q", "m.val").distinct()


def merged(intervals: DataFrame) -> DataFrame:
    """(module, obj, lo, hi): the union of intervals as the fewest disjoint ones; touching ones are joined."""
    w = Window.partitionBy(*KEY).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = bounded(intervals).withColumn("new", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("new").over(w))
    return island.groupBy(*KEY, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def clipped(segments: DataFrame, queries: DataFrame) -> DataFrame:
    """(module, q, obj, qlo, qhi, lo, hi): the covered parts of each query, disjoint; a query without any has null lo."""
    m, q = merged(segments).alias("m"), bounded(queries).alias("q")
    both = q.join(m, F.expr(f"m.module = q.module AND m.obj = q.obj AND {overlap('m', 'q')}"), "left")
    return both.select("q.module", "q.q", "q.obj", F.col("q.lo").alias("qlo"), F.col("q.hi").alias("qhi"), F.when(F.col("m.lo").isNotNull(), F.greatest("q.lo", "m.lo")).alias("lo"), F.when(F.col("m.hi").isNotNull(), F.least("q.hi", "m.hi")).alias("hi"))


def overlaps(segments: DataFrame, queries: DataFrame) -> DataFrame:
    """(module, q, any_overlap, full_overlap): whether a query meets the map, and whether the map covers all of it."""
    c = clipped(segments, queries).groupBy("module", "q", "obj", "qlo", "qhi").agg(F.count("lo").alias("n"), F.sum(F.col("hi") - F.col("lo") + 1).alias("bytes"))
    return c.select("module", "q", (F.col("n") > 0).alias("any_overlap"), F.coalesce(F.col("bytes") == F.col("qhi") - F.col("qlo") + 1, F.lit(False)).alias("full_overlap"))


def uncovered(segments: DataFrame, queries: DataFrame) -> DataFrame:
    """(module, q, lo, hi): the gaps of each query that no interval of the map covers."""
    c = clipped(segments, queries)
    w = Window.partitionBy("module", "q", "obj").orderBy("lo")
    before = c.where("lo is not null").select("module", "q", F.coalesce(F.lag("hi").over(w) + 1, F.col("qlo")).alias("lo"), (F.col("lo") - 1).alias("hi"))
    after = c.groupBy("module", "q", "obj", "qlo", "qhi").agg(F.max("hi").alias("last")).select("module", "q", F.coalesce(F.col("last") + 1, F.col("qlo")).alias("lo"), F.col("qhi").alias("hi"))
    return before.unionByName(after).where("lo <= hi")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """(module, obj, lo, hi, val): the common parts of two maps' intervals that hold an equal value."""
    x, y = a.alias("x"), b.alias("y")
    on = F.expr(f"x.module = y.module AND x.obj = y.obj AND x.val = y.val AND {overlap('x', 'y')}")
    return x.join(y, on).select("x.module", "x.obj", F.greatest("x.lo", "y.lo").alias("lo"), F.least("x.hi", "y.hi").alias("hi"), "x.val").distinct()


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """(module, obj, lo, hi): parts that both interval lists cover."""
    x, y = merged(a).alias("x"), merged(b).alias("y")
    return x.join(y, F.expr(f"x.module = y.module AND x.obj = y.obj AND {overlap('x', 'y')}")).select("x.module", "x.obj", F.greatest("x.lo", "y.lo").alias("lo"), F.least("x.hi", "y.hi").alias("hi"))


def filtered(segments: DataFrame, values: DataFrame) -> DataFrame:
    """A map's intervals with a value in values(module, val)."""
    return segments.join(values, ["module", "val"], "left_semi").select(segments.columns)
