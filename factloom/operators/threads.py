"""Threads: regions, fork-join and lock-unlock pairs, critical sections, interference. Nodes (module, node, kind), edges
(module, src, dst)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixpoint import closure, fixpoint
from ..functions.grouped import per_group, split_by_size

#: Functions of the thread library and what a call of one is.
LIBRARY = {"pthread_create": "FORK", "pthread_join": "JOIN", "pthread_exit": "EXIT", "pthread_mutex_lock": "LOCK", "pthread_mutex_unlock": "UNLOCK"}
MODULE = ("module",)


def recognised(calls: DataFrame) -> DataFrame:
    """calls(module, node, name) with the kind of node that they are; others are plain calls."""
    kinds = F.create_map(*[F.lit(x) for pair in LIBRARY.items() for x in pair])
    return calls.select("module", "node", F.coalesce(F.element_at(kinds, F.col("name")), F.lit("CALL")).alias("kind"))


def boundaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges at which a new region begins: out of exit or fork, into entry or join, or into a node with several predecessors."""
    k = nodes.select("module", "node", "kind")
    many = edges.groupBy("module", "dst").count().where("count > 1").select("module", "dst", F.lit(True).alias("many"))
    e = edges.join(k.select("module", F.col("node").alias("src"), F.col("kind").alias("ks")), ["module", "src"]).join(k.select("module", F.col("node").alias("dst"), F.col("kind").alias("kd")), ["module", "dst"]).join(many, ["module", "dst"], "left")
    return e.where("ks IN ('EXIT', 'FORK') OR kd IN ('ENTRY', 'JOIN') OR many").select("module", "src", "dst")


def regions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, node, region): nodes joined by edges that are no boundary; named by the first. Inside a region every node has
    one parent at most, so pointers to parents are doubled."""
    inner = edges.join(boundaries(nodes, edges), ["module", "src", "dst"], "left_anti")
    up = closure(inner.select("module", F.col("dst").alias("src"), F.col("src").alias("dst")), MODULE, "regions")
    roots = nodes.select("module", "node").join(inner.select("module", F.col("dst").alias("node")), ["module", "node"], "left_anti")
    inside = up.join(roots.select("module", F.col("node").alias("dst")), ["module", "dst"]).select("module", F.col("src").alias("node"), F.col("dst").alias("region"))
    return inside.unionByName(roots.select("module", "node", F.col("node").alias("region")))


def region_edges(edges: DataFrame, region: DataFrame) -> DataFrame:
    """(module, src_region, dst_region): all edges between different regions; back edges too."""
    a = region.select("module", F.col("node").alias("src"), F.col("region").alias("src_region"))
    b = region.select("module", F.col("node").alias("dst"), F.col("region").alias("dst_region"))
    return edges.join(a, ["module", "src"]).join(b, ["module", "dst"]).where("src_region <> dst_region").select("module", "src_region", "dst_region").distinct()


def matched(nodes: DataFrame, targets: DataFrame, first: str, second: str) -> DataFrame:
    """(module, a, b): pairs of kinds (fork and join, lock and unlock) whose points-to sets targets(module, node, tgt) meet."""
    k = nodes.select("module", "node", "kind").join(targets, ["module", "node"])
    a = k.where(F.col("kind") == first).select("module", F.col("node").alias("a"), "tgt")
    b = k.where(F.col("kind") == second).select("module", F.col("node").alias("b"), "tgt")
    return a.join(b, ["module", "tgt"]).select("module", "a", "b").distinct()


def critical_sections(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(module, lock, node): nodes between a lock and its unlocks: reachable from it without passing one; the unlocks are in.
    pairs(module, a, b): locks and their unlocks."""
    unlock = pairs.select("module", F.col("a").alias("lock"), F.col("b").alias("src"))
    seeds = pairs.select("module", F.col("a").alias("lock")).distinct().join(edges.select("module", F.col("src").alias("lock"), "dst"), ["module", "lock"]).select("module", "lock", F.col("dst").alias("node"))

    def step(front: DataFrame) -> DataFrame:
        return front.withColumnRenamed("node", "src").join(unlock, ["module", "lock", "src"], "left_anti").join(edges, ["module", "src"]).select("module", "lock", F.col("dst").alias("node"))

    return fixpoint(seeds, step, "sections", hops=3)


def solve_parallel(rows: list[tuple]) -> Iterator[tuple]:
    """(r1, r2) of one module, each once, rows (region, null) and edges (src, dst): neither comes before the other."""
    number = {r: i for i, r in enumerate(sorted({x for row in rows for x in row if x is not None}))}
    names = list(number)
    succ = [0] * len(names)
    for a, b in rows:
        if a is not None and b is not None:
            succ[number[a]] |= 1 << number[b]
    after = []
    for direct in succ:
        seen = new = direct
        while new:
            low = new & -new
            more = succ[low.bit_length() - 1] & ~seen
            seen |= more
            new = new ^ low | more
        after.append(seen)
    asked = sorted({a for a, b in rows if b is None and a is not None})
    for i, r1 in enumerate(asked):
        mine, at = after[number[r1]], number[r1]
        yield from ((r1, r2) for r2 in asked[i + 1 :] if not (mine >> number[r2] & 1 or after[number[r2]] >> at & 1))


#: Regions and edges of a module that a task solves at once; one that has more goes by relations.
LARGE_MODULE = 4_000


def parallel_by_edges(region: DataFrame, edges: DataFrame, large: int = LARGE_MODULE) -> DataFrame:
    """parallel(region, order) of region_edges() whose closure is the order: each module's regions and edges meet, so that
    neither the order nor all pairs are tables. Modules of more than large of them go that way."""
    r = region.select("module", F.col("region").alias("a"), F.lit(None).cast("long").alias("b")).distinct()
    e = edges.select("module", F.col("src_region").alias("a"), F.col("dst_region").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    rows = r.unionByName(e).where("module IS NOT NULL")
    few, many = split_by_size(rows, MODULE, large)
    one = lambda df: per_group(df, MODULE, lambda _, group: solve_parallel(group), "module long, r1 long, r2 long")
    if many is None:
        return one(rows)
    mine = edges.join(many, "module", "left_semi").select("module", F.col("src_region").alias("src"), F.col("dst_region").alias("dst"))
    rest = parallel(region.join(many, "module", "left_semi"), closure(mine, MODULE, "order"))
    return rest if few is None else rest.unionByName(one(rows.join(few, "module", "left_semi")))


def parallel(region: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(module, r1, r2), r1 < r2: regions that may run at once: all pairs of a module; with order, the closure of
    region_edges(), only those of which neither comes before the other."""
    r = region.select("module", "region").distinct()
    both = r.select("module", F.col("region").alias("r1")).join(r.select("module", F.col("region").alias("r2")), "module").where("r1 < r2")
    if order is None:
        return both
    fwd = order.select("module", F.col("src").alias("r1"), F.col("dst").alias("r2"))
    back = order.select("module", F.col("dst").alias("r1"), F.col("src").alias("r2"))
    return both.join(fwd, ["module", "r1", "r2"], "left_anti").join(back, ["module", "r1", "r2"], "left_anti")


def interference(region: DataFrame, access: DataFrame, pairs: DataFrame) -> DataFrame:
    """(module, store, load): accesses(module, node, op, obj, off) in regions of pairs(module, r1, r2) that may meet: the same
    object, and offsets equal or one unknown (null). Three equi-joins in place of one with a disjunction."""
    a = access.join(region, ["module", "node"])
    s = a.where("op = 'store'").select("module", F.col("node").alias("store"), F.col("region").alias("rs"), "obj", F.col("off").alias("so"))
    l = a.where("op = 'load'").select("module", F.col("node").alias("load"), F.col("region").alias("rl"), "obj", F.col("off").alias("lo"))  # noqa: E741
    same = s.where("so IS NOT NULL").join(l.where("lo IS NOT NULL").withColumnRenamed("lo", "so"), ["module", "obj", "so"]).select("module", "store", "load", "rs", "rl")
    any_store = s.where("so IS NULL").join(l, ["module", "obj"]).select("module", "store", "load", "rs", "rl")
    any_load = s.where("so IS NOT NULL").join(l.where("lo IS NULL"), ["module", "obj"]).select("module", "store", "load", "rs", "rl")
    meet = same.unionByName(any_store).unionByName(any_load).withColumn("r1", F.least("rs", "rl")).withColumn("r2", F.greatest("rs", "rl"))
    return meet.join(pairs, ["module", "r1", "r2"], "left_semi").select("module", "store", "load").distinct()


def section_edges(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """(module, src, dst): a lock controls its section, and its unlocks control it."""
    return sections.select("module", F.col("lock").alias("src"), F.col("node").alias("dst")).unionByName(pairs.select("module", F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
