"""Control dependence over av(fn, t, src, dst): dst can be reached from src without entering t.

All variants are positive queries over that one closure and its complement; see the docstrings for the definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixpoint import closure, fixpoint, reach
from ..functions.store import materialize


def av(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, t, src, dst): paths of at least one edge in the graph without t, for every node t. Linear recursion: each path
    is extended by the edges alone, which aren't multiplied by t; path doubling would join many times more rows."""
    start = edges.join(nodes.select("fn", F.col("node").alias("t")), "fn").where("t <> src AND t <> dst").select("fn", "t", "src", "dst")
    onwards = edges.select("fn", F.col("src").alias("dst"), F.col("dst").alias("to"))

    def step(front: DataFrame) -> DataFrame:
        return front.join(onwards, ["fn", "dst"]).where("to <> t").select("fn", "t", "src", F.col("to").alias("dst")).distinct()

    return fixpoint(start, step, "av", hops=3)


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("fn", "node").join(edges.select("fn", F.col("src").alias("node")).distinct(), ["fn", "node"], "left_anti")


def avoid(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(fn, n, t): some maximal path from n never meets t: n <> t and n is a sink, or reaches without t a sink or a node on a
    cycle. Its complement is "all maximal paths from n meet t"."""
    ends = sinks(nodes, edges)
    own = ends.select("fn", F.col("node").alias("n")).join(nodes.select("fn", F.col("node").alias("t")), "fn").where("n <> t")
    cyc = paths.where("src = dst").select("fn", "t", F.col("src").alias("dst")).distinct()
    to_cycle = paths.join(cyc, ["fn", "t", "dst"], "left_semi").select("fn", F.col("src").alias("n"), "t")
    to_sink = paths.join(ends.select("fn", F.col("node").alias("dst")), ["fn", "dst"], "left_semi").select("fn", F.col("src").alias("n"), "t")
    return own.select("fn", "n", "t").unionByName(to_cycle).unionByName(to_sink).distinct()


def all_max_paths(nodes: DataFrame, avoids: DataFrame) -> DataFrame:
    """(fn, n, t): every maximal path from n meets t (n itself included)."""
    pairs = nodes.select("fn", F.col("node").alias("n")).join(nodes.select("fn", F.col("node").alias("t")), "fn")
    return pairs.join(avoids, ["fn", "n", "t"], "left_anti")


def ntscd(nodes: DataFrame, edges: DataFrame, avoids: DataFrame, reflexive: bool = False) -> DataFrame:
    """(fn, node, depends_on): non-termination sensitive control dependence: one successor of a branching node can avoid the
    node and another can't. reflexive also keeps nodes that depend on themselves, as two of the known algorithms do."""
    t = nodes.select("fn", F.col("node").alias("t"))
    pairs = edges.join(t, "fn").join(avoids.select("fn", F.col("n").alias("dst"), "t", F.lit(1).alias("a")), ["fn", "dst", "t"], "left")
    told = pairs.groupBy("fn", "t", "src").agg(F.max(F.coalesce("a", F.lit(0))).alias("some"), F.min(F.coalesce("a", F.lit(0))).alias("every")).where("some = 1 AND every = 0")
    told = told if reflexive else told.where("t <> src")
    return told.select("fn", F.col("t").alias("node"), F.col("src").alias("depends_on"))


def post_dominators(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(fn, node, pdom): every path from node to an exit meets pdom; itself included. Only for nodes that reach an exit."""
    ends = sinks(nodes, edges)
    all_paths = closure(edges, ("fn",), "paths")
    out = all_paths.join(ends.select("fn", F.col("node").alias("dst")), ["fn", "dst"], "left_semi").select("fn", F.col("src").alias("node")).unionByName(ends).distinct()
    escapes = paths.join(ends.select("fn", F.col("node").alias("dst")), ["fn", "dst"], "left_semi").select("fn", F.col("src").alias("node"), F.col("t").alias("pdom"))
    own = ends.join(nodes.select("fn", F.col("node").alias("pdom")), "fn").where("node <> pdom").select("fn", "node", "pdom")
    pairs = out.join(nodes.select("fn", F.col("node").alias("pdom")), "fn")
    return pairs.join(escapes.unionByName(own).distinct(), ["fn", "node", "pdom"], "left_anti").select("fn", "node", "pdom")


def scd(nodes: DataFrame, edges: DataFrame, paths: DataFrame | None = None, pdom: DataFrame | None = None) -> DataFrame:
    """(fn, node, depends_on): standard control dependence by post-dominance frontiers: node post-dominates a successor of
    depends_on and doesn't strictly post-dominate depends_on. In functions without exit every branch controls its
    successors. Of paths (av) or of pdom, post_dominators() already made, one is needed."""
    pd_ = pdom if pdom is not None else materialize(post_dominators(nodes, edges, paths), "pdom")
    cand = edges.join(pd_.select("fn", F.col("node").alias("dst"), F.col("pdom").alias("b")), ["fn", "dst"]).select("fn", "b", "src").distinct()
    strict = pd_.where("node <> pdom").select("fn", F.col("pdom").alias("b"), F.col("node").alias("src"))
    main = cand.join(strict, ["fn", "b", "src"], "left_anti")
    endless = nodes.select("fn").distinct().join(sinks(nodes, edges).select("fn").distinct(), "fn", "left_anti")
    fall = edges.join(endless, "fn", "left_semi").select("fn", F.col("dst").alias("b"), "src")
    branch = edges.groupBy("fn", "src").count().where("count > 1").select("fn", "src")
    return main.unionByName(fall.distinct()).join(branch, ["fn", "src"], "left_semi").select("fn", F.col("b").alias("node"), F.col("src").alias("depends_on")).distinct()


def dominators(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(fn, node, dom): every path from the root, node 1, to node meets dom; itself included; reachable nodes only."""
    reached = reach(edges, nodes.where("node = 1").select("fn", "node"), ("fn",))
    around = paths.where("src = 1").select("fn", F.col("dst").alias("node"), F.col("t").alias("dom")).unionByName(
        nodes.select("fn", F.lit(1).cast("long").alias("node"), F.col("node").alias("dom")).where("dom <> 1"))
    return reached.join(nodes.select("fn", F.col("node").alias("dom")), "fn").join(around.distinct(), ["fn", "node", "dom"], "left_anti").select("fn", "node", "dom")


def dominance_frontier(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(fn, node, frontier): node dominates a predecessor of frontier but not frontier strictly."""
    over = edges.join(dom.select("fn", F.col("node").alias("src"), F.col("dom").alias("a")), ["fn", "src"]).select("fn", "a", "dst").distinct()
    strict = dom.where("node <> dom").select("fn", F.col("dom").alias("a"), F.col("node").alias("dst"))
    return over.join(strict, ["fn", "a", "dst"], "left_anti").select("fn", F.col("a").alias("node"), F.col("dst").alias("frontier"))


def dod(nodes: DataFrame, edges: DataFrame, paths: DataFrame, avoids: DataFrame) -> DataFrame:
    """(fn, p, a, b), a < b: decisive order dependence: all maximal paths from p meet both a and b, from one successor a comes
    first on all of them, from another b does."""
    must = materialize(all_max_paths(nodes, avoids), "must")
    met = must.where("n <> t")
    branch = edges.groupBy("fn", "src").count().where("count > 1").select("fn", F.col("src").alias("n"))
    on = met.join(branch, ["fn", "n"], "left_semi")
    pairs = on.select("fn", F.col("n").alias("p"), F.col("t").alias("a")).join(on.select("fn", F.col("n").alias("p"), F.col("t").alias("b")), ["fn", "p"]).where("a <> b")
    s = pairs.join(edges.select("fn", F.col("src").alias("p"), F.col("dst").alias("s")), ["fn", "p"]).where("s <> b")
    s = s.join(must.select("fn", F.col("n").alias("s"), F.col("t").alias("a")), ["fn", "s", "a"], "left_semi")
    around = paths.select("fn", F.col("t").alias("a"), F.col("src").alias("s"), F.col("dst").alias("b"))
    first = s.join(around, ["fn", "a", "s", "b"], "left_anti").select("fn", "p", "a", "b").distinct()
    return first.alias("x").join(first.alias("y"), F.expr("x.fn = y.fn AND x.p = y.p AND x.a = y.b AND x.b = y.a AND x.a < x.b"), "left_semi")


def dod_ntscd(nodes: DataFrame, edges: DataFrame, order: DataFrame, avoids: DataFrame) -> DataFrame:
    """(fn, node, depends_on): nodes on all maximal paths of one successor of a branch and not of another, and both nodes of
    each pair whose order the branch decides, order being dod()'s rows."""
    both = order.select("fn", F.explode(F.array("a", "b")).alias("node"), F.col("p").alias("depends_on"))
    return ntscd(nodes, edges, avoids, reflexive=True).unionByName(both).distinct()


def strong_closure(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(fn, node): least strongly control-closed set with the seeds. Each round adds every p that has an edge to r, where p is
    reachable from the set, r meets exactly one first member of the set and can't avoid the set, and p either meets two
    or can avoid it. Members found are rechecked with the larger set, as both conditions depend on it."""
    inside = materialize(seeds.select("fn", "node").distinct(), "closed")
    all_paths = closure(edges, ("fn",), "paths")
    ends = sinks(nodes, edges)
    for _ in range(max_rounds):
        member = inside.select("fn", F.col("node").alias("dst"), F.lit(True).alias("m"))
        open_ = edges.join(inside.select("fn", F.col("node").alias("src")), ["fn", "src"], "left_anti").join(inside.select("fn", F.col("node").alias("dst")), ["fn", "dst"], "left_anti")
        free = closure(open_, ("fn",), "free")  # paths outside the set
        step = edges.join(inside.select("fn", F.col("node").alias("src")), ["fn", "src"], "left_anti").join(member, ["fn", "dst"]).select("fn", "src", "dst")
        first = step.unionByName(free.withColumnRenamed("dst", "mid").join(step.withColumnRenamed("src", "mid"), ["fn", "mid"]).select("fn", "src", "dst")).unionByName(inside.select("fn", F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()
        theta = first.groupBy("fn", F.col("src").alias("node")).agg(F.count("*").alias("n"))
        outside = nodes.select("fn", "node").join(inside, ["fn", "node"], "left_anti")
        stuck = outside.join(ends, ["fn", "node"], "left_semi").unionByName(free.where("src = dst").select("fn", F.col("src").alias("node"))).distinct()
        gamma = stuck.unionByName(free.join(stuck.withColumnRenamed("node", "dst"), ["fn", "dst"], "left_semi").select("fn", F.col("src").alias("node"))).distinct()
        reached = all_paths.join(inside.select("fn", F.col("node").alias("src")), ["fn", "src"], "left_semi").select("fn", F.col("dst").alias("node")).distinct()
        r = theta.where("n = 1").join(gamma, ["fn", "node"], "left_anti").select("fn", F.col("node").alias("dst"))
        p = theta.where("n >= 2").select("fn", "node").unionByName(gamma).distinct().join(reached, ["fn", "node"], "left_semi").select("fn", F.col("node").alias("src"))
        new = edges.join(r, ["fn", "dst"], "left_semi").join(p, ["fn", "src"], "left_semi").select("fn", F.col("src").alias("node")).distinct().join(inside, ["fn", "node"], "left_anti")
        new = materialize(new, "closed")
        if new.isEmpty():
            return inside
        inside = materialize(inside.unionByName(new), "closed")
    raise RuntimeError("control closure: too many rounds")


def no_return(nodes: DataFrame, edges: DataFrame, calls: DataFrame, returns: DataFrame) -> DataFrame:
    """(fn, node): points after which a function may not go on: sinks that aren't returns(fn, node), and calls of functions
    that have such a point."""
    stops = sinks(nodes, edges).join(returns, ["fn", "node"], "left_anti")

    def step(front: DataFrame) -> DataFrame:
        return front.select(F.col("fn").alias("callee")).distinct().join(calls, "callee").select(F.col("caller").alias("fn"), F.col("call").alias("node"))

    return fixpoint(stops, step, "noret", hops=1)


def interprocedural(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(fn, node, depends_on): everything that a point of no return reaches depends on it."""
    seeds = points.select("fn", "node", F.col("node").alias("depends_on"))
    return reach(edges, seeds, ("fn",)).where("node <> depends_on")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(fn, only_a, only_b): numbers of dependences that one result has and the other hasn't."""
    cols = ["fn", "node", "depends_on"]
    x, y = a.select(cols).withColumn("a", F.lit(1)), b.select(cols).withColumn("b", F.lit(1))
    both = x.join(y, cols, "full")
    return both.groupBy("fn").agg(F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))
