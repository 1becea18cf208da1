"""Generic graph operators over edge tables (keys, src, dst): degrees, walks, components, blocks, loops, checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixpoint import closure, fixpoint, reach
from ..functions.grouped import LARGE, per_group, split_by_size
from ..functions.store import materialize

FN = ("fn",)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, node, n_out, n_in): one aggregate over both ends of each edge."""
    ends = edges.select("fn", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("fn", "e.*")
    ends = ends.unionByName(nodes.select("fn", "node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return ends.groupBy("fn", "node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def bfs(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(fn, node, depth): least number of edges from a seed; one round a level, known nodes leave the frontier."""
    first = seeds.select("fn", "node").distinct().withColumn("depth", F.lit(0).cast("long"))
    known = front = first
    from ..functions.store import materialize

    known = front = materialize(first, "bfs")
    while True:
        new = front.join(edges.withColumnRenamed("src", "node"), ["fn", "node"]).select("fn", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        front = materialize(new.join(known.select("fn", "node"), ["fn", "node"], "left_anti"), "bfs")
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def walk(edges: DataFrame, seeds: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Nodes that a walk over edges(fn, src, dst, etype) of the given kinds visits; a kind "rev_x" walks x backwards."""
    forward = edges.where(F.col("etype").isin(*[k for k in kinds if not k.startswith("rev_")])).select("fn", "src", "dst")
    back = edges.where(F.col("etype").isin(*[k[4:] for k in kinds if k.startswith("rev_")])).select("fn", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(forward.unionByName(back).distinct(), seeds, FN)


def icfg(edges: DataFrame, calls: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """(src_fn, src, dst_fn, dst): control flow where a call to a function with an entry goes to it instead of onwards, and the
    function's exits go to where the call would have gone. calls(caller, call, callee); entries, exits(fn, node)."""
    e, known = edges.alias("e"), calls.join(entries.select(F.col("fn").alias("callee")).distinct(), "callee", "left_semi")
    sites = known.select(F.col("caller").alias("fn"), F.col("call").alias("src")).distinct()
    plain = edges.join(sites, ["fn", "src"], "left_anti").select(F.col("fn").alias("src_fn"), "src", F.col("fn").alias("dst_fn"), "dst")
    into = known.alias("k").join(entries.alias("n"), F.expr("n.fn = k.callee")).selectExpr("k.caller AS src_fn", "k.call AS src", "n.fn AS dst_fn", "n.node AS dst")
    back = known.alias("k").join(exits.alias("x"), F.expr("x.fn = k.callee")).join(e, F.expr("e.fn = k.caller AND e.src = k.call")).selectExpr("x.fn AS src_fn", "x.node AS src", "e.fn AS dst_fn", "e.dst AS dst")
    return plain.unionByName(into).unionByName(back).distinct()


def icfg_reach(flow: DataFrame, seeds: DataFrame) -> DataFrame:
    """(fn, node) reachable from seeds(fn, node) over icfg()'s edges."""
    def step(front: DataFrame) -> DataFrame:
        return front.select(F.col("fn").alias("src_fn"), F.col("node").alias("src")).join(flow, ["src_fn", "src"]).select(F.col("dst_fn").alias("fn"), F.col("dst").alias("node"))

    return fixpoint(seeds.select("fn", "node"), step, "icfg-reach", hops=3)


def scc(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(fn, node, scc): strongly connected component, named by its smallest node; paths is the closure of the edges."""
    mutual = paths.alias("p").join(paths.alias("q"), F.expr("p.fn = q.fn AND p.src = q.dst AND p.dst = q.src")).select("p.fn", F.col("p.src").alias("node"), F.col("p.dst").alias("other"))
    both = mutual.unionByName(nodes.select("fn", "node", F.col("node").alias("other")))
    return both.groupBy("fn", "node").agg(F.min("other").alias("scc"))


def condensation(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(fn, scc_src, scc_dst): edges between different components."""
    a = comp.select("fn", F.col("node").alias("src"), F.col("scc").alias("scc_src"))
    b = comp.select("fn", F.col("node").alias("dst"), F.col("scc").alias("scc_dst"))
    return edges.join(a, ["fn", "src"]).join(b, ["fn", "dst"]).where("scc_src <> scc_dst").select("fn", "scc_src", "scc_dst").distinct()


def loops(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(fn, node, loop): nodes on a cycle: in a component of several nodes, or with an edge to themselves."""
    size = Window.partitionBy("fn", "scc")
    many = comp.withColumn("n", F.count("*").over(size)).where("n > 1").select("fn", "node", "scc")
    own = edges.where("src = dst").select("fn", F.col("src").alias("node"))
    return many.unionByName(comp.join(own, ["fn", "node"], "left_semi")).distinct().withColumnRenamed("scc", "loop")


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, node): first nodes of basic blocks: the root, nodes with other than one predecessor, nodes after a branch."""
    pred = edges.groupBy("fn", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    branch = edges.groupBy("fn", "src").agg(F.count("*").alias("n_out")).where("n_out > 1")
    after = edges.join(branch, ["fn", "src"]).select("fn", F.col("dst").alias("node")).distinct().withColumn("after", F.lit(True))
    return nodes.join(pred, ["fn", "node"], "left").join(after, ["fn", "node"], "left").where("node = 1 OR coalesce(n_in, 0) <> 1 OR after").select("fn", "node")


def solve_blocks(rows: list[tuple]) -> Iterator[tuple]:
    """(node, leader) of a function, rows (leader, null) and (node, the one before it in its block)."""
    up = {node: before for node, before in rows if before is not None}
    block = {node: node for node, before in rows if before is None}
    for node in up:
        way = []
        while node is not None and node not in block:
            way.append(node)
            block[node] = None  # a circle without a leader is no block
            node = up.get(node)
        for x in way:
            block[x] = block.get(node)
    yield from ((node, leader) for node, leader in block.items() if leader is not None)


def blocks(nodes: DataFrame, edges: DataFrame, large: int = LARGE) -> DataFrame:
    """(fn, node, bb): the block of each node, named by its leader. Within a block every node has one predecessor, so
    each node points to one node at most: blocks are found where a function's pointers meet, or, in functions of more than
    large nodes, by doubling them."""
    lead = leaders(nodes, edges).select("fn", "node")
    first = lead.withColumn("first", F.lit(True))
    inner = nodes.select("fn", "node").join(first, ["fn", "node"], "left").where("first is null").select("fn", F.col("node").alias("dst"))
    up = edges.join(inner, ["fn", "dst"]).select("fn", F.col("dst").alias("src"), F.col("src").alias("dst")).where("dst IS NOT NULL")
    rows = materialize(up.unionByName(lead.select("fn", F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"))), "block-pointers")
    odd = rows.where("fn IS NULL OR src IS NULL").select("fn", F.col("src").alias("node"), F.col("src").alias("bb"))
    rows = rows.where("fn IS NOT NULL AND src IS NOT NULL")
    few, many = split_by_size(rows, FN, large)
    one = lambda df: per_group(df, FN, lambda _, group: solve_blocks(group), "fn long, node long, bb long").unionByName(odd)
    if many is None:
        return one(rows)
    mine = rows.join(many, "fn", "left_semi")
    back = closure(mine.where("dst IS NOT NULL"), FN, "blocks")
    leader = mine.where("dst IS NULL").select("fn", F.col("src").alias("node"), F.col("src").alias("bb"))
    inside = back.join(leader.select("fn", F.col("bb").alias("dst")), ["fn", "dst"]).select("fn", F.col("src").alias("node"), F.col("dst").alias("bb"))
    rest = inside.unionByName(leader)
    return rest.unionByName(odd) if few is None else rest.unionByName(one(rows.join(few, "fn", "left_semi")))


def split_calls(bbs: DataFrame, calls: DataFrame) -> DataFrame:
    """(fn, node, bb, part): blocks cut before and after each call of a defined function: a running count in node order."""
    call = calls.select(F.col("caller").alias("fn"), F.col("call").alias("node")).distinct().withColumn("c", F.lit(1))
    w = Window.partitionBy("fn", "bb").orderBy("node")
    marked = bbs.join(call, ["fn", "node"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    begins = F.col("c") + F.coalesce(F.lag("c").over(w), F.lit(0))
    return marked.withColumn("b", F.when(begins > 0, 1).otherwise(0)).withColumn("part", F.sum("b").over(w)).select("fn", "node", "bb", "part")


def loop_bodies(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, head, node): for each head of a back edge (an edge to a node that reaches its source) the nodes on a cycle with it."""
    back = edges.where("dst <= src").alias("b").join(paths.alias("p"), F.expr("p.fn = b.fn AND p.src = b.dst AND p.dst = b.src"), "left_semi")
    own = edges.where("src = dst")
    heads = back.select("fn", F.col("dst").alias("head")).unionByName(own.select("fn", F.col("dst").alias("head"))).distinct()
    to = paths.select("fn", F.col("src").alias("head"), F.col("dst").alias("node"))
    fro = paths.select("fn", F.col("src").alias("node"), F.col("dst").alias("head"))
    return heads.join(to, ["fn", "head"]).join(fro, ["fn", "node", "head"], "left_semi").select("fn", "head", "node").unionByName(heads.select("fn", "head", F.col("head").alias("node"))).distinct()


def loop_exits(bodies: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, head, src, dst): edges that leave a loop's body."""
    out = bodies.withColumnRenamed("node", "src").join(edges, ["fn", "src"])
    return out.join(bodies.withColumnRenamed("node", "dst"), ["fn", "head", "dst"], "left_anti").select("fn", "head", "src", "dst")


def invalid(nodes: DataFrame, edges: DataFrame, reachable: DataFrame) -> DataFrame:
    """(fn, node, error): dangling edge ends, duplicate edges, nodes that the root doesn't reach."""
    ids = nodes.select("fn", "node")
    dangling = edges.select("fn", F.explode(F.array("src", "dst")).alias("node")).distinct().join(ids, ["fn", "node"], "left_anti").withColumn("error", F.lit("dangling"))
    twice = edges.groupBy("fn", "src", "dst").count().where("count > 1").select("fn", F.col("src").alias("node"), F.lit("duplicate").alias("error"))
    lost = ids.join(reachable.select("fn", "node"), ["fn", "node"], "left_anti").withColumn("error", F.lit("unreachable"))
    return dangling.unionByName(twice).unionByName(lost)


def statistics(nodes: DataFrame, edges: DataFrame, bbs: DataFrame) -> DataFrame:
    """(fn, n_nodes, n_edges, n_blocks, n_branches, n_ends)."""
    out = edges.groupBy("fn", "src").agg(F.count("*").alias("n_out"))
    e = out.groupBy("fn").agg(F.sum("n_out").alias("n_edges"), F.count("*").alias("n_flow"), F.sum((F.col("n_out") > 1).cast("long")).alias("n_branches"))
    b = bbs.groupBy("fn").agg(F.countDistinct("bb").alias("n_blocks"))
    n = nodes.groupBy("fn").agg(F.count("*").alias("n_nodes"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return n.join(e, "fn", "left").join(b, "fn", "left").select("fn", "n_nodes", zero("n_edges"), zero("n_blocks"), zero("n_branches"), (F.col("n_nodes") - F.coalesce("n_flow", F.lit(0))).alias("n_ends"))


def dfs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fn, node, pre, post): depth-first numbers from each function's node 1, successors in order of id. Sequential by
    nature: one function's edges are walked in one task, without recursion."""
    def per_function(pdf: pd.DataFrame) -> pd.DataFrame:
        nxt: dict[int, list[int]] = {}
        for s, d in sorted(zip(pdf.src.tolist(), pdf.dst.tolist(), strict=True)):
            if d >= 0:
                nxt.setdefault(s, []).append(d)
        pre, post, clock = {}, {}, 0
        pre[1], stack = 0, [(1, iter(nxt.get(1, [])))]
        clock = 1
        while stack:
            at, rest = stack[-1]
            for d in rest:
                if d not in pre:
                    pre[d] = clock
                    clock += 1
                    stack.append((d, iter(nxt.get(d, []))))
                    break
            else:
                post[at] = clock
                clock += 1
                stack.pop()
        return pd.DataFrame({"fn": pdf.fn.iloc[0], "node": list(pre), "pre": list(pre.values()), "post": [post[n] for n in pre]})

    rows = edges.select("fn", "src", "dst").unionByName(nodes.where("node = 1").select("fn", F.col("node").alias("src"), F.lit(-1).cast("long").alias("dst")))
    return rows.groupBy("fn").applyInPandas(per_function, "fn long, node long, pre long, post long")


def edge_kinds(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """(fn, src, dst, kind): tree, back, forward or cross, from depth-first numbers; edges from unreached nodes are left out."""
    a = numbers.select("fn", F.col("node").alias("src"), F.col("pre").alias("a0"), F.col("post").alias("a1"))
    b = numbers.select("fn", F.col("node").alias("dst"), F.col("pre").alias("b0"), F.col("post").alias("b1"))
    both = edges.join(a, ["fn", "src"]).join(b, ["fn", "dst"])
    inner = F.expr("a0 <= b0 AND b1 <= a1 AND src <> dst")
    parent = F.max(F.when(F.expr("a0 < b0 AND b1 < a1"), F.col("a0"))).over(Window.partitionBy("fn", "dst"))
    kind = F.when(F.expr("b0 <= a0 AND a1 <= b1"), "back").when(inner & (F.col("a0") == F.col("parent")), "tree").when(inner, "forward").otherwise("cross")
    return both.withColumn("parent", parent).select("fn", "src", "dst", kind.alias("kind"))


def random_graph(spark, n_fn: int, n_nodes: int, n_edges: int, seed: int = 1) -> DataFrame:
    """(fn, src, dst): n_edges draws a function of edges with at most two successors a node, by hashes of the draw's number."""
    draw = lambda n: F.pmod(F.conv(F.left(F.md5(F.concat_ws(":", "id", F.lit(seed + n))), F.lit(12)), 16, 10).cast("long"), F.lit(n_nodes)) + 1
    draws = spark.range(n_fn * n_edges).select(F.expr(f"id div {n_edges}").alias("fn"), draw(0).alias("src"), draw(1).alias("dst"))
    w = Window.partitionBy("fn", "src").orderBy("dst")
    return draws.distinct().withColumn("i", F.row_number().over(w)).where("i <= 2").drop("i")
