"""What one pass over a function's control flow tells: paths, dominance, post-dominance, avoidable nodes, decided orders.

A function's graph is solved where its rows meet, with sets of nodes as bits of integers: a search per node, no relation
of all paths around all nodes. Functions of more rows than a task should hold go the relational way of control.py.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixpoint import closure
from ..functions.grouped import per_group, split_by_size
from ..functions.store import materialize
from . import control as C
from . import graph as G

#: Nodes and edges of a function that is solved in one pass.
LARGE_FUNCTION = 4_000
KINDS = {"path": ("src", "dst"), "avoid": ("n", "t"), "dom": ("node", "dom"), "pdom": ("node", "pdom"), "dod": ("p", "a", "b")}


class Graph:
    """Nodes numbered from 0, successors and predecessors as bits."""

    def __init__(self, nodes: list[int], edges: list[tuple[int, int]]):
        self.names = sorted(set(nodes))
        number = {n: i for i, n in enumerate(self.names)}
        self.succ, self.pred = [0] * len(self.names), [0] * len(self.names)
        for a, b in edges:
            if a in number and b in number:
                self.succ[number[a]] |= 1 << number[b]
                self.pred[number[b]] |= 1 << number[a]
        self.all = (1 << len(self.names)) - 1
        self.exits = sum(1 << i for i, s in enumerate(self.succ) if not s)

    @staticmethod
    def bits(x: int) -> Iterator[int]:
        while x:
            low = x & -x
            yield low.bit_length() - 1
            x ^= low

    @staticmethod
    def spread(start: int, onto: list[int], within: int) -> int:
        """start and what it leads to inside within."""
        seen = new = start & within
        while new:
            step = 0
            for i in Graph.bits(new):
                step |= onto[i]
            new = step & within & ~seen
            seen |= new
        return seen

    def onwards(self, i: int, within: int) -> int:
        """What paths of an edge or more lead to inside within."""
        return self.spread(self.succ[i], self.succ, within)

    def surely(self, t: int) -> int:
        """The nodes all of whose maximal paths meet t: coloured from t backwards, a node once all its successors are."""
        red = new = 1 << t
        while new:
            near = 0
            for i in self.bits(new):
                near |= self.pred[i]
            new = 0
            for i in self.bits(near & ~red):
                if not self.succ[i] & ~red:
                    new |= 1 << i
            red |= new
        return red


def solve_post_dominators(rows: list[tuple]) -> Iterator[tuple]:
    """The rows of kind pdom of solve_function() alone."""
    g = Graph([a for a, b in rows if b is None], [(a, b) for a, b in rows if b is not None])
    out = Graph.spread(g.exits, g.pred, g.all)
    for t, name in enumerate(g.names):
        free = Graph.spread(g.exits, g.pred, g.all & ~(1 << t))
        yield from (("pdom", g.names[i], name, None) for i in Graph.bits(out & ~free))


def solve_function(rows: list[tuple]) -> Iterator[tuple]:
    """(kind, a, b, c) of one function, rows (node, null) and (src, dst); its root is node 1."""
    g = Graph([a for a, b in rows if b is None], [(a, b) for a, b in rows if b is not None])
    name, n = g.names, len(g.names)
    out = Graph.spread(g.exits, g.pred, g.all)  # what reaches an exit
    root = name.index(1) if 1 in name else None
    reached = Graph.spread(1 << root, g.succ, g.all) if root is not None else 0
    must = [0] * n  # by node: what all its maximal paths meet
    for i in range(n):
        yield from (("path", name[i], name[j], None) for j in Graph.bits(g.onwards(i, g.all)))
    for t in range(n):
        red, rest = g.surely(t), g.all & ~(1 << t)
        for i in Graph.bits(red):
            must[i] |= 1 << t
        yield from (("avoid", name[i], name[t], None) for i in Graph.bits(g.all & ~red))
        free = Graph.spread(g.exits, g.pred, rest)
        yield from (("pdom", name[i], name[t], None) for i in Graph.bits(out & ~free))
        around = Graph.spread(1 << root, g.succ, rest) if root is not None and root != t else 0
        yield from (("dom", name[i], name[t], None) for i in Graph.bits(reached & ~around))
    for p in range(n):
        both = must[p] & ~(1 << p)
        if g.succ[p].bit_count() < 2 or both.bit_count() < 2:
            continue
        first: set[tuple[int, int]] = set()  # (a, b): from a successor a comes before b on every path
        for a in Graph.bits(both):
            for s in Graph.bits(g.succ[p]):
                if must[s] >> a & 1:
                    met = g.onwards(s, g.all & ~(1 << a)) if s != a else 0
                    first.update((a, b) for b in Graph.bits(both & ~met & ~(1 << a) & ~(1 << s)))
        yield from (("dod", name[p], name[a], name[b]) for a, b in first if a < b and (b, a) in first)


def post_dominators(nodes: DataFrame, edges: DataFrame, large: int = LARGE_FUNCTION) -> DataFrame:
    """(fn, node, pdom): facts()' rows of that kind, without making the others."""
    rows = nodes.select("fn", F.col("node").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(edges.select("fn", F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    few, many = split_by_size(rows, ["fn"], large)
    told = lambda df: per_group(df, ["fn"], lambda _, group: solve_post_dominators(group), "fn long, kind string, a long, b long, c long").select("fn", F.col("a").alias("node"), F.col("b").alias("pdom"))
    if many is None:
        return told(rows)
    v, e = nodes.join(many, "fn", "left_semi"), edges.join(many, "fn", "left_semi")
    rest = C.post_dominators(v, e, C.av(v, e))
    return rest if few is None else rest.unionByName(told(rows.join(few, "fn", "left_semi")))


def facts(nodes: DataFrame, edges: DataFrame, large: int = LARGE_FUNCTION) -> dict[str, DataFrame]:
    """path(fn, src, dst), avoid(fn, n, t), dom(fn, node, dom), pdom(fn, node, pdom), dod(fn, p, a, b), as control.py says,
    of nodes(fn, node) and edges(fn, src, dst)."""
    rows = nodes.select("fn", F.col("node").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(edges.select("fn", F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    few, many = split_by_size(rows, ["fn"], large)
    out: dict[str, DataFrame] = {}
    if few is not None or many is None:
        mine = rows if many is None else rows.join(few, "fn", "left_semi")
        told = materialize(per_group(mine, ["fn"], lambda _, group: solve_function(group), "fn long, kind string, a long, b long, c long"), "flow")
        out = {kind: told.where(F.col("kind") == kind).select("fn", *[F.col(x).alias(y) for x, y in zip("abc", names, strict=False)]) for kind, names in KINDS.items()}
    if many is not None:
        v, e = nodes.join(many, "fn", "left_semi"), edges.join(many, "fn", "left_semi")
        av = C.av(v, e)
        avoid = materialize(C.avoid(v, e, av), "avoid")
        rest = {"path": closure(e, ("fn",), "paths"), "avoid": avoid, "dom": C.dominators(v, e, av), "pdom": C.post_dominators(v, e, av), "dod": C.dod(v, e, av, avoid)}
        out = {kind: out[kind].unionByName(rest[kind]) if kind in out else rest[kind] for kind in KINDS}
    return out


def solve_loops(rows: list[tuple]) -> Iterator[tuple]:
    """(head, node, null) of the loops' bodies and (head, src, dst) of the edges that leave them, of one function's edges."""
    g = Graph([x for e in rows for x in e], rows)
    number = {v: i for i, v in enumerate(g.names)}
    for head in sorted({b for a, b in rows if b <= a}):
        i = number[head]
        ahead = g.onwards(i, g.all)
        if not any(b == head and (a == b or a > b and ahead >> number[a] & 1) for a, b in rows):
            continue
        body = 1 << i | ahead & g.spread(g.pred[i], g.pred, g.all)
        yield from ((head, g.names[j], None) for j in g.bits(body))
        yield from ((head, g.names[j], g.names[k]) for j in g.bits(body) for k in g.bits(g.succ[j] & ~body))


def loops(edges: DataFrame, exits: bool, large: int = LARGE_FUNCTION) -> DataFrame:
    """graph.loop_bodies() or, with exits, graph.loop_exits() of edges(fn, src, dst), without a relation of all paths;
    functions of more than large edges go that way."""
    edges = edges.select("fn", "src", "dst").where("fn is not null and src is not null and dst is not null").distinct()
    few, many = split_by_size(edges, ["fn"], large)
    told = lambda df: per_group(df, ["fn"], lambda _, group: solve_loops(group), "fn long, head long, src long, dst long")
    one = lambda df: told(df).where("dst is not null") if exits else told(df).where("dst is null").select("fn", "head", F.col("src").alias("node"))
    if many is None:
        return one(edges)
    e = edges.join(many, "fn", "left_semi")
    rest = G.loop_bodies(closure(e, ("fn",), "paths"), e)
    rest = G.loop_exits(rest, e) if exits else rest
    return rest if few is None else rest.unionByName(one(edges.join(few, "fn", "left_semi")))


def solve_strong_closure(rows: list[tuple]) -> Iterator[tuple]:
    """(node,) of one function's closure, rows (node, null, seed) and (src, dst, null); by rounds as in strong_closure()."""
    g = Graph([a for a, b, _ in rows if b is None], [(a, b) for a, b, _ in rows if b is not None])
    number = {v: i for i, v in enumerate(g.names)}
    inside = sum(1 << i for i in {number[a] for a, b, seed in rows if b is None and seed})
    far = [g.onwards(i, g.all) for i in range(len(g.names))]
    while True:
        outside = g.all & ~inside
        onto = 0  # what the set leads to
        for i in g.bits(inside):
            onto |= far[i]
        first, loops = [0] * len(g.names), g.exits & outside
        for i in range(len(g.names)):
            if inside >> i & 1:
                first[i] = 1 << i
                continue
            for j in g.bits(g.spread(1 << i, g.succ, outside)):
                first[i] |= g.succ[j] & inside
            if g.onwards(i, outside) >> i & 1:
                loops |= 1 << i
        escapes = g.spread(loops, g.pred, outside)
        sure = sum(1 << i for i, x in enumerate(first) if x.bit_count() == 1) & ~escapes
        torn = (sum(1 << i for i, x in enumerate(first) if x.bit_count() > 1) | escapes) & onto
        new = sum(1 << i for i in g.bits(torn & outside) if g.succ[i] & sure)
        if not new:
            yield from ((g.names[i],) for i in g.bits(inside))
            return
        inside |= new


def strong_closure(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, large: int = LARGE_FUNCTION) -> DataFrame:
    """(fn, node): least strongly control-closed set with the seeds, as control.strong_closure() defines it; functions of up
    to large nodes and edges one by one where their rows meet."""
    marked = nodes.select("fn", "node").join(seeds.select("fn", "node").distinct().withColumn("seed", F.lit(True)), ["fn", "node"], "left")
    rows = marked.select("fn", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.coalesce("seed", F.lit(False)).alias("seed"))
    rows = rows.unionByName(edges.select("fn", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("boolean").alias("seed")).distinct())
    few, many = split_by_size(rows, ["fn"], large)
    one = lambda df: per_group(df, ["fn"], lambda _, group: solve_strong_closure(group), "fn long, node long")
    if many is None:
        return one(rows)
    mine = lambda df: df.join(many, "fn", "left_semi")
    out = C.strong_closure(mine(nodes), mine(edges), mine(seeds))
    return out if few is None else out.unionByName(one(rows.join(few, "fn", "left_semi")))
