"""Memory effects and reaching definitions at byte granularity.

sites(fn, node, pos, role, obj, lo, hi): role is def (may write), kill (must write), use; node is a block of the control
flow, pos the order inside. Every byte range is cut into the elementary segments of its object first.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.carried import LARGE_GRAPH, carried
from ..functions.fixpoint import fixpoint
from ..functions.grouped import per_group, split_by_size
from ..functions.store import materialize
from . import intervals as I  # noqa: E741

#: Sites and edges of a function whose reaching definitions are solved in one pass, and bits of a lot of its objects.
LARGE_FLOW, FLOW_BITS = 2_000, 1 << 16

#: Memory effects of library functions: (name, argument, role, offset, length, argument that holds the length).
LIBRARY = [
    ("memcpy", 0, "def", 0, None, 2), ("memcpy", 1, "use", 0, None, 2),
    ("memmove", 0, "def", 0, None, 2), ("memmove", 1, "use", 0, None, 2),
    ("memset", 0, "def", 0, None, 2),
    ("memcmp", 0, "use", 0, None, 2), ("memcmp", 1, "use", 0, None, 2),
    ("strlen", 0, "use", 0, None, None), ("strchr", 0, "use", 0, None, None), ("strrchr", 0, "use", 0, None, None),
    ("strcpy", 0, "def", 0, None, None), ("strcpy", 1, "use", 0, None, None),
    ("strncpy", 0, "def", 0, None, 2), ("strncpy", 1, "use", 0, None, 2),
]
LIBRARY_DDL = "name string, arg int, role string, off long, len long, len_arg int"
#: What calls of functions without a body may do; read_args is the default.
POLICIES = ("pure", "read_any", "write_any", "read_args", "write_args")


def accesses(stmts: DataFrame, pt: DataFrame) -> DataFrame:
    """(fn, node, pos, role, obj, lo, hi) of stores and loads, stmts(fn, node, pos, op, ptr, len), by points-to sets pt(fn, n,
    tgt, off), off -1 unknown. A store must write if its pointer has one target with a known offset, else it may. An
    unknown offset is the whole object."""
    n = F.count("*").over(Window.partitionBy("fn", "pos"))
    both = stmts.join(pt.withColumnRenamed("n", "ptr"), ["fn", "ptr"]).where("tgt >= 0").withColumn("n", n)
    role = F.when(F.col("op") == "load", "use").when((F.col("n") == 1) & (F.col("off") >= 0), "kill").otherwise("def")
    lo = F.when(F.col("off") >= 0, F.col("off")).otherwise(F.lit(0).cast("long"))
    hi = F.when(F.col("off") >= 0, F.col("off") + F.col("len") - 1)
    return both.select("fn", "node", "pos", role.alias("role"), F.col("tgt").alias("obj"), lo.alias("lo"), hi.alias("hi"))


def library_effects(calls: DataFrame, args: DataFrame, models: DataFrame) -> DataFrame:
    """(fn, pos, role, arg, off, len) of calls(fn, pos, name) by models; args(fn, pos, arg, value): constant arguments. len is
    null where it isn't known."""
    m = calls.join(F.broadcast(models), "name")  # a table of library functions
    got = m.join(args.select("fn", "pos", F.col("arg").alias("len_arg"), "value"), ["fn", "pos", "len_arg"], "left")
    return got.select("fn", "pos", "role", "arg", "off", F.coalesce("len", "value").alias("len"))


def undefined_effects(calls: DataFrame, args: DataFrame, policy: str = "read_args") -> DataFrame:
    """(fn, pos, role, arg) of calls of functions without a body: arg null stands for any memory."""
    if policy not in POLICIES:
        raise ValueError(policy)
    if policy == "pure":
        return calls.select("fn", "pos", F.lit("use").alias("role"), F.lit(None).cast("int").alias("arg")).limit(0)
    role = F.lit("use" if policy.startswith("read") else "def").alias("role")
    if policy.endswith("any"):
        return calls.select("fn", "pos", role, F.lit(None).cast("int").alias("arg"))
    return calls.join(args.select("fn", "pos", "arg").distinct(), ["fn", "pos"]).select("fn", "pos", role, "arg")


def segmented(sites: DataFrame) -> DataFrame:
    """sites with their elementary segments: (fn, node, pos, role, obj, seg), seg the segment's first byte."""
    named = sites.withColumnRenamed("fn", "module")
    e, s = I.elementary(named).alias("e"), I.bounded(named).alias("s")
    on = F.expr("e.module = s.module AND e.obj = s.obj AND s.lo <= e.lo AND e.hi <= s.hi")
    return e.join(s, on).select(F.col("s.module").alias("fn"), "s.node", "s.pos", "s.role", "s.obj", F.col("e.lo").alias("seg"))


def block_definitions(seg: DataFrame) -> DataFrame:
    """(fn, node, obj, seg, def, strong): what a block leaves in each segment: its last must-write and the may-writes after;
    strong: whether there is a must-write, so that nothing from before passes."""
    writes = seg.where("role <> 'use'")
    w = Window.partitionBy("fn", "node", "obj", "seg")
    last = F.max(F.when(F.col("role") == "kill", F.col("pos"))).over(w)
    return writes.withColumn("last", last).where("last is null OR pos >= last").select("fn", "node", "obj", "seg", F.col("pos").alias("def"), F.col("last").isNotNull().alias("strong"))


def flow_in(seg: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, node, obj, seg, def): definitions that reach the start of each block. Linear recursion; what a block kills is
    fixed beforehand."""
    left = block_definitions(seg)
    kills = left.where("strong").select("fn", "node", "obj", "seg").distinct()
    e = edges.select("fn", F.col("src").alias("node"), "dst")
    cols = ["fn", "node", "obj", "seg", "def"]
    anchor = left.join(e, ["fn", "node"]).select("fn", F.col("dst").alias("node"), "obj", "seg", "def")

    def step(front: DataFrame) -> DataFrame:
        return front.join(kills, ["fn", "node", "obj", "seg"], "left_anti").join(e, ["fn", "node"]).select("fn", F.col("dst").alias("node"), "obj", "seg", "def")

    return fixpoint(anchor.select(cols), step, "flow-in")


def parts(sites: dict, most: int = FLOW_BITS) -> Iterator[list[list[tuple]]]:
    """The objects' sites in lots of about so many bytes' bits; objects don't touch each other."""
    lot, size = [], 0
    for mine in sites.values():
        if lot and size + len(mine) ** 2 > most:
            yield lot
            lot, size = [], 0
        lot.append(mine)
        size += len(mine) ** 2
    if lot:
        yield lot


def solve_flow(rows: list[tuple]) -> Iterator[tuple]:
    """(use, def) of one function, each once: rows (node, pos, role, obj, lo, hi, null) of its sites, role "read" for
    reads of unknown memory, and (src, null, null, null, null, null, dst). A bit stands for a write in a segment."""
    succ: dict[int, set[int]] = {}
    sites: dict[int, list[tuple]] = {}
    reads, writes = [], {}
    for node, pos, role, obj, lo, hi, dst in rows:
        if role is None:
            succ.setdefault(node, set()).add(dst)
        elif role == "read":
            reads.append((pos, node))
        elif pos is not None and node is not None:
            if role != "use":
                writes.setdefault(node, []).append(pos)
            if obj is not None and lo is not None:
                sites.setdefault(obj, []).append((pos, node, role, lo, hi + 1))
    found: dict[int, set[int]] = {}
    for pos, node in reads:
        found.setdefault(pos, set()).update(d for d in writes.get(node, ()) if d < pos)
    for lot in parts(sites):
        at: dict[int, list[tuple]] = {}
        mask: list[int] = []  # by segment
        bits: list[tuple[int, int]] = []  # by bit: position, and the bits of the write
        for mine in lot:
            cuts = sorted({x for *_, lo, end in mine for x in (lo, end)})
            number = {x: i + len(mask) for i, x in enumerate(cuts)}
            mask += [0] * len(cuts)
            for pos, node, role, lo, end in mine:
                a, b = number[lo], number[end]
                first = len(bits)
                if role != "use" and a < b:
                    own = (1 << b - a) - 1 << first
                    bits += [(pos, own)] * (b - a)
                    for i in range(b - a):
                        mask[a + i] |= 1 << first + i
                at.setdefault(node, []).append((pos, role, a, b, first))
        gen, kill, asked = {}, {}, []
        for node, mine in at.items():
            mine.sort(key=lambda r: r[0])
            now: dict[int, int] = {}
            killed: set[int] = set()
            i = 0
            while i < len(mine):
                j = i
                while j < len(mine) and mine[j][0] == mine[i][0]:
                    j += 1
                fresh: dict[int, int] = {}
                dead: set[int] = set()
                for pos, role, a, b, first in mine[i:j]:
                    if role == "use":
                        local = far = 0
                        for x in range(a, b):
                            local |= now.get(x, 0)
                            if x not in killed:
                                far |= mask[x]
                        asked.append((pos, node, local, far))
                    else:
                        for x in range(a, b):
                            fresh[x] = fresh.get(x, 0) | 1 << first + x - a
                        if role == "kill":
                            dead.update(range(a, b))
                for x, new in fresh.items():
                    now[x] = new if x in dead else now.get(x, 0) | new
                killed |= dead
                i = j
            if now:
                gen[node] = functools.reduce(operator.or_, now.values())
                kill[node] = functools.reduce(operator.or_, (mask[x] for x in killed), 0)
        into: dict[int, int] = {}
        work = list(gen)
        while work:
            n = work.pop()
            out = gen.get(n, 0) | into.get(n, 0) & ~kill.get(n, 0)
            for d in succ.get(n, ()):
                before = into.get(d, 0)
                if out & ~before:
                    into[d] = before | out
                    work.append(d)
        asked += [(pos, node, 0, -1) for pos, node in reads]
        for pos, node, local, far in asked:
            rest = local | into.get(node, 0) & far
            mine = found.setdefault(pos, set()) if rest else None
            while rest:
                d, own = bits[(rest & -rest).bit_length() - 1]
                mine.add(d)
                rest &= ~own
    for use, defs in found.items():
        yield from ((use, d) for d in defs)


def solve_nodes(rows: list[tuple]) -> Iterator[tuple]:
    """(src, dst), each once: solve_flow()'s defs and uses by the nodes that they stand at."""
    at: dict[int, set[int]] = {}
    for node, pos, role, *_ in rows:
        if role is not None and pos is not None:
            at.setdefault(pos, set()).add(node)
    yield from {(src, dst) for use, d in solve_flow(rows) for src in at[d] for dst in at[use]}


def by_function(sites: DataFrame, edges: DataFrame, reads: DataFrame | None, rounds: Callable[..., DataFrame], large: int, solve: Callable[[list[tuple]], Iterator[tuple]] = solve_flow, names: tuple[str, str] = ("use", "def")) -> DataFrame:
    """(fn, names) of solve() where a function's rows meet; functions of more than large rows go through rounds."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = sites.select("fn", "node", "pos", "role", "obj", "lo", F.coalesce("hi", F.lit(I.MAX)).alias("hi"), none("long").alias("dst"))
    if reads is not None:
        rows = rows.where("role <> 'use'").unionByName(reads.select("fn", "node", "pos", F.lit("read").alias("role"), *[none("long").alias(c) for c in ("obj", "lo", "hi", "dst")]))
    rows = rows.unionByName(edges.select("fn", F.col("src").alias("node"), none("long").alias("pos"), none("string").alias("role"), *[none("long").alias(c) for c in ("obj", "lo", "hi")], "dst").distinct())
    rows = rows.where("fn is not null")
    few, many = split_by_size(rows, ["fn"], large)
    one = lambda df: per_group(df, ["fn"], lambda _, group: solve(group), f"fn long, {names[0]} long, {names[1]} long")
    if many is None:
        return one(rows)
    mine = lambda df: df.join(many, "fn", "left_semi")
    out = rounds(mine(sites), mine(edges), *([mine(reads)] if reads is not None else []))
    return out if few is None else out.unionByName(one(rows.join(few, "fn", "left_semi")))


def reaching(sites: DataFrame, edges: DataFrame, queries: DataFrame | None = None, large: int = LARGE_FLOW) -> DataFrame:
    """(fn, use, def): the writes that each use's bytes may come from; use and def are positions. queries: more uses
    (fn, node, pos, obj, lo, hi) that aren't part of the program. Functions of up to large sites and edges are solved one
    by one where their rows meet."""
    if queries is not None:
        sites = sites.unionByName(queries.withColumn("role", F.lit("use")))
    return by_function(sites, edges, None, reaching_in_rounds, large)


def reaching_in_rounds(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """reaching() by relations and rounds over all functions."""
    seg = segmented(sites)
    uses, writes = seg.where("role = 'use'").alias("u"), seg.where("role <> 'use'").alias("w")
    here = uses.join(writes, F.expr("u.fn = w.fn AND u.node = w.node AND u.obj = w.obj AND u.seg = w.seg AND w.pos < u.pos"), "left")
    here = here.select("u.fn", "u.node", "u.obj", "u.seg", F.col("u.pos").alias("use"), F.col("w.pos").alias("def"), F.col("w.role").alias("role"))
    last = F.max(F.when(F.col("role") == "kill", F.col("def"))).over(Window.partitionBy("fn", "node", "use", "obj", "seg"))
    here = here.withColumn("last", last)
    local = here.where("def is not null AND (last is null OR def >= last)").select("fn", "use", "def")
    open_ = here.where("last is null").select("fn", "node", "obj", "seg", "use").distinct()
    outer = open_.join(flow_in(seg, edges), ["fn", "node", "obj", "seg"]).select("fn", "use", "def")
    return local.unionByName(outer).distinct()


def data_edges(sites: DataFrame, edges: DataFrame, large: int = LARGE_FLOW) -> DataFrame:
    """(fn, src, dst): the nodes of the writes that reach a node's reads, reaching() with nodes for positions."""

    def rounds(sites: DataFrame, edges: DataFrame) -> DataFrame:
        at = sites.select("fn", "pos", "node").distinct()
        r = reaching_in_rounds(sites, edges)
        return r.join(at.select("fn", F.col("pos").alias("def"), F.col("node").alias("src")), ["fn", "def"]).join(at.select("fn", F.col("pos").alias("use"), F.col("node").alias("dst")), ["fn", "use"]).select("fn", "src", "dst").distinct()

    return by_function(sites, edges, None, rounds, large, solve_nodes, ("src", "dst"))


def unknown_reads(sites: DataFrame, edges: DataFrame, reads: DataFrame, large: int = LARGE_FLOW) -> DataFrame:
    """(fn, use, def): for reads of unknown memory, reads(fn, node, pos), every write that may come before them."""
    return by_function(sites, edges, reads, unknown_reads_in_rounds, large)


def unknown_reads_in_rounds(sites: DataFrame, edges: DataFrame, reads: DataFrame) -> DataFrame:
    """unknown_reads() by relations and rounds over all functions."""
    seg = segmented(sites)
    inside = flow_in(seg, edges).select("fn", "node", "def").distinct()
    far = reads.join(inside, ["fn", "node"]).select("fn", F.col("pos").alias("use"), "def")
    near = reads.alias("r").join(sites.where("role <> 'use'").alias("s"), F.expr("r.fn = s.fn AND r.node = s.node AND s.pos < r.pos")).select("r.fn", F.col("r.pos").alias("use"), F.col("s.pos").alias("def"))
    return far.unionByName(near).distinct()


def own_effects(sites: DataFrame, escaping: DataFrame) -> DataFrame:
    """(fn, role, obj, lo, hi): what functions themselves may write and read of escaping(obj)."""
    return sites.join(escaping, "obj", "left_semi").select("fn", F.when(F.col("role") == "use", "ref").otherwise("mod").alias("role"), "obj", "lo", "hi")


def modref(sites: DataFrame, calls: DataFrame, escaping: DataFrame, large: int = LARGE_GRAPH) -> DataFrame:
    """(fn, role, obj, lo, hi): what a function and those it calls may write and read of the objects that others can see,
    escaping(obj); calls(caller, call, callee). Effects are carried to callers a lot at a time, each lot by a task that holds
    the call graph; one of more than large edges goes through rounds."""
    own = materialize(own_effects(sites, escaping).distinct(), "own-effects")
    edge = materialize(calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst")).distinct(), "callers")
    if edge.count() > large:
        return modref_in_rounds(own, edge)
    return carried(own.withColumnRenamed("fn", "node"), edge, ["role", "obj", "lo", "hi"]).withColumnRenamed("node", "fn")


def modref_in_rounds(own: DataFrame, edge: DataFrame) -> DataFrame:
    """modref() of own effects along edges from callee to caller, by rounds over relations."""

    def step(front: DataFrame) -> DataFrame:
        return front.join(edge, F.col("fn") == F.col("src")).select(F.col("dst").alias("fn"), "role", "obj", "lo", "hi")

    return fixpoint(own, step, "modref", hops=1)


def modref_hulls(sites: DataFrame, calls: DataFrame, escaping: DataFrame, large: int = LARGE_GRAPH) -> DataFrame:
    """(fn, role, obj, lo, hi): the hull of modref()'s rows of an object, without those rows."""
    own = own_effects(sites, escaping).groupBy("fn", "role", "obj").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = materialize(own, "own-hulls")
    edge = materialize(calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst")).distinct(), "callers")
    if edge.count() > large:
        return modref_in_rounds(own, edge).groupBy("fn", "role", "obj").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return carried(own.withColumnRenamed("fn", "node"), edge, ["role", "obj"], ["lo", "hi"]).withColumnRenamed("node", "fn")


def call_effects(effects: DataFrame, calls: DataFrame, after: int) -> DataFrame:
    """(fn, node, pos, role, obj, lo, hi): what calls(caller, call, callee) may do where they stand, from the rows of modref()
    or modref_hulls(): one may-write and one use an object, over all its bytes that the called function touches. pos is after
    plus the node, so a call comes behind the statements of its block."""
    hull = effects.groupBy("fn", "role", "obj").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    at = hull.withColumnRenamed("fn", "callee").join(calls.select("caller", "call", "callee").distinct(), "callee")
    role = F.when(F.col("role") == "mod", "def").otherwise("use")
    merged = at.groupBy(F.col("caller").alias("fn"), F.col("call").alias("node"), role.alias("role"), "obj").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.select("fn", "node", (F.col("node") + after).alias("pos"), "role", "obj", "lo", "hi")


def reaching_over_calls(sites: DataFrame, edges: DataFrame, calls: DataFrame, escaping: DataFrame, after: int) -> DataFrame:
    """reaching() of a program whose calls write and read what the functions they call do: (fn, use, def), positions of at
    least after being calls."""
    done = call_effects(modref_hulls(sites, calls, escaping), calls, after)
    return reaching(sites.select(done.columns).unionByName(done), edges)


def unknown_writes(sites: DataFrame, edges: DataFrame, writes: DataFrame) -> DataFrame:
    """(fn, use, def): writes(fn, node, pos) of unknown memory may define every use that comes after them."""
    e = edges.select("fn", F.col("src").alias("node"), "dst")
    after = fixpoint(writes.join(e, ["fn", "node"]).select("fn", F.col("dst").alias("node"), F.col("pos").alias("def")), lambda front: front.join(e, ["fn", "node"]).select("fn", F.col("dst").alias("node"), "def"), "unknown-writes")
    uses = sites.where("role = 'use'").select("fn", "node", F.col("pos").alias("use")).distinct()
    far = uses.join(after, ["fn", "node"]).select("fn", "use", "def")
    near = uses.join(writes.select("fn", "node", F.col("pos").alias("def")), ["fn", "node"]).where("def < use").select("fn", "use", "def")
    return far.unionByName(near).distinct()


def escaping_objects(cells: DataFrame, visible: DataFrame) -> DataFrame:
    """(module, obj) that code outside may reach: visible(module, obj), and what their cells(module, obj, off, tgt, toff) and
    those of objects found so point to."""
    near = cells.where("tgt >= 0").select("module", "obj", "tgt").distinct()
    return fixpoint(visible.select("module", "obj"), lambda front: front.join(near, ["module", "obj"]).select("module", F.col("tgt").alias("obj")), "escaping")


def summary(sites: DataFrame) -> DataFrame:
    """(fn, node, is_use, is_def): whether a node reads memory, and whether it writes any."""
    return sites.groupBy("fn", "node").agg(F.bool_or(F.col("role") == "use").alias("is_use"), F.bool_or(F.col("role") != "use").alias("is_def"))
