"""Dependence graphs and slicing: dep(fn, src, dst, etype), src depends-on direction: dst depends on src."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixpoint import fixpoint, reach
from ..functions.grouped import LARGE, per_group, split_by_size
from ..functions.store import materialize

FN = ("fn",)


def dependence_graph(use: DataFrame, data: DataFrame, control: DataFrame, interference: DataFrame | None = None) -> DataFrame:
    """(fn, src, dst, etype) of use(fn, src, dst), data(fn, src, dst), control(fn, node, depends_on)."""
    out = use.select("fn", "src", "dst", F.lit("use").alias("etype")).unionByName(data.select("fn", "src", "dst", F.lit("data").alias("etype")))
    out = out.unionByName(control.select("fn", F.col("depends_on").alias("src"), F.col("node").alias("dst"), F.lit("control").alias("etype")))
    if interference is not None:
        out = out.unionByName(interference.select("fn", "src", "dst", F.lit("interference").alias("etype")))
    return out.distinct()


def onwards(start: set, succ: dict[int, set]) -> set:
    """start and what it leads to."""
    seen, work = set(start), list(start)
    while work:
        for x in succ.get(work.pop(), ()):
            if x not in seen:
                seen.add(x)
                work.append(x)
    return seen


def by_function(edges: DataFrame, criteria: DataFrame, solve, names: tuple[str, ...], rounds, large: int) -> DataFrame:
    """(fn, names) of solve(edges, criteria), pairs (src, dst) and a set of nodes, where a function's edges and criteria meet;
    functions of more than large rows go through rounds(edges, criteria). Criteria without a function reach themselves."""
    none = F.lit(None).cast("long")
    rows = criteria.select("fn", F.col("node").alias("src"), none.alias("dst"), F.lit(True).alias("asked")).unionByName(edges.where("fn IS NOT NULL").select("fn", "src", "dst", F.lit(False).alias("asked")))

    def solved(_, group: list[tuple]) -> Iterator[tuple]:
        wanted = {a for a, _, asked in group if asked}
        if wanted:
            yield from solve([(a, b) for a, b, asked in group if not asked], wanted)

    few, many = split_by_size(rows, ["fn"], large)
    one = lambda df: per_group(df, ["fn"], solved, "fn long, " + ", ".join(f"{n} long" for n in names))
    if many is None:
        return one(rows)
    # null counts as a function here
    mine = lambda df, keys: df.alias("d").join(keys.alias("k"), F.col("d.fn").eqNullSafe(F.col("k.fn")), "left_semi")
    rest = rounds(mine(edges, many), mine(criteria, many)).select("fn", *names)
    return rest if few is None else rest.unionByName(one(mine(rows, few)))


def backward_slice(dep: DataFrame, criteria: DataFrame, entry: int = 1, large: int = LARGE) -> DataFrame:
    """(fn, criterion, node): everything that criteria(fn, node) depend on, and the entry of each function touched. Functions of
    up to large edges and criteria are solved where their rows meet."""

    def solve(edges: list[tuple], wanted: set) -> Iterator[tuple]:
        back: dict[int, set] = {}
        for a, b in edges:
            if b is not None:
                back.setdefault(b, set()).add(a)
        for c in wanted:
            yield from ((c, n) for n in onwards({c}, back) | {entry})

    return by_function(dep, criteria, solve, ("criterion", "node"), lambda d, c: backward_in_rounds(d, c, entry), large)


def backward_in_rounds(dep: DataFrame, criteria: DataFrame, entry: int) -> DataFrame:
    """backward_slice() by rounds over all functions."""
    back = dep.select("fn", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    seeds = criteria.select("fn", F.col("node").alias("criterion"), "node")
    marked = reach(back, seeds, FN)
    return marked.unionByName(criteria.select("fn", F.col("node").alias("criterion"), F.lit(entry).cast("long").alias("node"))).distinct()


def forward_slice(dep: DataFrame, criteria: DataFrame, entry: int = 1, large: int = LARGE) -> DataFrame:
    """(fn, node): everything that depends on criteria, and what that needs to run: a backward slice from all of it. Functions
    of up to large edges and criteria are solved where their rows meet."""

    def solve(edges: list[tuple], wanted: set) -> Iterator[tuple]:
        succ: dict[int, set] = {}
        back: dict[int, set] = {}
        for a, b in edges:
            if a is not None:
                succ.setdefault(a, set()).add(b)
            if b is not None:
                back.setdefault(b, set()).add(a)
        yield from ((n,) for n in onwards(onwards(wanted, succ), back) | {entry})

    return by_function(dep, criteria, solve, ("node",), lambda d, c: forward_in_rounds(d, c, entry), large)


def forward_in_rounds(dep: DataFrame, criteria: DataFrame, entry: int) -> DataFrame:
    """forward_slice() by rounds over all functions."""
    hit = reach(dep.select("fn", "src", "dst").distinct(), criteria.select("fn", "node"), FN)
    back = dep.select("fn", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    need = reach(back, hit, FN)
    return need.unionByName(criteria.select("fn", F.lit(entry).cast("long").alias("node"))).distinct()


def apply_slice(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """nodes that a slice keeps."""
    return nodes.join(marked.select("fn", "node").distinct(), ["fn", "node"], "left_semi")


def slice_statistics(bbs: DataFrame, marked: DataFrame) -> DataFrame:
    """(fn, nodes_total, nodes_removed, blocks_removed)."""
    m = bbs.join(marked.select("fn", "node").distinct().withColumn("kept", F.lit(1)), ["fn", "node"], "left")
    per = m.groupBy("fn", "bb").agg(F.count("*").alias("n"), F.count("kept").alias("k"))
    return per.groupBy("fn").agg(F.sum("n").alias("nodes_total"), F.sum(F.col("n") - F.col("k")).alias("nodes_removed"), F.sum((F.col("k") == 0).cast("long")).alias("blocks_removed"))


def repaired(edges: DataFrame, marked: DataFrame, large: int = LARGE) -> DataFrame:
    """(fn, src, dst): control flow between kept nodes: over removed ones to the first kept; an edge that finds none goes to a
    safe exit, node 0. Equal successors collapse. Functions of up to large edges and kept nodes are solved where these meet."""

    def solve(pairs: list[tuple], kept: set) -> Iterator[tuple]:
        succ: dict[int, set] = {}
        for a, b in pairs:
            if a is not None:
                succ.setdefault(a, set()).add(b)
        gone = {a: to for a, to in succ.items() if a not in kept}
        for a in succ.keys() & kept:
            to = {b for b in onwards(succ[a], gone) if b in kept and b is not None and b != a}
            yield from ((a, b) for b in to or {0})

    return by_function(edges, marked.select("fn", "node").distinct(), solve, ("src", "dst"), repaired_in_rounds, large)


def repaired_in_rounds(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """repaired() by rounds over all functions."""
    kept = marked.select("fn", "node").distinct()
    gone_src = edges.join(kept.withColumnRenamed("node", "src"), ["fn", "src"], "left_anti")
    start = edges.join(kept.withColumnRenamed("node", "src"), ["fn", "src"], "left_semi").select("fn", "src", "dst")
    step_edges = gone_src.select("fn", F.col("src").alias("dst"), F.col("dst").alias("nxt"))
    over = fixpoint(start, lambda front: front.join(step_edges, ["fn", "dst"]).select("fn", "src", F.col("nxt").alias("dst")), "repair")
    good = over.join(kept.withColumnRenamed("node", "dst"), ["fn", "dst"], "left_semi").where("src <> dst").select("fn", "src", "dst").distinct()
    lost = start.select("fn", "src").distinct().join(good.select("fn", "src").distinct(), ["fn", "src"], "left_anti")
    return good.unionByName(lost.select("fn", "src", F.lit(0).cast("long").alias("dst")))


def match_criteria(stmts: DataFrame, texts: DataFrame) -> DataFrame:
    """(criterion, fn, node) of stmts(fn, node, file, fun, line, obj) that texts(criterion) name: file#fun#line#obj, an empty
    part matches anything; several criteria are comma-separated; the last part may be a call, name(), or a global, @name."""
    one = texts.select("criterion", F.explode(F.split("criterion", ",")).alias("part"))
    p = F.split("part", "#")
    c = one.select("criterion", *[F.nullif(F.coalesce(F.get(p, F.lit(i)), F.lit("")), F.lit("")).alias(n) for i, n in enumerate(("cfile", "cfun", "cline", "cobj"))])
    c = c.withColumn("cobj", F.regexp_replace("cobj", r"^[@&]|\(\)$", ""))
    on = F.expr("(cfile IS NULL OR cfile = file) AND (cfun IS NULL OR cfun = fun) AND (cline IS NULL OR cline = CAST(line AS STRING)) AND (cobj IS NULL OR cobj = obj)")
    with_fun = c.where("cfun IS NOT NULL").join(stmts, (F.col("cfun") == F.col("fun")) & on)
    # criteria that a user typed; those without a function meet every statement, from a broadcast side while they are few
    free = c.where("cfun IS NULL")
    rest = stmts.join(F.broadcast(free) if free.count() <= 10_000 else free, on)
    return with_fun.select("criterion", "fn", "node").unionByName(rest.select("criterion", "fn", "node")).distinct()


def next_instruction(criteria: DataFrame, bbs: DataFrame) -> DataFrame:
    """(fn, node): the node after each criterion in its block."""
    from pyspark.sql import Window

    nxt = bbs.withColumn("nxt", F.lead("node").over(Window.partitionBy("fn", "bb").orderBy("node")))
    return criteria.join(nxt, ["fn", "node"]).where("nxt IS NOT NULL").select("fn", F.col("nxt").alias("node"))


def secondary(edges: DataFrame, primary: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates(fn, node) that lie on a path to a primary criterion."""
    back = edges.select("fn", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return candidates.join(reach(back, primary.select("fn", "node"), FN), ["fn", "node"], "left_semi")


def cutoff(nodes: DataFrame, edges: DataFrame, criteria: DataFrame) -> DataFrame:
    """(fn, node, action) of nodes from which no criterion can be reached: exit where a live node leads to them, else remove."""
    back = edges.select("fn", F.col("dst").alias("src"), F.col("src").alias("dst"))
    live = reach(back, criteria.select("fn", "node"), FN)
    dead = nodes.join(criteria.select("fn").distinct(), "fn", "left_semi").select("fn", "node").join(live, ["fn", "node"], "left_anti")
    front = edges.join(live.withColumnRenamed("node", "src"), ["fn", "src"], "left_semi").select("fn", F.col("dst").alias("node")).distinct().withColumn("f", F.lit(True))
    return dead.join(front, ["fn", "node"], "left").select("fn", "node", F.when(F.col("f"), "exit").otherwise("remove").alias("action"))


def unused_functions(functions: DataFrame, uses: DataFrame, entry: int) -> DataFrame:
    """(fn) without any use by a function that stays, uses(user, fn): repeated until none is found; the entry stays.
    Functions that use each other keep each other."""
    left, gone = functions.select("fn").distinct(), None
    while True:
        used = uses.join(left.withColumnRenamed("fn", "user"), "user", "left_semi").select("fn").distinct()
        drop = materialize(left.where(F.col("fn") != entry).join(used, "fn", "left_anti"), "unused")
        if drop.isEmpty():
            return gone if gone is not None else drop
        gone = drop if gone is None else gone.unionByName(drop)
        left = materialize(left.join(drop, "fn", "left_anti"), "left")


def lines(stmts: DataFrame, marked: DataFrame) -> DataFrame:
    """(file, line) that a slice keeps."""
    return stmts.join(marked.select("fn", "node").distinct(), ["fn", "node"], "left_semi").select("file", "line").distinct()


def summary_edges(dep: DataFrame, params: DataFrame) -> DataFrame:
    """(call, actual_in, actual_out): parameters of a call whose value depends on others through the called function.

    dep(src, dst) over global node ids; params(call, formal, actual, dir): dir in or out pairs a formal parameter with a
    call's actual one. path holds what reaches each formal out inside its function; a path that arrives at a formal in
    makes summaries at every call, and these are edges for further paths.
    """
    outs = params.where("dir = 'out'")
    ins = params.where("dir = 'in'")
    path = new = materialize(outs.select(F.col("formal").alias("node"), F.col("formal").alias("fo")).distinct(), "path")
    back = dep.select(F.col("dst").alias("node"), F.col("src").alias("prev"))
    summary = None
    for _ in range(200):
        hit = path.join(ins.select(F.col("formal").alias("node"), "call", F.col("actual").alias("actual_in")), "node")
        made = hit.join(outs.select("call", F.col("formal").alias("fo"), F.col("actual").alias("actual_out")), ["call", "fo"]).select("call", "actual_in", "actual_out").distinct()
        made = materialize(made, "summary")
        edges = back.unionByName(made.select(F.col("actual_out").alias("node"), F.col("actual_in").alias("prev")))
        grown = made.count() != (summary.count() if summary is not None else 0)
        summary = made
        front = path if grown else new
        new = materialize(front.join(edges, "node").select(F.col("prev").alias("node"), "fo").distinct().join(path, ["node", "fo"], "left_anti"), "path")
        if new.isEmpty() and not grown:
            return summary
        path = path.unionByName(new)
    raise RuntimeError("summary edges: too many rounds")


#: Functions of a pack that a call by pointer meets at once, and calls that meet packs in one task.
PACK, CALLS_DEALT = 1_024, 2_000


def call_graph(direct: DataFrame, pointer_calls: DataFrame, pt: DataFrame, address_taken: DataFrame) -> DataFrame:
    """(caller, call, callee): direct calls; calls by pointer, pointer_calls(caller, call, n, n_args), to the functions their
    points-to sets pt(n, tgt) name; where a set names none, to every function address_taken(fn, n_args) whose address is
    taken and that takes as many arguments.

    The last are calls times functions, so they are neither shuffled nor compared, except those of a place that could tell a
    function twice: one that calls directly, too, or with several numbers of arguments. Calls are dealt evenly; each task
    reads the functions as packs, so these aren't shuffled either, and makes its rows a pack at a time.
    """
    site = ["caller", "call"]
    edge = [*site, "callee"]
    known = materialize(pointer_calls.join(pt.select("n", F.col("tgt").alias("callee")), "n").join(address_taken.select(F.col("fn").alias("callee")), "callee", "left_semi").select(edge), "known-calls")
    calls = pointer_calls.join(known.select(site).distinct(), site, "left_anti").select(*site, "n_args").distinct()
    seen = calls.select(*site, F.lit(1).alias("times")).unionByName(direct.select(*site, F.lit(1).alias("times")).distinct()).groupBy(site).agg((F.sum("times") > 1).alias("again"))
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in site]
    open_ = materialize(calls.alias("c").join(seen.alias("s"), same).select("c.*", "s.again"), "open-calls")
    taken = materialize(address_taken.select("fn", "n_args").distinct(), "taken")
    full = taken.groupBy("n_args").agg(F.ceil(F.count("*") / PACK).alias("packs"))  # a row for each number of arguments
    packs = taken.join(F.broadcast(full), "n_args").groupBy("n_args", F.pmod(F.xxhash64("fn"), "packs").alias("pack")).agg(F.transform(F.collect_list(F.struct("fn")), lambda f: f.fn).alias("fns"))
    packs = materialize(packs, "packs").select("n_args", "fns").coalesce(1)

    def guess(again: bool) -> DataFrame:
        """Calls by every pack, the former dealt to tasks: no side is shuffled by its number of arguments, as few occur."""
        mine = open_.where(F.col("again") == again).drop("again")
        return mine.repartition(max(1, -(-mine.count() // CALLS_DEALT)), *site).join(packs.hint("shuffle_replicate_nl"), "n_args").select(*site, F.explode("fns").alias("callee"))

    return direct.select(edge).unionByName(known).unionByName(guess(True)).distinct().unionByName(guess(False))


def dot(dep: DataFrame) -> DataFrame:
    """(fn, line): a dependence graph as lines of DOT, to be written as text."""
    style = F.when(F.col("etype") == "control", "blue").when(F.col("etype") == "data", "red").otherwise("black")
    body = dep.select("fn", F.format_string('  "%s" -> "%s" [color=%s];', "src", "dst", style).alias("line"), F.lit(1).alias("o"))
    ends = dep.select("fn").distinct().select("fn", F.explode(F.array(F.struct(F.format_string('digraph "%s" {', "fn").alias("line"), F.lit(0).alias("o")), F.struct(F.lit("}").alias("line"), F.lit(2).alias("o")))).alias("e")).select("fn", "e.line", "e.o")
    return body.unionByName(ends).select("fn", "o", "line")


#: Kinds of edges of a system dependence graph that go into a called function, and out of one.
INTO, OUT_OF = ("call", "param_in"), ("param_out",)
GLOBAL = ["src_fn", "src", "dst_fn", "dst", "etype"]


def system_graph(dep: DataFrame, calls: DataFrame, params: DataFrame, stops: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """(src_fn, src, dst_fn, dst, etype): the functions' dependence graphs dep(fn, src, dst, etype) and what joins them.

    A called function's entry depends on the call: calls(caller, call, callee, entry). params(caller, call, callee, formal,
    actual, dir): a formal in depends on the actual in, an actual out on the formal out. stops(fn, node, depends_on): what
    runs only if a call returns. summary(caller, actual_in, actual_out): a call's outs by its ins. dst depends on src.
    """
    lit = lambda name: F.lit(name).alias("etype")
    out = dep.select(F.col("fn").alias("src_fn"), "src", F.col("fn").alias("dst_fn"), "dst", "etype")
    out = out.unionByName(calls.select(F.col("caller").alias("src_fn"), F.col("call").alias("src"), F.col("callee").alias("dst_fn"), F.col("entry").alias("dst"), lit("call")))
    out = out.unionByName(params.where("dir = 'in'").select(F.col("caller").alias("src_fn"), F.col("actual").alias("src"), F.col("callee").alias("dst_fn"), F.col("formal").alias("dst"), lit("param_in")))
    out = out.unionByName(params.where("dir = 'out'").select(F.col("callee").alias("src_fn"), F.col("formal").alias("src"), F.col("caller").alias("dst_fn"), F.col("actual").alias("dst"), lit("param_out")))
    if stops is not None:
        out = out.unionByName(stops.select(F.col("fn").alias("src_fn"), F.col("depends_on").alias("src"), F.col("fn").alias("dst_fn"), F.col("node").alias("dst"), lit("noret")))
    if summary is not None:
        out = out.unionByName(summary.select(F.col("caller").alias("src_fn"), F.col("actual_in").alias("src"), F.col("caller").alias("dst_fn"), F.col("actual_out").alias("dst"), lit("summary")))
    return out.distinct()


def reach_over_calls(graph: DataFrame, seeds: DataFrame, backward: bool = True, without: tuple[str, ...] = ()) -> DataFrame:
    """(fn, node) that seeds(fn, node) depend on, or with backward false what depends on them, without some kinds of edges."""
    near, far = ("dst", "src") if backward else ("src", "dst")
    e = graph.where(~F.col("etype").isin(*without)) if without else graph
    e = e.select(F.col(f"{near}_fn").alias("fn"), F.col(near).alias("node"), F.col(f"{far}_fn").alias("to_fn"), F.col(far).alias("to")).distinct()

    def step(front: DataFrame) -> DataFrame:
        return front.join(e, ["fn", "node"]).select(F.col("to_fn").alias("fn"), F.col("to").alias("node"))

    return fixpoint(seeds.select("fn", "node"), step, "slice", hops=3)


def backward_slice_over_calls(graph: DataFrame, criteria: DataFrame, by_context: bool = False) -> DataFrame:
    """(fn, node) that criteria(fn, node) depend on, over calls in both directions.

    by_context: in two phases, so that a call is left by the same call that it was entered by; needs summary edges in
    graph. First up to callers, not into called functions; then from all that, into called functions, not up again.
    """
    if not by_context:
        return reach_over_calls(graph, criteria)
    up = reach_over_calls(graph, criteria, without=OUT_OF)
    return reach_over_calls(graph, up, without=INTO)


def forward_slice_over_calls(graph: DataFrame, criteria: DataFrame) -> DataFrame:
    """(fn, node): what depends on criteria, over calls, and what all of that needs to run."""
    return reach_over_calls(graph, reach_over_calls(graph, criteria, backward=False))


def invalid_dependences(nodes: DataFrame, dep: DataFrame, control: DataFrame) -> DataFrame:
    """(fn, node, error): edges with an end that isn't a node, control edges that the control dependences control(fn, node,
    depends_on) lack, control dependences without an edge, nodes on no edge."""
    # rows meet once, by function; what a function holds is grouped there by node and by control edge
    none = F.lit(None).cast("long")
    row = lambda df, a, b, kind: df.select("fn", F.col(a).alias("node"), (F.col(b) if b else none).alias("on"), F.lit(kind).cast("int").alias("kind") if isinstance(kind, int) else kind.alias("kind"))
    edge = F.when(F.col("etype") == "control", 4).otherwise(2)
    rows = row(nodes, "node", None, 1).unionByName(row(dep, "dst", "src", edge)).unionByName(row(control, "node", "depends_on", 8)).repartition("fn")
    end = lambda c: F.struct(F.col(c).alias("node"), none.alias("on"), F.lit(2).alias("is"), F.lit(False).alias("pair"))
    same = F.struct("node", "on", F.col("kind").alias("is"), (F.col("kind") > 2).alias("pair"))
    parts = F.when(F.col("kind") == 2, F.array(end("node"), end("on"))).when(F.col("kind") == 4, F.array(end("node"), end("on"), same)).otherwise(F.array(same))
    is_ = rows.select("fn", F.explode(parts).alias("x")).groupBy("fn", "x.node", "x.on", "x.pair").agg(F.expr("bit_or(x.is)").alias("is"))
    # null equals nothing
    known = F.col("fn").isNotNull() & F.col("node").isNotNull() & (F.col("on").isNotNull() | ~F.col("pair"))
    lacks = lambda one, other, name: F.when((F.col("is").bitwiseAND(one) != 0) & ~((F.col("is").bitwiseAND(other) != 0) & known), F.lit(name))
    errors = F.filter(F.array(lacks(2, 1, "no node"), lacks(4, 8, "unknown control"), lacks(8, 4, "missing control"), lacks(1, 2, "isolated")), lambda e: e.isNotNull())
    return is_.select("fn", "node", F.explode(errors).alias("error")).distinct()


def module_statistics(nodes: DataFrame, edges: DataFrame, calls: DataFrame, entry: int) -> DataFrame:
    """(functions, called, nodes, edges, calls, reachable): sizes of a program; reachable: functions that entry calls, directly
    or over others."""
    near = calls.select(F.col("caller").alias("fn"), F.col("callee").alias("to")).distinct()
    start = nodes.where(F.col("fn") == entry).select("fn").distinct()
    met = fixpoint(start, lambda front: front.join(near, "fn").select(F.col("to").alias("fn")), "reachable", hops=2)
    n = nodes.agg(F.countDistinct("fn").alias("functions"), F.count("*").alias("nodes"))
    c = calls.agg(F.countDistinct("callee").alias("called"), F.count("*").alias("calls"))
    rows = n.join(c, F.lit(True)).join(edges.agg(F.count("*").alias("edges")), F.lit(True)).join(met.agg(F.count("*").alias("reachable")), F.lit(True))  # one row each
    return rows.select("functions", "called", "nodes", "edges", "calls", "reachable")
