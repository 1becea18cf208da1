"""Queries against their SQL on the smallest tables, and operators against brute force on random graphs."""

import random

import pyarrow as pa
import pytest
from helpers import rows, sql_rows

from factloom.functions.fixpoint import closure, reach
from factloom.operators import control as C
from factloom.operators import depgraph as D
from factloom.operators import flow as W
from factloom.operators import graph as G
from factloom.operators import intervals as I
from factloom.operators import memory as M
from factloom.operators import pointer as P
from factloom.operators import relations as R
from factloom.operators import threads as T
from factloom.plans import catalog
from factloom.sources import facts
from factloom.sources.facts import fact

SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
#: The SQL of these unrolls all rounds of the pointer analysis and takes half a minute each on the larger tables.
UNROLLED = {n for n, sql in catalog.SQL.items() if "pts0" in sql}


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - UNROLLED))
def test_query_equals_sql(spark, duck_mid, name):
    assert rows(catalog.QUERIES[name](spark, MID)) == sql_rows(duck_mid, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(UNROLLED))
def test_query_of_points_to_sets_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SMALL)) == sql_rows(duck, catalog.SQL[name])


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES and set(catalog.SQL) <= set(catalog.QUERIES)


def graphs(seed=3, n_fn=40):
    rnd = random.Random(seed)
    nodes, edges = {}, {}
    for fn in range(n_fn):
        k = rnd.randint(3, 7)
        nodes[fn] = list(range(1, k + 1))
        edges[fn] = sorted({(a, rnd.randint(1, k)) for a in nodes[fn] for _ in range(rnd.randint(0, 2))})
    return nodes, edges


@pytest.fixture(scope="module")
def random_graphs(spark):
    nodes, edges = graphs()
    n = spark.createDataFrame([(f, v) for f in nodes for v in nodes[f]], "fn long, node long").cache()
    e = spark.createDataFrame([(f, a, b) for f in edges for a, b in edges[f]], "fn long, src long, dst long").cache()
    return nodes, edges, n, e


def succ(edges, n):
    return [b for a, b in edges if a == n]


def must_hit(nodes, edges, targets):
    """Nodes all of whose maximal paths meet targets: least fixpoint of colouring."""
    red = set(targets)
    while True:
        new = {n for n in nodes if n not in red and succ(edges, n) and all(s in red for s in succ(edges, n))}
        if not new:
            return red
        red |= new


def test_one_pass_equals_relations(spark, random_graphs):
    """Groups that fit a task are solved one by one, larger ones by relations; both ways give the same."""
    _, _, n, e = random_graphs
    few, many = W.facts(n, e), W.facts(n, e, large=12)
    for kind in W.KINDS:
        assert rows(few[kind]) == rows(many[kind]) and few[kind].count()
    seeds = n.where("node <= 2")
    assert rows(W.strong_closure(n, e, seeds)) == rows(C.strong_closure(n, e, seeds)) == rows(W.strong_closure(n, e, seeds, large=12))
    cons, objects = fact(spark, SMALL, "cons").where("module < 40"), fact(spark, SMALL, "object").where("module < 40")
    for x, y in zip(P.analyse(cons, objects, 8), P.analyse(cons, objects, 8, large=30), strict=True):
        assert rows(x) == rows(y) and x.count()
    vr = fact(spark, SMALL, "vr_fact").where("loc < 60").selectExpr("loc", "lt", "shiftleft(1, CAST(rel AS INT) - 1) AS rels", "rt")
    for f in (R.closed, R.classes):
        assert rows(f(vr)) == rows(f(vr, large=8))


def test_ntscd_and_dod_by_brute_force(random_graphs):
    nodes, edges, n, e = random_graphs
    av = C.av(n, e)
    avoid = C.avoid(n, e, av)
    got = {(r.fn, r.node, r.depends_on) for r in C.ntscd(n, e, avoid).collect()}
    want = set()
    for f in nodes:
        for t in nodes[f]:
            red = must_hit(nodes[f], edges[f], {t})
            for p in nodes[f]:
                s = succ(edges[f], p)
                if p != t and any(x in red for x in s) and any(x not in red for x in s):
                    want.add((f, t, p))
    assert got == want

    def before(f, s, a, b):
        """All maximal paths from s meet a, and before any b."""
        if s == b:
            return False
        red, ns = {a}, nodes[f]
        while True:
            new = {x for x in ns if x not in red and x != b and succ(edges[f], x) and all(y in red for y in succ(edges[f], x))}
            if not new:
                return s in red
            red |= new

    got = {(r.fn, r.p, r.a, r.b) for r in C.dod(n, e, av, avoid).collect()}
    want = set()
    for f in nodes:
        for p in nodes[f]:
            ss = succ(edges[f], p)
            if len(ss) < 2:
                continue
            for a in nodes[f]:
                for b in nodes[f]:
                    if a < b and p not in (a, b) and p in must_hit(nodes[f], edges[f], {a}) and p in must_hit(nodes[f], edges[f], {b}) and any(before(f, s, a, b) for s in ss) and any(before(f, s, b, a) for s in ss):
                        want.add((f, p, a, b))
    assert got == want


def test_strong_closure_by_brute_force(spark, random_graphs):
    nodes, edges, n, e = random_graphs
    got = {(r.fn, r.node) for r in C.strong_closure(n, e, n.where("node <= 2")).collect()}
    want = set()
    for f in nodes:
        x = {1, 2}
        while True:
            def theta(p):
                seen, todo, hit = set(), [p], set()
                while todo:
                    v = todo.pop()
                    if v in x:
                        hit.add(v)
                    elif v not in seen:
                        seen.add(v)
                        todo += succ(edges[f], v)
                return hit
            gamma = set(nodes[f]) - must_hit(nodes[f], edges[f], x)
            from_x, todo = set(), [s for v in x for s in succ(edges[f], v)]
            while todo:
                v = todo.pop()
                if v not in from_x:
                    from_x.add(v)
                    todo += succ(edges[f], v)
            new = {p for p, r in edges[f] if p not in x and p in from_x and len(theta(r)) == 1 and r not in gamma and (len(theta(p)) >= 2 or p in gamma)}
            if not new:
                break
            x |= new
        want |= {(f, v) for v in x}
    assert got == want


def test_dfs_and_edge_kinds(random_graphs):
    nodes, edges, n, e = random_graphs
    numbers = G.dfs(e, n)
    kinds = {(r.fn, r.src, r.dst): r.kind for r in G.edge_kinds(e, numbers).collect()}
    reached = {(r.fn, r.node) for r in numbers.collect()}
    assert reached == {(r.fn, r.node) for r in reach(e, n.where("node = 1"), ("fn",)).collect()}
    tree = [k for k, v in kinds.items() if v == "tree"]
    assert len(tree) == len(reached) - len(nodes)  # one tree edge into each reached node but the roots
    assert all(a == b for (_, a, b), v in kinds.items() if a == b and v == "back" or a == b)


def test_dfs_numbers_and_kinds_by_brute_force(random_graphs):
    nodes, edges, n, e = random_graphs
    numbers = G.dfs(e, n)
    got = {(r.fn, r.node): (r.pre, r.post) for r in numbers.collect()}
    want, kinds = {}, {}
    for f in nodes:
        clock, pre, post, tree = [0], {}, {}, set()

        def visit(v):
            pre[v] = clock[0]
            clock[0] += 1
            for w in sorted(succ(edges[f], v)):
                if w not in pre:
                    tree.add((v, w))
                    visit(w)
            post[v] = clock[0]
            clock[0] += 1

        visit(1)
        want |= {(f, v): (pre[v], post[v]) for v in pre}
        for a, b in edges[f]:
            if a in pre and b in pre:
                down, up = pre[a] <= pre[b] and post[b] <= post[a], pre[b] <= pre[a] and post[a] <= post[b]
                kinds[f, a, b] = "back" if up else "tree" if (a, b) in tree else "forward" if down else "cross"
    assert got == want
    assert {(r.fn, r.src, r.dst): r.kind for r in G.edge_kinds(e, numbers).collect()} == kinds


FLOW = [
    # p = &a; *p = &x; y = *p; *p = &z; w = *p: the second load sees the second store alone
    ("straight", [("alloc", 1, 10), ("alloc", 2, 11), ("store", 1, 2), ("load", 3, 1), ("alloc", 4, 12), ("store", 1, 4), ("load", 5, 1)], None, {3: {11}, 5: {12}}, {3: {11, 12}, 5: {11, 12}}),
    # the two arms of a diamond store different things: both reach its end, each load in an arm sees its own
    ("diamond", [("alloc", 1, 10), ("alloc", 2, 11), ("alloc", 4, 12), ("store", 1, 2), ("load", 3, 1), ("store", 1, 4), ("load", 5, 1), ("load", 6, 1)],
     [(1, 2), (2, 3), (3, 4), (4, 5), (3, 6), (6, 7), (5, 8), (7, 8)], {3: {11}, 5: {12}, 6: {11, 12}}, {3: {11, 12}, 5: {11, 12}, 6: {11, 12}}),
    # a loop: what the body stores reaches the load before it
    ("loop", [("alloc", 1, 10), ("alloc", 2, 11), ("alloc", 4, 12), ("store", 1, 2), ("load", 3, 1), ("store", 1, 4)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 5)], {3: {11, 12}}, {3: {11, 12}}),
    # two objects behind one pointer: no store through it replaces anything
    ("weak", [("alloc", 1, 10), ("alloc", 1, 20), ("alloc", 2, 11), ("alloc", 4, 12), ("store", 1, 2), ("store", 1, 4), ("load", 3, 1)], None, {3: {11, 12}}, {3: {11, 12}}),
]


@pytest.mark.parametrize("name,steps,flow,by_flow,at_all", FLOW, ids=[f[0] for f in FLOW])
def test_flow_sensitive_shapes(name, steps, flow, by_flow, at_all):
    rows_ = [(k, d, s, None, None, i) for i, (k, d, s) in enumerate(steps, 1)]
    objs = [("object", o, 0, 8, None, None) for o in (10, 11, 12, 20)]
    edge = flow or [(i, i + 1) for i in range(1, len(steps))]
    pt = P.solve_flow(rows_ + objs + [("edge", a, b, None, None, None) for a, b in edge], 64, False)
    assert {n: {t for t, _ in pt[n]} for n in by_flow} == by_flow
    pt, _ = P.solve_module([r[:5] for r in rows_ + objs], 64)
    assert {n: {t for t, _ in pt[n]} for n in at_all} == at_all


def test_freed_objects_are_invalidated():
    steps = [("alloc", 1, 10), ("alloc", 2, 11), ("store", 1, 2), ("free", 9, 2), ("load", 3, 1)]
    rows_ = [(k, d, s, None, None, i) for i, (k, d, s) in enumerate(steps, 1)] + [("edge", i, i + 1, None, None, None) for i in range(1, 5)] + [("object", 10, 0, 8, None, None)]
    assert P.solve_flow(rows_, 64, False)[3] == {(11, 0)} and P.solve_flow(rows_, 64, True)[3] == {(P.INVALIDATED, 0)}


def test_calls_forks_and_joins_by_pointer(spark):
    cons = spark.createDataFrame([
        (1, "alloc", 1, 50, None, None), (1, "alloc", 2, 60, None, None), (1, "copy", 7, 6, None, None),  # function 50 returns its parameter
        (1, "call", 3, 1, 2, None), (1, "alloc", 4, 61, None, None), (1, "fork", 8, 1, 4, None), (1, "join", 9, 1, None, None),
    ], "module long, kind string, dst long, src long, off long, len long")
    objects = spark.createDataFrame([(1, 50, 0, False)], "module long, obj long, size long, zero boolean")
    functions = spark.createDataFrame([(1, 50, 6, 7)], "module long, obj long, param long, result long")
    small, large = (P.analyse(cons, objects, 64, large, functions)[0] for large in (100, 1))
    assert rows(small) == rows(large)
    got = {(r.n, r.tgt) for r in small.collect()}
    assert {(3, 60), (3, 61), (9, 60), (9, 61), (6, 60), (6, 61)} <= got and (8, 60) not in got


def test_slices_over_calls(spark):
    # functions 1 and 2 call 3, which gives back what it takes: 1's result is 12, from 11; 2's is 22, from 21
    dep = spark.createDataFrame([(3, 1, 2, "data"), (1, 2, 13, "data"), (2, 2, 23, "data")], "fn long, src long, dst long, etype string")
    calls = spark.createDataFrame([(1, 2, 3, 1), (2, 2, 3, 1)], "caller long, call long, callee long, entry long")
    params = spark.createDataFrame([(1, 2, 3, 1, 11, "in"), (1, 2, 3, 2, 2, "out"), (2, 2, 3, 1, 21, "in"), (2, 2, 3, 2, 2, "out")], "caller long, call long, callee long, formal long, actual long, dir string")
    summary = spark.createDataFrame([(1, 11, 2), (2, 21, 2)], "caller long, actual_in long, actual_out long")
    g = D.system_graph(dep, calls, params, summary=summary)
    start = spark.createDataFrame([(1, 13)], "fn long, node long")
    any_ = {(r.fn, r.node) for r in D.backward_slice_over_calls(g, start).collect()}
    exact = {(r.fn, r.node) for r in D.backward_slice_over_calls(g, start, by_context=True).collect()}
    assert any_ == {(1, 13), (1, 2), (1, 11), (3, 1), (3, 2), (2, 21), (2, 2)}
    assert exact == {(1, 13), (1, 2), (1, 11), (3, 1), (3, 2)}
    assert (2, 23) in {(r.fn, r.node) for r in D.forward_slice_over_calls(g, spark.createDataFrame([(1, 11)], "fn long, node long")).collect()}


def test_empty_tables(spark):
    n, e = spark.createDataFrame([], "fn long, node long"), spark.createDataFrame([], "fn long, src long, dst long")
    assert closure(e, ("fn",)).count() == 0 and reach(e, n, ("fn",)).count() == 0
    assert G.degrees(n, e).count() == 0 and C.av(n, e).count() == 0 and G.bfs(e, n).count() == 0


def test_intervals(spark):
    s = spark.createDataFrame([(1, 0, 0, 9, 1, 1, True), (1, 0, 5, 14, 2, 2, False), (1, 0, 8, 8, 3, 3, True)], "module int, obj int, lo long, hi long, val int, pos int, strong boolean")
    assert {(r.lo, r.hi, r.val) for r in I.update(s).collect()} == {(0, 4, 1), (5, 7, 1), (5, 7, 2), (8, 8, 3), (9, 9, 1), (9, 9, 2), (10, 14, 2)}
    q = spark.createDataFrame([(1, 7, 0, 12, 20), (1, 8, 0, 30, 31), (1, 9, 0, 3, 6)], "module int, q int, obj int, lo long, hi long")
    segs = I.add(s)
    assert {(r.q, r.lo, r.hi) for r in I.uncovered(segs, q).collect()} == {(7, 15, 20), (8, 30, 31)}
    assert {(r.q, r.any_overlap, r.full_overlap) for r in I.overlaps(segs, q).collect()} == {(7, True, False), (8, False, False), (9, True, True)}
    unbounded = spark.createDataFrame([(1, 0, 4, None)], "module int, obj int, lo long, hi long")
    assert I.common(unbounded, s).collect()[0][2:] == (4, 14)


def test_pointer_shapes(spark):
    cons = spark.createDataFrame([
        (1, "alloc", 1, 100, None, None), (1, "alloc", 2, 101, None, None), (1, "store", 1, 2, None, None), (1, "load", 3, 1, None, None),  # x = *p
        (1, "gep", 4, 1, 4, None), (1, "store", 4, 1, None, None), (1, "load", 5, 4, None, None),
        (1, "gep", 6, 6, 4, None), (1, "copy", 6, 1, None, None),  # a gep on itself ends in an unknown offset
        (2, "alloc", 1, 7, None, None), (2, "load", 2, 1, None, None),
    ], "module long, kind string, dst long, src long, off long, len long")
    obj = spark.createDataFrame([(1, 100, 16, False), (1, 101, 8, False), (2, 7, 8, True)], "module long, obj long, size long, zero boolean")
    pt, mem = P.analyse(cons, obj)
    got = {(r.module, r.n, r.tgt, r.off) for r in P.absorbed(pt).collect()}
    assert {(1, 3, 101, 0), (1, 5, 100, 0), (2, 2, P.NULL_, 0)} <= got and (1, 6, 100, -1) in got and (1, 6, 100, 0) not in got
    assert (1, 3, 100, 0) not in got
    again = P.analyse(P.optimised(cons)[0], obj)[0]
    assert again.count() > 0 and mem.where("tgt = 101 and off = 0").count() == 1


def test_loops_in_one_pass_equal_relations(spark, random_graphs):
    _, _, _, e = random_graphs
    bodies = G.loop_bodies(closure(e, ("fn",)), e)
    for large in (4_000, 5, 0):
        assert rows(W.loops(e, exits=False, large=large)) == rows(bodies)
        assert rows(W.loops(e, exits=True, large=large)) == rows(G.loop_exits(bodies, e))
    assert not W.loops(e.limit(0), exits=True).collect()


def test_reaching_definitions_in_one_pass_equal_rounds(spark, random_graphs):
    _, _, n, e = random_graphs
    rnd = random.Random(8)
    sites = []
    for fn, node in sorted((r.fn, r.node) for r in n.collect()):
        for i in range(rnd.randint(1, 5)):
            lo = rnd.randint(0, 9)
            sites.append((fn, node, 10 * node + i, rnd.choice(["def", "kill", "use"]), rnd.randint(0, 1), lo, rnd.choice([None, lo, lo + 3, lo - 1])))
            if rnd.random() < 0.3:  # one position may touch several objects
                sites.append((*sites[-1][:3], rnd.choice(["def", "kill", "use"]), rnd.randint(0, 1), lo, lo + 2))
    s = spark.createDataFrame(sites, "fn long, node long, pos long, role string, obj long, lo long, hi long").cache()
    reads = s.where("role = 'use'").select("fn", "node", "pos").distinct()
    want, wide = rows(M.reaching_in_rounds(s, e)), rows(M.unknown_reads_in_rounds(s, e, reads))
    assert len(want) > 100
    for large in (2_000, 12, 0):
        assert rows(M.reaching(s, e, large=large)) == want
        assert rows(M.unknown_reads(s, e, reads, large=large)) == wide
    assert not M.reaching(s.limit(0), e.limit(0)).collect()


def test_reaching_definitions_across_blocks(spark):
    sites = spark.createDataFrame([(1, 1, 1, "kill", 0, 0, 3), (1, 2, 2, "kill", 0, 2, 5), (1, 3, 3, "use", 0, 0, 7), (1, 3, 4, "def", 0, 0, 0), (1, 3, 5, "use", 0, 0, 0)], "fn long, node long, pos long, role string, obj long, lo long, hi long")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3)], "fn long, src long, dst long")
    assert {(r.use, r["def"]) for r in M.reaching(sites, edges).collect()} == {(3, 1), (3, 2), (5, 4), (5, 1)}


def test_summary_edges(spark):
    # callee: formal in 11 -> 12 -> formal out 13; 20 calls it with actuals 21 -> 22; 30 calls the caller
    dep = spark.createDataFrame([(11, 12), (12, 13), (14, 14), (23, 21), (22, 24)], "src long, dst long")
    params = spark.createDataFrame([(20, 11, 21, "in"), (20, 13, 22, "out"), (30, 23, 31, "in"), (30, 24, 32, "out")], "call long, formal long, actual long, dir string")
    assert {(r.call, r.actual_in, r.actual_out) for r in D.summary_edges(dep, params).collect()} == {(20, 21, 22), (30, 31, 32)}


def test_unused_functions(spark):
    fns = spark.createDataFrame([(i,) for i in range(1, 7)], "fn long")
    uses = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (6, 5)], "user long, fn long")
    assert {r.fn for r in D.unused_functions(fns, uses, 1).collect()} == {3, 4}


def test_relation_laws(spark):
    from pyspark.sql import functions as F

    one = spark.range(4096).select(F.col("id").cast("int").alias("r"))
    assert one.where(R.inverted(R.inverted(F.col("r"))) != F.col("r")).count() == 0
    done = spark.createDataFrame(one.select(R.implied(F.col("r")).alias("r")).distinct().collect(), "r int")
    assert done.where(R.implied(F.col("r")) != F.col("r")).count() == 0
    low = one.where("r < 1024")
    assert low.where(R.negated(R.negated(F.col("r"))) != F.col("r")).count() == 0
    vr = spark.createDataFrame([(1, 1, R.BIT["SLE"], 2), (1, 2, R.BIT["SLE"], 3), (1, 3, R.BIT["SLE"], 1), (1, 3, R.BIT["SLT"], 4)], "loc long, lt long, rels int, rt long")
    assert {(r.val, r.cls) for r in R.classes(vr).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert (1, "SLT", 4) in {(r.lt, r.rel, r.rt) for r in R.closed(vr).collect()}


def test_thread_library(spark):
    calls = spark.createDataFrame([(1, 1, "pthread_create"), (1, 2, "puts")], "module long, node long, name string")
    assert {(r.node, r.kind) for r in T.recognised(calls).collect()} == {(1, "FORK"), (2, "CALL")}


def test_pointer_facts_hold_every_statement(spark, duck):
    stmt = fact(spark, SMALL, "stmt")
    assert stmt.agg({"pos": "max"}).first()[0] > 16 and fact(spark, SMALL, "cons").count() == stmt.count() == duck.execute("select count(*) from lineitem join orders on o_orderkey = l_orderkey").fetchone()[0]
    for name in ("m01_accesses", "m05_library_effects", "m06_undefined_calls", "x07_statistics"):
        assert rows(catalog.QUERIES[name](spark, SMALL)) == sql_rows(duck, catalog.SQL[name])


def test_value_relations_hold_every_order(spark, duck):
    want = duck.execute("select count(*) from (select distinct l_orderkey % 2000, l_partkey % 12, l_linenumber, l_suppkey % 12 from lineitem)").fetchone()[0]
    assert fact(spark, SMALL, "vr_fact").count() == want
    assert rows(catalog.QUERIES["v08_contradictions"](spark, SMALL)) == sql_rows(duck, catalog.SQL["v08_contradictions"])


def test_modref_covers_every_object(spark):
    sites, calls = fact(spark, SMALL, "mem_site").collect(), {(r.callee, r.caller) for r in fact(spark, SMALL, "call_edge").collect()}
    own = {}
    for r in sites:
        own.setdefault(r.fn, set()).add(("ref" if r.role == "use" else "mod", r.obj, r.lo, r.hi))
    callers = {}
    for callee, caller in calls:
        callers.setdefault(callee, set()).add(caller)
    want, todo = {}, list(own.items())
    while todo:
        fn, facts = todo.pop()
        new = facts - want.setdefault(fn, set())
        want[fn] |= new
        todo += [(c, new) for c in callers.get(fn, ()) if new]
    got = {tuple(r) for r in catalog.QUERIES["m12_modref"](spark, SMALL).select("fn", "role", "obj", "lo", "hi").collect()}
    assert got == {(fn, *x) for fn, facts in want.items() for x in facts} and len({x[2] for x in got}) == 6


def test_call_graph_tells_each_function_once(spark, monkeypatch):
    monkeypatch.setattr(D, "PACK", 3)
    monkeypatch.setattr(D, "CALLS_DEALT", 2)
    rnd = random.Random(5)
    direct = [(rnd.randint(1, 6), rnd.randint(1, 4), rnd.randint(1, 9)) for _ in range(12)]
    ptr = [(rnd.randint(1, 6), rnd.randint(1, 4), n, rnd.choice([1, 3])) for n in range(25)] + [(1, 1, 7, 1), (1, 1, 7, 1), (1, 1, 8, 3)]
    pt = [(n, rnd.randint(1, 40)) for n in range(0, 25, 3)]
    taken = [(fn, rnd.choice([0, 1, 3])) for fn in range(1, 40, 2)] + [(3, 1), (3, 3), (3, 3)]
    known = {(c, p, t) for c, p, n, _ in ptr for m, t in pt if m == n and t in {fn for fn, _ in taken}}
    found = {(c, p) for c, p, _ in known}
    want = set(direct) | known | {(c, p, fn) for c, p, _, k in ptr if (c, p) not in found for fn, j in taken if j == k}
    df = D.call_graph(spark.createDataFrame(direct, "caller long, call long, callee long"), spark.createDataFrame(ptr, "caller long, call long, n long, n_args long"), spark.createDataFrame(pt, "n long, tgt long"), spark.createDataFrame(taken, "fn long, n_args long"))
    assert sorted(map(tuple, df.select("caller", "call", "callee").collect())) == sorted(want)


def test_calls_by_pointer_meet_packs_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(D, "PACK", 3)
    monkeypatch.setattr(D, "CALLS_DEALT", 2)
    ptr = [(i % 5, i, 100 + i, k) for i, k in enumerate([1, 1, 1, 2, 7, None, 1, 2])] + [(0, 0, 100, 2)]
    taken = [(fn, 1) for fn in range(20)] + [(None, 1), (30, 2), (31, 2), (32, None), (3, 1), (40, 5)]
    want = {(c, p, fn) for c, p, _, k in ptr if k is not None for fn, j in set(taken) if j == k} | {(0, 0, 3)}
    long = lambda *names: ", ".join(f"{n} long" for n in names)
    df = D.call_graph(spark.createDataFrame([(0, 0, 3)], long("caller", "call", "callee")), spark.createDataFrame(ptr, long("caller", "call", "n", "n_args")), spark.createDataFrame([], long("n", "tgt")), spark.createDataFrame(taken, long("fn", "n_args")))
    got = [tuple(r) for r in df.select("caller", "call", "callee").collect()]
    assert len(got) == len(want) and set(got) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" in plan


def test_effects_carried_to_callers_equal_rounds(spark):
    rnd = random.Random(8)
    sites = [(rnd.choice([*range(30), None]), 1, i, rnd.choice(["def", "kill", "use"]), rnd.randint(0, 5), rnd.choice([None, rnd.randint(0, 60)]), rnd.choice([None, rnd.randint(60, 99)])) for i in range(150)]
    calls = [(rnd.choice([*range(40), None]), i, rnd.choice([*range(40), None])) for i in range(60)] + [(40 + i + 1, 1, 40 + i) for i in range(5)] + [(40, 1, 0), (3, 1, 3)]
    s, c = spark.createDataFrame(sites, "fn long, node long, pos long, role string, obj long, lo long, hi long"), spark.createDataFrame(calls, "caller long, call long, callee long")
    for escaping in (spark.range(5), spark.range(0)):
        escaping = escaping.withColumnRenamed("id", "obj")
        got = rows(M.modref(s, c, escaping))
        assert len(got) == len(set(got)) and got == rows(M.modref(s, c, escaping, large=0))
        assert rows(M.modref_hulls(s, c, escaping)) == rows(M.modref_hulls(s, c, escaping, large=0))
    assert not got


def test_slices_in_one_pass_equal_rounds(spark, random_graphs):
    nodes, edges, n, e = random_graphs
    odd = spark.createDataFrame([(0, None, 2), (0, 2, None), (None, 1, 2), (900, 1, 2)], e.schema)
    dep = e.unionByName(e).unionByName(odd)
    criteria = n.where("fn % 3 > 0 AND node % 2 = 0").unionByName(spark.createDataFrame([(None, 4), (901, 7), (0, 2), (0, 2)], n.schema))
    for one in (D.backward_slice, D.forward_slice, D.repaired):
        got = rows(one(dep, criteria))
        assert got and len(got) == len(set(got)) and got == rows(one(dep, criteria, large=12)), one


def test_data_edges_and_post_dominators_in_one_pass_equal_rounds(spark, random_graphs):
    nodes, edges, n, e = random_graphs
    rnd = random.Random(4)
    sites = spark.createDataFrame([(fn, rnd.choice(nodes[fn]), pos, rnd.choice(["def", "kill", "use"]), rnd.randint(0, 2), lo := rnd.randint(0, 4), lo + 3) for fn in nodes for pos in range(12)], "fn long, node long, pos long, role string, obj long, lo long, hi long")
    got = rows(M.data_edges(sites, e))
    assert got and got == rows(M.data_edges(sites, e, large=0))
    assert rows(W.post_dominators(n, e)) == rows(W.facts(n, e)["pdom"]) == rows(W.post_dominators(n, e, large=0))


def test_blocks_in_one_pass_equal_doubling(spark, random_graphs):
    _, _, n, e = random_graphs
    n, e = n.where("fn < 15"), e.where("fn < 15")
    ring = [(99, 1, 2), (99, 3, 4), (99, 4, 3), (99, 2, 5), (99, 5, 6), (99, 8, 7)]
    e = e.unionByName(spark.createDataFrame(ring, e.schema))
    n = n.unionByName(spark.createDataFrame([(99, i) for i in range(1, 8)], n.schema))
    got = rows(G.blocks(n, e))
    assert got == rows(G.blocks(n, e, large=4)) and [(b, v) for b, f, v in got if f == 99] == [(1, 1), (1, 2), (1, 5), (1, 6)]


def test_parallel_regions_in_one_pass_equal_relations(spark):
    rnd = random.Random(6)
    region = spark.createDataFrame([(m, node, node // 2) for m in range(8) for node in range(2 * m + 3)] + [(9, 1, 1)], "module long, node long, region long")
    edge = spark.createDataFrame([(m, rnd.randint(0, m + 1), rnd.randint(0, m + 1)) for m in range(8) for _ in range(m)], "module long, src_region long, dst_region long")
    order = closure(edge.select("module", edge.src_region.alias("src"), edge.dst_region.alias("dst")), ("module",), "order")
    want = rows(T.parallel(region, order))
    assert want and rows(T.parallel_by_edges(region, edge)) == want == rows(T.parallel_by_edges(region, edge, large=8))


def test_flow_sensitive_steps_run_again_only_after_what_they_read(monkeypatch):
    n, calls, plain = 40, [], P.moved_offset
    monkeypatch.setattr(P, "moved_offset", lambda *a: calls.append(a) or plain(*a))
    steps = [("gep", n - i, n - i - 1, 0, None, i + 1) for i in range(n)] + [("alloc", 0, 9, None, None, n + 1)]
    flow = [("edge", i, i + 1, None, None, None) for i in range(1, n + 1)]
    got = P.solve_flow(steps + flow + [("object", 9, 0, 4, None, None)], 8, False)
    assert got == {i: {(9, 0)} for i in range(n + 1)} and len(calls) <= 2 * n


def test_points_to_rules_are_applied_again_only_after_growth(monkeypatch):
    n, calls, plain = 40, [], P.moved_offset
    monkeypatch.setattr(P, "moved_offset", lambda *a: calls.append(a) or plain(*a))
    rules = [("gep", n - i, n - i - 1, 0, None) for i in range(n)] + [("alloc", 0, 9, None, None), ("object", 9, 0, 4, None)]
    pt, mem = P.solve_module(rules, 8)
    assert pt == {i: {(9, 0)} for i in range(n + 1)} and not mem and len(calls) <= n


def test_points_to_neither_orders_statements_nor_is_written_twice(spark):
    at = SMALL + "/."  # tables of its own
    pt, mem = (catalog.QUERIES[q](spark, at) for q in ("p13_points_to", "p13_memory"))
    assert not any(key[1] == at and key[2] in ("fact-stmt", "fact-small_stmt") for key in facts._kept)
    assert {f.rpartition("/")[0] for f in pt.inputFiles()} == {f.rpartition("/")[0] for f in mem.inputFiles()}


def test_moved_cells_are_gathered_before_they_are_written(monkeypatch):
    """What many cells hold goes to each of many targets once, not cell by cell."""
    n, calls, plain = 40, [], P.moved_offset
    monkeypatch.setattr(P, "moved_offset", lambda *a: calls.append(a) or plain(*a))
    rows = [("object", o, 0, 400, None) for o in range(n)] + [("alloc", 0, o, None, None) for o in range(n)] + [("gep", 0, 0, 4, None)]
    rows += [("store", 0, 0, None, None), ("memcpy", 0, 0, None, 8)]
    pt, mem = P.solve_module(rows, 16)
    every = {(o, at) for o in range(n) for at in (-1, 0, 4, 8, 12)}
    assert len(calls) < 10 * len(every)
    assert pt == {0: every} and mem == {o: dict.fromkeys((-1, 0, 4, 8, 12), every) for o in range(n)}


def test_points_to_sets_of_many_modules_side_by_side():
    """As bits, against one module at a time: rules of every kind, sizes and lengths, also such as don't fit the bits."""
    rnd = random.Random(21)
    for limit in (1, 3, 8, 1 << 60):
        rows_ = [(None, "alloc", 1, 2, None, None), (None, "copy", 3, 1, None, None)]
        for module in range(120):
            n = rnd.choice([2, 4, 8])
            for _ in range(rnd.randrange(1, 40)):
                kind = rnd.choice(["alloc", "alloc", "copy", "gep", "load", "store", "memcpy", "null"] + ["call"] * (module % 40 == 0))
                dst, src = rnd.randrange(n), rnd.randrange(rnd.choice([n, n, 20 if module % 30 == 1 else n]))
                off = rnd.choice([None, 0, 1, 4, 8, 30, -2]) if kind == "gep" else None
                rows_.append((module, kind, None if rnd.random() < 0.002 else dst, None if kind == "null" else src, off, rnd.choice([0, 1, 2, 8, 40] + [None] * (module % 25 == 0)) if kind == "memcpy" else None))
            rows_ += [(module, "object", o, rnd.choice([0, 0, 1, None]), rnd.choice([None, 0, 1, 5, 7, 9, 60]), None) for o in range(rnd.randrange(7))]
        table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows_, strict=True), (pa.int64(), pa.string(), *[pa.int64()] * 4), strict=True)], names=["module", "kind", "dst", "src", "off", "len"])
        got = [tuple(r.values()) for part in P.solve_tables(table, limit) for r in part.to_pylist()]
        want = [(m, *r) for m in (None, *range(120)) for r in zip(*P.solve_columns([x[1:] for x in rows_ if x[0] == m], limit), strict=True)]
        assert len(got) == len(set(got)) and set(got) == set(want) and len(want) > 1000


def test_invalid_dependences_meet_once(spark):
    """As joins tell them, with nulls, from one shuffle."""
    rnd = random.Random(36)
    some = lambda n: rnd.choice([*range(n), None])
    nodes = {(some(4), some(9)) for _ in range(25)}
    dep = {(some(4), some(9), some(9), rnd.choice(["control", "data", "use", None])) for _ in range(60)}
    told = {(some(4), some(9), some(9)) for _ in range(30)} | {(f, b, a) for f, a, b, e in dep if e == "control" and rnd.random() < 0.5}
    ends = {(f, x) for f, a, b, _ in dep for x in (a, b)}
    is_ = {(f, b, a) for f, a, b, e in dep if e == "control"}
    lacking = lambda rows_, others, name: {(*r[:2], name) for r in rows_ if None in r or r not in others}
    want = lacking(ends, nodes, "no node") | lacking(is_, told, "unknown control") | lacking(told, is_, "missing control") | lacking(nodes, ends, "isolated")
    out = D.invalid_dependences(*(spark.createDataFrame(sorted(d, key=repr), ddl) for d, ddl in ((nodes, "fn long, node long"), (dep, "fn long, src long, dst long, etype string"), (told, "fn long, node long, depends_on long"))))
    got = [tuple(r) for r in out.select("fn", "node", "error").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({e for *_, e in want}) == 4
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
