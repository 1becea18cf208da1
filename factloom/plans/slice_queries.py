"""Queries of dependence graphs, slicing, call graphs, threads and value relations over the derived program facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import depgraph as D
from ..operators import memory as M
from ..operators import relations as R
from ..operators import threads as T
from ..sources.facts import fact
from . import graph_queries, memory_queries

CRITERIA = "ok % 10 = 0"
#: Positions from here on are calls.
AFTER = 1_000_000


class Inputs(graph_queries.Inputs):
    criteria = property(lambda s: s.nodes.where(CRITERIA).select("fn", "node"))
    use = property(lambda s: s.typed.where("etype = 'use'").select("fn", "src", "dst"))

    effect_hulls = property(lambda s: s.keep("effect-hulls", lambda: M.modref_hulls(s.fact("mem_site"), s.calls, s.fact("mem_site").select("obj").distinct())))

    def fact(self, name: str) -> DataFrame:
        return fact(self.spark, self.sf, name)

    #: Data dependence between nodes: of the writes that reach their reads.
    data = property(lambda s: s.keep("data", lambda: M.data_edges(s.fact("mem_site"), s.edges)))
    dep = property(lambda s: s.keep("dep", lambda: D.dependence_graph(s.use, s.data, s.scd)))
    back = property(lambda s: s.keep("slice", lambda: D.backward_slice(s.dep, s.criteria)))
    tnode, tedge = property(lambda s: s.fact("thread_event")), property(lambda s: s.fact("thread_edge"))
    mutex = property(lambda s: s.tnode.select("module", "node", F.col("mutex").alias("tgt")))
    region = property(lambda s: s.keep("region", lambda: T.regions(s.tnode, s.tedge)))
    locks = property(lambda s: T.matched(s.tnode, s.mutex, "LOCK", "UNLOCK"))
    vr = property(lambda s: s.fact("vr_fact").select("loc", "lt", F.expr("shiftleft(1, CAST(rel AS INT) - 1)").alias("rels"), "rt"))
    vr_closed = property(lambda s: s.keep("vr-closed", lambda: R.closed(s.vr)))

    address_taken = property(lambda s: s.nodes.select("fn").distinct().where("fn % 10 < 3").select("fn", (F.col("fn") % 4).alias("n_args")))

    @property
    def pairs_of_calls(self) -> tuple[DataFrame, ...]:
        c = self.keep("numbered-calls", lambda: self.calls.join(self.nodes.select(F.col("fn").alias("caller"), F.col("node").alias("call"), "ok"), ["caller", "call"]))
        direct = c.where("ok % 2 = 0").select("caller", "call", "callee")
        ptr = c.where("ok % 2 = 1").select("caller", "call", F.col("ok").alias("n"), (F.col("ok") % 4).alias("n_args"))
        pt = c.where("ok % 2 = 1 AND ok % 3 <> 0").select(F.col("ok").alias("n"), F.col("callee").alias("tgt"))
        return direct, ptr, pt, self.address_taken

    @property
    def params(self) -> DataFrame:
        """Each call passes the node before it in and takes its own node out; a function's first node is its formal in, its last its formal out."""
        c = self.calls
        last = self.nodes.groupBy(F.col("fn").alias("callee")).agg(F.max("node").alias("k"))
        c = c.join(last, "callee")
        ins = c.where("call > 1").select("caller", "call", "callee", F.lit(1).cast("long").alias("formal"), (F.col("call") - 1).alias("actual"), F.lit("in").alias("dir"))
        return ins.unionByName(c.select("caller", "call", "callee", F.col("k").alias("formal"), F.col("call").alias("actual"), F.lit("out").alias("dir")))

    @property
    def summary(self) -> DataFrame:
        """(call, actual_in, actual_out), nodes of all functions in one number: the function above 32 bits, the node below."""
        one = lambda fn, node: F.shiftleft(fn, 32) + F.col(node)
        p = self.params.select(one("caller", "call").alias("call"), one("callee", "formal").alias("formal"), one("caller", "actual").alias("actual"), "dir")
        dep = self.use.unionByName(self.edges).select(one("fn", "src").alias("src"), one("fn", "dst").alias("dst")).distinct()
        return self.keep("summary", lambda: D.summary_edges(dep, p))

    @property
    def system(self) -> DataFrame:
        entries = self.calls.withColumn("entry", F.lit(1).cast("long"))
        stops = C.interprocedural(self.edges, C.no_return(self.nodes, self.edges, self.calls, self.returns))
        return self.keep("system", lambda: D.system_graph(self.dep, entries, self.params, stops))

    started = property(lambda s: s.nodes.where("ok % 50 = 0").select("fn", "node"))


def q(f):
    return lambda spark, sf: f(Inputs(spark, sf))


def texts(i: Inputs) -> DataFrame:
    return i.spark.createDataFrame([("f1.c#fun1##",), ("#fun2#3#,##2#o1",), ("###@o5",), ("f0.c##1#",)], "criterion string")


def rels(i: Inputs) -> DataFrame:
    return i.spark.range(4096).select(F.col("id").cast("int").alias("rels"))


def single(i: Inputs) -> DataFrame:
    b = i.spark.range(144).select(F.expr("shiftleft(1, CAST(id % 12 AS INT))").alias("a"), F.expr("shiftleft(1, CAST(id DIV 12 AS INT))").alias("b"))
    return b


def area(i: Inputs, where: str) -> DataFrame:
    return i.nodes.where(where).select("fn", F.col("node").alias("loc"), (F.col("ok") % 3).alias("area")).distinct()


QUERIES = {
    "s01_use_edges": q(lambda i: i.use),
    "s02_data_edges": q(lambda i: i.data),
    "s06_dependence_graph": q(lambda i: i.dep),
    "s08_backward_slice": q(lambda i: i.back),
    "s09_forward_slice": q(lambda i: D.forward_slice(i.dep, i.criteria)),
    "s10_apply_slice": q(lambda i: D.apply_slice(i.nodes.select("fn", "node"), i.back)),
    "s10_slice_statistics": q(lambda i: D.slice_statistics(i.blocks, i.back)),
    "s11_repair": q(lambda i: D.repaired(i.edges, i.back)),
    "s12_criteria": q(lambda i: D.match_criteria(i.fact("source_stmt"), texts(i))),
    "s13_secondary": q(lambda i: D.secondary(i.edges, i.criteria, i.nodes.where("ok % 3 = 1").select("fn", "node"))),
    "s14_next_instruction": q(lambda i: D.next_instruction(i.criteria, i.blocks)),
    "s15_cutoff": q(lambda i: D.cutoff(i.nodes, i.edges, i.criteria)),
    "s16_unused_functions": q(lambda i: D.unused_functions(i.nodes, i.calls.select(F.col("caller").alias("user"), F.col("callee").alias("fn")).distinct(), 1)),
    "s18_lines": q(lambda i: D.lines(i.fact("source_stmt"), i.back)),
    "s19_summary_edges": q(lambda i: i.summary),
    "s05_parameters": q(lambda i: i.params),
    "s08_slice_over_calls": q(lambda i: D.backward_slice_over_calls(i.system, i.started)),
    "s09_forward_over_calls": q(lambda i: D.forward_slice_over_calls(i.system, i.started)),
    "s20_system_graph": q(lambda i: i.system),
    "s17_module_statistics": q(lambda i: D.module_statistics(i.nodes, i.edges, i.calls, 1)),
    "g16_invalid_dependences": q(lambda i: D.invalid_dependences(i.nodes, i.dep, i.scd)),
    "m07_call_effects": q(lambda i: M.call_effects(i.effect_hulls, i.calls, AFTER)),
    "m13_reaching_over_calls": q(lambda i: M.reaching_over_calls(i.fact("mem_site"), i.edges, i.calls, i.fact("mem_site").select("obj").distinct(), AFTER)),
    "m15_unknown_writes": q(lambda i: M.unknown_writes(i.fact("mem_site"), i.edges, i.fact("mem_site").where("role = 'def'").select("fn", "node", "pos").distinct())),
    "m18_summary": q(lambda i: M.summary(i.fact("mem_site"))),
    "k01_call_graph": q(lambda i: D.call_graph(*i.pairs_of_calls)),
    "k02_callers": q(lambda i: i.calls.groupBy("callee").agg(F.countDistinct("caller").alias("n_callers"), F.count("*").alias("n_calls"))),
    "k03_address_taken": q(lambda i: i.address_taken),
    "x04_dot": q(lambda i: D.dot(i.dep)),
    "t03_lock_pairs": q(lambda i: i.locks),
    "t02_fork_join_pairs": q(lambda i: T.matched(i.tnode, i.mutex, "FORK", "JOIN")),
    "t04_regions": q(lambda i: i.region),
    "t04_region_edges": q(lambda i: T.region_edges(i.tedge, i.region)),
    "t05_critical_sections": q(lambda i: T.critical_sections(i.tedge, i.locks)),
    "t06_parallel_all": q(lambda i: T.parallel(i.region)),
    "t06_parallel": q(lambda i: T.parallel_by_edges(i.region, T.region_edges(i.tedge, i.region))),
    "t07_interference": q(lambda i: T.interference(i.region, i.fact("thread_access"), T.parallel(i.region))),
    "v01_algebra": q(lambda i: rels(i).select("rels", R.inverted(F.col("rels")).alias("inv"), R.negated(F.col("rels")).alias("neg"), R.conflicting(F.col("rels")).alias("conf"), R.strict(F.col("rels")).alias("st"), R.non_strict(F.col("rels")).alias("nst"), R.conflict(F.col("rels")).alias("bad"))),
    "v05_compose": q(lambda i: single(i).select("a", "b", R.composed(F.col("a"), F.col("b")).alias("c"))),
    "v07_classes": q(lambda i: R.classes(i.vr)),
    "v06_closure": q(lambda i: i.vr_closed),
    "v08_contradictions": q(lambda i: R.contradictions(i.vr)),
    "v09_first_strict": q(lambda i: R.first_strict(i.vr_closed)),
    "v10_bounds": q(lambda i: R.bounds(i.vr_closed, i.spark.range(3).select((F.col("id") * 4).alias("val"), (F.col("id") * 10).alias("value")))),
    "v17_common": q(lambda i: R.common(i.vr.withColumn("pred", F.col("loc") % 2).withColumn("loc", F.expr("loc DIV 2")).groupBy("loc", "pred", "lt", "rt").agg(F.bit_or("rels").alias("rels")), i.vr.select(F.expr("loc DIV 2").alias("loc"), (F.col("loc") % 2).alias("p")).groupBy("loc").agg(F.countDistinct("p").alias("n")))),
    "v21_valid_areas": q(lambda i: R.valid_areas(i.edges, i.nodes.select("fn", F.col("node").alias("loc")), area(i, "ok % 5 < 2"), area(i, "ok % 7 = 0"))),
}


def bits(column: str, rows: tuple) -> str:
    return " | ".join(f"(CASE WHEN {column} & {1 << k} <> 0 THEN {R.mask(n)} ELSE 0 END)" for k, n in enumerate(rows) if n) or "0"


RULES = [*R.CHAINS, *[(n, "EQ", n) for n in R.NAMES if n not in ("NE", "PT", "PF")], *[("EQ", n, n) for n in R.NAMES[2:10]]]
VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

PARTS = graph_queries.PARTS | {k: v for k, v in memory_queries.PARTS.items() if k in ("spoint", "selem", "sseg", "bdef", "skill", "inflow", "uses")} | {
    "crit": f"SELECT fn, node FROM node WHERE {CRITERIA}",
    "use_edge": "SELECT fn, node - 2 AS src, node AS dst FROM node WHERE node > 2 AND ok % 3 = 0",
    "reaches": memory_queries.ORACLE["m10_reaching_definitions"],
    "data_edge": "SELECT DISTINCT r.fn, d.node AS src, u.node AS dst FROM reaches r JOIN mem_site d ON d.fn = r.fn AND d.pos = r.def JOIN mem_site u ON u.fn = r.fn AND u.pos = r.use",
    "dep": "SELECT fn, src, dst, 'use' AS etype FROM use_edge UNION SELECT fn, src, dst, 'data' FROM data_edge UNION SELECT fn, depends_on, node, 'control' FROM scd",
    "bslice": "SELECT fn, node AS criterion, node FROM crit UNION SELECT s.fn, s.criterion, d.src FROM bslice s JOIN dep d ON d.fn = s.fn AND d.dst = s.node",
    "marked": "SELECT fn, criterion, node FROM bslice UNION SELECT fn, node, 1 FROM crit",
    "fhit": "SELECT fn, node FROM crit UNION SELECT h.fn, d.dst FROM fhit h JOIN dep d ON d.fn = h.fn AND d.src = h.node",
    "fneed": "SELECT fn, node FROM fhit UNION SELECT n.fn, d.src FROM fneed n JOIN dep d ON d.fn = n.fn AND d.dst = n.node",
    "keptn": "SELECT DISTINCT fn, node FROM marked",
    "over": """SELECT e.fn, e.src, e.dst FROM cfg_edge e JOIN keptn k ON k.fn = e.fn AND k.node = e.src
        UNION SELECT o.fn, o.src, e.dst FROM over o ANTI JOIN keptn k ON k.fn = o.fn AND k.node = o.dst JOIN cfg_edge e ON e.fn = o.fn AND e.src = o.dst""",
    "ccall": "SELECT c.caller, c.call, c.callee, n.ok FROM call_edge c JOIN node n ON n.fn = c.caller AND n.node = c.call",
    "taken": "SELECT DISTINCT fn, fn % 4 AS n_args FROM node WHERE fn % 10 < 3",
    "known": "SELECT c.caller, c.call, p.callee FROM ccall c JOIN ccall p ON p.ok = c.ok AND p.ok % 3 <> 0 JOIN taken t ON t.fn = p.callee WHERE c.ok % 2 = 1",
    "live": "SELECT fn, node FROM crit UNION SELECT l.fn, e.src FROM live l JOIN cfg_edge e ON e.fn = l.fn AND e.dst = l.node",
    "bound": """SELECT e.* FROM thread_edge e JOIN thread_event a ON a.module = e.module AND a.node = e.src JOIN thread_event b ON b.module = e.module AND b.node = e.dst
        WHERE a.kind IN ('EXIT', 'FORK') OR b.kind IN ('ENTRY', 'JOIN') OR (SELECT count(*) FROM thread_edge x WHERE x.module = e.module AND x.dst = e.dst) > 1""",
    "inner_edge": "SELECT module, src, dst FROM thread_edge EXCEPT SELECT module, src, dst FROM bound",
    "reg": """SELECT module, node, node AS region FROM thread_event n WHERE NOT EXISTS (SELECT 1 FROM inner_edge i WHERE i.module = n.module AND i.dst = n.node)
        UNION SELECT r.module, i.dst, r.region FROM reg r JOIN inner_edge i ON i.module = r.module AND i.src = r.node""",
    "redge": "SELECT DISTINCT e.module, a.region AS src_region, b.region AS dst_region FROM thread_edge e JOIN reg a ON a.module = e.module AND a.node = e.src JOIN reg b ON b.module = e.module AND b.node = e.dst WHERE a.region <> b.region",
    "rorder": "SELECT module, src_region, dst_region FROM redge UNION SELECT o.module, o.src_region, e.dst_region FROM rorder o JOIN redge e ON e.module = o.module AND e.src_region = o.dst_region",
    "par": "SELECT DISTINCT a.module, a.region AS r1, b.region AS r2 FROM reg a JOIN reg b ON b.module = a.module AND a.region < b.region",
    "lockp": "SELECT DISTINCT a.module, a.node AS a, b.node AS b FROM thread_event a JOIN thread_event b ON b.module = a.module AND b.mutex = a.mutex WHERE a.kind = 'LOCK' AND b.kind = 'UNLOCK'",
    "csec": """SELECT DISTINCT p.module, p.a AS lock, e.dst AS node FROM lockp p JOIN thread_edge e ON e.module = p.module AND e.src = p.a
        UNION SELECT c.module, c.lock, e.dst FROM csec c ANTI JOIN lockp p ON p.module = c.module AND p.a = c.lock AND p.b = c.node JOIN thread_edge e ON e.module = c.module AND e.src = c.node""",
    "vrb": f"""SELECT loc, lt, rt, bit_or(r) AS r FROM (
        SELECT loc, lt, rt, (1 << (rel - 1))::INT AS r FROM vr_fact
        UNION ALL SELECT loc, rt, lt, {bits('(1 << (rel - 1))::INT', R.INVERSE)} FROM vr_fact) GROUP BY loc, lt, rt""",
    "vri": f"SELECT loc, lt, rt, CASE WHEN q & 514 = 514 THEN q | 0 ELSE q END AS rels FROM (SELECT loc, lt, rt, r | {bits('r', R.IMPLIED)} AS q FROM vrb)",
    "vrf": """SELECT loc, lt, rt, (rels | CASE WHEN rels & 6 = 6 THEN 8 ELSE 0 END | CASE WHEN rels & 66 = 66 THEN 128 ELSE 0 END | CASE WHEN rels & 18 = 18 THEN 32 ELSE 0 END | CASE WHEN rels & 258 = 258 THEN 512 ELSE 0 END)::INT AS rels FROM vri""",
    "vredge": "SELECT loc, lt, n.name AS rel, rt FROM vrf JOIN (VALUES " + VALUES([(i, n) for i, n in enumerate(R.NAMES[:10]) if n != "NE"]) + ") n(i, name) ON (rels >> n.i) & 1 = 1",
    "rule": f"SELECT * FROM (VALUES {VALUES(RULES)}) t(a, b, c)",
    "vrc": "SELECT loc, lt, rel, rt FROM vredge UNION SELECT p.loc, p.lt, u.c, e.rt FROM vrc p JOIN vredge e ON e.loc = p.loc AND e.lt = p.rt JOIN rule u ON u.a = p.rel AND u.b = e.rel",
    "ck": "SELECT DISTINCT loc, k.k, lt, rt FROM vrf JOIN (VALUES ('EQ', 1), ('SLE', 5), ('ULE', 17)) k(k, m) ON rels & k.m <> 0 WHERE lt <> rt",
    "cp": "SELECT loc, k, lt, rt FROM ck UNION SELECT p.loc, p.k, p.lt, e.rt FROM cp p JOIN ck e ON e.loc = p.loc AND e.k = p.k AND e.lt = p.rt",
    "csame": "SELECT DISTINCT p.loc, p.lt, p.rt FROM cp p JOIN cp q ON q.loc = p.loc AND q.k = p.k AND q.lt = p.rt AND q.rt = p.lt",
    "cm": "SELECT loc, lt, rt FROM csame UNION SELECT m.loc, m.lt, s.rt FROM cm m JOIN csame s ON s.loc = m.loc AND s.lt = m.rt",
    "slt": "SELECT DISTINCT loc, lt, rt FROM vrc WHERE rel = 'SLT' AND lt <> rt",
    "amade": "SELECT DISTINCT fn, node AS loc, ok % 3 AS area FROM node WHERE ok % 5 < 2",
    "aend": "SELECT DISTINCT fn, node AS loc, ok % 3 AS area FROM node WHERE ok % 7 = 0",
    "aall": "SELECT n.fn, n.node AS loc, a.area FROM node n JOIN (SELECT DISTINCT fn, area FROM amade) a ON a.fn = n.fn",
    "abad": """SELECT fn, loc, area FROM aall a WHERE NOT EXISTS (SELECT 1 FROM cfg_edge e WHERE e.fn = a.fn AND e.dst = a.loc)
        UNION SELECT e.fn, c.dst, e.area FROM aend e JOIN cfg_edge c ON c.fn = e.fn AND c.src = e.loc
        UNION SELECT b.fn, c.dst, b.area FROM abad b ANTI JOIN (SELECT * FROM amade ANTI JOIN aend USING (fn, loc, area)) m ON m.fn = b.fn AND m.loc = b.loc AND m.area = b.area JOIN cfg_edge c ON c.fn = b.fn AND c.src = b.loc""",
}

def over_calls(text: str) -> str:
    """The SQL of reaching definitions over the sites with the effects of calls among them."""
    for name in ("mem_site", "spoint", "selem", "sseg", "bdef", "skill", "inflow", "uses"):
        text = re.sub(rf"\b{name}\b", f"c_{name}", text)
    return text


PARTS |= {"mref": memory_queries.PARTS["mref"]} | {
    "ceff": f"""SELECT c.caller AS fn, c.call AS node, {AFTER} + c.call AS pos, CASE WHEN h.role = 'mod' THEN 'def' ELSE 'use' END AS role, h.obj, min(h.lo) AS lo, max(h.hi) AS hi
        FROM mref h JOIN (SELECT DISTINCT caller, call, callee FROM call_edge) c ON c.callee = h.fn GROUP BY ALL""",
    "c_mem_site": "SELECT fn, node, pos, role, obj, lo, hi FROM mem_site UNION ALL SELECT fn, node, pos, role, obj, lo, hi FROM ceff",
    **{f"c_{n}": over_calls(memory_queries.PARTS[n]) for n in ("spoint", "selem", "sseg", "bdef", "skill", "inflow", "uses")},
    "par_in": "SELECT caller, call, callee, CAST(1 AS BIGINT) AS formal, call - 1 AS actual, 'in' AS dir FROM call_edge WHERE call > 1",
    "par_out": "SELECT c.caller, c.call, c.callee, k.k AS formal, c.call AS actual, 'out' AS dir FROM call_edge c JOIN (SELECT fn, max(node) AS k FROM node GROUP BY fn) k ON k.fn = c.callee",
    "sys": """SELECT fn AS src_fn, src, fn AS dst_fn, dst, etype FROM dep UNION SELECT caller, call, callee, 1, 'call' FROM call_edge
        UNION SELECT caller, actual, callee, formal, 'param_in' FROM par_in UNION SELECT callee, formal, caller, actual, 'param_out' FROM par_out
        UNION SELECT r.fn, r.node, r.fn, p.dst, 'noret' FROM noret r JOIN paths p ON p.fn = r.fn AND p.src = r.node WHERE p.dst <> r.node""",
    "sstart": "SELECT fn, node FROM node WHERE ok % 50 = 0",
    "sback": "SELECT fn, node FROM sstart UNION SELECT s.src_fn, s.src FROM sback b JOIN sys s ON s.dst_fn = b.fn AND s.dst = b.node",
    "sfwd": "SELECT fn, node FROM sstart UNION SELECT s.dst_fn, s.dst FROM sfwd b JOIN sys s ON s.src_fn = b.fn AND s.src = b.node",
    "sneed": "SELECT fn, node FROM sfwd UNION SELECT s.src_fn, s.src FROM sneed b JOIN sys s ON s.dst_fn = b.fn AND s.dst = b.node",
    "use_fn": "SELECT DISTINCT caller AS user_fn, callee AS fn FROM call_edge",
    "use_path": "SELECT user_fn AS a, fn AS b FROM use_fn UNION SELECT p.a, u.fn FROM use_path p JOIN use_fn u ON u.user_fn = p.b",
    "wild": "SELECT DISTINCT w.fn, w.pos AS def, e.dst AS node FROM mem_site w JOIN cfg_edge e ON e.fn = w.fn AND e.src = w.node WHERE w.role = 'def' UNION SELECT w.fn, w.def, e.dst FROM wild w JOIN cfg_edge e ON e.fn = w.fn AND e.src = w.node",
    "dep_end": "SELECT fn, src AS node FROM dep UNION SELECT fn, dst FROM dep",
}

ORACLE = {
    "s16_unused_functions": "SELECT DISTINCT fn FROM node WHERE fn <> 1 AND fn NOT IN (SELECT b FROM use_path WHERE a = 1 OR a IN (SELECT a FROM use_path WHERE a = b))",
    "s05_parameters": "SELECT caller, call, callee, formal, actual, dir FROM par_in UNION ALL SELECT caller, call, callee, formal, actual, dir FROM par_out",
    "s08_slice_over_calls": "SELECT fn, node FROM sback",
    "s09_forward_over_calls": "SELECT fn, node FROM sneed",
    "s20_system_graph": "SELECT src_fn, src, dst_fn, dst, etype FROM sys",
    "s17_module_statistics": """SELECT (SELECT count(DISTINCT fn) FROM node) AS functions, (SELECT count(DISTINCT callee) FROM call_edge) AS called, (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM cfg_edge) AS edges, (SELECT count(*) FROM call_edge) AS calls,
        (SELECT count(*) FROM (SELECT b FROM use_path WHERE a = 1 UNION SELECT fn FROM node WHERE fn = 1)) AS reachable""",
    "g16_invalid_dependences": "SELECT n.fn, n.node, 'isolated' AS error FROM node n ANTI JOIN dep_end d ON d.fn = n.fn AND d.node = n.node",
    "m07_call_effects": "SELECT fn, node, pos, role, obj, lo, hi FROM ceff",
    "m13_reaching_over_calls": over_calls(memory_queries.ORACLE["m10_reaching_definitions"]),
    "m15_unknown_writes": """SELECT u.fn, u.pos AS use, w.def FROM mem_site u JOIN wild w ON w.fn = u.fn AND w.node = u.node WHERE u.role = 'use'
        UNION SELECT u.fn, u.pos, d.pos FROM mem_site u JOIN mem_site d ON d.fn = u.fn AND d.node = u.node AND d.role = 'def' AND d.pos < u.pos WHERE u.role = 'use'""",
    "m18_summary": "SELECT fn, node, bool_or(role = 'use') AS is_use, bool_or(role <> 'use') AS is_def FROM mem_site GROUP BY fn, node",
    "s01_use_edges": "SELECT fn, src, dst FROM use_edge",
    "s02_data_edges": "SELECT fn, src, dst FROM data_edge",
    "s06_dependence_graph": "SELECT fn, src, dst, etype FROM dep",
    "s08_backward_slice": "SELECT fn, criterion, node FROM marked",
    "s09_forward_slice": "SELECT fn, node FROM fneed UNION SELECT fn, 1 FROM crit",
    "s10_apply_slice": "SELECT n.fn, n.node FROM node n SEMI JOIN keptn k ON k.fn = n.fn AND k.node = n.node",
    "s10_slice_statistics": "SELECT fn, sum(n)::BIGINT AS nodes_total, sum(n - k)::BIGINT AS nodes_removed, count(*) FILTER (k = 0) AS blocks_removed FROM (SELECT b.fn, b.bb, count(*) AS n, count(k.node) AS k FROM bbs b LEFT JOIN keptn k ON k.fn = b.fn AND k.node = b.node GROUP BY b.fn, b.bb) GROUP BY fn",
    "s11_repair": """SELECT DISTINCT o.fn, o.src, o.dst FROM over o JOIN keptn k ON k.fn = o.fn AND k.node = o.dst WHERE o.src <> o.dst
        UNION ALL SELECT DISTINCT o.fn, o.src, CAST(0 AS BIGINT) FROM over o WHERE NOT EXISTS (SELECT 1 FROM over x JOIN keptn k ON k.fn = x.fn AND k.node = x.dst WHERE x.fn = o.fn AND x.src = o.src AND x.src <> x.dst)""",
    "s12_criteria": """SELECT 'f1.c#fun1##' AS criterion, fn, node FROM source_stmt WHERE file = 'f1.c' AND fun = 'fun1'
        UNION SELECT '#fun2#3#,##2#o1', fn, node FROM source_stmt WHERE (fun = 'fun2' AND line = 3) OR (line = 2 AND obj = 'o1')
        UNION SELECT '###@o5', fn, node FROM source_stmt WHERE obj = 'o5' UNION SELECT 'f0.c##1#', fn, node FROM source_stmt WHERE file = 'f0.c' AND line = 1""",
    "s13_secondary": "SELECT n.fn, n.node FROM node n JOIN live l ON l.fn = n.fn AND l.node = n.node WHERE n.ok % 3 = 1",
    "s14_next_instruction": "SELECT c.fn, b.nxt AS node FROM crit c JOIN (SELECT fn, node, lead(node) OVER (PARTITION BY fn, bb ORDER BY node) AS nxt FROM bbs) b ON b.fn = c.fn AND b.node = c.node WHERE b.nxt IS NOT NULL",
    "s15_cutoff": """SELECT n.fn, n.node, CASE WHEN EXISTS (SELECT 1 FROM cfg_edge e JOIN live l ON l.fn = e.fn AND l.node = e.src WHERE e.fn = n.fn AND e.dst = n.node) THEN 'exit' ELSE 'remove' END AS action
        FROM node n WHERE n.fn IN (SELECT fn FROM crit) AND NOT EXISTS (SELECT 1 FROM live l WHERE l.fn = n.fn AND l.node = n.node)""",
    "s18_lines": "SELECT DISTINCT s.file, s.line FROM source_stmt s JOIN keptn k ON k.fn = s.fn AND k.node = s.node",
    "k01_call_graph": """SELECT caller, call, callee FROM ccall WHERE ok % 2 = 0 UNION SELECT * FROM known
        UNION SELECT c.caller, c.call, t.fn FROM ccall c JOIN taken t ON t.n_args = c.ok % 4 WHERE c.ok % 2 = 1 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.caller = c.caller AND k.call = c.call)""",
    "k02_callers": "SELECT callee, count(DISTINCT caller) AS n_callers, count(*) AS n_calls FROM call_edge GROUP BY callee",
    "k03_address_taken": "SELECT DISTINCT fn, fn % 4 AS n_args FROM node WHERE fn % 10 < 3",
    "x04_dot": """SELECT fn, 1 AS o, '  "' || src || '" -> "' || dst || '" [color=' || CASE etype WHEN 'control' THEN 'blue' WHEN 'data' THEN 'red' ELSE 'black' END || '];' AS line FROM dep
        UNION ALL SELECT DISTINCT fn, 0, 'digraph "' || fn || '" {' FROM dep UNION ALL SELECT DISTINCT fn, 2, '}' FROM dep""",
    "t03_lock_pairs": "SELECT module, a, b FROM lockp",
    "t02_fork_join_pairs": "SELECT DISTINCT a.module, a.node AS a, b.node AS b FROM thread_event a JOIN thread_event b ON b.module = a.module AND b.mutex = a.mutex WHERE a.kind = 'FORK' AND b.kind = 'JOIN'",
    "t04_regions": "SELECT module, node, region FROM reg",
    "t04_region_edges": "SELECT module, src_region, dst_region FROM redge",
    "t05_critical_sections": "SELECT module, lock, node FROM csec",
    "t06_parallel_all": "SELECT module, r1, r2 FROM par",
    "t06_parallel": "SELECT p.module, p.r1, p.r2 FROM par p WHERE NOT EXISTS (SELECT 1 FROM rorder o WHERE o.module = p.module AND ((o.src_region = p.r1 AND o.dst_region = p.r2) OR (o.src_region = p.r2 AND o.dst_region = p.r1)))",
    "t07_interference": """SELECT DISTINCT s.module, s.node AS store, l.node AS load FROM thread_access s JOIN thread_access l ON l.module = s.module AND l.obj = s.obj AND (l.off = s.off OR l.off IS NULL OR s.off IS NULL)
        JOIN reg a ON a.module = s.module AND a.node = s.node JOIN reg b ON b.module = l.module AND b.node = l.node WHERE s.op = 'store' AND l.op = 'load' AND a.region <> b.region""",
    "v01_algebra": f"""SELECT rels, {bits('rels', R.INVERSE)} AS inv, {bits('rels', R.NEGATION)} AS neg, {bits('rels', R.CONFLICTS)} AS conf, rels & {R.mask('SLT ULT SGT UGT')} AS st, rels & {R.mask('SLE ULE SGE UGE')} AS nst,
        ({bits('rels', R.CONFLICTS)}) & rels <> 0 AS bad FROM (SELECT i::INT AS rels FROM range(4096) t(i))""",
    "v05_compose": "SELECT a, b, ((CASE WHEN a & 1 <> 0 THEN b ELSE 0 END) | (CASE WHEN b & 1 <> 0 THEN a ELSE 0 END) | " + " | ".join(f"(CASE WHEN a & {R.BIT[r]} <> 0 AND b & {R.BIT[s]} <> 0 THEN {R.BIT[t]} ELSE 0 END)" for r, s, t in R.CHAINS) + ")::INT AS c FROM (SELECT (1 << (i % 12))::INT AS a, (1 << (i // 12))::INT AS b FROM range(144) t(i))",
    "v07_classes": "SELECT v.loc, v.val, least(v.val, coalesce((SELECT min(m.rt) FROM cm m WHERE m.loc = v.loc AND m.lt = v.val), v.val)) AS cls FROM (SELECT DISTINCT loc, lt AS val FROM vrf) v",
    "v06_closure": "SELECT loc, lt, rel, rt FROM vrc",
    "v08_contradictions": f"SELECT loc, lt, rt FROM vrf WHERE ({bits('rels', R.CONFLICTS)}) & rels <> 0",
    "v09_first_strict": "SELECT loc, lt, rt FROM slt s WHERE NOT EXISTS (SELECT 1 FROM slt a JOIN slt b ON b.loc = a.loc AND b.lt = a.rt WHERE a.loc = s.loc AND a.lt = s.lt AND b.rt = s.rt)",
    "v10_bounds": """SELECT * FROM (SELECT loc, lt AS val, max(CASE WHEN rel = 'SGT' THEN x.v + 1 WHEN rel IN ('SGE', 'EQ') THEN x.v END) AS lo, min(CASE WHEN rel = 'SLT' THEN x.v - 1 WHEN rel IN ('SLE', 'EQ') THEN x.v END) AS hi
        FROM vrc JOIN (SELECT i * 4 AS val, i * 10 AS v FROM range(3) t(i)) x ON x.val = vrc.rt GROUP BY loc, lt) WHERE lo IS NOT NULL OR hi IS NOT NULL""",
    "v17_common": """SELECT g.loc, g.lt, g.rels, g.rt FROM (SELECT loc, lt, rt, bit_and(r) AS rels, count(*) AS c FROM (SELECT loc // 2 AS loc, loc % 2 AS p, lt, rt, bit_or((1 << (rel - 1))::INT) AS r FROM vr_fact GROUP BY ALL) GROUP BY loc, lt, rt) g
        JOIN (SELECT loc // 2 AS loc, count(DISTINCT loc % 2) AS n FROM vr_fact GROUP BY 1) n ON n.loc = g.loc WHERE g.c = n.n AND g.rels <> 0""",
    "v21_valid_areas": "SELECT fn, loc, area FROM aall ANTI JOIN abad USING (fn, loc, area)",
}
