"""Queries of interval, memory and pointer operators over the derived program facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I  # noqa: E741
from ..operators import memory as M
from ..operators import pointer as P
from ..sources.facts import fact, kept

FIELD_LIMIT = 8


class Inputs:
    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def keep(self, name, make) -> DataFrame:
        return kept(self.spark, self.sf, name, make)

    def __getattr__(self, name):
        return fact(self.spark, self.sf, name)

    @property
    def writes(self) -> DataFrame:
        return self.rw_site.where("role <> 'use'").select("module", "obj", "lo", "hi", F.col("pos").alias("val"), "pos", (F.col("role") == "kill").alias("strong"))

    @property
    def asks(self) -> DataFrame:
        return self.rw_site.where("role = 'use'").select("module", F.col("pos").alias("q"), "obj", "lo", "hi")

    segments = property(lambda s: s.keep("segments", lambda: I.add(s.writes)))
    seg = property(lambda s: s.keep("seg", lambda: M.segmented(s.mem_site)))

    def points(self) -> tuple[DataFrame, DataFrame]:
        both = []
        name = "points-to"

        def made(i: int) -> DataFrame:
            if not both:
                both.extend(P.analyse(self.cons, self.object, FIELD_LIMIT))
            return both[i]

        return tuple(kept(self.spark, self.sf, n, lambda i=i: made(i), ready=True) for i, n in enumerate((name, name + "-mem")))

    @property
    def pt(self) -> DataFrame:
        return P.absorbed(self.points()[0])

    @property
    def pairs(self) -> DataFrame:
        n = self.pt.select("module", "n").distinct()
        return n.select("module", F.col("n").alias("a")).join(n.select("module", F.col("n").alias("b")), "module").where("a < b")

    @property
    def wanted(self) -> DataFrame:
        return self.cons.where("kind = 'alloc'").select("module", F.col("dst").alias("n"), F.col("src").alias("tgt"), F.when(F.col("dst") % 2 == 0, 0).otherwise(4).cast("long").alias("off")).distinct()


def q(f):
    return lambda spark, sf: f(Inputs(spark, sf))


def no_copies(i: Inputs) -> DataFrame:
    """Points-to sets of the same program without its phis and casts of odd targets."""
    return i.keep("points-to-less", lambda: P.absorbed(P.analyse(i.cons.where("NOT (kind = 'copy' AND dst % 2 = 1)"), i.object, FIELD_LIMIT)[0]))


def optimised_points(i: Inputs) -> DataFrame:
    """Points-to sets by way of the optimised constraints, for all nodes."""
    cons, rep = P.optimised(i.cons)
    pt = P.analyse(cons, i.object, FIELD_LIMIT)[0]
    old = rep.join(pt.withColumnRenamed("n", "new"), ["module", "new"]).select("module", F.col("old").alias("n"), "tgt", "off")
    return P.absorbed(pt.join(rep.select("module", F.col("old").alias("n")), ["module", "n"], "left_anti").select(P.PT).unionByName(old).distinct())


QUERIES = {
    "i02_add": q(lambda i: i.segments),
    "i03_update": q(lambda i: I.update(i.writes)),
    "i04_add_all": q(lambda i: I.add_all(i.segments, F.lit(-5).cast("long"))),
    "i05_overlaps": q(lambda i: I.overlaps(i.segments, i.asks)),
    "i06_gather": q(lambda i: I.gather(i.segments, i.asks)),
    "i07_uncovered": q(lambda i: I.uncovered(i.segments, i.asks)),
    "i08_intersection": q(lambda i: I.intersection(i.segments, I.update(i.writes))),
    "i09_merge": q(lambda i: I.merged(i.writes.select("module", "obj", "lo", "hi"))),
    "i09_common": q(lambda i: I.common(i.writes.select("module", "obj", "lo", "hi"), i.asks.select("module", "obj", "lo", "hi"))),
    "i10_site_intersection": q(lambda i: I.intersection(i.rw_site.where("role = 'def'").select("module", "obj", "lo", "hi", F.lit(0).alias("val")), i.rw_site.where("role = 'kill'").select("module", "obj", "lo", "hi", F.lit(0).alias("val"))).drop("val")),
    "i11_filter_values": q(lambda i: I.filtered(i.segments, i.writes.where("val % 2 = 0").select("module", "val").distinct())),
    "m01_accesses": q(lambda i: M.accesses(i.small_stmt.where("kind IN (3, 4)").select(F.col("module").alias("fn"), "pos", F.col("pos").alias("node"), F.when(F.col("kind") == 3, "store").otherwise("load").alias("op"), F.when(F.col("kind") == 3, F.col("lhs")).otherwise(F.col("rhs")).alias("ptr"), F.lit(4).cast("long").alias("len")), i.pt.withColumnRenamed("module", "fn"))),
    "m05_library_effects": q(lambda i: M.library_effects(i.small_stmt.select(F.col("module").alias("fn"), "pos", F.element_at(F.array(*[F.lit(n) for n in sorted({m[0] for m in M.LIBRARY})]), (F.col("kind") + 1).cast("int")).alias("name")), i.small_stmt.where("pk % 2 = 0").select(F.col("module").alias("fn"), "pos", F.lit(2).alias("arg"), (F.col("pk") % 8).alias("value")), i.spark.createDataFrame(M.LIBRARY, M.LIBRARY_DDL))),
    "m06_undefined_calls": q(lambda i: M.undefined_effects(i.small_stmt.where("kind = 7").select(F.col("module").alias("fn"), "pos"), i.small_stmt.where("kind = 7").select(F.col("module").alias("fn"), "pos", (F.col("pk") % 3).cast("int").alias("arg")))),
    "m09_block_definitions": q(lambda i: M.block_definitions(i.seg)),
    "m10_reaching_definitions": q(lambda i: M.reaching(i.mem_site, i.cfg_edge)),
    "m12_modref": q(lambda i: M.modref(i.mem_site, i.call_edge, i.mem_site.select("obj").distinct())),
    "m14_unknown_reads": q(lambda i: M.unknown_reads(i.mem_site, i.cfg_edge, i.mem_site.where("role = 'use'").select("fn", "node", "pos"))),
    "m16_query": q(lambda i: M.reaching(i.mem_site.where("role <> 'use'"), i.cfg_edge, i.node.where("node % 3 = 0").select("fn", "node", F.lit(100000).cast("long").alias("pos"), (F.col("ok") % 6).alias("obj"), F.lit(2).cast("long").alias("lo"), F.lit(5).cast("long").alias("hi")))),
    "p13_points_to": q(lambda i: i.points()[0]),
    "p13_memory": q(lambda i: i.points()[1]),
    "p22_absorbed": q(lambda i: i.pt),
    "p22_properties": q(lambda i: P.properties(i.pt)),
    "p22_may_must": q(lambda i: P.may_point(i.pt, i.wanted)),
    "p22_remove_any": q(lambda i: P.remove_any(i.pt, i.object.where("zero").select("module", F.col("obj").alias("tgt")))),
    "p24_optimised": q(optimised_points),
    "p28_accessed": q(lambda i: P.accessed(i.pt, i.cons.where("kind = 'load'").select("module", F.col("src").alias("n"), F.lit(4).cast("long").alias("len")).distinct())),
    "p30_alias": q(lambda i: P.alias(i.pt, i.pairs)),
    "p31_difference": q(lambda i: P.difference(i.pt, no_copies(i))),
    "p10_calls_by_pointer": q(lambda i: P.analyse(i.call_cons, i.object, FIELD_LIMIT, functions=i.function)[0]),
    "p15_flow_sensitive": q(lambda i: P.absorbed(P.analyse_flow(i.flow_cons, i.flow_edge, i.object, FIELD_LIMIT))),
    "p19_invalidated": q(lambda i: P.absorbed(P.analyse_flow(i.flow_cons, i.flow_edge, i.object, FIELD_LIMIT, invalidate=True))),
    "p25_without_unknown": q(lambda i: P.without_unknown(i.cons, i.pt)),
    "p29_covers": q(lambda i: P.covers(i.pt, i.cons.where("kind = 'load'").select("module", F.col("src").alias("n"), F.lit(4).cast("long").alias("len")).distinct())),
    "m08_escaping": q(lambda i: M.escaping_objects(i.points()[1], i.object.where("zero").select("module", "obj"))),
    "x07_statistics": q(lambda i: P.statistics(i.pt)),
}

#: Rounds that the SQL unrolls; more than any module of the test tables needs.
ROUNDS = 24


def pointer_round(at: str) -> str:
    """One round of all rules over the state at: (module, r, a, b, tgt, off), r 0: node a points to tgt+off; r 1: cell a+b holds it."""
    pt = f"(SELECT * FROM {at} WHERE r = 0)"
    mem = f"(SELECT * FROM {at} WHERE r = 1)"
    fit = "CASE WHEN {0} < 0 OR {1} IS NULL OR {1} < 0 THEN -1 WHEN ({0} + {1} = 0 OR {0} + {1} < coalesce(o.size, 0)) AND {0} + {1} < 8 THEN {0} + {1} ELSE -1 END"
    shift = fit.format("p.off", "c.off")
    move = "CASE WHEN s.off < 0 OR m.b < 0 OR d.off < 0 THEN -1 WHEN (d.off + m.b - s.off = 0 OR d.off + m.b - s.off < coalesce(o.size, 0)) AND d.off + m.b - s.off < 8 THEN d.off + m.b - s.off ELSE -1 END"
    return f"""SELECT * FROM {at}
      UNION SELECT c.module, 0, c.dst, 0, p.tgt, p.off FROM cons c JOIN {pt} p ON p.module = c.module AND p.a = c.src WHERE c.kind = 'copy'
      UNION SELECT c.module, 0, c.dst, 0, p.tgt, CASE WHEN p.tgt < 0 THEN p.off ELSE {shift} END FROM cons c JOIN {pt} p ON p.module = c.module AND p.a = c.src LEFT JOIN object o ON o.module = p.module AND o.obj = p.tgt WHERE c.kind = 'gep'
      UNION SELECT c.module, 0, c.dst, 0, m.tgt, m.off FROM cons c JOIN {pt} p ON p.module = c.module AND p.a = c.src JOIN {mem} m ON m.module = p.module AND m.a = p.tgt AND (m.b = p.off OR m.b < 0 OR p.off < 0) WHERE c.kind = 'load' AND p.tgt >= 0
      UNION SELECT c.module, 1, p.tgt, p.off, v.tgt, v.off FROM cons c JOIN {pt} p ON p.module = c.module AND p.a = c.dst JOIN {pt} v ON v.module = c.module AND v.a = c.src WHERE c.kind = 'store' AND p.tgt >= 0
      UNION SELECT c.module, 1, d.tgt, {move}, m.tgt, m.off FROM cons c JOIN {pt} d ON d.module = c.module AND d.a = c.dst JOIN {pt} s ON s.module = c.module AND s.a = c.src
        JOIN {mem} m ON m.module = s.module AND m.a = s.tgt AND (s.off < 0 OR m.b < 0 OR (m.b >= s.off AND m.b < s.off + c.len)) LEFT JOIN object o ON o.module = d.module AND o.obj = d.tgt WHERE c.kind = 'memcpy' AND d.tgt >= 0 AND s.tgt >= 0"""


def pointer_parts(name: str, cons: str, calls: bool = False) -> dict[str, str]:
    start = f"""SELECT module, 0 AS r, dst AS a, CAST(0 AS BIGINT) AS b, src AS tgt, CAST(0 AS BIGINT) AS off FROM {cons} WHERE kind = 'alloc'
      UNION SELECT module, 1, obj, -1, -2, 0 FROM object WHERE zero"""
    out = {f"{name}0": start}
    for n in range(ROUNDS):
        out[f"{name}{n + 1}"] = pointer_round(f"{name}{n}").replace("FROM cons ", f"FROM {cons} ")
        if calls:
            pt = f"(SELECT * FROM {name}{n} WHERE r = 0)"
            out[f"{name}{n + 1}"] += f"""
              UNION SELECT c.module, 0, f.param, 0, v.tgt, v.off FROM {cons} c JOIN {pt} p ON p.module = c.module AND p.a = c.src JOIN function f ON f.module = c.module AND f.obj = p.tgt JOIN {pt} v ON v.module = c.module AND v.a = c.off WHERE c.kind = 'call'
              UNION SELECT c.module, 0, c.dst, 0, v.tgt, v.off FROM {cons} c JOIN {pt} p ON p.module = c.module AND p.a = c.src JOIN function f ON f.module = c.module AND f.obj = p.tgt JOIN {pt} v ON v.module = c.module AND v.a = f.result WHERE c.kind = 'call'"""
    last = f"{name}{ROUNDS}"
    out[f"{name}_raw"] = f"SELECT module, a AS n, tgt, off FROM {last} WHERE r = 0"
    out[f"{name}_mem"] = f"SELECT module, a AS obj, b AS off, tgt, off AS toff FROM {last} WHERE r = 1"
    out[f"{name}_abs"] = f"SELECT * FROM {name}_raw p WHERE off < 0 OR NOT EXISTS (SELECT 1 FROM {name}_raw x WHERE x.module = p.module AND x.n = p.n AND x.tgt = p.tgt AND x.off < 0)"
    return out


PARTS = {
    "w": "SELECT module, obj, lo, hi, pos AS val, pos, role = 'kill' AS strong FROM rw_site WHERE role <> 'use'",
    "ask": "SELECT module, pos AS q, obj, lo, hi FROM rw_site WHERE role = 'use'",
    "point": "SELECT module, obj, lo AS x FROM w UNION SELECT module, obj, hi + 1 FROM w",
    "elem": "SELECT * FROM (SELECT module, obj, x AS lo, lead(x) OVER (PARTITION BY module, obj ORDER BY x) - 1 AS hi FROM point) WHERE hi IS NOT NULL",
    "cover": "SELECT DISTINCT e.module, e.obj, e.lo, e.hi, w.val, w.pos, w.strong FROM elem e JOIN w ON w.module = e.module AND w.obj = e.obj AND w.lo <= e.lo AND e.hi <= w.hi",
    "segs": "SELECT DISTINCT module, obj, lo, hi, val FROM cover",
    "upd": "SELECT DISTINCT module, obj, lo, hi, val FROM cover c WHERE NOT EXISTS (SELECT 1 FROM cover x WHERE x.module = c.module AND x.obj = c.obj AND x.lo = c.lo AND x.strong AND x.pos > c.pos)",
    "byte_w": "SELECT DISTINCT module, obj, unnest(range(lo, hi + 1)) AS b FROM w",
    "byte_q": "SELECT module, q, obj, unnest(range(lo, hi + 1)) AS b FROM ask",
    "spoint": "SELECT fn, obj, lo AS x FROM mem_site UNION SELECT fn, obj, hi + 1 FROM mem_site",
    "selem": "SELECT * FROM (SELECT fn, obj, x AS lo, lead(x) OVER (PARTITION BY fn, obj ORDER BY x) - 1 AS hi FROM spoint) WHERE hi IS NOT NULL",
    "sseg": "SELECT DISTINCT s.fn, s.node, s.pos, s.role, s.obj, e.lo AS seg FROM mem_site s JOIN selem e ON e.fn = s.fn AND e.obj = s.obj AND s.lo <= e.lo AND e.hi <= s.hi",
    "bdef": """SELECT s.fn, s.node, s.obj, s.seg, s.pos AS def, k.last IS NOT NULL AS strong FROM sseg s
        LEFT JOIN (SELECT fn, node, obj, seg, max(pos) AS last FROM sseg WHERE role = 'kill' GROUP BY ALL) k ON k.fn = s.fn AND k.node = s.node AND k.obj = s.obj AND k.seg = s.seg
        WHERE s.role <> 'use' AND (k.last IS NULL OR s.pos >= k.last)""",
    "skill": "SELECT DISTINCT fn, node, obj, seg FROM bdef WHERE strong",
    "inflow": """SELECT b.fn, e.dst AS node, b.obj, b.seg, b.def FROM bdef b JOIN cfg_edge e ON e.fn = b.fn AND e.src = b.node
        UNION SELECT i.fn, e.dst, i.obj, i.seg, i.def FROM inflow i ANTI JOIN skill k ON k.fn = i.fn AND k.node = i.node AND k.obj = i.obj AND k.seg = i.seg JOIN cfg_edge e ON e.fn = i.fn AND e.src = i.node""",
    "uses": "SELECT u.*, (SELECT max(k.pos) FROM sseg k WHERE k.fn = u.fn AND k.node = u.node AND k.obj = u.obj AND k.seg = u.seg AND k.role = 'kill' AND k.pos < u.pos) AS last FROM sseg u WHERE u.role = 'use'",
    "mref": """SELECT DISTINCT fn, CASE WHEN role = 'use' THEN 'ref' ELSE 'mod' END AS role, obj, lo, hi FROM mem_site
        UNION SELECT c.caller, m.role, m.obj, m.lo, m.hi FROM mref m JOIN call_edge c ON c.callee = m.fn""",
    "asked": "SELECT fn, node, ok % 6 AS obj FROM node WHERE node % 3 = 0",
    "esc": "SELECT module, obj FROM object WHERE zero UNION SELECT m.module, m.tgt FROM esc e JOIN (SELECT DISTINCT module, obj, tgt FROM pts_mem WHERE tgt >= 0) m ON m.module = e.module AND m.obj = e.obj",
    "accessed_at": "SELECT DISTINCT c.module, c.src AS n, p.tgt AS obj, CASE WHEN p.off >= 0 THEN p.off ELSE 0 END AS lo, CASE WHEN p.off >= 0 THEN p.off + 3 END AS hi FROM cons c JOIN pts_abs p ON p.module = c.module AND p.n = c.src WHERE c.kind = 'load' AND p.tgt >= 0",
    "fewer": "SELECT * FROM cons WHERE NOT (kind = 'copy' AND dst % 2 = 1)",
    **pointer_parts("pts", "cons"),
    **pointer_parts("less", "fewer"),
    **pointer_parts("fp", "call_cons", calls=True),
    "lib": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, '{r}', {o}, {'NULL' if la is None else la})" for n, a, r, o, _, la in M.LIBRARY) + ") t(name, arg, role, off, len_arg)",
}

LIB_NAMES = ", ".join(f"'{n}'" for n in sorted({m[0] for m in M.LIBRARY}))

ORACLE = {
    "i02_add": "SELECT module, obj, lo, hi, val FROM segs",
    "i03_update": "SELECT module, obj, lo, hi, val FROM upd",
    "i04_add_all": "SELECT * FROM segs UNION SELECT module, obj, lo, hi, -5 FROM segs",
    "i05_overlaps": "SELECT a.module, a.q, coalesce(c.n, 0) > 0 AS any_overlap, coalesce(c.n, 0) = a.hi - a.lo + 1 AS full_overlap FROM ask a LEFT JOIN (SELECT module, q, count(*) AS n FROM byte_q SEMI JOIN byte_w USING (module, obj, b) GROUP BY ALL) c ON c.module = a.module AND c.q = a.q",
    "i06_gather": "SELECT DISTINCT a.module, a.q, w.val FROM ask a JOIN w ON w.module = a.module AND w.obj = a.obj AND w.lo <= a.hi AND a.lo <= w.hi",
    "i07_uncovered": """SELECT module, q, min(b) AS lo, max(b) AS hi FROM (
        SELECT module, q, b, b - row_number() OVER (PARTITION BY module, q ORDER BY b) AS g FROM byte_q ANTI JOIN byte_w USING (module, obj, b)) GROUP BY module, q, g""",
    "i08_intersection": "SELECT DISTINCT s.module, s.obj, greatest(s.lo, u.lo) AS lo, least(s.hi, u.hi) AS hi, s.val FROM segs s JOIN upd u ON u.module = s.module AND u.obj = s.obj AND u.val = s.val AND u.lo <= s.hi AND s.lo <= u.hi",
    "i09_merge": "SELECT module, obj, min(b) AS lo, max(b) AS hi FROM (SELECT *, b - row_number() OVER (PARTITION BY module, obj ORDER BY b) AS g FROM byte_w) GROUP BY module, obj, g",
    "i09_common": """SELECT module, obj, min(b) AS lo, max(b) AS hi FROM (SELECT *, b - row_number() OVER (PARTITION BY module, obj ORDER BY b) AS g FROM (
        SELECT module, obj, b FROM byte_w INTERSECT SELECT module, obj, b FROM byte_q)) GROUP BY module, obj, g""",
    "i10_site_intersection": "SELECT DISTINCT d.module, d.obj, greatest(d.lo, k.lo) AS lo, least(d.hi, k.hi) AS hi FROM rw_site d JOIN rw_site k ON d.role = 'def' AND k.role = 'kill' AND k.module = d.module AND k.obj = d.obj AND k.lo <= d.hi AND d.lo <= k.hi",
    "i11_filter_values": "SELECT module, obj, lo, hi, val FROM segs WHERE val % 2 = 0",
    "m01_accesses": """SELECT s.module AS fn, s.pos AS node, s.pos, CASE WHEN s.kind = 4 THEN 'use' WHEN count(*) OVER (PARTITION BY s.module, s.pos) = 1 AND p.off >= 0 THEN 'kill' ELSE 'def' END AS role,
        p.tgt AS obj, CASE WHEN p.off >= 0 THEN p.off ELSE 0 END AS lo, CASE WHEN p.off >= 0 THEN p.off + 3 END AS hi
        FROM small_stmt s JOIN pts_abs p ON p.module = s.module AND p.n = CASE WHEN s.kind = 3 THEN s.lhs ELSE s.rhs END WHERE s.kind IN (3, 4) AND p.tgt >= 0""",
    "m05_library_effects": f"""SELECT s.module AS fn, s.pos, l.role, l.arg, l.off, CASE WHEN l.len_arg = 2 AND s.pk % 2 = 0 THEN s.pk % 8 END AS len
        FROM small_stmt s JOIN lib l ON l.name = [{LIB_NAMES}][s.kind + 1]""",
    "m06_undefined_calls": "SELECT module AS fn, pos, 'use' AS role, CAST(pk % 3 AS INT) AS arg FROM small_stmt WHERE kind = 7",
    "m09_block_definitions": "SELECT fn, node, obj, seg, def, strong FROM bdef",
    "m10_reaching_definitions": """SELECT u.fn, u.pos AS use, d.pos AS def FROM uses u JOIN sseg d ON d.fn = u.fn AND d.node = u.node AND d.obj = u.obj AND d.seg = u.seg AND d.role <> 'use' AND d.pos < u.pos AND (u.last IS NULL OR d.pos >= u.last)
        UNION SELECT u.fn, u.pos, i.def FROM uses u JOIN inflow i ON i.fn = u.fn AND i.node = u.node AND i.obj = u.obj AND i.seg = u.seg WHERE u.last IS NULL""",
    "m12_modref": "SELECT fn, role, obj, lo, hi FROM mref",
    "m14_unknown_reads": """SELECT r.fn, r.pos AS use, i.def FROM mem_site r JOIN inflow i ON i.fn = r.fn AND i.node = r.node WHERE r.role = 'use'
        UNION SELECT r.fn, r.pos, s.pos FROM mem_site r JOIN mem_site s ON s.fn = r.fn AND s.node = r.node AND s.pos < r.pos AND s.role <> 'use' WHERE r.role = 'use'""",
    "m16_query": """SELECT a.fn, 100000::BIGINT AS use, d.pos AS def FROM asked a JOIN sseg d ON d.fn = a.fn AND d.node = a.node AND d.obj = a.obj AND d.role <> 'use' AND d.seg <= 5
          AND EXISTS (SELECT 1 FROM selem e WHERE e.fn = d.fn AND e.obj = d.obj AND e.lo = d.seg AND e.hi >= 2) AND NOT EXISTS (SELECT 1 FROM sseg k WHERE k.fn = d.fn AND k.node = d.node AND k.obj = d.obj AND k.seg = d.seg AND k.role = 'kill' AND k.pos > d.pos)
        UNION SELECT a.fn, 100000, i.def FROM asked a JOIN inflow i ON i.fn = a.fn AND i.node = a.node AND i.obj = a.obj AND i.seg <= 5 AND EXISTS (SELECT 1 FROM selem e WHERE e.fn = i.fn AND e.obj = i.obj AND e.lo = i.seg AND e.hi >= 2)
          ANTI JOIN skill k ON k.fn = i.fn AND k.node = i.node AND k.obj = i.obj AND k.seg = i.seg""",
    "p13_points_to": "SELECT module, n, tgt, off FROM pts_raw",
    "p13_memory": "SELECT module, obj, off, tgt, toff FROM pts_mem",
    "p22_absorbed": "SELECT module, n, tgt, off FROM pts_abs",
    "p22_properties": "SELECT module, n, count(*) AS size, count(*) = 1 AS singleton, bool_or(tgt = -1) AS has_unknown, bool_or(tgt = -2) AS has_null, bool_or(tgt = -3) AS has_invalidated FROM pts_abs GROUP BY module, n",
    "p22_may_must": """SELECT q.module, q.n, q.tgt, q.off, EXISTS (SELECT 1 FROM pts_abs p WHERE p.module = q.module AND p.n = q.n AND ((p.tgt = q.tgt AND (p.off = q.off OR p.off < 0)) OR p.tgt = -1)) AS may,
        EXISTS (SELECT 1 FROM pts_abs p WHERE p.module = q.module AND p.n = q.n AND p.tgt = q.tgt AND p.off = q.off) AND (SELECT count(*) FROM pts_abs p WHERE p.module = q.module AND p.n = q.n) = 1 AS must
        FROM (SELECT DISTINCT module, dst AS n, src AS tgt, CASE WHEN dst % 2 = 0 THEN 0 ELSE 4 END::BIGINT AS off FROM cons WHERE kind = 'alloc') q""",
    "p22_remove_any": "SELECT module, n, tgt, off FROM pts_abs p WHERE NOT EXISTS (SELECT 1 FROM object o WHERE o.zero AND o.module = p.module AND o.obj = p.tgt)",
    "p24_optimised": "SELECT module, n, tgt, off FROM pts_abs",
    "p28_accessed": "SELECT DISTINCT c.module, c.src AS n, CASE WHEN p.tgt >= 0 THEN p.tgt END AS obj, CASE WHEN p.off >= 0 THEN p.off END AS off, CASE WHEN p.off >= 0 THEN CAST(4 AS BIGINT) END AS len FROM cons c JOIN pts_abs p ON p.module = c.module AND p.n = c.src WHERE c.kind = 'load'",
    "p30_alias": """SELECT a.module, a.n AS a, b.n AS b, CASE
        WHEN a.c = 1 AND b.c = 1 AND a.t = b.t AND a.o = b.o AND a.o >= 0 AND a.t >= 0 THEN 'MustAlias'
        WHEN EXISTS (SELECT 1 FROM pts_abs x JOIN pts_abs y ON y.module = x.module AND y.tgt = x.tgt AND (x.off = y.off OR x.off < 0 OR y.off < 0) WHERE x.module = a.module AND x.n = a.n AND y.n = b.n AND x.tgt >= 0) THEN 'MayAlias' ELSE 'NoAlias' END AS verdict
        FROM (SELECT module, n, count(*) AS c, max(tgt) AS t, max(off) AS o FROM pts_abs GROUP BY ALL) a JOIN (SELECT module, n, count(*) AS c, max(tgt) AS t, max(off) AS o FROM pts_abs GROUP BY ALL) b ON b.module = a.module AND a.n < b.n""",
    "m08_escaping": "SELECT module, obj FROM esc",
    "p10_calls_by_pointer": "SELECT module, n, tgt, off FROM fp_raw",
    "p25_without_unknown": "SELECT c.* FROM cons c WHERE kind NOT IN ('load', 'store') OR EXISTS (SELECT 1 FROM pts_abs p WHERE p.module = c.module AND p.n = CASE WHEN c.kind = 'load' THEN c.src ELSE c.dst END AND p.tgt >= 0)",
    "p29_covers": """SELECT * FROM accessed_at a WHERE NOT EXISTS (SELECT 1 FROM accessed_at x WHERE x.module = a.module AND x.n = a.n AND x.obj = a.obj AND x.lo <= a.lo AND (x.hi IS NULL OR x.hi >= a.hi) AND (x.lo < a.lo OR x.hi IS DISTINCT FROM a.hi))""",
    "p31_difference": "SELECT module, n, tgt, off FROM pts_abs p WHERE NOT EXISTS (SELECT 1 FROM less_abs x WHERE x.module = p.module AND x.n = p.n AND ((x.tgt = p.tgt AND (x.off = p.off OR x.off < 0)) OR x.tgt = -1))",
    "x07_statistics": "SELECT module, count(*) AS n_sets, sum(c)::BIGINT AS n_pointers, max(c) AS max_size, count(*) FILTER (c = 1) AS n_singletons, sum(u)::BIGINT AS n_unknown_offsets, sum(z)::BIGINT AS n_null FROM (SELECT module, n, count(*) AS c, count(*) FILTER (off < 0) AS u, count(*) FILTER (tgt = -2) AS z FROM pts_abs GROUP BY module, n) GROUP BY module",
}
