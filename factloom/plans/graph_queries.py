"""Queries of graph and control dependence operators over the derived program facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixpoint import reach
from ..operators import control as C
from ..operators import flow as W
from ..operators import graph as G
from ..sources.facts import fact, kept

FN = ("fn",)


class Inputs:
    """The relations that these queries share, each made once a session and input."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def keep(self, name, make) -> DataFrame:
        return kept(self.spark, self.sf, name, make)

    nodes = property(lambda s: fact(s.spark, s.sf, "node"))
    edges = property(lambda s: fact(s.spark, s.sf, "cfg_edge"))
    calls = property(lambda s: fact(s.spark, s.sf, "call_edge"))
    roots = property(lambda s: s.nodes.where("node = 1").select("fn", "node"))
    def flow_fact(self, kind: str) -> DataFrame:
        made: dict = {}

        def one(k: str) -> DataFrame:
            if not made:
                made.update(W.facts(self.nodes, self.edges))
            return made[k]

        return {k: self.keep(f"flow-{k}", lambda k=k: one(k)) for k in W.KINDS}[kind]

    paths = property(lambda s: s.flow_fact("path"))
    avoid = property(lambda s: s.flow_fact("avoid"))
    pdom = property(lambda s: s.keep("pdom", lambda: W.post_dominators(s.nodes, s.edges)))
    dod = property(lambda s: s.flow_fact("dod"))
    scc = property(lambda s: s.keep("scc", lambda: G.scc(s.nodes, s.paths)))
    blocks = property(lambda s: s.keep("blocks", lambda: G.blocks(s.nodes, s.edges)))
    reached = property(lambda s: s.keep("reached", lambda: reach(s.edges, s.roots, FN)))
    scd = property(lambda s: s.keep("scd", lambda: C.scd(s.nodes, s.edges, pdom=s.pdom)))
    ntscd = property(lambda s: s.keep("ntscd", lambda: C.ntscd(s.nodes, s.edges, s.avoid)))
    sinks = property(lambda s: C.sinks(s.nodes, s.edges))
    dom = property(lambda s: s.flow_fact("dom"))

    @property
    def typed(self) -> DataFrame:
        """Dependence-like edges: control flow, and uses of the node two before."""
        cfg = self.edges.withColumn("etype", F.lit("cfg"))
        use = self.nodes.where("node > 2 AND ok % 3 = 0").select("fn", (F.col("node") - 2).alias("src"), F.col("node").alias("dst"), F.lit("use").alias("etype"))
        return cfg.unionByName(use)

    @property
    def flow(self) -> DataFrame:
        return self.keep("icfg", lambda: G.icfg(self.edges, self.calls, self.roots, self.sinks))

    @property
    def returns(self) -> DataFrame:
        """Exits that return: those of nodes whose order number is odd; the others stop."""
        return self.sinks.join(self.nodes.where("ok % 8 <> 0").select("fn", "node"), ["fn", "node"], "left_semi")


def q(f):
    return lambda spark, sf: f(Inputs(spark, sf))


QUERIES = {
    "g01_degrees": q(lambda i: G.degrees(i.nodes, i.edges)),
    "g02_bfs": q(lambda i: G.bfs(i.edges, i.roots)),
    "g03_dfs_numbers": q(lambda i: G.dfs(i.edges, i.nodes)),
    "g04_walk": q(lambda i: G.walk(i.typed, i.nodes.where("ok % 11 = 0").select("fn", "node"), ("use", "rev_cfg"))),
    "g05_reach": q(lambda i: i.reached),
    "g06_icfg_reach": q(lambda i: G.icfg_reach(i.flow, i.roots)),
    "g07_scc": q(lambda i: i.scc),
    "g08_condensation": q(lambda i: G.condensation(i.edges, i.scc)),
    "g09_loops": q(lambda i: G.loops(i.edges, i.scc)),
    "g10_blocks": q(lambda i: i.blocks),
    "g11_split_calls": q(lambda i: G.split_calls(i.blocks, i.calls)),
    "g12_dominance_frontier": q(lambda i: C.dominance_frontier(i.edges, i.dom)),
    "g13_edge_kinds": q(lambda i: G.edge_kinds(i.edges, G.dfs(i.edges, i.nodes))),
    "g14_loop_bodies": q(lambda i: W.loops(i.edges, exits=False)),
    "g14_loop_exits": q(lambda i: W.loops(i.edges, exits=True)),
    "g15_invalid": q(lambda i: G.invalid(i.nodes, i.edges, i.reached)),
    "g17_statistics": q(lambda i: G.statistics(i.nodes, i.edges, i.blocks)),
    "g18_random_graph": lambda spark, sf: G.random_graph(spark, 50, 20, 30),
    "c00_avoid": q(lambda i: i.avoid),
    "c01_standard_cd": q(lambda i: i.scd),
    "c02_ntscd": q(lambda i: i.ntscd),
    "c03_ntscd2": q(lambda i: C.ntscd(i.nodes, i.edges, i.avoid, reflexive=True)),
    "c04_ntscd_fixpoint": q(lambda i: C.ntscd(i.nodes, i.edges, i.avoid, reflexive=True)),
    "c06_all_max_paths": q(lambda i: C.all_max_paths(i.nodes, i.avoid)),
    "c07_dod": q(lambda i: i.dod),
    "c09_dod_ntscd": q(lambda i: C.dod_ntscd(i.nodes, i.edges, i.dod, i.avoid)),
    "c10_strong_closure": q(lambda i: W.strong_closure(i.nodes, i.edges, i.nodes.where("ok % 4 = 0"))),
    "c11_no_return": q(lambda i: C.no_return(i.nodes, i.edges, i.calls, i.returns)),
    "c11_interprocedural": q(lambda i: C.interprocedural(i.edges, C.no_return(i.nodes, i.edges, i.calls, i.returns))),
    "c14_dependent": q(lambda i: i.ntscd.select("fn", F.col("depends_on").alias("node"), F.col("node").alias("dependent"))),
    "c16_difference": q(lambda i: C.difference(i.scd, i.ntscd)),
    "g12_post_dominators": q(lambda i: i.pdom),
}

#: Relations that the SQL below shares, by name, in order.
PARTS = {
    "paths": "SELECT fn, src, dst FROM cfg_edge UNION SELECT p.fn, p.src, e.dst FROM paths p JOIN cfg_edge e ON e.fn = p.fn AND e.src = p.dst",
    "av": "SELECT e.fn, n.node AS t, e.src, e.dst FROM cfg_edge e JOIN node n ON n.fn = e.fn WHERE n.node <> e.src AND n.node <> e.dst UNION SELECT p.fn, p.t, p.src, e.dst FROM av p JOIN cfg_edge e ON e.fn = p.fn AND e.src = p.dst AND e.dst <> p.t",
    "reached": "SELECT fn, node FROM node WHERE node = 1 UNION SELECT r.fn, e.dst FROM reached r JOIN cfg_edge e ON e.fn = r.fn AND e.src = r.node",
    "sink": "SELECT fn, node FROM node n WHERE NOT EXISTS (SELECT 1 FROM cfg_edge e WHERE e.fn = n.fn AND e.src = n.node)",
    "branch": "SELECT fn, src FROM cfg_edge GROUP BY fn, src HAVING count(*) > 1",
    "avoid": """SELECT s.fn, s.node AS n, n.node AS t FROM sink s JOIN node n ON n.fn = s.fn AND n.node <> s.node
        UNION SELECT a.fn, a.src, a.t FROM av a JOIN sink s ON s.fn = a.fn AND s.node = a.dst
        UNION SELECT a.fn, a.src, a.t FROM av a JOIN (SELECT DISTINCT fn, t, src FROM av WHERE src = dst) c ON c.fn = a.fn AND c.t = a.t AND c.src = a.dst""",
    "must": "SELECT a.fn, a.node AS n, b.node AS t FROM node a JOIN node b ON b.fn = a.fn ANTI JOIN avoid v ON v.fn = a.fn AND v.n = a.node AND v.t = b.node",
    "ntscd_all": """SELECT e.fn, n.node, e.src AS depends_on FROM cfg_edge e JOIN node n ON n.fn = e.fn LEFT JOIN avoid v ON v.fn = e.fn AND v.n = e.dst AND v.t = n.node
        GROUP BY e.fn, n.node, e.src HAVING count(v.n) > 0 AND count(v.n) < count(*)""",
    "ntscd": "SELECT * FROM ntscd_all WHERE node <> depends_on",
    "pdom": """SELECT o.fn, o.node, n.node AS pdom FROM (SELECT fn, node FROM sink UNION SELECT p.fn, p.src FROM paths p JOIN sink s ON s.fn = p.fn AND s.node = p.dst) o
        JOIN node n ON n.fn = o.fn
        WHERE NOT EXISTS (SELECT 1 FROM av a JOIN sink s ON s.fn = a.fn AND s.node = a.dst WHERE a.fn = o.fn AND a.src = o.node AND a.t = n.node)
          AND NOT EXISTS (SELECT 1 FROM sink s WHERE s.fn = o.fn AND s.node = o.node AND n.node <> o.node)""",
    "scd": """SELECT DISTINCT c.fn, c.b AS node, c.src AS depends_on FROM (
          SELECT e.fn, p.pdom AS b, e.src FROM cfg_edge e JOIN pdom p ON p.fn = e.fn AND p.node = e.dst
          WHERE NOT EXISTS (SELECT 1 FROM pdom x WHERE x.fn = e.fn AND x.pdom = p.pdom AND x.node = e.src AND x.node <> x.pdom)
          UNION SELECT fn, dst, src FROM cfg_edge WHERE fn NOT IN (SELECT fn FROM sink)) c
        JOIN branch b ON b.fn = c.fn AND b.src = c.src""",
    "dom": """SELECT r.fn, r.node, n.node AS dom FROM reached r JOIN node n ON n.fn = r.fn
        WHERE NOT EXISTS (SELECT 1 FROM av a WHERE a.fn = r.fn AND a.src = 1 AND a.dst = r.node AND a.t = n.node) AND NOT (r.node = 1 AND n.node <> 1)""",
    "comp": """SELECT n.fn, n.node, least(n.node, coalesce(min(p.dst), n.node)) AS scc FROM node n
        LEFT JOIN (SELECT p.* FROM paths p JOIN paths q ON q.fn = p.fn AND q.src = p.dst AND q.dst = p.src) p ON p.fn = n.fn AND p.src = n.node GROUP BY n.fn, n.node""",
    "lead": """SELECT n.fn, n.node FROM node n LEFT JOIN (SELECT fn, dst, count(*) AS c FROM cfg_edge GROUP BY fn, dst) i ON i.fn = n.fn AND i.dst = n.node
        WHERE n.node = 1 OR coalesce(i.c, 0) <> 1 OR EXISTS (SELECT 1 FROM cfg_edge e JOIN branch b ON b.fn = e.fn AND b.src = e.src WHERE e.fn = n.fn AND e.dst = n.node)""",
    "bbs": """SELECT fn, node, node AS bb FROM lead UNION SELECT b.fn, e.dst, b.bb FROM bbs b JOIN cfg_edge e ON e.fn = b.fn AND e.src = b.node
        WHERE NOT EXISTS (SELECT 1 FROM lead l WHERE l.fn = e.fn AND l.node = e.dst)""",
    "head": """SELECT DISTINCT e.fn, e.dst AS head FROM cfg_edge e WHERE e.dst <= e.src AND (e.src = e.dst OR EXISTS (SELECT 1 FROM paths p WHERE p.fn = e.fn AND p.src = e.dst AND p.dst = e.src))""",
    "body": "SELECT fn, head, head AS node FROM head UNION SELECT h.fn, h.head, p.dst FROM head h JOIN paths p ON p.fn = h.fn AND p.src = h.head JOIN paths q ON q.fn = h.fn AND q.src = p.dst AND q.dst = h.head",
    "first": """SELECT DISTINCT x.fn, x.n AS p, x.t AS a, y.t AS b FROM must x JOIN must y ON y.fn = x.fn AND y.n = x.n AND x.t <> y.t
        JOIN branch r ON r.fn = x.fn AND r.src = x.n JOIN cfg_edge e ON e.fn = x.fn AND e.src = x.n AND e.dst <> y.t
        JOIN must m ON m.fn = x.fn AND m.n = e.dst AND m.t = x.t
        ANTI JOIN av v ON v.fn = x.fn AND v.t = x.t AND v.src = e.dst AND v.dst = y.t
        WHERE x.n <> x.t AND y.n <> y.t""",
    "dod": "SELECT x.fn, x.p, x.a, x.b FROM first x JOIN first y ON y.fn = x.fn AND y.p = x.p AND y.a = x.b AND y.b = x.a WHERE x.a < x.b",
    "stop": "SELECT s.fn, s.node FROM sink s JOIN node n ON n.fn = s.fn AND n.node = s.node WHERE n.ok % 8 = 0",
    "noret": "SELECT fn, node FROM stop UNION SELECT c.caller, c.call FROM noret r JOIN call_edge c ON c.callee = r.fn",
    "typed": """SELECT fn, dst AS src, src AS dst FROM cfg_edge UNION SELECT fn, node - 2, node FROM node WHERE node > 2 AND ok % 3 = 0""",
    "walked": "SELECT fn, node FROM node WHERE ok % 11 = 0 UNION SELECT w.fn, t.dst FROM walked w JOIN typed t ON t.fn = w.fn AND t.src = w.node",
    "depth": "SELECT fn, node, CAST(0 AS BIGINT) AS d FROM node WHERE node = 1 UNION SELECT p.fn, e.dst, p.d + 1 FROM depth p JOIN cfg_edge e ON e.fn = p.fn AND e.src = p.node WHERE p.d < 40",
    "site": "SELECT DISTINCT caller AS fn, call AS src FROM call_edge",
    "flow": """SELECT e.fn AS src_fn, e.src, e.fn AS dst_fn, e.dst FROM cfg_edge e ANTI JOIN site s ON s.fn = e.fn AND s.src = e.src
        UNION SELECT caller, call, callee, 1 FROM call_edge
        UNION SELECT s.fn, s.node, e.fn, e.dst FROM call_edge c JOIN sink s ON s.fn = c.callee JOIN cfg_edge e ON e.fn = c.caller AND e.src = c.call""",
    "flowed": "SELECT fn, node FROM node WHERE node = 1 UNION SELECT f.dst_fn, f.dst FROM flowed x JOIN flow f ON f.src_fn = x.fn AND f.src = x.node",
}

ORACLE = {
    "g01_degrees": "SELECT n.fn, n.node, (SELECT count(*) FROM cfg_edge e WHERE e.fn = n.fn AND e.src = n.node) AS n_out, (SELECT count(*) FROM cfg_edge e WHERE e.fn = n.fn AND e.dst = n.node) AS n_in FROM node n",
    "g02_bfs": "SELECT fn, node, min(d) AS depth FROM depth GROUP BY fn, node",
    "g04_walk": "SELECT fn, node FROM walked",
    "g05_reach": "SELECT fn, node FROM reached",
    "g06_icfg_reach": "SELECT fn, node FROM flowed",
    "g07_scc": "SELECT fn, node, scc FROM comp",
    "g08_condensation": "SELECT DISTINCT e.fn, a.scc AS scc_src, b.scc AS scc_dst FROM cfg_edge e JOIN comp a ON a.fn = e.fn AND a.node = e.src JOIN comp b ON b.fn = e.fn AND b.node = e.dst WHERE a.scc <> b.scc",
    "g09_loops": "SELECT c.fn, c.node, c.scc AS loop FROM comp c JOIN paths p ON p.fn = c.fn AND p.src = c.node AND p.dst = c.node",
    "g10_blocks": "SELECT fn, node, bb FROM bbs",
    "g11_split_calls": """SELECT fn, node, bb, CAST(sum(b) OVER (PARTITION BY fn, bb ORDER BY node) AS BIGINT) AS part FROM (
        SELECT *, CASE WHEN c + coalesce(lag(c) OVER (PARTITION BY fn, bb ORDER BY node), 0) > 0 THEN 1 ELSE 0 END AS b
        FROM (SELECT b.*, CASE WHEN s.src IS NULL THEN 0 ELSE 1 END AS c FROM bbs b LEFT JOIN site s ON s.fn = b.fn AND s.src = b.node) x) y""",
    "g12_dominance_frontier": """SELECT DISTINCT e.fn, d.dom AS node, e.dst AS frontier FROM cfg_edge e JOIN dom d ON d.fn = e.fn AND d.node = e.src
        WHERE NOT EXISTS (SELECT 1 FROM dom x WHERE x.fn = e.fn AND x.dom = d.dom AND x.node = e.dst AND x.node <> x.dom)""",
    "g12_post_dominators": "SELECT fn, node, pdom FROM pdom",
    "g14_loop_bodies": "SELECT fn, head, node FROM body",
    "g14_loop_exits": "SELECT b.fn, b.head, e.src, e.dst FROM body b JOIN cfg_edge e ON e.fn = b.fn AND e.src = b.node WHERE NOT EXISTS (SELECT 1 FROM body x WHERE x.fn = b.fn AND x.head = b.head AND x.node = e.dst)",
    "g15_invalid": "SELECT n.fn, n.node, 'unreachable' AS error FROM node n WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.fn = n.fn AND r.node = n.node)",
    "g17_statistics": """SELECT n.fn, n.n_nodes, coalesce(e.n_edges, 0) AS n_edges, b.n_blocks, coalesce(e.n_branches, 0) AS n_branches, n.n_nodes - coalesce(e.n_flow, 0) AS n_ends
        FROM (SELECT fn, count(*) AS n_nodes FROM node GROUP BY fn) n
        LEFT JOIN (SELECT fn, CAST(sum(c) AS BIGINT) AS n_edges, count(*) AS n_flow, count(*) FILTER (c > 1) AS n_branches FROM (SELECT fn, src, count(*) AS c FROM cfg_edge GROUP BY fn, src) GROUP BY fn) e ON e.fn = n.fn
        JOIN (SELECT fn, count(DISTINCT bb) AS n_blocks FROM bbs GROUP BY fn) b ON b.fn = n.fn""",
    "g18_random_graph": """SELECT fn, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY fn, src ORDER BY dst) AS i FROM (
        SELECT DISTINCT id // 30 AS fn, ('0x' || left(md5(id || ':1'), 12))::BIGINT % 20 + 1 AS src, ('0x' || left(md5(id || ':2'), 12))::BIGINT % 20 + 1 AS dst FROM range(1500) t(id))) WHERE i <= 2""",
    "c00_avoid": "SELECT fn, n, t FROM avoid",
    "c01_standard_cd": "SELECT fn, node, depends_on FROM scd",
    "c02_ntscd": "SELECT fn, node, depends_on FROM ntscd",
    "c03_ntscd2": "SELECT fn, node, depends_on FROM ntscd_all",
    "c04_ntscd_fixpoint": "SELECT fn, node, depends_on FROM ntscd_all",
    "c06_all_max_paths": "SELECT fn, n, t FROM must",
    "c07_dod": "SELECT fn, p, a, b FROM dod",
    "c09_dod_ntscd": "SELECT fn, node, depends_on FROM ntscd_all UNION SELECT fn, a, p FROM dod UNION SELECT fn, b, p FROM dod",
    "c11_no_return": "SELECT fn, node FROM noret",
    "c11_interprocedural": """SELECT DISTINCT r.fn, p.dst AS node, r.node AS depends_on FROM noret r JOIN paths p ON p.fn = r.fn AND p.src = r.node WHERE p.dst <> r.node""",
    "c14_dependent": "SELECT fn, depends_on AS node, node AS dependent FROM ntscd",
    "c16_difference": """SELECT coalesce(a.fn, b.fn) AS fn, count(*) FILTER (b.fn IS NULL) AS only_a, count(*) FILTER (a.fn IS NULL) AS only_b
        FROM scd a FULL JOIN ntscd b ON a.fn = b.fn AND a.node = b.node AND a.depends_on = b.depends_on GROUP BY 1""",
}
