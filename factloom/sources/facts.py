"""Program facts derived from the driver tables, by SQL that two engines read alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.store import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Fact tables over driver tables and earlier facts. Integer arithmetic only.
FACTS = {
    # a function is a customer, its nodes are the orders
    "node": """
        SELECT o_custkey AS fn, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS node,
               CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS k, o_orderkey AS ok, o_orderstatus AS st, o_orderpriority AS pr
        FROM orders""",
    "cfg_edge": """
        SELECT DISTINCT fn, src, dst FROM (
          SELECT fn, node AS src, node + 1 AS dst FROM node WHERE node < k
          UNION ALL SELECT fn, node AS src, 1 + (ok * 7 + fn) % k AS dst FROM node WHERE st = 'F') e""",
    "call_edge": """
        SELECT n.fn AS caller, n.node AS call, c.fn AS callee
        FROM node n JOIN (SELECT count(*) AS m FROM customer) z ON n.pr LIKE '1%'
        JOIN (SELECT DISTINCT fn FROM node) c ON c.fn = 1 + (n.ok * 13) % z.m""",
    # statements of a module (a customer): its lineitems
    "stmt": """
        SELECT o_custkey AS module, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS pos,
               CAST(l_linenumber AS BIGINT) AS kind, l_suppkey % 8 AS lhs, CAST(floor(l_suppkey / 8) AS BIGINT) % 8 AS rhs,
               l_partkey % 6 AS obj, l_suppkey AS sk, l_partkey AS pk, l_orderkey AS ok
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "small_stmt": "SELECT * FROM stmt",
    # memory accesses: byte ranges of objects, in the order of statements
    "rw_site": """
        SELECT module, pos, CASE WHEN kind IN (3) THEN 'kill' WHEN kind = 7 THEN 'def' ELSE 'use' END AS role, obj,
               sk % 16 AS lo, sk % 16 + pk % 8 AS hi
        FROM stmt WHERE kind IN (3, 4, 7)""",
    # the same accesses, placed in the control flow: a statement's block is its order
    "mem_site": """
        SELECT s.module AS fn, n.node, s.pos, CASE WHEN s.kind = 3 THEN 'kill' WHEN s.kind = 7 THEN 'def' ELSE 'use' END AS role, s.obj,
               s.sk % 16 AS lo, s.sk % 16 + s.pk % 8 AS hi
        FROM stmt s JOIN node n ON n.fn = s.module AND n.ok = s.ok WHERE s.kind IN (3, 4, 7)""",
    # pointer constraints of a module
    "cons": """
        SELECT module, CASE kind WHEN 1 THEN 'alloc' WHEN 2 THEN 'copy' WHEN 3 THEN 'store' WHEN 4 THEN 'load' WHEN 5 THEN 'gep' WHEN 6 THEN 'copy' ELSE 'memcpy' END AS kind,
               lhs AS dst, CASE WHEN kind = 1 THEN obj ELSE rhs END AS src, CASE WHEN kind = 5 THEN 4 * (sk % 3) END AS off, CASE WHEN kind = 7 THEN CAST(8 AS BIGINT) END AS len
        FROM small_stmt""",
    # the same statements in their order, and a control flow over them
    "flow_cons": """
        SELECT module, pos, CASE kind WHEN 1 THEN 'alloc' WHEN 2 THEN 'copy' WHEN 3 THEN 'store' WHEN 4 THEN 'load' WHEN 5 THEN 'gep' WHEN 6 THEN 'free' ELSE 'memcpy' END AS kind,
               lhs AS dst, CASE WHEN kind = 1 THEN obj ELSE rhs END AS src, CASE WHEN kind = 5 THEN 4 * (sk % 3) END AS off, CASE WHEN kind = 7 THEN CAST(8 AS BIGINT) END AS len
        FROM stmt""",
    "flow_edge": """
        SELECT DISTINCT module, src, dst FROM (
          SELECT s.module, s.pos AS src, s.pos + 1 AS dst FROM stmt s JOIN (SELECT module, max(pos) AS k FROM stmt GROUP BY module) n ON n.module = s.module WHERE s.pos < n.k
          UNION ALL SELECT s.module, s.pos AS src, 1 + (s.ok * 7 + s.pk) % n.k AS dst FROM stmt s JOIN (SELECT module, max(pos) AS k FROM stmt GROUP BY module) n ON n.module = s.module WHERE s.pk % 9 = 0) e""",
    # functions are objects 1, 3 and 5: node 8 + obj is the parameter, 16 + obj the result, which is the parameter
    "function": "SELECT DISTINCT module, obj, 8 + obj AS param, 16 + obj AS result FROM stmt WHERE kind = 1 AND obj % 2 = 1",
    "call_cons": """
        SELECT module, CASE WHEN kind = 'memcpy' THEN 'call' ELSE kind END AS kind, dst, src, CASE WHEN kind = 'memcpy' THEN (dst + src) % 8 ELSE off END AS off, CASE WHEN kind <> 'memcpy' THEN len END AS len FROM cons
        UNION ALL SELECT module, 'copy' AS kind, result AS dst, param AS src, CAST(NULL AS BIGINT) AS off, CAST(NULL AS BIGINT) AS len FROM function""",
    "object": """
        SELECT module, obj, max(pk % 50) AS size, obj % 3 = 0 AS zero FROM small_stmt WHERE kind = 1 GROUP BY module, obj""",
    "thread_event": """
        SELECT user_id AS module, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS node,
               CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS k,
               CASE event_type WHEN 'signup' THEN 'ENTRY' WHEN 'view' THEN 'FORK' WHEN 'purchase' THEN 'LOCK' WHEN 'error' THEN 'UNLOCK' ELSE CASE WHEN event_id % 4 = 0 THEN 'JOIN' ELSE 'GENERAL' END END AS kind,
               event_id % 3 AS mutex, event_id AS eid
        FROM events""",
    "thread_edge": """
        SELECT DISTINCT module, src, dst FROM (
          SELECT module, node AS src, node + 1 AS dst FROM thread_event WHERE node < k
          UNION ALL SELECT module, node AS src, 1 + (eid * 7 + module) % k AS dst FROM thread_event WHERE kind = 'FORK') e""",
    "thread_access": """
        SELECT module, node, CASE WHEN eid % 2 = 0 THEN 'store' ELSE 'load' END AS op, eid % 5 AS obj, CASE WHEN eid % 7 <> 0 THEN eid % 3 END AS off
        FROM thread_event WHERE kind = 'GENERAL'""",
    "source_stmt": """
        SELECT fn, node, concat('f', CAST(fn % 3 AS VARCHAR(20)), '.c') AS file, concat('fun', CAST(fn AS VARCHAR(20))) AS fun, node AS line, concat('o', CAST(ok % 6 AS VARCHAR(20))) AS obj FROM node""",
    "vr_fact": """
        SELECT DISTINCT l_orderkey % 2000 AS loc, l_partkey % 12 AS lt, CAST(l_linenumber AS BIGINT) AS rel, l_suppkey % 12 AS rt
        FROM lineitem""",
}

_kept: dict[tuple, DataFrame] = {}


#: Facts made straight of the driver tables: they leave out the order of statements, which takes longer than the rest.
UNORDERED = ("cons", "object")


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], ready: bool = False) -> DataFrame:
    """A relation that several queries share, made once a session and input as a table in the shared folder; ready: make()
    gives such a table."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _kept:
        _kept[at] = make() if ready else materialize(make(), name.replace("/", "-"))
    return _kept[at]


def fact(spark: SparkSession, sf_dir: str, name: str, keep: bool = True) -> DataFrame:
    """A driver table or a fact table; keep: as a table in the shared folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not keep and (spark.sparkContext.applicationId, sf_dir, f"fact-{name}") in _kept:
        keep = True
    sql = FACTS[name]
    args = {n: fact(spark, sf_dir, n, keep and name not in UNORDERED) for n in (*TABLES, *FACTS) if n != name and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)}
    same = re.fullmatch(r"SELECT \* FROM (\w+)", sql.strip())  # another name of a table
    for n in args:
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    if not keep:
        return spark.sql(sql, **args)
    return kept(spark, sf_dir, f"fact-{name}", lambda: args[same[1]] if same else spark.sql(sql, **args), ready=bool(same))
