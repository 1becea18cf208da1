"""Every registered query over program facts and the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..sources.facts import FACTS
from . import graph_queries, memory_queries, slice_queries

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "s08_backward_slice"


def with_parts(sql: str, parts: dict[str, str]) -> str:
    """sql preceded by the relations that it uses, and those that they use, as common tables in order of need."""
    known = FACTS | parts
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b(?:FROM|JOIN|IN \()\s*{name}\b|\bFROM {name}\b", text):
                if name in parts and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", parts[name]):
                    need(re.sub(rf"\b(?:FROM|JOIN)\s+{name}\b", "", parts[name]))
                else:
                    need(known[name])
                if name not in order:
                    order.append(name)

    need(sql)
    head = ",\n".join(f"{n} AS ({known[n]})" if n in parts and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", parts[n]) else f"{n} AS MATERIALIZED ({known[n]})" for n in order)
    return f"WITH RECURSIVE {head}\n{sql}" if head else sql


for module in (graph_queries, memory_queries, slice_queries):
    QUERIES |= module.QUERIES
    SQL |= {name: with_parts(sql, module.PARTS) for name, sql in module.ORACLE.items()}
