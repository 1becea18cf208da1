"""What nodes of one graph hand on along its edges: labels, or a span of values for each label.

One graph over all functions can't be split as independent groups can, but labels don't touch each other: they are dealt
into lots, every lot gets the edges, and a task carries 64 labels at a time, or one span. A graph of more edges than a task
should hold is for rounds over relations instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Edges that a task holds, and labelled nodes of a lot on average.
LARGE_GRAPH, LOT_ROWS = 30_000_000, 4_000_000
#: Stands for a node that is null. Nothing leaves it, as null equals nothing.
NO_NODE = -(1 << 63)
CHUNK = 100_000


class Graph:
    """Edges by their start; nodes are numbered."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, nodes: np.ndarray):
        self.ids = np.unique(np.concatenate([src, dst, nodes]))
        src, dst = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        by = np.argsort(src, kind="stable")
        self.src, self.dst = src[by].astype(np.int32), dst[by].astype(np.int32)
        self.first = np.searchsorted(self.src, np.arange(len(self.ids) + 1))

    def number(self, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, nodes)

    def leaving(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(src, dst) of the edges of nodes."""
        n = self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(self.first[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.src[at], self.dst[at]

    def carry(self, bits: np.ndarray) -> None:
        """bits of nodes, joined in place with those of all nodes before them."""
        now = np.flatnonzero(bits)
        while len(now):
            src, dst = self.leaving(now)
            gain = bits[src] & ~bits[dst]
            on = np.flatnonzero(gain)
            np.bitwise_or.at(bits, dst[on], gain[on])
            now = np.unique(dst[on])

    def spread(self, held: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """lo and hi of the nodes that hold a span, in place the least and most of all nodes before them, themselves included."""
        now = np.flatnonzero(held)
        while len(now):
            src, dst = self.leaving(now)
            on = np.flatnonzero(~held[dst] | (lo[src] < lo[dst]) | (hi[src] > hi[dst]))
            src, dst = src[on], dst[on]
            np.minimum.at(lo, dst, lo[src])
            np.maximum.at(hi, dst, hi[src])
            held[dst] = True
            now = np.unique(dst)


def coded(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's values, a row of each number); nulls are values."""
    code = np.zeros(len(columns[0]), np.int64)
    first = np.zeros(min(1, len(code)), np.int64)
    for column in columns:
        values = column.dictionary_encode(null_encoding="encode")
        one, code = code, values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first, code = np.unique(one * (len(values.dictionary) + 1) + code, return_index=True, return_inverse=True)
    return code, first


def carried(own: DataFrame, edges: DataFrame, labels: Sequence[str], span: Sequence[str] = ()) -> DataFrame:
    """(node, labels, span): what own(node, labels, span) gives each node and, along edges(src, dst), all nodes after it. Without
    a span, labels that arrive, each once; with one, two columns, the least of the first and the most of the second, of
    those that aren't null. Both tables are read several times and should be kept ones."""
    from pyspark.sql.pandas.types import to_arrow_schema

    labels, span = list(labels), list(span)
    fields = [StructField("node", own.schema["node"].dataType), *[own.schema[c] for c in (*labels, *span)]]
    schema_ = StructType([StructField(f.name, f.dataType) for f in fields])
    schema = to_arrow_schema(schema_)
    size = own.agg(F.count("*").alias("rows"), F.countDistinct(F.struct(*labels)).alias("labels")).first()
    at_once = 1 if span else 64
    lots = max(1, min(-(-size["labels"] // at_once), 2 * own.sparkSession.sparkContext.defaultParallelism), -(-size["rows"] // LOT_ROWS))
    node = lambda c: F.coalesce(F.col(c), F.lit(NO_NODE)).cast("long")
    mine = own.select(F.pmod(F.xxhash64(*labels), F.lit(lots)).cast("int").alias("lot"), node("node").alias("a"), F.lit(None).cast("long").alias("b"), *labels, *span)
    way = edges.where("src IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), F.col("src").cast("long").alias("a"), node("dst").alias("b"))
    rows = mine.unionByName(way, allowMissingColumns=True)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
        """(src, dst, labelled nodes) of each lot."""
        at, src, dst, held = None, [], [], []
        for batch in batches:
            lot = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(lot)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if lot[x] != at:
                    if held:
                        yield np.concatenate(src), np.concatenate(dst), pa.Table.from_batches(held)
                    at, src, dst, held = lot[x], [], [], []
                part = batch.slice(x, y - x)
                edge = pc.is_valid(part.column(2))
                way = part.filter(edge)
                src.append(way.column(1).to_numpy())
                dst.append(way.column(2).to_numpy())
                held.append(part.filter(pc.invert(edge)))
        if held:
            yield np.concatenate(src), np.concatenate(dst), pa.Table.from_batches(held)

    def told(ids: np.ndarray, values: list, ends: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x in range(0, len(ids), CHUNK):
            some = ids[x : x + CHUNK]
            none = some == NO_NODE
            cols = [pa.array(some, pa.int64(), mask=none if none.any() else None).cast(schema[0].type)]
            cols += [pa.repeat(v, len(some)).cast(f.type) for v, f in zip(values, list(schema)[1:], strict=False)]
            for end, worst, f in zip(ends, (np.iinfo(np.int64).max, np.iinfo(np.int64).min), list(schema)[1 + len(labels) :], strict=False):
                cols.append(pa.array(end[x : x + CHUNK], pa.int64(), mask=end[x : x + CHUNK] == worst).cast(f.type))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, dst, held in met(batches):
            if not len(held):
                continue
            held = held.combine_chunks()
            columns = [held.column(c).chunk(0) for c in labels]
            code, first = coded(columns)
            nodes = held.column("a").to_numpy()
            graph = Graph(src, dst, nodes)
            nodes = graph.number(nodes)
            by = np.argsort(code, kind="stable")
            cut = np.searchsorted(code[by], np.arange(len(first) + 1))
            for k in range(0, len(first), at_once):
                some = by[cut[k] : cut[min(k + at_once, len(first))]]
                if span:
                    reached = np.zeros(len(graph.ids), bool)
                    reached[nodes[some]] = True
                    lo = np.full(len(graph.ids), np.iinfo(np.int64).max)
                    hi = np.full(len(graph.ids), np.iinfo(np.int64).min)
                    low, high = (held.column(c).chunk(0).take(pa.array(some)) for c in span)
                    for end, of, put in ((lo, low, np.minimum), (hi, high, np.maximum)):
                        known = np.flatnonzero(pc.is_valid(of).to_numpy(zero_copy_only=False))
                        put.at(end, nodes[some][known], of.drop_null().to_numpy().astype(np.int64))
                    graph.spread(reached, lo, hi)
                    all_ = np.flatnonzero(reached)
                    yield from told(graph.ids[all_], [c[int(first[k])] for c in columns], [lo[all_], hi[all_]])
                    continue
                bits = np.zeros(len(graph.ids), np.uint64)
                np.bitwise_or.at(bits, nodes[some], np.uint64(1) << (code[some] - k).astype(np.uint64))
                graph.carry(bits)
                for j in range(k, min(k + at_once, len(first))):
                    yield from told(graph.ids[np.flatnonzero(bits >> np.uint64(j - k) & np.uint64(1))], [c[int(first[j])] for c in columns], [])

    # more tasks than lots, so that two of these seldom fall into one
    return rows.repartition(8 * lots, "lot").sortWithinPartitions("lot").mapInArrow(run, schema_)
