"""What the operators of this subpackage share: shared-folder tables, token and block helpers, streaming groups."""

from __future__ import annotations

import ctypes
import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import drop_table, materialize, shared_dir  # noqa: F401

#: The white space of every contract here; bytes.split() without arguments splits on exactly these bytes.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: One multiplier for all rolling hashes (odd, from the golden ratio).
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: 64-bit words of a filter of ids at most: about 64 MB as a broadcast table. A fuller filter lets more rows through.
FILTER_WORDS = 1 << 21


def possibly_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows without most of those whose key isn't in ids(key): a join with ids must follow. No row shuffles: the ids come
    as bits of hashes, one word for every four ids, FILTER_WORDS at most."""
    words = min(FILTER_WORDS, 1 << max(10, (ids.count() // 4).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(64 * words))
    word, bit = F.shiftright(place, 6).alias("filter_word"), place.bitwiseAND(63).cast("int").alias("filter_bit")
    bits = ids.select(word, bit).groupBy("filter_word").agg(F.expr("bit_or(shiftleft(1L, filter_bit))").alias("filter_bits"))
    marked = rows.select("*", word, bit).join(F.broadcast(bits), "filter_word").where("(shiftright(filter_bits, filter_bit) & 1L) = 1")
    return marked.select(rows.columns)


def normalized(text):
    """Column: each run of white space as one space; byte searches first, the regular expression only where runs exist."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def word_count(text):
    """Column: number of words, from lengths, without building arrays."""
    flat = F.btrim(normalized(text))
    spaces = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return col.fill_null("") if col.null_count else col


def slices(col: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of a string column in parts of about that many bytes; a longer text is alone."""
    ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, col.slice(a, b - a)
        a = b


def released(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; behind them the worker, which waits for another task, gives free memory back to the system."""
    yield from rows
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


class Tokens:
    """The words of a column of texts: text i has at[first[i]:first[i + 1]], numbers into distinct (UTF-8 bytes)."""

    def __init__(self, col: pa.Array, lower: bool = False):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(col) if lower else col)
        encoded = lists.flatten().dictionary_encode()
        at, first = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        first = first - first[0]
        empty = pc.index(encoded.dictionary, pa.scalar("", encoded.dictionary.type)).as_py()
        if empty >= 0:  # before a leading and after a trailing white space
            keep = at != empty
            first = np.concatenate([[0], np.cumsum(keep)])[first]
            at = at[keep]
        self.at, self.first = at, first
        self.names: pa.Array = encoded.dictionary

    @functools.cached_property
    def distinct(self) -> list[bytes]:
        return self.names.cast(pa.large_binary() if pa.types.is_large_string(self.names.type) else pa.binary()).to_pylist()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word in order."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), np.uint64, len(self.distinct))[self.at]


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of each k consecutive words inside each text, and the texts' bounds in them.

    A text with fewer words, but one at least, has one window: its whole.
    """
    n = np.diff(first)
    made = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    begin = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], made)
    size = np.repeat(np.minimum(n, k), made)
    out = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            have = i < size
            if have.all():
                out = (out ^ (out >> np.uint64(29))) * MIX + h[begin + i]
            else:
                out[have] = (out[have] ^ (out[have] >> np.uint64(29))) * MIX + h[begin[have] + i]
        return mixed(out + size.astype(np.uint64)), bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * MIX
        return x ^ (x >> np.uint64(29))


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal keys, from batches already sorted by them; holds one group at a time."""
    parts: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in itertools.pairwise(starts):
            key = tuple(c[a].as_py() for c in cols)
            if parts and key != last:
                yield pa.Table.from_batches(parts)
                parts = []
            last = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Dicts of columns as record batches of bounded size."""
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_pylist(part, schema)


def arrow_schema(ddl: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str, size: int = 2000) -> DataFrame:
    """mapInArrow whose function yields one dict per row."""
    _, schema = arrow_schema(ddl)
    return df.mapInArrow(lambda it: batched(iter(f(it)), schema, size), ddl)


def clustered(df: DataFrame, keys: list[str], then: list[str] = ()) -> DataFrame:
    """Rows of a key in one partition and adjacent, in the order of then; the sort spills, nothing is collected."""
    return df.repartition(*map(F.col, keys)).sortWithinPartitions(*keys, *then)


#: Different edges of a graph whose components one task finds, in about 150 MB.
FEW_EDGES = 1_000_000


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of edges a - b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(ends.ravel(), 2)
    root = np.arange(len(nodes))
    while True:
        u, v = root[x], root[y]
        apart = u != v
        if not apart.any():
            return nodes, nodes[root]
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (deeper := root[root] != root).any():
            root[deeper] = root[root[deeper]]


def components(edges: DataFrame, max_rounds: int = 1_000, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) of the undirected graph edges(a long, b long): component is the smallest node that is reachable.

    Up to few different edges are solved by one task: rounds over so little are all scheduling, and each of their exchanges
    takes a thread of the driver. Larger graphs: alternates large-star and small-star steps, each an aggregate and a join on the same key, until nothing changes
    (O(log n) rounds); every round is a table in the shared folder. Nothing is collected but one count a round. Nodes of
    high degree: the minimum is pre-aggregated before its shuffle, and the joins are plain equi-joins that adaptive
    execution can split. Loops (a = b) only introduce the node. Null ends are ignored.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= few:
        ddl = "node long, component long"
        _, schema = arrow_schema(ddl)

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
            if parts:
                found = least_nodes(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                for i in range(0, len(found[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in found], schema=schema)

        return materialize(now.coalesce(1).mapInArrow(solve, ddl), "components")
    loops = now.where("a = b").select("a", "b")
    work = now.where("a <> b")
    for round_ in range(max_rounds):
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_m, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = materialize(small, "stars")
        # settled: every node has one smaller neighbour, and that neighbour is no one's larger end
        many = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1).alias("x")).limit(1)
        deep = new.select("a").join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(F.lit(1).alias("x")).limit(1)
        old, work = work, new
        if round_:  # the first table also holds the loops
            drop_table(old)
        if not many.union(deep).take(1):
            break
    else:
        raise RuntimeError(f"components: {max_rounds} rounds")
    roots = work.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = loops.select(F.col("a").alias("node"), F.col("b").alias("component"))
    inside = work.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
    return inside.union(alone.join(inside.select("node"), "node", "left_anti"))
