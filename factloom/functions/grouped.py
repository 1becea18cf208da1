"""One pass over groups that fit a task: rows of a key meet in order, a function answers for each group.

Analyses of independent modules or functions need no rounds over all of them: each small one is solved where its rows
meet. Groups of more rows than a task should hold are told apart first, for the relational form of the same analysis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a group that one task solves in memory.
LARGE = 20_000


def per_group(rows: DataFrame, keys: Sequence[str], solve: Callable[[tuple, list[tuple]], Iterator[tuple]], ddl: str, columns: bool = False) -> DataFrame:
    """Rows of solve(key, rows of the group) behind the key's columns; ddl names and types them all. Rows are tuples of the
    other columns, in their order, unsorted; columns: solve tells lists, one a column. One shuffle by key; a task holds one
    group."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = list(keys)
    n = len(keys)
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    rows = rows.select(*keys, *[c for c in rows.columns if c not in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        lists: list[list] = [[] for _ in schema]
        at, group = None, []

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(lists if columns else zip(*out, strict=True), schema, strict=True)], schema=schema)
            for x in (out, *lists):
                x.clear()
            return batch

        def solved(key: tuple, rows: list[tuple]) -> int:
            """How many rows wait to be told."""
            if not columns:
                out.extend((*key, *r) for r in solve(key, rows))
                return len(out)
            more = solve(key, rows)
            for mine, c in zip(lists, (*([k] * len(more[0]) for k in key), *more), strict=True):
                mine += c
            return len(lists[0])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != at:
                    if group and solved(at, group) > 20_000:
                        yield told()
                    at, group = row[:n], []
                group.append(row[n:])
        if group and solved(at, group):
            yield told()

    return rows.repartition(*map(F.col, keys)).sortWithinPartitions(*keys).mapInArrow(run, ddl)


#: Rows of groups that are solved side by side.
SIDE_BY_SIDE = 200_000


def many_groups(rows: DataFrame, key: str, solve: Callable[[pa.Table], Iterator[pa.Table]], ddl: str) -> DataFrame:
    """Rows of solve(table), where a table is some whole groups of rows by key, which comes first and in order, null before all.
    One shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    rows = rows.select(key, *[c for c in rows.columns if c != key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        waiting = 0

        def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for out in solve(table):
                yield from out.select(schema.names).cast(schema).to_batches(max_chunksize=100_000)

        for batch in batches:
            parts.append(batch)
            waiting += batch.num_rows
            if waiting >= SIDE_BY_SIDE:
                table = pa.Table.from_batches(parts)
                end = table.column(0)[-1]
                last = int(pc.index(table.column(0), end).as_py()) if end.is_valid else 0  # the last group may go on
                if last:
                    yield from solved(table.slice(0, last))
                    parts = table.slice(last).combine_chunks().to_batches()
                    waiting = table.num_rows - last
        if waiting:
            yield from solved(pa.Table.from_batches(parts))

    return rows.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, ddl)


def split_by_size(rows: DataFrame, keys: Sequence[str], large: int = LARGE) -> tuple[DataFrame | None, DataFrame | None]:
    """(keys of groups up to large rows, keys of larger ones); None where there are none."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows_"))
    ends = sizes.agg(F.min("rows_").alias("least"), F.max("rows_").alias("most")).first()
    if ends["least"] is None:
        return None, None
    few, many = sizes.where(F.col("rows_") <= large).select(*keys), sizes.where(F.col("rows_") > large).select(*keys)
    return few if ends["least"] <= large else None, many if ends["most"] > large else None
