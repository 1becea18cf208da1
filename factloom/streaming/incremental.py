"""Facts that arrive as a stream: micro-batches extend edge tables and the relations that grow with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixpoint import reach


def extend_reach(known: DataFrame, edges: DataFrame, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that new edges add to known(keys, node and more), a relation closed under edges(keys, src, dst) without added.

    Reachability only grows, so the walk starts at the far ends of new edges whose near end is known.
    """
    keys = list(keys)
    starts = known.withColumnRenamed("node", "src").join(added, [*keys, "src"]).withColumn("node", F.col("dst")).select(known.columns)
    fresh = starts.distinct().join(known, known.columns, "left_anti")
    return reach(edges.unionByName(added).distinct(), fresh, keys).join(known, known.columns, "left_anti")


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def follow(stream: DataFrame, seeds: DataFrame, edges_path: str, known_path: str, checkpoint: str, keys: Sequence[str] = ("fn",)):
    """Starts a query that keeps known_path closed under the edges(keys, src, dst) that stream has brought so far.

    Each micro-batch writes folders named by its number, so a batch that is run again overwrites its own and nothing else.
    """
    keys = list(keys)
    cols = [*keys, "src", "dst"]

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        old = read_or_none(spark, edges_path)
        old = old.where(F.col("batch") < number).select(cols) if old is not None else df.select(cols).limit(0)
        added = df.select(cols).distinct().join(old, cols, "left_anti")
        known = read_or_none(spark, known_path)
        known = known.where(F.col("batch") < number).select(seeds.columns) if known is not None else seeds.limit(0)
        known = known.unionByName(seeds).distinct()
        grown = extend_reach(known, old, added, keys)
        first = seeds if number == 0 else seeds.limit(0)
        added.write.mode("overwrite").parquet(f"{edges_path}/batch={number}")
        grown.unionByName(first).distinct().write.mode("overwrite").parquet(f"{known_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
