from factloom.functions.fixpoint import reach
from factloom.sources import sinks
from factloom.streaming.incremental import follow


def test_stream_keeps_reachability(spark, tmp_path):
    edges = [(1, 1, 2), (1, 3, 4), (1, 2, 3), (1, 4, 2), (2, 1, 2), (2, 5, 6)]
    src = tmp_path / "in"
    for i in range(0, 6, 2):
        spark.createDataFrame(edges[i : i + 2], "fn long, src long, dst long").coalesce(1).write.mode("append").parquet(f"file://{src}")
    seeds = spark.createDataFrame([(1, 1), (2, 1)], "fn long, node long")
    stream = spark.readStream.schema("fn long, src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"file://{src}")
    q = follow(stream, seeds, f"file://{tmp_path}/edges", f"file://{tmp_path}/known", f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    got = {(r.fn, r.node) for r in spark.read.parquet(f"file://{tmp_path}/known").collect()}
    want = {(r.fn, r.node) for r in reach(spark.createDataFrame(edges, "fn long, src long, dst long"), seeds, ("fn",)).collect()}
    assert got == want == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)}


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1), (1, 2)], "fn long, node long")
    sinks.write_slice(nodes, nodes.where("node = 2"), f"file://{tmp_path}/slice")
    assert [(r.fn, r.node) for r in spark.read.parquet(f"file://{tmp_path}/slice").collect()] == [(1, 2)]
    rel = spark.createDataFrame([(1, 2, 9), (1, 2, 7)], "fn long, node long, value long")
    assert [r.pt for r in sinks.annotated(nodes, pt=rel).orderBy("node").collect()] == [None, "7,9"]
    sinks.write_dot(spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, "c")], "fn long, o int, line string"), f"file://{tmp_path}/dot")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/dot").collect()] == ["a", "b", "c"]
