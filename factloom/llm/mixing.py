"""Mixing sources to target weights: tokens per source, water-filled targets, repetition rates, one seeded extra copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix"
#: Bits of a document's hash, and of its bucket: the first look for a source's cut is by bucket, the second inside one.
HASH_BITS, BUCKET_BITS = 52, 12
#: Tables of one row per source are broadcast up to this number of rows (about 100 bytes each); beyond it joins shuffle.
BROADCAST_SOURCES = 50_000


def bounded(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def seeded_hash(doc_id, seed: str = SEED):
    """Column: a hash of the id, uniform in [0, 2^HASH_BITS)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.left(F.md5(text), F.lit(HASH_BITS // 4)), 16, 10).cast("long")


def document_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, h): words of the whole text (null: 0) and the hash that seeds the draw."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded_hash(F.col("doc_id"), seed).alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from sizes(source, size); weights repeat over sources by code point, null last.

    The total is shared by weight; a target stops at max_repeat times its source's size and the excess is reshared until
    none is above. Sorted by capacity per weight the capped sources are a prefix, so all rounds of resharing are one
    running sum. After the first aggregate the work is on one row per source. Integers until the last division.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    rank = F.row_number().over(Window.orderBy(*name)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("long")
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("cap") / F.col("w"), *name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(F.lit(0))
    per = per.withColumn("left", F.sum("source_size").over(whole) - before)
    per = per.withColumn("w_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("capped", F.col("w") * F.col("left") > F.col("cap") * F.col("w_left"))
    level = F.max(F.when(~F.col("capped"), F.struct("w_left", "left"))).over(whole)  # the first that isn't capped
    share = (F.col("w") * level["left"]).cast("double") / level["w_left"].cast("double")
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mixture_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, independent: bool = False) -> DataFrame:
    """(source, source_size, target, whole, cut): every document of a source is taken whole times, and once more if its
    hash is at most cut.

    independent: each document's draw is its own, the cut is the fraction of the hashes' range. Sources of few documents
    then miss their targets by far (by half with 50 documents), so by default draws of a source are dealt out together:

    The extra copy is a Bernoulli draw seeded by the id: it is given if the middle of the document, with its source laid
    out in hash order, lies within the fraction of the rate. A place in hash order is uniform, so the probability is the
    fraction, and the words taken end within about half a document of the target at any number of documents. The cut is
    found by two aggregates: words per (source, bucket of hashes), then the rows of one bucket a source.
    """
    shift = HASH_BITS - BUCKET_BITS
    bucket = F.shiftright("h", shift)
    per = materialize(sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "buckets")
    targets = materialize(source_targets(per, weights, max_repeat), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    if independent:
        cut = F.when(F.col("source_size") > 0, F.floor(F.col("extra") / F.col("source_size") * F.lit(float(1 << HASH_BITS)))).otherwise(0).cast("long") - 1
        return materialize(targets.select("source", "source_size", "target", "whole", cut.alias("cut")), "plan")
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ran = per.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).alias("p")
    hit = ran.join(bounded(targets).alias("t"), F.expr("p.source <=> t.source")).where("before < extra and extra <= before + size")
    hit = materialize(hit.select("p.source", "bucket", "before", "extra"), "crossed")
    crossed = sizes.withColumn("bucket", bucket).alias("d").join(bounded(hit).alias("x"), F.expr("d.source <=> x.source and d.bucket = x.bucket"))
    by_h = crossed.groupBy("d.source", "d.bucket", "d.h").agg(F.sum("d.size").alias("size"), F.min("before").alias("before"), F.min("extra").alias("extra"))
    upto = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    last = by_h.withColumn("middle", F.col("before") + upto - F.col("size") / 2).where("middle <= extra").groupBy("source").agg(F.max("h").alias("last"))
    cuts = hit.alias("b").join(last.alias("l"), F.expr("b.source <=> l.source"), "left").select("b.source", F.coalesce("last", F.shiftleft("bucket", shift) - 1).alias("cut"))
    plan = targets.alias("t").join(cuts.alias("c"), F.expr("t.source <=> c.source"), "left")
    return materialize(plan.select("t.source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")), "plan")


def copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized (source, h and more) with source_size, target and copies; one row per source is joined, by broadcast if few."""
    both = sized.alias("d").join(bounded(plan).alias("p"), F.expr("d.source <=> p.source"))
    return both.select("d.*", "source_size", "target", (F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, independent: bool = False) -> DataFrame:
    """The mixture itself: docs' rows, each as many times as it is taken, without shuffling a text.

    Null or empty texts have size 0; they are copied at their source's rate. A null source is a source of its own.
    Repeated rows draw together; an empty table stays empty. More columns pass through; names that this function uses itself may be among them.
    """
    plan = mixture_plan(materialize(document_sizes(docs, seed), "sizes"), weights, max_repeat, independent)
    rows = docs.select(F.struct("*").alias("row"), "source", seeded_hash(F.col("doc_id"), seed).alias("h"))
    taken = copies(rows, plan).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(document_sizes(table(spark, sf_dir, "documents")), "sizes")
    out = copies(sizes, mixture_plan(sizes))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || left(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 13))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM per),
placed AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source IS NULL, encode(source)) AS i,
         (sum(source_size) OVER ())::BIGINT AS total FROM weighed),
ran AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_rest FROM placed),
level AS (SELECT rest AS l_rest, w_rest AS l_w FROM ran WHERE NOT w * rest > cap * w_rest ORDER BY i LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN w * rest > cap * w_rest THEN cap::DOUBLE ELSE (w * l_rest)::DOUBLE / l_w::DOUBLE END AS target
  FROM ran LEFT JOIN level ON true),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
by_h AS (SELECT source, h, sum(size)::BIGINT AS size FROM sized GROUP BY source, h),
laid AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM by_h),
cuts AS (
  SELECT r.source, max(l.h) AS cut FROM rated r JOIN laid l ON l.source IS NOT DISTINCT FROM r.source
  WHERE l.upto - l.size / 2.0 <= r.target - r.whole * r.source_size AND r.target - r.whole * r.source_size > 0
  GROUP BY r.source)
SELECT d.doc_id, d.size, r.source_size, r.target,
       d.size * (r.whole + CASE WHEN d.h <= coalesce(c.cut, -1) THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN cuts c ON c.source IS NOT DISTINCT FROM r.source
"""
