"""Exact dedup: a two-pass Bloom filter finds possibly repeated hashes; only those rows shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, normalized, table

#: Rows for each 64-bit word of the filter, which grows with the rows; two bits of one word are set for each row. With eight
#: rows a word one text in twenty that has no copy goes to the exact step; none is lost.
ROWS_A_WORD = 8
#: A filter of up to this many words (about 32 bytes each) is broadcast. A larger one stays dealt by hash range, and the
#: rows' digests meet it by a shuffle; texts don't.
BROADCAST_WORDS = 1 << 21
#: A text with more than 1 / HOT of the rows that shuffle is hot; there are fewer than HOT such texts, so their table is
#: broadcast and their rows are not dealt by key.
HOT = 4096


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sha: hex SHA-256 of the text with each run of white space as one space (null: empty)."""
    return docs.withColumn("sha", F.sha2(F.encode(normalized(F.col(text)), "UTF-8"), 256))


def filter_words(rows: int) -> int:
    """Words of a filter for so many rows, a power of two."""
    return max(1 << 10, 1 << max(0, -(-rows // ROWS_A_WORD) - 1).bit_length())


def place(sha, words: int):
    """Columns: the word of a hash in a filter of so many, and its two bits there, from separate digits of it."""
    digits = lambda start: F.conv(F.substr(sha, F.lit(start), F.lit(12)), 16, 10).cast("long")
    bits = digits(20)
    return F.pmod(digits(1), F.lit(words)), F.array(bits.bitwiseAND(63).cast("int"), F.shiftright(bits, 6).bitwiseAND(63).cast("int"))


def repeated_filter(shas: DataFrame, words: int) -> DataFrame:
    """First pass over shas(sha): (word, bits), the bits that two or more rows set.

    Each task counts its own places before they shuffle, so at most as many rows leave it as the filter has places.
    """
    word, bits = place(F.col("sha"), words)
    places = shas.select(word.alias("word"), F.explode(bits).alias("bit")).groupBy("word", "bit").agg(F.count("*").alias("n"))
    return places.where("n > 1").groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def flagged(rows: DataFrame, bits: DataFrame, words: int, most: int = BROADCAST_WORDS) -> DataFrame:
    """Second pass: rows(sha and more) with maybe: whether both bits of the hash were set twice (a hash whose two bits are
    one sets it twice itself, and is let through). No row shuffles while the filter has up to most words."""
    word, two = place(F.col("sha"), words)
    side = bits.select(F.col("word").alias("filter_word"), F.col("bits").alias("filter_bits"))
    side = F.broadcast(side) if words <= most else side
    both = rows.withColumn("filter_place", word).withColumn("filter_two", two).join(side, F.col("filter_place") == F.col("filter_word"), "left")
    isset = lambda i: F.expr(f"shiftright(filter_bits, filter_two[{i}]) & 1L") == 1
    return both.withColumn("maybe", F.coalesce(isset(0) & isset(1), F.lit(False))).drop("filter_place", "filter_two", "filter_word", "filter_bits")


def exact_groups(docs: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    Texts are equal when equal after each run of ASCII white space became one space; null is empty. Of equal texts the
    row with the smallest doc_id stays (null ids last); of rows that repeat both id and text one stays. A text that no
    other row has is its own group of 1. An empty table has no rows. Other columns are ignored, whatever their names.
    """
    shas = materialize(hashed(docs.select("doc_id", "text")).select("doc_id", "sha"), "digests")
    words = filter_words(shas.count())
    flag = flagged(shas, materialize(repeated_filter(shas, words), "bloom"), words, most)
    alone = flag.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    maybe = materialize(flag.where("maybe").groupBy("sha", "doc_id").agg(F.count("*").alias("n")), "maybe")
    met = materialize(maybe.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    large = max(1000, maybe.count() // HOT)
    hot = met.where(F.col("group_size") > large)
    join = lambda rows, side: rows.join(side, "sha")
    cold_rows = maybe.join(F.broadcast(hot.select("sha")), "sha", "left_anti")
    told = join(maybe, F.broadcast(hot)).unionByName(join(cold_rows, met.where(F.col("group_size") <= large)))
    each = told.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return alone.unionByName(each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")))


def deduplicate(docs: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """docs without the rows that exact_groups drops; texts outside possible groups pass straight through.

    Null texts are empty ones; of rows that repeat, one stays; an empty table stays empty; other columns pass, whatever
    their names.
    """
    columns = docs.columns
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    shas = materialize(hashed(rows).select("doc_id", "sha"), "digests")
    words = filter_words(shas.count())
    bits = materialize(repeated_filter(shas, words), "bloom")
    first = flagged(shas, bits, words, most).where("maybe").groupBy("sha").agg(F.min("doc_id").alias("keep_id"))
    first = materialize(first, "groups")
    flag = flagged(hashed(rows).select("row", "doc_id", "sha"), bits, words, most)
    through = flag.where("not maybe").select("row")
    met = flag.where("maybe").alias("f").join(first.alias("g"), F.expr("f.sha = g.sha and f.doc_id <=> g.keep_id")).select("f.sha", "row")
    one = met.groupBy("sha").agg(F.first("row").alias("row")).select("row")
    return through.unionByName(one).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1 AS kept, sha AS text_sha256
FROM d
"""
