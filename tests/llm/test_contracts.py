"""Every operator with nulls, empty and very long texts, ties and repeated rows, empty tables and columns of clashing names."""

import random
import re

import pytest
from helpers import rows

from factloom.llm import chat, exact_dedup, lm_score, mixing, ngram_join, packing, pii, quality, substring_dedup, warc

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ["sha", "word", "bits", "maybe", "row", "size", "h", "bucket", "copies", "target", "key", "doc", "ref", "n", "a", "b", "c", "t", "component", "filter_word", "block", "kind", "held_out", "kept", "keep_id", "copy", "label", "quality", "toxic", "found", "added", "pos", "start"]

LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)], LABELS)


def judge(docs):
    return quality.judged(docs, quality.train(docs, labels(docs.sparkSession)))


#: Operators on documents, with the columns by which results are compared.
OPERATORS = {
    "pii": lambda d: pii.detect(d),
    "exact groups": exact_dedup.exact_groups,
    "exact dedup": lambda d: exact_dedup.deduplicate(d).select("doc_id", "text", "source"),
    "mixing": lambda d: mixing.mix(d).select("doc_id", "text", "source"),
    "lm": lambda d: lm_score.scored(d),
    "near": lambda d: ngram_join.near_duplicates(d),
    "one of each": lambda d: ngram_join.one_of_each(d).select("doc_id", "text"),
    "packing": lambda d: packing.packed(d.coalesce(1).sortWithinPartitions("doc_id", "text")).drop("sequence_id"),
    "substring": substring_dedup.repeated_passages,
    "quality": judge,
    "kept": lambda d: quality.kept_documents(d, labels(d.sparkSession)).select("doc_id", "text"),
}


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    some = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "Éta", "x1"]) for _ in range(n)) for n in (4, 30, 80, 120)]
    texts = [*some, some[2], None, "", " \t\n", "mail a@b.co", some[3] + " end", None, ""]
    data = [(i, t, "en", None if i % 4 == 0 else "s%d" % (i % 2), 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[2], data[5], (None, some[1], None, None, None), (None, None, None, None, None)], DDL)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_nulls_and_repeats(spark, docs, name):
    plain = rows(OPERATORS[name](docs))
    more = docs.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES if c not in docs.columns])
    assert rows(OPERATORS[name](more)) == plain
    if name not in ("substring", "mixing", "exact dedup"):
        ids = {r.doc_id for r in OPERATORS[name](docs).select("doc_id").collect()}
        assert name in ("one of each", "kept") or ids == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("exact groups", "near", "quality")])
def test_very_long_text(spark, name):
    rnd = random.Random(2)
    long = " ".join("".join(rnd.choices("abcdefghij", k=8)) for _ in range(1_120_000))
    assert len(long) > 10_000_000
    docs = spark.createDataFrame([(1, long, "en", "s", 0), (2, "short one", "en", "s", 0), (3, long[-700:], "en", "s", 0)], DDL)
    got = OPERATORS[name](docs)
    if name == "substring":
        assert [(r.doc_id, r.ref_doc_id) for r in got.collect()] == [(3, 1)]
    elif name == "packing":
        assert got.where("doc_id = 1").agg({"length": "sum"}).first()[0] == got.where("doc_id = 1").first().doc_tokens
    else:
        assert {r.doc_id for r in got.select("doc_id").collect()} >= {1} - ({1} if name == "kept" else set())


def test_pages_of_any_kind(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "x" * 10_000_000, "<p>a</p>"]
    data = [(i, None if i == 2 else f"http://h/{i}", h) for i, h in enumerate(html)]
    pages = spark.createDataFrame([*data, data[3], (None, "u", "<p>a</p>")], "page_id long, url string, html string")
    more = pages.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES])
    told = []
    for i, p in enumerate((pages, more)):
        out = f"file://{tmp_path}/{i}"
        warc.write(p, out)
        told.append(rows(warc.read(spark, out).drop("html")))
    assert told[0] == told[1] and len(told[0]) == 8
    assert warc.write(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_shards_of_uneven_ids(spark):
    """Ids far apart and close together: no shard over size, whatever the partitions."""
    ids = [*range(1000), *(10**15 + i for i in range(500)), -(10**17)]
    pages = spark.createDataFrame([(i, 10) for i in ids], "page_id long, bytes long")
    bounds = warc.shard_bounds(pages, shard_bytes=200, ranges=16)
    assert bounds == warc.shard_bounds(pages.repartition(7), shard_bytes=200, ranges=16)
    shard = {r.page_id: r.s for r in pages.select("page_id", warc.shard_of(pages.page_id, bounds, step=5).alias("s")).collect()}
    assert shard == {i: sum(b <= i for b in bounds) for i in ids}
    sizes = [sum(10 for i in ids if shard[i] == s) for s in set(shard.values())]
    assert max(sizes) <= 200 and len(sizes) < 2.5 * len(ids) * 10 / 200


def test_messages_of_any_kind(spark):
    data = [(1, 1, "user", "hi"), (1, 2, "assistant", "x" * 10_000_000), (1, 2, "assistant", "tie"), (1, 3, None, None), (2, 1, "assistant", ""), (None, 1, "user", "lost")]
    m = spark.createDataFrame(data, "conv_id long, position long, role string, text string")
    plain = rows(chat.read_back(chat.formatted(m)))
    assert rows(chat.read_back(chat.formatted(m.selectExpr("*", *[f"'x' AS {c}" for c in [*CLASHES, "turn", "learned", "chars", "loss", "part"]])))) == plain and len(plain) == 3
    assert chat.read_back(chat.formatted(m.limit(0))).count() == 0
    assert chat.fold_events(spark.createDataFrame([], "conv_id long, seq long, op string, message_id string, role string, text string")).count() == 0


def test_bloom_filter_beyond_the_broadcast_bound(docs):
    """A filter that isn't broadcast gives the same groups."""
    assert rows(exact_dedup.exact_groups(docs, most=0)) == rows(exact_dedup.exact_groups(docs))
    assert rows(exact_dedup.deduplicate(docs, most=0).select("doc_id")) == rows(exact_dedup.deduplicate(docs).select("doc_id"))


def test_independent_draws(spark):
    """The draw by the fraction alone: each extra copy where the hash is below it."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "ab"[i % 2], 0) for i in range(400)], DDL)
    sizes = mixing.document_sizes(docs)
    plan = {r.source: r for r in mixing.mixture_plan(sizes, independent=True).collect()}
    for r in sizes.collect():
        p = plan[r.source]
        assert (r.h <= p.cut) == (r.h < int((p.target - p.whole * p.source_size) / p.source_size * 2**mixing.HASH_BITS))
    taken = mixing.mix(docs, independent=True).groupBy("source").agg({"text": "count"}).collect()
    assert len(taken) == 2 and re.match("[ab]", taken[0].source)
