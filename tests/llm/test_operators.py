"""Operators of factloom.llm against brute force, with nulls, empty, long and repeated rows, empty tables, extra columns."""

import base64
import hashlib
import math
import random
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import rows, sql_rows

from factloom.llm import chat, common, exact_dedup, lm_score, mixing, ngram_join, packing, pii, quality, queries, substring_dedup, warc

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return (t or "").encode().split()


def texts():
    rnd = random.Random(5)
    vocab = ["w%d" % i for i in range(60)] + ["été", "日本", "Über"]
    long = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (3, 12, 40, 90, 200, 200, 400)]
    near = long[4].split()
    near[70] = "changed"
    passage = " ".join("p%d" % i for i in range(60))
    out = [*long, long[4], " ".join(near), long[2].replace(" ", "\n\t "), None, "", " \n ", "one", "x" * 5000, passage + " " + long[2], long[3] + " " + passage, "a b c d e f g h i j " * 30]
    return out + ["mail joe@x.com or +1 (521) 555-6210, 4111 1111 1111 1111 at 10.0.0.1 and 1.2.3.999"]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, "en", ("s%d" % (i % 3)) if i % 7 else None, 0) for i, t in enumerate(texts())]
    data.append(data[5])  # a repeated row
    return spark.createDataFrame(data, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SMALL)) == sql_rows(duck, queries.SQL[name])


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(data)
    groups = {}
    for i, t in data:
        groups.setdefault(norm(t), []).append(i)
    for r in got:
        g = next(v for v in groups.values() if r.doc_id in v)
        assert (r.keep_id, r.group_size) == (min(g), len(g))
    kept = exact_dedup.deduplicate(docs.withColumnRenamed("lang", "sha"))  # a column named like one used inside
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values()) == sorted(r.doc_id for r in got if r.kept)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.deduplicate(empty).columns == empty.columns


def test_filter_flags_every_repeated_hash(spark):
    shas = spark.range(3000).selectExpr("sha2(cast(id % 2000 as string), 256) as sha")
    words_ = exact_dedup.filter_words(3000)
    flag = exact_dedup.flagged(shas, exact_dedup.repeated_filter(shas, words_), words_)
    twice = {r.sha for r in shas.groupBy("sha").count().where("count > 1").collect()}
    assert twice <= {r.sha for r in flag.where("maybe").collect()} and flag.count() == 3000


def test_mixing(docs, empty):
    sizes = mixing.document_sizes(docs)
    plan = {r.source: r for r in mixing.mixture_plan(sizes).collect()}
    by = Counter()
    for r in docs.collect():
        by[r.source] += len(words(r.text))
    order = sorted(s for s in by if s is not None) + ([None] if None in by else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, total, target = set(order), sum(by.values()), {}
    while True:
        share = {s: total * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * by[s]
            total -= 3 * by[s]
        open_ -= over
    assert {s: plan[s].target for s in order} == pytest.approx(target)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and rows(mixed) == rows(mixing.mix(docs))
    biggest = max(len(words(t)) for t in texts())
    took = Counter()
    for r in mixed.collect():
        took[r.source] += len(words(r.text))
    assert all(abs(took[s] - target[s]) <= biggest for s in order)
    assert mixing.mix(empty).count() == 0


def brute_components(data, k=4, num=85, den=100):
    sets = {}
    for i, t in data:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_ngram_join(docs, empty):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components(data)
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(data) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_chains_and_tiles(spark):
    rnd = random.Random(2)
    base = ["b%d" % i for i in range(150)]
    data, doc = [], list(base)
    for i in range(30):  # each differs from the one before by a word: a chain of links
        doc = list(doc)
        doc[rnd.randrange(150)] = "c%d" % i
        data.append((i, " ".join(doc)))
    data += [(100 + i, " ".join("r%d" % rnd.randrange(5) for _ in range(n))) for i, n in enumerate([4, 5, 6, 7, 8, 9, 10, 12, 15, 20] * 4)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_components(data)
    for tile in (2048, 8):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame, tile=tile).collect()} == want


def test_every_linked_pair_shares_a_part():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 5, 8, 13, 40, 100, 300, 900):
        for _ in range(30):
            a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
            drop = rnd.integers(0, int(0.15 * len(a)) + 1)
            add = rnd.integers(0, max(1, int((len(a) - drop) / 0.85) - len(a) + 1))
            b = np.unique(np.concatenate([rnd.permutation(a)[drop:], rnd.integers(0, 2**63, add, dtype=np.uint64)]))
            same = len(np.intersect1d(a, b))
            if not len(b) or 100 * same < 85 * (len(a) + len(b) - same):
                continue
            h, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            own = ngram_join.band(np.diff(bounds), 85, 100)
            keys = [set(), set()]
            for up in (0, 1):
                owner, key = ngram_join.part_keys(h, bounds, own, up, 85, 100)
                for o, x in zip(owner.tolist(), key.tolist(), strict=True):
                    keys[o].add(x)
            assert keys[0] & keys[1]


def test_lm_block_counts_merge_as_parts_come():
    """Peak memory of a block's counts follows its distinct keys: parts that repeat don't add up."""
    import tracemalloc

    rnd = np.random.default_rng(7)
    text = b" ".join(b"w%d" % i for i in rnd.integers(0, 10**6, 60_000))
    peak = []
    for copies in (4, 16):
        x = lm_score.stream([text] * copies)
        tracemalloc.start()
        found = lm_score.stream_counts(x)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found[lm_score.WORDS][1].sum() == 60_000 * copies and len(found[lm_score.WORDS][0]) == len(set(text.split()))
        assert (np.diff(found[lm_score.KEYS][0].astype(object)) > 0).all() and found[lm_score.KEYS][1].sum() == copies * (len(text) + 2)
    assert peak[1] < 1.5 * peak[0]


def made_sets(rnd, n, num, den):
    """A random set of n shingles at most, and one that links with it as far as chance allows."""
    a = np.unique(rnd.integers(0, 2**64 - 1, n, dtype=np.uint64))
    drop = rnd.integers(0, (den - num) * len(a) // den + 1)
    add = rnd.integers(0, max(1, (len(a) - drop) * den // num - len(a) + 1))
    return a, np.unique(np.concatenate([rnd.permutation(a)[drop:], rnd.integers(0, 2**64 - 1, add, dtype=np.uint64)]))


def similar(a, b, num, den):
    same = len(np.intersect1d(a, b))
    return len(b) > 0 and den * same >= num * (len(a) + len(b) - same)


def keys_of(sets, num, den):
    h, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    keys = [set() for _ in sets]
    for up in (0, 1):
        owner, key = ngram_join.part_keys(h, bounds, ngram_join.band(np.diff(bounds), num, den), up, num, den)
        for o, x in zip(owner.tolist(), key.tolist(), strict=True):
            keys[o].add(x)
    return keys


def test_linked_pairs_share_a_part_and_unlike_ones_with_a_common_phrase_none():
    rnd = np.random.default_rng(5)
    for num, den in ((80, 100), (85, 100), (50, 100)):
        for n in (1, 3, 9, 30, 100, 400, 1000):
            for _ in range(20):
                a, b = made_sets(rnd, n, num, den)
                if similar(a, b, num, den):
                    x, y = keys_of([a, b], num, den)
                    assert x & y
    common = rnd.integers(0, 2**64 - 1, 10, dtype=np.uint64)
    unlike = keys_of([np.unique(np.concatenate([common, rnd.integers(0, 2**64 - 1, 900, dtype=np.uint64)])) for _ in range(40)], 80, 100)
    assert sum(bool(x & y) for i, x in enumerate(unlike) for y in unlike[:i]) < 0.02 * 40 * 39 / 2


def test_sketches_lose_no_link_and_tell_unlike_sets_apart():
    rnd = np.random.default_rng(6)
    for num, den in ((80, 100), (85, 100), (30, 100)):
        sets = [x for n in (1, 2, 5, 20, 63, 64, 65, 300, 1000, 3000) for _ in range(6) for x in made_sets(rnd, n, num, den) if len(x)]
        sketch = ngram_join.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])).to_pylist()
        root = ngram_join.alike(np.array([len(x) for x in sets]), sketch, num, den)
        assert all(root[i] == root[j] for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if similar(a, b, num, den))
    apart = [np.unique(rnd.integers(0, 2**64 - 1, 500, dtype=np.uint64)) for _ in range(50)]
    sketch = ngram_join.sketches(np.concatenate(apart), np.arange(51) * 500).to_pylist()
    assert sum(map(len, sketch)) * 32 <= 50 * 500 * 8 * 2 and ngram_join.alike(np.full(50, 500), sketch, 80, 100) == list(range(50))
    assert ngram_join.sketches(np.array([], np.uint64), np.array([0, 0])).null_count == 1


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.packed(docs.dropDuplicates(["doc_id"]), with_ids=True).toPandas()
    for doc, text in {r.doc_id: r.text for r in docs.collect()}.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        part = got[got.doc_id == doc].sort_values("start")
        assert np.concatenate(part.ids.tolist()).tolist() == ids.tolist() and (part.doc_tokens == len(ids)).all()
        assert part.start.tolist() == np.cumsum([0, *part.length])[:-1].tolist()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist()
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == np.cumsum([0, *seq.length])[:-1].tolist() and seq.length.sum() <= packing.CAPACITY
    assert packing.packed(empty).count() == 0


def test_differencing_balances_and_keeps_every_item():
    rnd = np.random.default_rng(1)
    for n, k in ((1, 1), (5, 3), (40, 7), (300, 40), (3, 9)):
        sizes = rnd.integers(1, 500, n)
        windows = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(n)) and len(windows) <= k
    sizes = rnd.integers(1, 100, 400)
    sums = [sizes[w].sum() for w in packing.differencing(sizes, 20)]
    assert max(sums) - min(sums) <= 5


def test_quality_base_rules(spark, docs, empty):
    got = {r.doc_id: r for r in quality.judged(docs, None).collect()}
    for i, t in {r.doc_id: r.text or "" for r in docs.collect()}.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {p for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and r.kept == (not r.base_failed)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None and quality.judged(empty, None).count() == 0


def test_quality_held_out_accuracy(spark):
    rnd = random.Random(1)
    good = lambda: " ".join(rnd.choice(["river", "stone", "walked", "quiet", "evening", "letter"]) for _ in range(60))
    bad = lambda: " ".join(rnd.choice(["BUY!!", "WIN$$$", "CLICK***", "FREE###"]) for _ in range(60))
    data = [(i, good() if i % 2 else bad()) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    held = {r.doc_id: r.probability for r in quality.judged(docs, model).where("doc_id >= 80").collect()}
    assert all((p >= quality.MIN_PROBABILITY) == bool(i % 2) for i, p in held.items())


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base_spans(spark, empty):
    rnd = random.Random(3)
    hard = ["a@b.c_d@e.f x@y x@y.z. a@b..c", "1.2.3.4.5.6.7.8 1.2.3.256 01.02.003.0004 😀 é 9.9.9.9", "4111 1111 1111 1111 4111-1111-1111-1111-4111 5 -6", "+1 (521) 555-6210+1 (521) 555-6210 +1 +12 3", None, "", "😀 a@b.co " * 150]
    hard += ["".join(rnd.choice("01 .-+@ab()5") for _ in range(300)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(frame).collect()}
    for i, t in enumerate(hard):
        assert sorted((x.s, x.k, x.e) for x in got[i].found) == base_spans(t or ""), t
        assert all(not (a.s < b.e and b.s < a.e) for a in got[i].added for b in got[i].found)
    assert pii.detect(empty).count() == 0


def test_pii_adds_secrets_and_leaves_prose_alone(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    data = [(i, f"some words then token = \"{h}\" and more words") for i, h in enumerate(hexes)] + [(100 + i, "plain words without any of it " * 5) for i in range(60)]
    data += [(200 + i, f"write to me{i}@mail.example.com today") for i in range(60)]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(len(got[i].added) == 1 for i in range(60)) and all(not got[100 + i].added and not got[100 + i].found for i in range(60))


def test_lm_scoring(docs, empty):
    got = lm_score.scored(docs).collect()
    data = [(r.doc_id, words(r.text and r.text.translate({c: c + 32 for c in range(65, 91)}))) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts, ends = Counter(), 0
    for i, w in data:
        if not held(i):
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    for i, w in data:
        r = next(x for x in got if x.doc_id == i)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(sum(base(counts[x]) for x in w) + base(ends))
    assert lm_score.scored(empty).count() == 0


def test_lm_scoring_predicts_over_word_bounds(spark, docs, empty):
    """The query's model against one by dictionaries over each document's byte stream."""
    order = lm_score.ORDER
    stream = lambda t: b"\0" * order + b" " + b"".join(w + b" " for w in words(t and t.translate({c: c + 32 for c in range(65, 91)}))) + b"\n"
    data = [(r.doc_id, stream(r.text)) for r in docs.collect()]
    model = {}
    for i, s in data:
        for at in range(order + 1, len(s)) if zlib.crc32(str(i).encode()) % 5 != 1 else []:
            for k in range(order + 1):
                model.setdefault(s[at - k : at], Counter())[s[at]] += 1
    want = {}
    for i, s in data:
        want[i] = 0.0
        for at in range(order + 1, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                seen = {x: c for x, c in model.get(s[at - k : at], {}).items() if x not in gone}
                if s[at] in seen:
                    want[i] += math.log10(seen[s[at]] / (sum(seen.values()) + len(seen)))
                    break
                if seen:
                    want[i] += math.log10(len(seen) / (sum(seen.values()) + len(seen)))
                gone |= set(seen)
            else:
                want[i] -= math.log10(lm_score.SYMBOLS - len(gone))
    got = lm_score.scored(docs).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-6)
    rnd = random.Random(3)
    fluent = " ".join(["the quick brown fox jumps over the lazy dog"] * 20)
    salad = fluent.split()
    rnd.shuffle(salad)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    mixed = [(i, fluent) for i in range(5) if i not in held] + [(held[0], fluent), (held[1], " ".join(salad))]
    score = {r.doc_id: r.score for r in lm_score.scored(spark.createDataFrame(mixed, "doc_id long, text string")).collect()}
    assert score[held[0]] > score[held[1]] + 10
    assert lm_score.scored(empty).count() == 0


def test_word_hashes_depend_on_the_word_alone():
    rnd = random.Random(2)
    words_ = [bytes(rnd.choices(b"abcdefgh\xc3\xa9", k=n)) for n in [1, 2, 3, 31, 32, 33, 64, 1000, 70_000, 200_000] * 2]
    one = lm_score.word_keys(lm_score.stream([b" ".join(words_)]))[0].tolist()
    assert one == [lm_score.word_keys(lm_score.stream([b"\t", w, b"x" * 50]))[0].tolist()[0] for w in words_]
    assert len(set(one)) == len(set(words_))


def test_packed_numbers_round_trip():
    for x in (np.array([], np.uint64), np.sort(np.array([3, 1 << 60, 7], np.uint64)), np.array([5, 0, 70000], np.uint32), np.array([-1.5, 0], np.float32)):
        assert lm_score.unpacked(lm_score.packed(x), len(x), x.dtype.type).tolist() == x.tolist()


def test_substring_dedup(spark, docs, empty):
    got = {(r.doc_id, r.ref_doc_id): r for r in substring_dedup.repeated_passages(docs).collect()}
    assert (16, 15) in got and got[16, 15].n_equal == 60 and (7, 4) in got and (8, 4) in got
    assert all(r.end - r.start >= 50 and r.similarity >= 0.8 for r in got.values())
    rnd = random.Random(8)
    fresh = lambda n: ["u%d" % rnd.randrange(10**9) for _ in range(n)]
    passage = fresh(80)
    fuzzy = list(passage)
    fuzzy[20], fuzzy[55] = "x", "y"
    del fuzzy[38]
    data = [(1, " ".join(fresh(50) + passage + fresh(50))), (2, " ".join(fresh(30) + fuzzy + fresh(90))), (3, " ".join(fresh(300)))]
    out = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.ref_doc_id) for r in out] == [(2, 1)] and out[0].n_equal == 77 and (out[0].start, out[0].end) == (30, 109)
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_substring_dedup_passage_whose_pieces_are_in_earlier_documents(spark):
    rnd = random.Random(9)
    fresh = lambda n: ["u%d" % rnd.randrange(10**9) for _ in range(n)]
    passage, inside = fresh(60), fresh(70)
    pieces = [passage[a : a + 18] for a in range(0, 60, 14)]
    scattered = [w for p in pieces for w in [*p, *fresh(60)]]
    again = [w for a in range(0, 70, 14) for w in [*inside[a : a + 18], *fresh(60)]]
    data = [(1, scattered), *((2 + i, fresh(40) + p + fresh(40)) for i, p in enumerate(pieces)), (20, fresh(30) + passage + fresh(50)), (21, fresh(70) + passage + fresh(10)), (30, again + inside + fresh(20)), (31, fresh(15) + inside + fresh(25))]
    data += [(40, fresh(9) * 30), (41, fresh(60))]
    data.append((42, data[-2][1]))
    out = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string")).collect()
    got = {(r.doc_id, r.ref_doc_id): (r.start, r.end, r.ref_start, r.ref_end) for r in out}
    assert got[21, 20] == (70, 130, 30, 90) and got[31, 30] == (15, 85, len(again), len(again) + 70)
    held = {w for r in out if r.doc_id == 42 for w in range(r.start, r.end)}
    assert {k for k in got} == {(21, 20), (31, 30), (42, 40)} and held == set(range(270))


@pytest.mark.parametrize("size", [60, 100])
def test_substring_dedup_finds_spread_edits(spark, size):
    """Against brute force: the best ungapped alignment of every two documents."""
    rnd = random.Random(size)
    fresh = lambda n: ["u%d" % rnd.randrange(10**9) for _ in range(n)]
    data = {}
    for i in range(40):
        passage = fresh(size)
        every = 5 + i % 8  # one word of so many is another one: similarity 0.80 to 0.92
        copy = [fresh(1)[0] if a % every == every - 1 else w for a, w in enumerate(passage)]
        if i % 4 == 3:  # the same share at random places
            at = set(rnd.sample(range(1, size - 1), size // every))
            copy = [fresh(1)[0] if a in at else w for a, w in enumerate(passage)]
        data[2 * i], data[2 * i + 1] = fresh(20 + i) + passage + fresh(30), fresh(35) + copy + fresh(15)
    want = set()
    for a in data:
        for b in (x for x in data if x < a):
            for shift in range(-60, 61):
                same = np.array([x == y for x, y in zip(data[a][max(0, shift) :], data[b][max(0, -shift) :], strict=False)])
                ends = np.concatenate([[0], np.cumsum(same)])
                if same.sum() >= 40 and any((ends[n:] - ends[:-n] >= 0.8 * n).any() for n in range(50, len(same) + 1)):
                    want.add((a, b))
    got = {(r.doc_id, r.ref_doc_id) for r in substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in data.items()], "doc_id long, text string")).collect()}
    assert len(want) == 40 and got == want


def test_components_of_few_edges_take_no_rounds(spark):
    rnd = random.Random(12)
    for n, m in ((1, 1), (40, 25), (300, 260), (300, 900)):
        edges = [(rnd.randrange(n) - n // 2, rnd.randrange(n) - n // 2) for _ in range(m)] + [(i + 1000, i + 1001) for i in range(50)] + [(None, 3), (4, None)]
        df = spark.createDataFrame(edges, "a long, b long").repartition(3)
        one, many = common.components(df), common.components(df, few=0)
        assert rows(one) == rows(many) and "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert common.components(df.limit(0)).count() == 0


def test_quality_holds_the_features_of_one_fit(spark, monkeypatch):
    """The rows of the first fit, then those that were held out, then all."""
    held, plain = [], np.zeros
    monkeypatch.setattr(quality.np, "zeros", lambda shape, *a: held.append(weakref.ref(x := plain(shape, *a))) or x if isinstance(shape, tuple) else plain(shape, *a))
    alive, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: alive.append(sum(len(r()) for r in held if r() is not None)) or fit(x, y))
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "buy now cheap ") * (i + 1)) for i in range(40)], "doc_id long, text string")
    quality.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert alive == [32, 40]


def test_chains_follow_the_order_of_both_sides():
    pos, ref = np.array([0, 10, 20, 30, 5]), np.array([100, 110, 50, 130, 300])
    assert substring_dedup.chains(pos, ref)[0] == [0, 1, 3]


def test_warc(spark, tmp_path):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 20000, "<p>é</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(3, "http://h/3", "<p>é</p>")], "page_id long, url string, html string")
    out = f"file://{tmp_path}/warc"
    manifest = warc.write(pages, out, roll_bytes=300, shard_bytes=8000)
    assert manifest.count() > 1
    got = warc.read(spark, out).collect()
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    assert len(got) == 7
    for r in got:
        payload = (html[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html[r.page_id] or ""] == r.page_id else ("revisit", first[html[r.page_id] or ""]))
    again = warc.write(pages.repartition(5), f"file://{tmp_path}/again", roll_bytes=300, shard_bytes=8000)
    assert rows(again) == rows(manifest)
    import gzip

    raw = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "warc").glob("*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\n") == 7 and not list((tmp_path / "warc").glob("_temporary*"))
    assert warc.write(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "message", "a", "user", "hi"), (1, 2, "message", "b", "assistant", ""), (1, 3, "delta", "b", None, "wro"), (1, 4, "delta", "b", None, "ng"),
        (1, 5, "message", "c", "user", "branch"), (1, 6, "regenerate", "b", None, ""), (1, 7, "delta", "b", None, "right"), (1, 8, "edit", "a", None, "hello"),
        (1, 9, "message", "d", "user", "gone"), (1, 10, "delete", "d", None, None), (2, 1, "message", "a", None, None),
    ]
    got = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, op string, message_id string, role string, text string"))
    assert [(r.conv_id, r.role, r.text) for r in got.orderBy("conv_id", "position").collect()] == [(1, "user", "hello"), (1, "assistant", "right"), (2, None, "")]


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|start|>user<|body|>x<|end|>\n", "<\\|start|>", "<\\\\|", "[\\INST] <s> <<SYS>> <</SYS>>", "", None, "\\", "😀é" * 100]
    m = spark.createDataFrame([(i % 3, i, ("user", "assistant", "<|end|>")[i % 3 if i < 8 else 1], t) for i, t in enumerate(hard)], "conv_id long, position long, role string, text string")
    for part_chars in (1 << 20, 40):
        got = {r.conv_id: r for r in chat.read_back(chat.formatted(m, part_chars)).collect()}
        for conv in range(3):
            turns = [(r.role, r.text or "") for r in m.orderBy("position").collect() if r.conv_id == conv]
            told = "".join(t for r, t in turns if r == "assistant")
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(told), hashlib.sha256(told.encode()).hexdigest())


def test_queries_run_on_the_small_tables(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op2_pii", "op5_lm_scoring", "op7_packing", "op10_quality_rules"):
        assert queries.QUERIES[name](spark, SMALL).select("doc_id").distinct().count() == n
