"""N-gram Jaccard join: equal parts of sets, parity sketches in size-banded tiles, exact sorted-array intersection, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MIX, Tokens, arrow_schema, clustered, components, materialize, mixed, possibly_in, released, slices, streamed_groups, table, text_column, windows

SHINGLE = 4
SIMILARITY = (85, 100)
#: Documents of a cluster that one task compares. Larger clusters are dealt into tiles of TILES times as many documents, and
#: of at most so many shingles for each of these; a task holds two tiles (64 MB of shingles at most, but for one set).
TILE, TILES = 2048, 4
SHINGLES = 2048
#: The same limit for tiles of sketches, which take a 32nd of the shingles' bytes at most.
SKETCHED = 32 * SHINGLES
#: Tables of one row a large cluster, or a size band of one, are broadcast up to this number of rows (24 bytes each).
BROADCAST_CLUSTERS = 50_000
#: 64-bit words of a bitmap signature.
SIGNATURE = 16


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text (lower-cased A-Z) as sorted 64-bit hashes, and the texts' bounds."""
    tokens = Tokens(col, lower=True)
    h, bounds = windows(tokens.hashes(), tokens.first, k)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(bounds) - 1))])


def band(n, num: int, den: int):
    """Size band of sets of n shingles: sizes of linked sets are in the same or neighbouring bands."""
    step = math.log(den / num) if num < den else 1.0
    return np.floor(np.log(np.maximum(n, 1)) / step + 1e-9).astype(np.int64)


def parts_of(interval: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, slack) of an interval: the band of that number and the one below it.

    Linked sets a, b differ in at most d = (den - num) / (den + num) * (|a| + |b|) shingles. Hash ranges cut all shingles
    into k = d + 1 + slack parts; at least 1 + slack parts hold the same shingles in both sets, so unless more than slack
    parts of both are empty, both have one equal part that isn't.
    """
    step = math.log(den / num) if num < den else 1.0
    top = np.ceil(np.exp((interval + 1) * step) + 1e-6)
    most = np.floor((den - num) / (den + num) * 2 * top + 1e-9).astype(np.int64)
    slack = 5 + most // 6 + top.astype(np.int64) // 128
    return most + 1 + slack, slack


def part_keys(h: np.ndarray, bounds: np.ndarray, own: np.ndarray, up: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the parts of each set in the interval own + up: equal keys mean equal parts (of an equal interval).

    A set of n shingles differs from a linked one in at most d = n * (den - num) / num, so one of any d + 1 of its parts is
    in both. Each set gives its d + 1 largest (ties in order of the key, the same in both sets): of two linked sets, take the
    one whose least given part is larger; the other gives all that large. Small parts are what unlike texts share by
    common phrases. Sets with more empty parts than the slack give all.
    """
    n = np.diff(bounds)
    interval = own + up
    k, slack = parts_of(interval, num, den)
    owner = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        part = ((h >> np.uint64(32)) * k.astype(np.uint64)[owner]) >> np.uint64(32)  # in the order of h: parts are runs
        run = np.ones(len(h), bool)
        run[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(run)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.add.reduceat(mixed(h + np.uint64(0x51)), at)
        size = np.minimum(np.diff(at, append=len(h)), 63).astype(np.uint64)
        owner, part = owner[at], part[at]
        key = mixed(total + mixed(part + (interval[owner].astype(np.uint64) << np.uint64(32))))
        # sets with more empty parts than the slack: their empty parts may be all that they share with another such set
        have = np.bincount(owner, minlength=len(n))
        empty = k - have
        given = np.where(empty > slack, have, np.minimum(have, 1 + np.minimum(k - 1 - slack, n * (den - num) // num)))
        place = (owner.astype(np.uint64) << np.uint64(40)) | ((np.uint64(63) - size) << np.uint64(34)) | (key >> np.uint64(30))
        last = np.sort(place)[np.maximum(np.cumsum(have) - have + given - 1, 0).clip(max=len(place) - 1)]
        keep = place <= last[owner]
        extra_owner, extra_key = [], []
        for i in np.flatnonzero((empty > slack) & (n > 0)):
            a, b = np.searchsorted(owner, [i, i + 1])  # before any part is left out
            free = np.setdiff1d(np.arange(k[i]), part[a:b].astype(np.int64)).astype(np.uint64)
            extra_owner.append(np.full(len(free), i))
            extra_key.append(mixed(np.uint64(0xE) + mixed(free + (np.uint64(interval[i]) << np.uint64(32)))))
    return np.concatenate([owner[keep], *extra_owner]), np.concatenate([key[keep], *extra_key]).view(np.int64)


def sketches(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A parity sketch of each set, null for empty ones: one bit for every shingle or more, each the parity of the shingles
    that hash to it. The sketches of two sets differ in at most as many bits as the sets in shingles; the halves of a
    sketch, xor-ed, are the sketch of half as many bits."""
    n = np.diff(bounds)
    bits = np.maximum(64, np.int64(1) << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bits // 64, 0))])
    out = np.zeros(ends[-1], np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    at = (mixed(h ^ MIX) >> np.uint64(20)) & (bits - 1).astype(np.uint64)[owner]
    np.bitwise_xor.at(out, ends[owner] + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    valid = pa.py_buffer(np.packbits(n > 0, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(n), [valid, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(out)])


def folded(sketch: bytes, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, words), axis=0)


def alike(n: np.ndarray, sketch: list[bytes], num: int, den: int) -> list[int]:
    """For each set of n shingles the first set of its component, by links that the sketches don't rule out."""
    order = np.argsort(n, kind="stable")
    size = n[order].astype(np.int64)
    words = np.array([len(sketch[i]) // 8 for i in order])  # ascending, as sizes are
    root = np.arange(len(n))
    for w in np.unique(words).tolist():
        lo, hi = np.searchsorted(words, [w, w + 1]).tolist()
        top = int(np.searchsorted(size, size[hi - 1] * den // num, side="right"))
        rows = np.stack([folded(sketch[order[i]], w) for i in range(lo, top)])
        for i in range(lo, hi):
            end = int(np.searchsorted(size, size[i] * den // num, side="right"))
            others = np.flatnonzero(root[i + 1 : end] != root[i])
            if not len(others):
                continue
            some = rows[i + 1 - lo : end - lo]
            some = some if len(others) == len(some) else some[others]
            others = others + i + 1
            apart = np.bitwise_count(some ^ rows[i - lo]).sum(axis=1, dtype=np.int64)
            near = others[(den + num) * apart <= (den - num) * (size[others] + size[i])]
            if len(near):
                joined = np.append(np.unique(root[near]), root[i])
                root[np.isin(root, joined)] = joined.min()
    out = np.empty(len(n), np.int64)
    out[order] = order[root]
    return out.tolist()


def candidate_edges(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, n, sketch): rows with n >= 0 carry the set size and the sketch of document a; the others join documents that
    share a part.

    One pass over the texts. A task sends the parts of each different set that it meets once, under the first document
    with that set, and joins the others to it. Part rows are dealt by key and sorted; the first document of a key is
    joined with each other one, so a key of m documents makes m - 1 rows and is streamed, never held.
    """
    ddl = "key long, doc long, other long, n int, sketch binary"
    _, schema = arrow_schema(ddl)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple, int] = {}
        for batch in batches:
            col, ids = text_column(batch), batch.column(batch.schema.get_field_index("doc_id"))
            for a, some in slices(col):
                h, bounds = shingle_sets(some, k)
                n = np.diff(bounds)
                doc = ids.slice(a, len(some)).to_numpy(zero_copy_only=False)
                valid = ~np.asarray(ids.slice(a, len(some)).is_null())
                yield pa.RecordBatch.from_arrays([pa.array(mixed(np.arange(len(n), dtype=np.uint64) + n.astype(np.uint64)).view(np.int64)), ids.slice(a, len(some)), pa.nulls(len(n), pa.int64()), pa.array(n.astype(np.int32)), sketches(h, bounds)], schema=schema)
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                full = np.flatnonzero(n)
                with np.errstate(over="ignore"):
                    if len(full):
                        one[full], two[full] = np.add.reduceat(mixed(h), bounds[full]), np.bitwise_xor.reduceat(mixed(h + np.uint64(7)), bounds[full])
                lead, links = np.zeros(len(n), bool), []
                for i in full:
                    if valid[i]:
                        first = met.setdefault((int(n[i]), int(one[i]), int(two[i])), int(doc[i]))
                        if first == doc[i]:
                            lead[i] = True
                        else:
                            links.append((first, int(doc[i])))
                if links:
                    x, y = np.array(links).T
                    yield pa.RecordBatch.from_arrays([pa.array(mixed(y.astype(np.uint64)).view(np.int64)), pa.array(y), pa.array(x), pa.array(np.full(len(x), -2, np.int32)), pa.nulls(len(x), pa.binary())], schema=schema)
                pick = np.flatnonzero(lead)
                if not len(pick):
                    continue
                sub = np.concatenate([[0], np.cumsum(n[pick])])
                hh = h[np.repeat(bounds[pick] - sub[:-1], n[pick]) + np.arange(sub[-1])]
                own = band(n[pick], num, den)
                for up in (0, 1):
                    owner, key = part_keys(hh, sub, own, up, num, den)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[pick][owner].astype(np.int64)), pa.nulls(len(key), pa.int64()), pa.array(np.full(len(key), -1, np.int32)), pa.nulls(len(key), pa.binary())], schema=schema)

    out_ddl = "a long, b long, n int, sketch binary"
    _, out_schema = arrow_schema(out_ddl)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_doc = None, None
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            key, doc, _, n, _ = batch.columns
            kind = n.to_numpy()
            passed = kind != -1
            if passed.any():
                rows = batch.filter(pa.array(passed))
                yield pa.RecordBatch.from_arrays(rows.columns[1:], schema=out_schema)
            part = np.flatnonzero(~passed)
            if not len(part):
                continue
            key, doc = key.to_numpy()[part], doc.to_numpy(zero_copy_only=False)[part].astype(np.int64)
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            leader = doc[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
            if last_key is not None and key[0] == last_key:
                leader[: np.argmax(start[1:]) + 1 if start[1:].any() else len(key)] = last_doc
            last_key, last_doc = key[-1], leader[-1]
            pairs = {(x, y) for x, y in zip(leader[leader != doc].tolist(), doc[leader != doc].tolist(), strict=True)} - sent
            if len(sent) > 1_000_000:
                sent.clear()
            sent |= pairs
            if pairs:
                x, y = np.array(sorted(pairs)).T
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(x), pa.array(np.full(len(x), -1, np.int32)), pa.nulls(len(x), pa.binary())], schema=out_schema)

    rows = docs.select("doc_id", "text").mapInArrow(lambda it: released(sign(it)), ddl)
    return materialize(clustered(rows, ["key"], ["n", "doc"]).mapInArrow(lambda it: released(meet(it)), out_ddl), "shared-parts")


def tiles(members: DataFrame, tile: int, num: int, den: int, shingles: int = SHINGLES) -> DataFrame:
    """members(doc, cluster, n) with the tasks that compare them: t, a struct.

    A cluster of up to tile documents is one task. In larger ones a size band is dealt into tiles by a hash of the id, as few
    as its shingles allow, since a set travels once for each tile that it is compared with;
    tasks are pairs of tiles of a band or of neighbouring bands, all others are too different in size to link.
    """
    step = math.log(den / num) if num < den else 1.0
    members = members.withColumn("band", F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / step + 1e-9))
    large_ones = materialize(members.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") > tile).select("cluster"), "large-clusters")
    # one row for each tile of documents at most: broadcast while few, so that no cluster's rows meet in one task
    few = large_ones.count() <= BROADCAST_CLUSTERS
    large_ones = F.broadcast(large_ones) if few else large_ones
    whole = members.join(large_ones, "cluster", "left_anti").withColumn("t", F.struct(F.lit(-1).cast("long").alias("lo"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    large = members.join(large_ones, "cluster")
    per = large.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count("*") / (TILES * tile), F.sum("n") / (shingles * tile))).cast("int").alias("here"))
    w = Window.partitionBy("cluster").orderBy("band")
    beside = lambda f: F.when(F.abs(f("band", 1).over(w) - F.col("band")) == 1, f("here", 1).over(w)).otherwise(0)
    per = per.withColumn("above", beside(F.lead)).withColumn("below", beside(F.lag))
    per = materialize(per, "bands")
    per = F.broadcast(per) if few and per.count() <= BROADCAST_CLUSTERS else per
    dealt = large.join(per, ["cluster", "band"]).withColumn("s", F.pmod(F.xxhash64("doc"), F.col("here")).cast("int"))
    task = lambda lo, i, j: F.struct(lo.cast("long").alias("lo"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(upto(F.col("here")), lambda o: task(F.col("band") * 2, F.least("s", o), F.greatest("s", o)))
    over = F.transform(upto(F.col("above")), lambda o: task(F.col("band") * 2 + 1, F.col("s"), o))
    under = F.transform(upto(F.col("below")), lambda o: task(F.col("band") * 2 - 1, o, F.col("s")))
    dealt = dealt.withColumn("t", F.explode(F.concat(same, over, under)))
    return whole.select("doc", "cluster", "n", "t").unionByName(dealt.select("doc", "cluster", "n", "t"))


def linked(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the first set of its component, by links with den * |a & b| >= num * |a | b|; sets by size.

    Sets that are in one component already aren't compared again. For the others, bitmaps first: they differ in at least
    the bits in which the bitmaps differ, which bounds the intersection from above; then the exact intersection.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    bits = np.zeros((len(sets), SIGNATURE), np.uint64)
    for i, s in enumerate(sets):
        b = (mixed(s) >> np.uint64(20)) % np.uint64(64 * SIGNATURE)
        np.bitwise_or.at(bits[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
    bits, size = bits[order], n[order]
    root = np.arange(len(sets))
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(size, size[i] * den // num, side="right"))
        others = np.arange(i + 1, end)
        others = others[root[others] != root[i]]
        if not len(others):
            continue
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        total = size[others] + size[i]
        most = (total - apart) // 2
        for j in others[most * (den + num) >= num * total]:
            if root[j] == root[i]:
                continue
            a, b = sets[order[i]], sets[order[j]]
            at = np.searchsorted(b, a)
            same = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
            if den * same >= num * (len(a) + len(b) - same):
                lo, hi = sorted((root[i], root[j]))
                root[root == hi] = lo
    out = np.empty(len(sets), np.int64)
    out[order] = order[root]
    return out.tolist()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for docs(doc_id, text): components of links of Jaccard similarity num / den at least.

    Exact: no link between different sets is lost (see part_keys). Documents that share a part, directly or over others,
    form clusters. Inside these, sketches are compared in tiles, which tells most documents of a cluster apart without
    their sets; what sketches can't tell apart forms the clusters whose sets are compared, in tiles again. Null or empty texts have no shingles and link with nothing. Rows
    that share a doc_id are one document for linking; a row without doc_id links with nothing and its component is null.
    An empty table has no rows; other columns are ignored, whatever their names.
    """
    num, den = similarity
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = candidate_edges(docs, shingle, num, den)
    clusters = components(met.where("n < 0 and b is not null"))
    members = met.where("n > 0").select(F.col("a").alias("doc"), "n").groupBy("doc").agg(F.max("n").alias("n")).join(clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), "doc")
    sketched = tiles(members, tile, num, den, SKETCHED).select("doc", F.col("cluster").alias("c"), "t.lo", "t.i", "t.j")
    sketched = sketched.join(met.where("n > 0").select(F.col("a").alias("doc"), "n", "sketch"), "doc").select("c", "lo", "i", "j", "doc", "n", "sketch")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed_groups(batches, ["c", "lo", "i", "j"]):
            doc = group["doc"].to_pylist()
            root = alike(group["n"].to_numpy(), group["sketch"].to_pylist(), num, den)
            pairs = [(d, doc[r]) for d, r in zip(doc, root, strict=True) if doc[r] != d]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    closer = components(clustered(sketched, ["c", "lo", "i", "j"], ["doc"]).mapInArrow(lambda it: released(tell(it)), "a long, b long"))
    members = members.drop("cluster").join(closer.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), "doc")
    dealt = materialize(tiles(members, tile, num, den), "tiles")

    ddl = "c long, lo long, i int, j int, doc long, h binary"
    _, schema = arrow_schema(ddl)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, some in slices(text_column(batch)):
                h, bounds = shingle_sets(some, shingle)
                hs = pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(some))], pa.binary())
                part = batch.slice(a, len(some))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f)) for f in schema.names[:-1]), hs], schema=schema)

    texts = possibly_in(docs, "doc_id", dealt.select(F.col("doc").alias("doc_id"))).join(dealt.withColumnRenamed("doc", "doc_id"), "doc_id")
    rows = texts.select("text", F.col("cluster").alias("c"), "t.lo", "t.i", "t.j", F.col("doc_id").alias("doc")).mapInArrow(lambda it: released(sets(it)), ddl)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed_groups(batches, ["c", "lo", "i", "j"]):
            doc = group["doc"].to_pylist()
            root = linked([np.frombuffer(x, np.uint64) for x in group["h"].to_pylist()], num, den)
            pairs = [(d, doc[r]) for d, r in zip(doc, root, strict=True) if doc[r] != d]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = clustered(rows, ["c", "lo", "i", "j"], ["doc"]).mapInArrow(lambda it: released(compare(it)), "a long, b long")
    found = components(links)
    sizes = met.where("n >= 0").select(F.col("a").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"))
    return sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id. Null and empty texts, rows without doc_id and rows
    that repeat all stay; an empty table stays empty; other columns pass, whatever their names."""
    dropped = near_duplicates(docs, shingle, similarity).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
