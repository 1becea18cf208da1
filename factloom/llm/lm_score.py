"""LM scoring: a byte-context model by partial matching (PPM), with escape estimation and symbol exclusion.

A text is a space, its lower-cased words, each followed by a space, then an end. The model predicts each byte behind the
first space from the ORDER bytes before it, over the bounds of words; zero bytes stand before a document.

Documents are read once, in blocks. What tasks exchange are each block's distinct contexts with their symbols, sorted and
compressed, dealt into buckets by the last DEALT_BY bytes of the context: a bucket has every order from there up complete,
and the orders below it are one table of at most 256^DEALT_BY rows. Each block gets the code lengths of its own contexts
back, and meets its texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, arrow_schema, materialize, mixed, released, slices, table, text_column

#: Bytes of context; a context and its symbol are one 64-bit key, a byte each: the nearest byte of context highest, the
#: symbol lowest, so that sorted keys are a trie in order.
ORDER = 6
#: The symbols that aren't bytes of a word. Words hold no white space.
SPACE, END = 0x20, 0x0A
SYMBOLS = 257 - 6 + 1  # bytes without white space, the space and the end
#: Bytes of text of a block of documents, one at least, and of the parts of it that are counted, or scored, at once.
BLOCK_BYTES = 20_000_000
STEP, SCORED_STEP = 2_000_000, 500_000
#: Context bytes by which keys are dealt, by hash, and bytes of text for each bucket of them (within bounds of their number).
DEALT_BY = 3
BUCKET_BYTES, BUCKETS = 4_000_000, (256, 16_384)
#: Keys of a row of the model, and keys that a task gathers before it sums them.
MODEL_ROW, GATHERED = 500_000, 4_000_000
#: Marks of a document's head and end while its text is cleaned: bytes that UTF-8 doesn't have.
HEAD_MARK, END_MARK = 0xFE, 0xFF
#: Kinds of rows: the counts of the low orders, of words, of contexts, and a block's texts.
LOW, WORDS, KEYS, TEXTS = range(4)


def cleaning() -> bytes:
    """A byte's successor: A-Z lower-cased, white space as a space, marks as what they stand for."""
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    out[0x09:0x0E] = SPACE
    out[HEAD_MARK], out[END_MARK] = 0, END
    return out.tobytes()


CLEANED = cleaning()
HEAD, TAIL = bytes([HEAD_MARK] * ORDER) + b" ", b" " + bytes([END_MARK])


def stream(texts: list[bytes]) -> np.ndarray:
    """The texts' bytes as the model reads them, one after the other; only a document's end is a line feed."""
    x = np.frombuffer(b"".join([HEAD, *(part for t in texts for part in (t, TAIL, HEAD))][: -1 if texts else None]).translate(CLEANED), np.uint8) if texts else np.zeros(0, np.uint8)
    space = x == SPACE
    again = np.zeros(len(x), bool)
    again[1:] = space[1:] & space[:-1]
    return x[~again]


def keys_of(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """The keys of places a to b (a is ORDER at least)."""
    out = np.empty(b - a, np.uint64)
    for i in range(a, b, 1 << 16):
        j = min(b, i + (1 << 16))
        key = x[i:j].astype(np.uint64)
        for back in range(1, ORDER + 1):
            key |= x[i - back : j - back].astype(np.uint64) << np.uint64(8 * (ORDER + 1 - back))
        out[i - a : j - a] = key
    return out


def predicted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which of the places a to b are symbols: all but a document's head."""
    end = np.flatnonzero(x[max(0, a - ORDER - 1) : b] == END) + max(0, a - ORDER - 1)
    out = np.ones(b - a, bool)
    for back in range(1, ORDER + 2):
        at = end + back
        out[at[(at >= a) & (at < b)] - a] = False
    if a <= ORDER:
        out[: ORDER + 1 - a] = False
    return out


def word_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the stream's words: 63 bits each, from sums of the bytes' own numbers times powers."""
    space = np.flatnonzero(x == SPACE)
    start = space[x[space + 1] != END] + 1 if len(space) else space
    stop = space[np.searchsorted(space, start)] if len(start) else start
    out = np.zeros(len(start), np.uint64)
    size = stop - start
    with np.errstate(over="ignore"):
        sign = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)
        live = np.arange(len(start))
        for i in range(32):
            live = live[size[live] > i]
            out[live] = mixed(out[live] * MIX + sign[x[start[live] + i]])
        for w in live[size[live] > 32].tolist():  # the rest of a long word as sums of pieces
            tail = sign[x[start[w] + 32 : stop[w]]]
            for v in np.split(tail, range(1 << 16, len(tail), 1 << 16)):
                out[w] = mixed(out[w] * MIX + (v * np.power(MIX, np.arange(len(v), dtype=np.uint64))).sum(dtype=np.uint64))
        return mixed(out + size.astype(np.uint64)) >> np.uint64(1), start


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of n."""
    if not len(keys):
        return keys, n
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[by], first, dtype=n.dtype)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs; sorts keys in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def portions(x: np.ndarray, most: int = STEP) -> Iterator[tuple[int, np.ndarray]]:
    """(documents before, stream) of whole documents of about so many bytes, one at least."""
    end = np.flatnonzero(x == END)
    a = done = 0
    while done < len(end):
        n = max(done + 1, int(np.searchsorted(end, a + most)))
        yield done, x[a : end[n - 1] + 1]
        a, done = int(end[n - 1]) + 1, n


def symbol_keys(x: np.ndarray, most: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, keys) of the symbols of a stream, so many places at a time."""
    for a in range(ORDER, len(x), most):
        b = min(len(x), a + most)
        at = np.flatnonzero(predicted(x, a, b))
        yield at + a, keys_of(x, a, b)[at]


def stream_counts(x: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and their counts of a stream, of contexts and of words. Parts are merged as they come, so a block's
    memory follows its distinct keys, not the sum of its parts'."""
    found = dict.fromkeys((KEYS, WORDS), (np.zeros(0, np.uint64), np.zeros(0, np.uint32)))

    def add(kind: int, keys: np.ndarray, n: np.ndarray) -> None:
        found[kind] = summed(*map(np.concatenate, zip(found[kind], (keys, n.astype(np.uint32)), strict=True)))

    for _, part in portions(x):
        for _, keys in symbol_keys(part):
            add(KEYS, *counted(keys))
        add(WORDS, *counted(word_keys(part)[0]))
    return found


def packed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed; sorted 64-bit ones as steps."""
    if x.dtype == np.uint64:
        x = np.diff(x, prepend=np.uint64(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, -1)
    out = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(out, dtype=np.uint64) if kind is np.uint64 else out


def bucket_of(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """Keys by the nearest DEALT_BY bytes of their context, words by their hash."""
    of = keys if kind == WORDS else keys >> np.uint64(8 * (ORDER + 1 - DEALT_BY))
    return (mixed(of * MIX) >> np.uint64(40)).astype(np.int64) % buckets


ROW = "block long, kind int, bucket int, part int, rows long, total long, seen long, keys binary, told binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("rows", pa.int64()), ("total", pa.int64()), ("seen", pa.int64()), ("keys", pa.binary()), ("told", pa.binary())])


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
    """(ids, held_out, texts) of about so many bytes of text, over the bounds of batches."""
    ids: list = []
    held: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        name = batch.schema.get_field_index
        for a, some in slices(text_column(batch), most // 4):
            some = some.cast(pa.large_binary() if pa.types.is_large_string(some.type) else pa.binary())
            n = pc.sum(pc.binary_length(some)).as_py() or 0
            if texts and size + n > most:
                yield ids, np.array(held, bool), texts
                ids, held, texts, size = [], [], [], 0
            ids += batch.column(name("doc_id")).slice(a, len(some)).to_pylist()
            held += batch.column(name("held_out")).slice(a, len(some)).to_pylist()
            texts += some.to_pylist()
            size += n
    if texts:
        yield ids, np.array(held, bool), texts


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass over docs(doc_id, text, held_out): rows of all four kinds, as ROW says. Counts are of training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for ids, held, texts in gathered(batches, BLOCK_BYTES):
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORDS: [], KEYS: []}
            streams = []
            for out in (False, True):
                x = stream([t for t, h in zip(texts, held.tolist(), strict=True) if h == out])
                for kind, (k, n) in stream_counts(x).items():
                    found[kind].append((k, np.zeros_like(n) if out else n))
                streams.append(x.tobytes())
            of_doc = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held)})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, of_doc.schema) as to:
                to.write_batch(of_doc)
            sizes = np.array([len(streams[0]), len(streams[1])], "<u8").tobytes()
            yield rows_of([(block, TEXTS, 0, 0, len(ids), int((~held).sum()), 0, sink.getvalue().to_pybytes(), sizes + pa.compress(b"".join(streams), codec="zstd", asbytes=True))])
            del streams, texts
            for kind in list(found):
                keys, n = summed(*map(np.concatenate, zip(*found.pop(kind), strict=True)))
                if kind == KEYS:
                    low, low_n = summed(suffix(keys, DEALT_BY - 1), n.astype(np.int64))
                    yield rows_of([(block, LOW, 0, 0, len(low), 0, 0, packed(low), packed(low_n.astype(np.uint32)))])
                bucket = bucket_of(keys, kind, buckets)
                by = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[by], np.arange(buckets + 1)).tolist()
                keys, n = keys[by], n[by].astype(np.uint32)
                yield rows_of([(block, kind, i, 0, b - a, 0, 0, packed(keys[a:b]), packed(n[a:b])) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a] or [(block, kind, 0, 0, 0, 0, 0, b"", b"")])
            block += 1

    return docs.select("doc_id", "text", "held_out").mapInArrow(lambda it: released(run(it)), ROW)


def suffix(keys: np.ndarray, order: int, of: int = ORDER) -> np.ndarray:
    """The symbol and the nearest bytes of its context, so many of as many as the keys have, in the lowest bits."""
    return (keys >> np.uint64(8 * (of + 1 - order))) << np.uint64(8) | keys & np.uint64(0xFF)


class Level:
    """Counts of one order: n of (context, symbol), and of each context its total and number of symbols."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int, of: int = ORDER):
        seen = n > 0
        self.order = order
        self.key, self.n = summed(suffix(keys[seen], order, of), n[seen])
        self.context, of = np.unique(self.key >> np.uint64(8), return_inverse=True)
        self.total, self.kinds = np.bincount(of, self.n, len(self.context)), np.bincount(of, minlength=len(self.context))

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def excluded_by(self, longer: Level) -> np.ndarray:
        """For each context of the longer order, the total here of the symbols that were seen there."""
        at = self.find(self.key, suffix(longer.key, self.order, longer.order))
        of = np.searchsorted(longer.context, longer.key >> np.uint64(8))
        return np.bincount(of, np.where(at >= 0, self.n[at], 0), len(longer.context))


def code_lengths(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each key's symbol after its context. levels: from the longest order to order 0.

    Escape estimation by the number of different symbols (method C); a symbol that a longer context has seen is excluded
    from the shorter ones, since it would have been coded there. Below order 0 all symbols are alike.
    """
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    gone_total, gone_kinds = np.zeros(len(keys)), np.zeros(len(keys))
    for i, level in enumerate(levels):
        cut = suffix(keys, level.order)
        context = level.find(level.context, cut >> np.uint64(8))
        hit = level.find(level.key, cut)
        live = open_ & (context >= 0)
        total = np.where(live, level.total[context] if len(level.context) else 0, 0) - gone_total
        kinds = np.where(live, level.kinds[context] if len(level.context) else 0, 0) - gone_kinds
        live &= kinds > 0.5
        said = live & (hit >= 0)
        out[said] += np.log10(level.n[hit[said]] / (total[said] + kinds[said]))
        fled = live & (hit < 0)
        out[fled] += np.log10(kinds[fled] / (total[fled] + kinds[fled]))
        open_ &= ~said
        known = open_ & (context >= 0)
        gone_kinds = np.where(known, level.kinds[context] if len(level.context) else 0, 0)
        if i + 1 < len(levels):
            gone = levels[i + 1].excluded_by(level)
            gone_total = np.where(known, gone[context] if len(gone) else 0, 0)
    out[open_] += np.log10(1 / np.maximum(1, SYMBOLS - gone_kinds[open_]))
    return out


def low_counts(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the orders below DEALT_BY over all documents, summed by tasks first: at most 256^DEALT_BY keys."""
    ddl = "key long, n long"
    _, schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                keys, n = summed(np.concatenate([keys, unpacked(r["keys"], r["rows"], np.uint64)]), np.concatenate([n, unpacked(r["told"], r["rows"], np.uint32).astype(np.int64)]))
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], schema=schema)

    low = made.where(F.col("kind") == LOW).select("rows", "keys", "told").mapInArrow(run, ddl).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    keys, n = low["key"].to_numpy().astype(np.int64).view(np.uint64), low["n"].to_numpy()
    by = np.argsort(keys)
    return keys[by], n[by]


def dealt(rows: DataFrame, keys: list[str], then: list[str], groups: int) -> DataFrame:
    """Rows of a key together and in order; as many tasks as the session says, or more for many groups, since small
    compressed rows are much work."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups)
    return rows.repartition(n, *map(F.col, keys)).sortWithinPartitions(*keys, *then)


def model(made: DataFrame, low: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """What is told of each bucket's keys, in rows as ROW says: of words their counts, of contexts the code lengths. A task
    holds one bucket's distinct keys; blocks are summed as they come."""
    low_keys, low_n = packed(low[0]), packed(low[1].astype(np.uint64))
    n_low = len(low[0])

    def told(kind: int, bucket: int, keys: np.ndarray, n: np.ndarray, lower: list) -> Iterator[pa.RecordBatch]:
        if kind == WORDS:
            value = n.astype(np.float64)
        else:
            upper = [Level(keys, n, order) for order in range(ORDER, DEALT_BY - 1, -1)]
            value = code_lengths(keys, [*upper, *lower])
        for part, a in enumerate(range(0, len(keys), MODEL_ROW)):
            k, m = keys[a : a + MODEL_ROW], n[a : a + MODEL_ROW]
            yield rows_of([(-1, kind, bucket, part, len(k), int(m.sum()), int((m > 0).sum()), packed(k), packed(value[a : a + MODEL_ROW].astype(np.float64 if kind == WORDS else np.float32)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = unpacked(low_keys, n_low, np.uint64), unpacked(low_n, n_low, np.uint64).astype(np.int64)
        lower = [Level(*low, order, DEALT_BY - 1) for order in range(DEALT_BY - 1, -1, -1)]
        at, waiting, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                kind, bucket, rows, keys, n = (batch.column(c)[i].as_py() for c in range(5))
                if (kind, bucket) != at and at is not None:
                    yield from told(*at, *summed(*map(np.concatenate, zip(*waiting, strict=True))), lower)
                    waiting, size = [], 0
                at = kind, bucket
                if rows:
                    waiting.append((unpacked(keys, rows, np.uint64), unpacked(n, rows, np.uint32).astype(np.int64)))
                    size += rows
                else:
                    waiting.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                if size > GATHERED:
                    waiting = [summed(*map(np.concatenate, zip(*waiting, strict=True)))]
                    size = 0
        if at is not None:
            yield from told(*at, *summed(*map(np.concatenate, zip(*waiting, strict=True))), lower)

    rows = made.where(F.col("kind").isin(WORDS, KEYS)).select("kind", "bucket", "rows", "keys", "told")
    return dealt(rows, ["kind", "bucket"], [], buckets // 8).mapInArrow(lambda it: released(run(it)), ROW)


def answered(made: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """Each block's keys with what the model tells of them: the model's rows of a bucket come first, then blocks one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, known, value = None, [], None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                block, kind, bucket, part, rows, _, _, keys, n = (c[i].as_py() for c in batch.columns)
                if (kind, bucket) != at:
                    at, parts, known = (kind, bucket), [], None
                kinds = np.float64 if kind == WORDS else np.float32
                if not rows:
                    continue
                k = unpacked(keys, rows, np.uint64)
                if block < 0:
                    parts.append((k, unpacked(n, rows, kinds)))
                    continue
                if known is None:
                    known, value = map(np.concatenate, zip(*parts, strict=True))
                    parts = []
                out.append((block, kind, bucket, part, rows, 0, 0, keys, packed(value[np.searchsorted(known, k)])))
            if out:
                yield rows_of(out)

    asked = made.where(F.col("kind").isin(WORDS, KEYS)).withColumn("told", F.lit(None).cast("binary"))
    return dealt(asked.unionByName(told), ["kind", "bucket"], ["block", "part"], buckets // 8).mapInArrow(lambda it: released(run(it)), ROW)


class Lookup:
    """Values by 64-bit keys, of which none is all ones: a table with at most two keys in three places, with linear steps."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        bits = max(8, int(1.5 * sum(len(k) for k, _ in parts)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, self.FREE), np.zeros(1 << bits, parts[0][1].dtype if parts else np.float64)
        for keys, values in parts:
            rest, step = np.arange(len(keys)), 0
            place = self.places(keys)
            while len(rest):
                at = (place[rest] + step) & self.mask
                free = self.key[at] == self.FREE
                self.key[at[free]] = keys[rest[free]]
                got = self.key[at] == keys[rest]
                self.value[at[got]] = values[rest[got]]
                rest, step = rest[~got], step + 1

    def places(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; every key must be there."""
        out = np.empty(len(keys), self.value.dtype)
        for a in range(0, len(keys), 1 << 16):
            k = keys[a : a + (1 << 16)]
            at = self.places(k)
            part = self.value[at]
            rest = np.flatnonzero(self.key[at] != k)
            while len(rest):
                at[rest] = (at[rest] + 1) & self.mask
                part[rest] = self.value[at[rest]]
                rest = rest[self.key[at[rest]] != k[rest]]
            out[a : a + (1 << 16)] = part
        return out


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text).

    Learns from documents whose crc32 of the id mod 5 isn't 1 (null ids: learn). Null or empty text: the end alone. Every
    word and every byte with its context counts. Repeated rows count and are returned each; other columns are ignored; an
    empty table has no rows. A text longer than a block is a block of its own, read by STEP places at a time.
    """
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = min(BUCKETS[1], max(BUCKETS[0], 1 << int(size // BUCKET_BYTES).bit_length()))
    made = materialize(blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", crc.alias("held_out")), buckets), "blocks")
    told = materialize(model(made, low_counts(made), buckets), "model")
    facts = told.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("seen"), F.lit(0)).alias("v")).first()
    ends = made.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    n_all = facts["n"] + ends
    scale = n_all + 0.5 * (facts["v"] + (1 if ends else 0) + 1)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    _, schema = arrow_schema(ddl)

    def score(ids: bytes, data: bytes, parts: dict[int, list]) -> pa.RecordBatch:
        of_doc = pa.ipc.open_stream(ids).read_all().combine_chunks().to_batches()[0]
        held = of_doc.column(1).to_numpy(zero_copy_only=False)
        sizes = np.frombuffer(data[:16], "<u8").astype(np.int64)
        raw = np.frombuffer(pa.decompress(data[16:], int(sizes.sum()), codec="zstd", asbytes=True), np.uint8)
        words, keys = (Lookup(parts.pop(kind)) for kind in (WORDS, KEYS))
        n_tokens, n_known, base, code = (np.zeros(len(held)) for _ in range(4))
        for out, x in ((False, raw[: sizes[0]]), (True, raw[sizes[0] :])):
            who = np.flatnonzero(held == out)
            if not len(who):
                continue
            for done, part in portions(x, SCORED_STEP):
                end = np.flatnonzero(part == END)
                docs_ = who[done : done + len(end)]
                h, start = word_keys(part)
                owner = np.searchsorted(end, start)
                c = words.get(h) if len(h) else np.zeros(0)
                n_tokens[docs_] = np.bincount(owner, minlength=len(end)) + 1
                n_known[docs_] = np.bincount(owner, c > 0, len(end)) + (ends > 0)
                base[docs_] = np.bincount(owner, np.log10((c + 0.5) / scale), len(end)) + np.log10((ends + 0.5) / scale)
                for at, key in symbol_keys(part, SCORED_STEP):
                    code[docs_] += np.bincount(np.searchsorted(end, at), keys.get(key).astype(np.float64), len(end))
        cols = [of_doc.column(0), of_doc.column(1), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(held), n_all)), pa.array(base), pa.array(code)]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {WORDS: [], KEYS: []}
        for batch in batches:
            for i in range(batch.num_rows):
                block, kind, _, _, rows, _, _, keys, told = (c[i].as_py() for c in batch.columns)
                if block != now:
                    now, parts = block, {WORDS: [], KEYS: []}
                if kind == TEXTS:  # the last of a block
                    yield score(keys, told, parts)
                else:
                    parts[kind].append((unpacked(keys, rows, np.uint64), unpacked(told, rows, np.float64 if kind == WORDS else np.float32)))

    both = answered(made, told, buckets).unionByName(made.where(F.col("kind") == TEXTS))
    return dealt(both, ["block"], ["kind"], int(size // BLOCK_BYTES)).mapInArrow(lambda it: released(run(it)), ddl)


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
