"""Packing: tokenize, cut into pieces, and fill windows of equal capacity by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tokens, arrow_schema, released, slices, table, text_column

CAPACITY = 4096
END_ID = 2
#: Pieces that are packed together; a task holds one such block besides a batch of texts.
BLOCK = 1536
#: A remainder is cut into equal pieces of at most this length: windows of many small pieces come out nearly equal, those
#: of three or four large ones don't (padding 0.5 % against 7 %).
PIECE = 512
#: Runs of letters, digits or marks whose ids a worker remembers. A cache only: when full, it forgets those met once.
CACHE = 300_000
#: Bytes of text that are split at once.
SLICE_BYTES = 4_000_000
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters whose words are split here, as the tokenizer's pattern does: printable ASCII and the letters of
#: Latin-1, which its normaliser only lower-cases; and that pattern for them. A word with other characters, or with what
#: may be a special token, is encoded whole.
PLAIN = r"^[!-~À-ÖØ-öø-ÿ]+$"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"
SPECIAL = "<|"


def byte_signs() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(shown)))}


class Pieces(dict):
    """The ids of whole texts, by the words between white space and the runs of letters, digits or marks in those.

    This tokenizer's runs never reach over white space (its pattern excludes it and its normaliser works within a
    character and its marks), so a text's ids are those of its words in order, and a word's those of its runs. A slice's
    distinct words are split at once, and each distinct run is encoded once.
    """

    made: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.signs = byte_signs()
        self.fresh: list[bytes] = []
        self.used = 0
        self.flat, self.start, self.size, self.met = np.zeros(1 << 16, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def at(cls, path: str) -> Pieces:
        if path not in cls.made:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            cls.made[path] = cls(path)
        return cls.made[path]

    def forget(self) -> None:
        """Keeps the runs that more than one slice had."""
        kept = np.flatnonzero(self.met > 1)
        names = list(self)
        where = np.arange(self.size[kept].sum()) + np.repeat(self.start[kept] - (np.cumsum(self.size[kept]) - self.size[kept]), self.size[kept])
        flat = self.flat[where]
        self.clear()
        for i in kept.tolist():
            self[names[i]] = len(self)
        self.size, self.met, self.used = self.size[kept], np.zeros(len(kept), np.int64), len(flat)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([flat, np.zeros(1 << 16, np.uint32)])

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n

    def learn(self) -> None:
        """Ids of the runs and words met since: runs by the model alone, whole words together, dealt back by their places."""
        if not self.fresh:
            return
        got: list[list[int]] = [[]] * len(self.fresh)
        whole: list[int] = []
        model, signs = self.encoder.model, self.signs
        for i, piece in enumerate(self.fresh):
            if piece[0] == 0x20:
                whole.append(i)
            else:
                got[i] = [t.id for t in model.tokenize(piece.decode("latin-1") if piece.isascii() else piece.decode("latin-1").translate(signs))]
        for part in itertools.batched(whole, 20_000):
            texts = [self.fresh[i][1:].decode("utf-8", "replace") for i in part]
            e = self.encoder.encode(" ".join(texts), add_special_tokens=False)
            ends = np.cumsum(np.array([len(t) + 1 for t in texts]))
            owner = np.searchsorted(ends, np.array([o[0] for o in e.offsets], np.int64), side="right")
            for i, x in zip(part, np.split(np.array(e.ids, np.int64), np.searchsorted(owner, np.arange(1, len(texts)))), strict=True):
                got[i] = x.tolist()
        size = np.fromiter(map(len, got), np.int64, len(got))
        more = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum()))
        if self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(more), np.uint32)])
        self.flat[self.used : self.used + len(more)] = more
        self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
        self.size, self.met = np.concatenate([self.size, size]), np.concatenate([self.met, np.zeros(len(size), np.int64)])
        self.used += len(more)
        self.fresh = []

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct words."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, SPECIAL)))
        split = pc.replace_substring_regex(pc.utf8_lower(words), PIECES, "\\0 ")
        kind = words.type
        text = pc.if_else(plain, split, pa.nulls(len(words), kind))
        lists = pc.ascii_split_whitespace(text.fill_null(""))
        pieces = lists.flatten().dictionary_encode()
        names = pieces.dictionary.cast(pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).to_pylist()
        known = np.fromiter((self[x] if x else -1 for x in names), np.int64, len(names))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        of_odd = np.fromiter((self[b" " + w.encode()] for w in words.take(pa.array(odd)).to_pylist()), np.int64, len(odd))
        self.learn()
        at, first = known[pieces.indices.to_numpy(zero_copy_only=False)], lists.offsets.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(words)), np.diff(first))
        owner, at = np.concatenate([owner[at >= 0], odd]), np.concatenate([at[at >= 0], of_odd])
        self.met[known[known >= 0]] += 1
        self.met[of_odd] += 1
        by = np.argsort(owner, kind="stable")
        owner, at = owner[by], at[by]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, self.size[at], len(words)).astype(np.int64))])
        return self.flat[spread(self.start[at], self.size[at])], bounds

    def ids(self, col: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column, as in encode(text, add_special_tokens=False)."""
        for _, part in slices(col, SLICE_BYTES):
            if len(self) > CACHE:
                self.forget()
            tokens = Tokens(part)
            flat, bounds = self.of_words(tokens.names)
            n = np.diff(bounds)[tokens.at]
            ids = flat[spread(bounds[tokens.at], n)]
            yield from (ids[a:b] for a, b in itertools.pairwise(np.concatenate([[0], np.cumsum(n)])[tokens.first]))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of each run, in order."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """k-way Karmarkar-Karp: the two partial partitions of largest imbalance are merged so that their imbalances oppose
    each other (largest window onto smallest), until one is left. The windows' items; empty windows are left out.

    A partial partition holds its windows that have items only, largest first; windows without items count as 0.
    Window items are chains: head and tail by window, next by item.
    """
    after = np.full(len(sizes), -1)
    order = np.argsort(-sizes, kind="stable")
    heap = [(-int(sizes[i]), n, np.array([sizes[i]]), np.array([i]), np.array([i])) for n, i in enumerate(order)]
    if k == 1:
        return [order.tolist()] if len(order) else []
    count = len(heap)
    while len(heap) > 1:
        (_, _, a, ah, at), (_, _, b, bh, bt) = heapq.heappop(heap), heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)
        if over:  # the smallest of a under the largest of b
            i, j = slice(len(a) - over, None), np.arange(over)[::-1]
            after[at[i]] = bh[j]
            value = np.concatenate([a[: len(a) - over], a[i] + b[j], b[over:]])
            head, tail = np.concatenate([ah, bh[over:]]), np.concatenate([at[: len(a) - over], bt[j], bt[over:]])
        else:
            value, head, tail = np.concatenate([a, b]), np.concatenate([ah, bh]), np.concatenate([at, bt])
        by = np.argsort(-value, kind="stable")
        value, head, tail = value[by], head[by], tail[by]
        if len(value) == k:
            value = value - value[-1]
        heapq.heappush(heap, (-int(value[0]), count, value, head, tail))
        count += 1
    out = []
    for i in heap[0][3].tolist() if heap else []:
        chain = []
        while i >= 0:
            chain.append(i)
            i = int(after[i])
        out.append(chain)
    return out


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of items, each within capacity: the fewest windows that could hold them, more while one is exceeded."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        found = differencing(sizes, k)
        most = max((int(sizes[w].sum()) for w in found), default=0)
        if most <= capacity:
            return found
        k = max(k + 1, -(-total // (2 * capacity - most)) if most < 2 * capacity else k + 1)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text) in sequences of at most capacity ids: DDL's columns, and ids where asked for.

    A document's ids are its text's (null: none) and end_id. Whole windows are cut off its front, each a sequence of its
    own; the pieces of remainders are packed by differencing in blocks of so many, as they come, so no row moves between tasks, a
    task's memory doesn't depend on its share, and padding is about one window in a block of hundreds. A sequence is
    padded to capacity, or not at all if its length is a power of two (padded_length). sequence_id: the task's number
    times 2^33 and a counter. Repeated rows are packed each; other columns are ignored; an empty table has
    no pieces.
    """
    path = path or tokenizer_path()
    ddl = DDL + (", ids array<int>" if with_ids else "")
    _, schema = arrow_schema(ddl)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Pieces.at(path)
        sequence = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        rows: list[tuple] = []
        rest: list[tuple] = []

        def told(doc, start: int, ids: np.ndarray, tokens: int) -> tuple:
            return doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens

        def length_of(n: int) -> int:
            return n if n & (n - 1) == 0 else capacity

        def close() -> None:
            for window in pack(np.array([r[2] for r in rest], np.int64), capacity) if rest else []:
                number, at, total = next(sequence), 0, sum(rest[i][2] for i in window)
                for i in window:
                    doc, start, n, crc, tokens, ids = rest[i]
                    rows.append((doc, start, n, crc, tokens, number, at, length_of(total), ids))
                    at += n
            rest.clear()

        def batch() -> pa.RecordBatch:
            cols = zip(*rows, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)], names=names)
            rows.clear()
            return out

        for b in batches:
            ids_of = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            for doc, text_ids in zip(ids_of, words.ids(text_column(b)), strict=True):
                ids = np.append(text_ids, np.uint32(end_id)).astype("<u4")
                for a in range(0, len(ids), capacity):
                    piece = ids[a : a + capacity]
                    if len(piece) == capacity:
                        rows.append((*told(doc, a, piece, len(ids)), next(sequence), 0, capacity, piece.astype(np.int32) if with_ids else None))
                        continue
                    for part in np.array_split(piece, -(-len(piece) // PIECE)):
                        rest.append((*told(doc, a, part, len(ids)), part.astype(np.int32) if with_ids else None))
                        a += len(part)
                if len(rest) >= block:
                    close()
                if len(rows) >= 10_000:
                    yield batch()
        close()
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(lambda it: released(run(it)), ddl)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))
