"""Quality rules: base rules of repetition and length, and a hashed n-gram logistic regression with calibrated output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tokens, arrow_schema, mixed, slices, table, text_column, windows

#: Fixed thresholds: of the base rules, and of the calibrated probability of quality below which a document goes.
MIN_WORDS = 10
MAX_REPEATED = 20
MIN_PROBABILITY = 0.8
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Buckets of word 1- and 2-grams, and of character 3-grams.
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 12
#: The model is fitted on at most this many labelled rows of each class: those whose ids hash lowest.
SAMPLE = 600
FOLDS = 5


def words_at_repeats(h: np.ndarray, bounds: np.ndarray, tokens: Tokens, k: int) -> np.ndarray:
    """For each text the words inside k-word windows that occur twice or more in it."""
    n = tokens.counts()
    owner = np.repeat(np.arange(len(n)), np.diff(bounds))
    whole = n[owner] >= k
    h, owner, where = h[whole], owner[whole], (np.arange(bounds[-1]) - bounds[owner] + tokens.first[owner])[whole]
    salted = h ^ mixed(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(salted, kind="stable")
    s = salted[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = where[order[twice]]
    step = np.zeros(len(tokens.at) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return covered[tokens.first[1:]] - covered[tokens.first[:-1]]


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


class Texts:
    """Counts and features of some texts, from their bytes and words."""

    def __init__(self, col: pa.Array):
        self.tokens = t = Tokens(col)
        self.n_words = t.counts()
        size = np.fromiter((len(w) - sum(0x80 <= c < 0xC0 for c in w) if not w.isascii() else len(w) for w in t.distinct), np.int64, len(t.distinct))
        self.word_chars = self.by_text(size[t.at], t.first)
        offsets = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        self.bytes = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.ends = offsets - offsets[0]
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        self.n_symbols = self.by_text(symbol[self.bytes], self.ends)
        raw = self.bytes.tobytes()
        self.n_dup_lines = np.array([repeated_lines(raw[a:b]) for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)], np.int64)
        self.h = t.hashes()
        h, bounds = windows(self.h, t.first, WINDOW)
        self.n_repeat_words = words_at_repeats(h, bounds, t, WINDOW)

    @staticmethod
    def by_text(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x, dtype=np.float64 if x.dtype.kind == "f" else np.int64)])
        return total[first[1:]] - total[first[:-1]]

    def failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEATED * self.n_words)

    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(buckets, bounds) of word 1-grams, word 2-grams and character 3-grams, as they occur."""
        with np.errstate(over="ignore"):
            one = (mixed(self.h) % np.uint64(WORD_BUCKETS)).astype(np.int32)
        h, bounds = windows(self.h, self.tokens.first, 2)
        two = (h % np.uint64(WORD_BUCKETS)).astype(np.int32)
        b = self.bytes.astype(np.uint32)
        code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) if len(b) > 2 else np.zeros(0, np.uint32)
        code ^= code >> np.uint32(15)
        three = (code * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int32) % CHAR_BUCKETS
        return [(one, self.tokens.first), (two, bounds), (three, np.minimum(self.ends, len(three)))]


WIDTHS = (WORD_BUCKETS, WORD_BUCKETS, CHAR_BUCKETS)


def scores(texts: Texts, weights: np.ndarray) -> np.ndarray:
    """Of each text the sum over families of the mean weight of its n-grams, and the bias."""
    out, at = np.full(len(texts.n_words), float(weights[-1])), 0
    for (bucket, bounds), width in zip(texts.grams(), WIDTHS, strict=True):
        out += Texts.by_text(weights[at : at + width][bucket].astype(np.float64), bounds) / np.maximum(np.diff(bounds), 1)
        at += width
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression; classes count alike. Full-batch Adam: the same rows give the same weights."""
    w = np.zeros(x.shape[1], np.float32)
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    x, y = np.ascontiguousarray(x, np.float32), y.astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = (each * (p - y)) @ x + np.float32(ridge) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= (rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
    return w.astype(np.float64)


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of Platt's sigmoid a * score + b, on scores of rows that the weights weren't fitted on; targets smoothed."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, spread = score.mean(), score.std() + 1e-9
    z = np.stack([(score - mean) / spread, np.ones_like(score)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        w -= np.linalg.solve(hess, z.T @ (p - t))
    return w[0] / spread, w[1] - w[0] * mean / spread


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float] | None:
    """(weights, a, b), or None where labelled rows of either class are missing.

    Rows without a quality of 0 or 1 are ignored; a document with contradicting labels counts as the lower one. The rows
    of the sample come to the driver as hashed counts, at most WIDTHS numbers each whatever their length.
    """
    told = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = docs.select("doc_id").distinct().join(told, "doc_id") if sample else told
    order = F.xxhash64("doc_id")
    picked = known.where("quality = 1").orderBy(order, "doc_id").limit(sample).union(known.where("quality = 0").orderBy(order, "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * sample rows of two numbers
    ddl = "doc_id long, quality int, bucket binary, value binary"
    _, schema = arrow_schema(ddl)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, name = text_column(batch), batch.schema.get_field_index
            for a, some in slices(col):
                buckets, values = [], []
                grams = Texts(some).grams()
                for i in range(len(some)):
                    at, pairs = 0, []
                    for (bucket, bounds), width in zip(grams, WIDTHS, strict=True):
                        n = np.bincount(bucket[bounds[i] : bounds[i + 1]], minlength=width)
                        at_, n_ = np.flatnonzero(n), n[np.flatnonzero(n)]
                        pairs.append((at_ + at, n_ / max(1, bounds[i + 1] - bounds[i])))
                        at += width
                    buckets.append(np.concatenate([p[0] for p in pairs]).astype(np.int32).tobytes())
                    values.append(np.concatenate([p[1] for p in pairs]).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(name("doc_id")).slice(a, len(some)), batch.column(name("quality")).slice(a, len(some)), pa.array(buckets, pa.binary()), pa.array(values, pa.binary())], schema=schema)

    got = rows.mapInArrow(features, ddl).toArrow().sort_by("doc_id")
    y = got["quality"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None

    def dense(rows: np.ndarray) -> np.ndarray:
        """Features of some rows; the driver holds those of one fit at a time."""
        x = np.zeros((len(rows), sum(WIDTHS) + 1), np.float32)
        x[:, -1] = 1
        for i, row in enumerate(rows.tolist()):
            x[i, np.frombuffer(got["bucket"][row].as_py(), np.int32)] = np.frombuffer(got["value"][row].as_py(), np.float32)
        return x

    every = np.arange(len(y))
    held = every % FOLDS == 0
    if len(set(y[~held])) == 2 and len(set(y[held])) == 2:
        weights = fit(dense(every[~held]), y[~held])
        a, b = calibrate(dense(every[held]) @ weights, y[held])
    else:
        a, b = 1.0, 0.0
    return fit(dense(every), y), a, b


DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judged(docs: DataFrame, model: tuple[np.ndarray, float, float] | None, minimum: float = MIN_PROBABILITY, carry: bool = False) -> DataFrame:
    """DDL's columns for docs(doc_id, text) in one pass of Arrow batches; carry: docs' own rows that are kept, instead.

    kept is false if the base rules fail, else whether the calibrated probability of quality reaches the minimum. Without
    a model (no labelled rows of both classes) the base rules alone decide and probability is null. Null text: no words.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) if carry else DDL
    _, schema = arrow_schema(DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = text_column(batch)
            for a, some in slices(col):
                t = Texts(some)
                failed = t.failed()
                p = 1 / (1 + np.exp(-np.clip(model[1] * scores(t, model[0]) + model[2], -50, 50))) if model else None
                kept = ~failed & (p >= minimum if model else True)
                if carry:
                    yield batch.slice(a, len(some)).filter(pa.array(kept))
                    continue
                counts = [pa.array(x.astype(np.int64)) for x in (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words)]
                ids = batch.column(batch.schema.get_field_index("doc_id")).slice(a, len(some)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *counts, pa.array(failed), pa.array(kept), pa.array(p) if model else pa.nulls(len(some), pa.float64())], schema=schema)

    return (docs if carry else docs.select("doc_id", "text")).mapInArrow(run, ddl)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, train(docs, labels), carry=True)
