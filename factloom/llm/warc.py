"""WARC: a deterministic sharded writer and a reader.

Records are range-sorted into shards by id, files roll by compressed size, headers and digests are regenerated, and files
are written under temporary names and committed by renaming them from a manifest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, shared_dir, table

#: A file is closed once it has this many compressed bytes.
ROLL_BYTES = 64 << 20
#: A shard takes records of at most this many payload bytes; ids are counted in so many equal ranges to find its bounds.
SHARD_BYTES = 256 << 20
RANGES = 4096
#: Payloads of at least this many bytes that an earlier record has are written as revisits.
REVISIT_BYTES = 0
#: Fixed values of the headers: a date that reruns share, and the name space of record ids.
DATE = "2000-01-01T00:00:00Z"
NAMES = uuid.UUID("6f1d4f64-6c0c-5d5e-9a39-5a5f6c3f7f10")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_text(value) -> str:
    """A header's value on one line."""
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, refers_to: tuple | None) -> bytes:
    """One record, compressed as its own gzip member. refers_to: (page_id,) of the response that a revisit repeats."""
    block = HTTP % len(payload) + (b"" if refers_to else payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid5(NAMES, f'{i}')}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_text(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-Id: {header_text(page_id)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        lines[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to[0])}", f"X-Refers-To-Page-Id: {header_text(refers_to[0])}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def shard_bounds(pages: DataFrame, shard_bytes: int = SHARD_BYTES, ranges: int = RANGES) -> list[int]:
    """The ids at which shards but the first begin, from pages(page_id, bytes).

    Bytes are summed in equal ranges of the ids; a range of more than a shard's bytes is divided again, and so on, so ids
    may lie as unevenly as they like. Consecutive ranges fill a shard; only an id that repeats can make one larger. The
    same pages give the same shards whatever their partitions. The driver holds, a round, at most so many ranges for each
    shard.
    """
    pages = pages.where("page_id is not null").groupBy("page_id").agg(F.sum("bytes").alias("bytes"))
    pages = materialize(pages, "id-bytes")
    ends = pages.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    if ends["lo"] is None:
        return []
    spans, done = [(ends["lo"], ends["hi"] + 1)], []
    while spans:
        spans.sort()
        table_ = pages.sparkSession.createDataFrame([(lo, hi, max(1, -(-(hi - lo) // ranges))) for lo, hi in spans], "lo long, hi long, width long")
        inside = pages.join(F.broadcast(table_), F.expr("page_id >= lo and page_id < hi"))
        sums = inside.groupBy("lo", "width", F.expr("(page_id - lo) div width").alias("i")).agg(F.sum("bytes").alias("bytes"), F.max("hi").alias("hi")).collect()
        spans = []
        for r in sums:
            a = r["lo"] + r["i"] * r["width"]
            b = min(r["hi"], a + r["width"])
            if r["bytes"] > shard_bytes and b - a > 1:
                spans.append((a, b))
            else:
                done.append((a, r["bytes"]))
    total, bounds = 0, []
    for a, size in sorted(done):
        if total and total + size > shard_bytes:
            total = 0
            bounds.append(a)
        total += size
    return bounds


def shard_of(page_id, bounds: list[int], step: int = 256):
    """Column: the number of bounds up to an id, by way of every step-th of them. Null ids are in shard 0."""
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= page_id))
    if len(bounds) <= step:
        found = upto(F.array(*map(F.lit, bounds))) if bounds else F.lit(0)
    else:
        coarse = F.array(*[F.lit(x) for x in bounds[::step]])
        fine = F.array(*[F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, len(bounds), step)])
        at = F.greatest(upto(coarse) - 1, F.lit(0))
        found = at * step + upto(F.element_at(fine, at + 1))
    return F.when(page_id.isNull(), 0).otherwise(found).cast("int")


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, sha, first_id) of pages whose payload a page with a smaller id has, from pages(page_id, sha, bytes).

    Payloads are equal when their SHA-1 is. The first ids are an aggregate that combines before its shuffle; they go back
    to the pages of groups over a join that is dealt by payload and, for groups with many pages, by a hash of the id.
    """
    ids = pages.where(F.col("bytes") >= least).groupBy("sha", "page_id").agg(F.count("*").alias("n"))
    first = ids.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("ids")).where("ids > 1")
    salts, many = 64, 10_000
    slot = F.when(F.col("ids") > many, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    cold, hot = first.where(F.col("ids") <= many), first.where(F.col("ids") > many).withColumn("slot", F.explode(slot))
    members = ids.select("sha", "page_id")
    one = members.join(cold, "sha")
    two = members.withColumn("slot", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(hot, ["sha", "slot"])
    both = one.select("page_id", "sha", "first_id").unionByName(two.select("page_id", "sha", "first_id"))
    return both.where("not (page_id <=> first_id)")


def write(pages: DataFrame, out: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) as WARC files shard-SSSSS-NNNN.warc.gz under out and returns the manifest.

    Of pages with equal payloads (UTF-8 of html, null: empty) of at least `least` bytes the one with the smallest id is a
    response, the others revisit it; rows that repeat an id and a payload revisit its first. Pages without id come first.
    An empty table writes no file; other columns are ignored.
    One shuffle moves the payloads, to their shard's task, in order; the revisits' facts travel beside them. Tasks write
    under _temporary, named by attempt; only files in the manifest, told by finished tasks, get their names.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    known = materialize(rows.select("page_id", "sha", "bytes"), "payloads")
    bounds = shard_bounds(known, shard_bytes)
    marks = revisits(known, least).select("page_id", "sha", F.col("first_id"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.lit(0).cast("long").alias("bytes"))
    pages_ = rows.select("page_id", "sha", F.lit(None).cast("long").alias("first_id"), F.lit(1).alias("kind"), "url", "html", "bytes")
    placed = marks.unionByName(pages_).withColumn("shard", shard_of(F.col("page_id"), bounds))
    placed = placed.repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "sha", "kind", "url")
    ddl = "temporary string, name string, records long, bytes long, sha256 string"
    _, schema = arrow_schema(ddl)
    temporary = f"{out}/_temporary"
    columns = ["shard", "page_id", "sha", "first_id", "kind", "url", "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(temporary)
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        mark, seen, now, number, file = None, None, None, 0, None

        def close() -> pa.RecordBatch:
            stream, path, name, records, size, sha = file
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((path, name, records, size, sha.hexdigest()), schema, strict=True)], schema=schema)

        for b in batches:
            for shard, page, sha, first, kind, url, html in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if kind == 0:
                    mark = (page, sha, first)
                    continue
                if file and (shard != now or file[4] >= roll_bytes):
                    yield close()
                    number, file = (number + 1 if shard == now else 0), None
                if file is None:
                    number = number if shard == now else 0
                    now, name = shard, f"shard-{shard:05d}-{number:04d}.warc.gz"
                    path = f"{base}/{attempt}-{name}"
                    file = [fs.open_output_stream(path, compression=None), path, name, 0, 0, hashlib.sha256()]
                payload = html.encode()
                again = (mark[2],) if mark and mark[:2] == (page, sha) else (page,) if seen == (page, sha) and len(payload) >= least else None
                seen = (page, sha)
                data = record(page, url, payload, again)
                file[0].write(data)
                file[3] += 1
                file[4] += len(data)
                file[5].update(data)
        if file:
            yield close()

    done = placed.select(*columns).mapInArrow(run, ddl).collect()  # one row a file
    return commit(spark, out, sorted(done, key=lambda r: r["name"]))


def commit(spark: SparkSession, out: str, files: list) -> DataFrame:
    """Gives the files their names and writes the manifest, itself under a temporary name first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(conf)
    fs.mkdirs(path(out))
    for f in files:
        fs.delete(path(out, f["name"]), False)
        if not fs.rename(path(f["temporary"]), path(out, f["name"])):
            raise OSError(f"{f['name']} could not be committed")
    manifest = [{"name": f["name"], "records": f["records"], "bytes": f["bytes"], "sha256": f["sha256"]} for f in files]
    stream = fs.create(path(out, "_manifest.json.tmp"), True)
    stream.write(bytearray(json.dumps(manifest, indent=1).encode()))
    stream.close()
    fs.delete(path(out, "_manifest.json"), False)
    fs.rename(path(out, "_manifest.json.tmp"), path(out, "_manifest.json"))
    fs.delete(path(out, "_temporary"), True)
    return spark.createDataFrame([tuple(m.values()) for m in manifest], "name string, records long, bytes long, sha256 string")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after another, without copying its rest for each."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof and at < len(view):
            piece = view[at : at + 65536]
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, out: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of the committed files under out.

    Block digests are checked, and a response's payload digest and length are taken from its payload. html is null for
    revisits.
    """
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    _, schema = arrow_schema(ddl)
    number = lambda x: int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for raw in members(content.as_py()):
                    h, block = parse(raw)
                    if h["WARC-Block-Digest"] != "sha1:" + digest(block):
                        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
                    kind = h["WARC-Type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    told = (len(payload), digest(payload)) if kind == "response" else (int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"))
                    rows.append((number(h["X-Page-Id"]), h["WARC-Target-URI"], *told, kind, number(h.get("X-Refers-To-Page-Id")), payload.decode() if payload is not None else None))
                    size += len(block)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out)
    return files.select("content").mapInArrow(run, ddl)


def full_uri(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark finds it in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = full_uri(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}")
    write(table(spark, sf_dir, "pages"), out)
    return read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
hex AS (SELECT page_id, html, first_id, sha1(html) AS h FROM p),
five AS (
  SELECT page_id, html, first_id, string_agg(lpad(bin(('0x' || c)::INT), 4, '0'), '' ORDER BY i) AS bits
  FROM (SELECT page_id, html, first_id, i, substr(h, i::INT, 1) AS c FROM hex, range(1, 41) r(i)) GROUP BY page_id, html, first_id)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(bits, 5 * k::INT + 1, 1)::INT + 8 * substr(bits, 5 * k::INT + 2, 1)::INT + 4 * substr(bits, 5 * k::INT + 3, 1)::INT + 2 * substr(bits, 5 * k::INT + 4, 1)::INT + substr(bits, 5 * k::INT + 5, 1)::INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM five
"""
