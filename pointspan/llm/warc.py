"""Deterministic sharded WARC archives: a writer and a reader.

Records are range-sorted by id, null ids first, then by a hash of the payload.
Shards are cut at weighted quantiles of that order: a histogram of the
records' bytes over the first digits of the order, of which bins that hold more
than a quarter of a shard are cut again by the next digits, until none does.
So an outlier among the ids or many rows without an id make no large shard
(rows that share id and payload stay together).  Shards hold about
``SHARD_BYTES``, or more where there would be over ``MOST_SHARDS``; they are
the same ones on every run.  A task writes
each shard's records in order into gzip members, one a record, and rolls to
a new file once a file has ``FILE_BYTES`` compressed.  All headers are made
anew: lengths, SHA-256 digests of block and payload, record ids from page ids.
A file is written under a temporary name and renamed to its final one, which
depends on the shard and its number only; so a task that is run twice leaves
the same files.  The tasks return a row per file; those rows, written as one
table, are the manifest, and only files in it are read.  Files are reached by
``pyarrow.fs``, so the folder can be in any store that it opens.

Of records with equal payloads of ``LEAST_SHARED`` bytes or more, the one
with the smallest page id is a response, and the others are revisits of it
that hold headers only.  Digests that many pages have are joined in salted
parts, so no task gets all of their pages.

Defined results: a null html has the empty payload; a null url is written as
an empty target; line ends and other controls in urls are percent-encoded; rows
with a null page id sort first and are responses that no other row points to;
rows that share the smallest page id of their payload are all responses; an
empty table makes no file and an empty result; other columns are not written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pointspan.shared import materialize, new_folder

LEAST_SHARED = 100
SHARD_BYTES, FILE_BYTES, MOST_SHARDS = 32 << 20, 8 << 20, 50_000
#: Hex digits of the order: whether there is an id, the id, the payload's hash; how many are cut at a time, and a record's bytes besides its payload.
DIGITS, STEP, HEADERS = 1 + 16 + 8, 3, 600
SALTS, HOT = 16, 64
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 20
MANIFEST = "shard int, name string, path string, records long, bytes long"


def order_key(page_id: Column, payload_hash: Column) -> Column:
    """The order of records as a string of hex digits."""
    hexed = lambda value, n: F.lpad(F.hex(value), n, "0")
    number = F.coalesce(page_id, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.when(page_id.isNull(), F.lit("0")).otherwise(F.lit("1")), hexed(number, 16), hexed(F.shiftrightunsigned(payload_hash, 32), 8))


def plan_records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``page_id, bytes, digest, place`` of every page, and ``page_id, digest, place, first`` of revisits with the page they point to."""
    raw = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page_id = F.col("page_id").cast("long")
    own = pages.select(page_id.alias("page_id"), F.octet_length(raw).cast("long").alias("bytes"), F.sha2(raw.cast("binary"), 256).alias("digest"), order_key(page_id, F.xxhash64(raw)).alias("place"))
    own = materialize(own, "digests")
    met = own.filter(F.col("bytes") >= LEAST_SHARED)
    shared = met.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # A digest of many pages is copied to every salt and its pages go by their ids; others use the salt -1.
    salted = shared.withColumn("salt", F.explode(F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))))
    spread = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    twins = met.withColumn("salt", F.explode(F.array(F.lit(-1), spread))).join(salted, ["digest", "salt"])
    return own, twins.select("page_id", "digest", "place", "first").filter(F.col("page_id") != F.col("first")).distinct()


def shard_starts(own: DataFrame, shard_bytes: int) -> list[str]:
    """Where each shard begins in the order: at most one prefix for each ``shard_bytes`` of the records."""
    low, high = own.agg(F.min("place"), F.max("place")).first()
    if low is None:
        return [""]
    same = next((i for i in range(DIGITS) if low[i] != high[i]), DIGITS)
    weight, live, bins = F.sum(F.col("bytes") + HEADERS).alias("b"), None, None
    for length in range(min(same + STEP, DIGITS), DIGITS + STEP, STEP):
        length = min(length, DIGITS)
        rows = own.select("bytes", F.substring("place", 1, length).alias("bin"), F.substring("place", 1, length - STEP).alias("parent"))
        if live is None:
            parts = rows.groupBy("bin").agg(weight).withColumn("start", F.sum("b").over(W.orderBy("bin")) - F.col("b"))  # 16**STEP rows at most
        else:
            inside = rows.join(live, "parent").groupBy("parent", "start", "bin").agg(weight)
            parts = inside.withColumn("start", F.col("start") + F.sum("b").over(W.partitionBy("parent").orderBy("bin")) - F.col("b"))
        parts = materialize(parts.select("bin", "b", "start"), "bins")
        heavy = (F.col("b") > shard_bytes // 4) & F.lit(length < DIGITS)
        done = parts.filter(~heavy).select("bin", "start")
        bins = done if bins is None else bins.unionAll(done)
        live = parts.filter(heavy).select(F.col("bin").alias("parent"), "start")
        if length == DIGITS or live.isEmpty():
            break
    starts = bins.groupBy(F.floor(F.col("start") / shard_bytes).alias("shard")).agg(F.min("bin").alias("bin"))
    return sorted(starts.toArrow().column("bin").to_pylist())


def escaped(url: str | None) -> str:
    return "".join(c if " " < c and c != "\x7f" else f"%{ord(c):02X}" if ord(c) < 128 else c for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; with ``first``, a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {escaped(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time, so equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Roller:
    """Writes a shard's files, each under a temporary name until it is whole."""

    def __init__(self, folder: str, shard: int, attempt: str, limit: int):
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.folder, self.shard, self.attempt, self.limit = folder, shard, attempt, limit
        self.number, self.out, self.done = 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.base}/_tmp-{self.attempt}-{self.name}"
            self.out, self.records, self.bytes = self.store.open_output_stream(self.temp, compression=None), 0, 0
        self.out.write(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        if self.bytes >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temp, f"{self.base}/{self.name}")
            self.done.append((self.shard, self.name, f"{self.folder}/{self.name}", self.records, self.bytes))
            self.out, self.number = None, self.number + 1


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` under ``folder`` and return the manifest, a row per file."""
    own, twins = plan_records(pages)
    total = own.agg(F.coalesce(F.sum(F.col("bytes") + HEADERS), F.lit(0))).first()[0]
    starts = shard_starts(own, max(shard_bytes, total // MOST_SHARDS))

    @F.pandas_udf("int")
    def shard_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(np.array(starts), place.to_numpy(dtype=str), side="right") - 1, 0))

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.cast("binary").alias("payload"), order_key(F.col("page_id").cast("long"), F.xxhash64(payload)).alias("place"))
    notes = twins.select(shard_of("place").alias("shard"), "page_id", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit(b"").alias("payload"), "first")
    rows = rows.select(shard_of("place").alias("shard"), "page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first"))
    parts = len(starts)
    # A page's note comes just before it, so the payloads are shuffled once and not joined.
    dealt = rows.unionByName(notes).repartition(parts, "shard").sortWithinPartitions("shard", "page_id", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, roller, done = str(TaskContext.get().taskAttemptId()), None, []
        noted, note = None, {}
        for batch in batches:
            for shard, page_id, kind, url, payload, first in zip(*(c for c in batch.columns), strict=True):
                if roller is None or roller.shard != shard.as_py():
                    if roller:
                        roller.close()
                        done += roller.done
                    roller = Roller(folder, shard.as_py(), attempt, file_bytes)
                if page_id.as_py() != noted:
                    noted, note = page_id.as_py(), {}
                if kind.as_py() == 0:
                    note[url.as_py()] = first.as_py()
                else:
                    data = payload.as_py()
                    digest = hashlib.sha256(data).hexdigest()
                    roller.add(member(record(noted, url.as_py(), data, digest, note.get(digest))))
        if roller:
            roller.close()
            done += roller.done
        columns = list(zip(*done, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "name", "path", "records", "bytes"])

    return materialize(dealt.mapInArrow(write, MANIFEST), "manifest")


def members(source) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while data := rest or source.read(READ):
        out.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("a gzip member is cut off")


def parse(data: bytes) -> dict:
    """Headers and block of a record, with its digests checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].partition(":")[2]:
        raise ValueError(f"{fields['WARC-Record-ID']}: its block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: its payload's digest differs")
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    return {
        "page_id": number("WARC-Record-ID"), "payload_bytes": int(lines["Content-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "payload": payload,
    }


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the manifest's files, a file being one unit of work."""
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}
    if payloads:
        kinds["payload"] = pa.binary()
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0):
                store, at = fs.FileSystem.from_uri(path.as_py())
                with store.open_input_stream(at, compression=None) as source:
                    part = []
                    for data in members(source):
                        part.append(parse(data))
                        if len(part) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], k) for n, k in kinds.items()], list(kinds))
                            part = []
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], k) for n, k in kinds.items()], list(kinds))

    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, MOST_SHARDS), "path").mapInArrow(each, schema)


def warc(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, and read them back."""
    manifest = write_archives(pages, new_folder(pages.sparkSession, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
