"""WARC archives as chunked record tables.

A *record table* has a row a chunk: record identifier, chunk number, bytes.  Writing
splits a payload into chunks inside the scan and streams them, one at a time, into an archive:
the worker never holds a record.  Reading streams an archive in buffers of ``chunk`` bytes and
emits chunk rows that carry the record's place and the digest of all of the
payload up to their end, so the last chunk's is the payload's and no later step needs
the whole record either.

Of records with equal payloads of ``least`` bytes or more the smallest identifier's is
``response``, the others ``revisit`` it: they hold HTTP headers but no payload.  Who is
first is found by partial aggregation of (digest, smallest identifier) and told to the
rows by a join over (digest, salt), so a payload that a third of the pages share is no
one task's.

Each record is a gzip member.  Each task writes its own files, under a name of its own; the manifest it returns
names the files with offsets where records begin, about ``split`` bytes apart, so large archives are read by many
tasks.  Files of lost attempts are in no manifest and aren't read.  Files go to a
folder that pyarrow can open on every executor.

Defined cases: null payloads are empty.  Null urls are written as ``urn:none``.  Rows with equal
identifiers write a record each; of equal identifiers and payloads the first is the
response.  A null identifier is written as ``none``, reads back as null, and comes last.  An empty
table writes no file and gives an empty result.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.blocks import open_store
from tidelake.llm.common import batches_of, new_path, stage

CHUNK, SPLIT, FILE = 1 << 20, 32 << 20, 1 << 30
#: Dates of records; writing the same table again gives the same bytes.
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = "file string, start long, stop long, records long"
_CHUNKS = "record_id long, record_type string, refers_to long, chunk_no int, start long, length long, total long, sha256_so_far string, stated_sha256 string, target string, data binary"


def marked(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, salts: int) -> DataFrame:
    """id, url, payload, digest, first: the identifier of the response with this payload, null for those that have none before them."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("urn:none")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")})
    large = rows.filter(F.octet_length("payload") >= least).select("digest", "salt", "id")
    by_salt = stage(large.groupBy("digest", "salt").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "payloads")
    firsts = by_salt.groupBy("digest").agg(F.min("low").alias("first"), F.sum("n").alias("all")).filter("all > 1")
    known = by_salt.select("digest", "salt").join(firsts, "digest").select(F.col("digest").alias("__digest"), F.col("salt").alias("__salt"), "first")
    return rows.join(known, (F.col("digest") == F.col("__digest")) & (F.col("salt") == F.col("__salt")), "left").drop("__digest", "__salt", "all")


def record_table(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows of marked() as chunk rows: id, url, digest, total, refers_to, revisit, chunk_no, data.  A revisit is one row without data."""
    place = F.row_number().over(Window.partitionBy("digest", "salt", "id").orderBy("url"))
    rows = rows.withColumn("revisit", F.coalesce(~(F.col("id").eqNullSafe(F.col("first")) & (place == 1)), F.lit(False)) & F.col("first").isNotNull()) if "first" in rows.columns else rows
    total = F.octet_length("payload")
    count = F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(total / chunk)).cast("int"))
    raw = F.col("payload").cast("binary")
    data = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.substring(F.col("raw"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return (
        rows.select("id", "url", "digest", total.cast("long").alias("total"), F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit", raw.alias("raw"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
        .select("id", "url", "digest", "total", "refers_to", "revisit", "chunk_no", data.alias("data"))
    )


def _name(i: int | None) -> str:
    return f"<urn:page:{'none' if i is None else i}>"


def _head(i: int | None, url: str, digest: str, total: int, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n".encode()
    kind = "revisit" if revisit else "response"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(i)}", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else total)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str, split: int = SPLIT, most: int = FILE) -> DataFrame:
    """Streams chunk rows, a record's in order, to archives in folder; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        out, name, cuts, records, left, check, member = None, "", [], 0, 0, None, None

        def close() -> pa.RecordBatch:
            end = out.tell()
            out.close()
            rows = [(name, a, b, n) for (a, n), b in zip(cuts, [*[c[0] for c in cuts[1:]], end], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["file", "start", "stop", "records"])

        for batch in batches:
            for k in range(batch.num_rows):
                i, url, digest, total, refers_to, revisit, chunk_no = (batch.column(c)[k].as_py() for c in range(7))
                data = batch.column(7)[k].as_buffer()
                if chunk_no == 0:
                    if out and out.tell() >= most:
                        yield close()
                        out = None
                    if not out:
                        name, cuts, records = f"{uuid.uuid4().hex}.warc.gz", [], 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)
                    if not cuts or out.tell() - cuts[-1][0] >= split:
                        cuts.append((out.tell(), 0))
                    cuts[-1] = (cuts[-1][0], cuts[-1][1] + 1)
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(member.compress(_head(i, url, digest, total, refers_to, revisit)))
                    left, check = 0 if revisit else total, hashlib.sha256()
                out.write(member.compress(data))
                check.update(data)
                left -= data.size
                if left == 0:
                    if not revisit and check.hexdigest() != digest:
                        raise RuntimeError("a payload changed on its way to the archive")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out:
            yield close()

    with batches_of(chunks.sparkSession, 64):  # a row is a chunk
        return stage(chunks.mapInArrow(write, _MANIFEST), "manifest")


class _Members:
    """What the gzip members of a file hold, from where the file stands."""

    def __init__(self, file) -> None:
        self.file, self.raw, self.member = file, b"", zlib.decompressobj(31)

    def read(self, size: int) -> bytes:
        """Some bytes, at most ``size``; none at the end."""
        while True:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, zlib.decompressobj(31)
            raw = self.raw or self.file.read(1 << 18)
            out = self.member.decompress(raw, size)  # without input, what the member still holds
            if not raw and not out:
                return b""
            self.raw = self.member.unconsumed_tail
            if out:
                return out


class _Stream:
    """Buffered reading of a stretch of a file."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.held = file, size, b""

    def line(self) -> bytes:
        while (at := self.held.find(b"\r\n")) < 0:
            if not (more := self.file.read(self.size)):
                raise RuntimeError("an archive ends within a record")
            self.held += more
        line, self.held = self.held[:at], self.held[at + 2 :]
        return line

    def some(self, most: int) -> bytes:
        """At least one byte, at most ``most``."""
        if not self.held:
            self.held = self.file.read(self.size)
            if not self.held:
                raise RuntimeError("an archive ends within a record")
        part, self.held = self.held[:most], self.held[most:]
        return part

    def fields(self) -> dict[str, str]:
        self.line()  # version, or status
        out = {}
        while line := self.line():
            key, _, value = line.decode().partition(": ")
            out[key.lower()] = value
        return out


def _number(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(found[1]) if found else None


def read_records(stream: _Stream, records: int, chunk: int, with_data: bool) -> Iterator[tuple]:
    """Chunk rows of the next records; each holds at most a chunk."""
    for _ in range(records):
        head = stream.fields()
        whole, before = int(head["content-length"]), 0
        # The HTTP head is small: it is read line by line and measured.
        block, lines = 0, []
        while True:
            line = stream.line()
            block += len(line) + 2
            if not line:
                break
            lines.append(line.decode())
        http = dict(x.lower().split(": ", 1) for x in lines[1:])
        left, n, check = whole - block, 0, hashlib.sha256()
        kind, i = head["warc-type"], _number(head["warc-record-id"])
        refers = _number(head["warc-refers-to"]) if kind == "revisit" else None
        total = int(http["content-length"])
        stated = head["warc-payload-digest"].removeprefix("sha256:")
        while left or n == 0:
            size, parts = min(chunk, left), []
            while size:
                parts.append(stream.some(size))
                check.update(parts[-1])
                size -= len(parts[-1])
            length = sum(map(len, parts))
            yield i, kind, refers, n, before, length, total, check.hexdigest(), stated, head["warc-target-uri"], b"".join(parts) if with_data else None
            before, left, n = before + length, left - length, n + 1
        if stream.line() or stream.line():
            raise RuntimeError("a record doesn't end where its length says")


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The record table of all archives in a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        schema = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("total", pa.int64()), ("sha256_so_far", pa.string()), ("stated_sha256", pa.string()), ("target", pa.string()), ("data", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{path}/{row['file']}") as f:
                    f.seek(row["start"])
                    rows, held = [], 0
                    for x in read_records(_Stream(_Members(f), 1 << 18), row["records"], chunk, with_data):
                        rows.append(x)
                        held += len(x[-1] or b"") + 500
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, _CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record from its last chunk: id, payload_bytes, payload_digest, record_type, refers_to.  A response's length and digest are
    those of the bytes read, a revisit's those its record states."""
    ends = chunks.filter((F.col("record_type") == "revisit") | (F.col("start") + F.col("length") == F.col("total")))
    same = (F.col("record_type") == "revisit") | (F.col("sha256_so_far") == F.col("stated_sha256"))
    digest = F.when(same, F.col("stated_sha256")).otherwise(F.raise_error(F.lit("a payload read differs from its digest")).cast("string"))
    return ends.select(F.col("record_id").alias("id"), F.col("total").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, chunk: int = CHUNK, salts: int = 256) -> DataFrame:
    """Writes pages to archives in the shared folder and returns records() of what is read back."""
    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    rows = marked(pages, id_col, url_col, payload_col, least, salts)
    manifest = write_archives(record_table(rows, chunk), folder)
    return records(read_archives(spark, manifest, folder, chunk, with_data=False))
