"""Questions of all blocks of a corpus at once: how often does each of my hashes occur in all blocks?

A *block* is a run of rows of about ``max_bytes`` of text.  Blocks are cut once and staged, a row a block, with
their numbers (as_blocks()).  So however later passes are planned, and with whatever cores or executors
they run, a block is the same and is told its answer by number.  Each block sends, once each, its distinct hashes with their
counts to the parts that own their leading bits; a part adds up and replies with
one count a hash, in the order of the request.  So a hash that a third of all rows
holds makes one entry a block, no row is sent back, and replies are one small
number a hash.  Replies are files by block in the shared folder.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import new_path, stage

MAX_BYTES = 6_000_000


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, for any scheme that pyarrow knows."""
    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://")):
        uri = uri.replace(ours, theirs, 1) if uri.startswith(ours) else uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, name: str, parts: Iterator[bytes]) -> None:
    """Writes a file under a name of its own, then moves it: attempts of the same task don't meet.

    All attempts write the same bytes, so where another's file stands already it stays: not every store lets a move replace one.
    """
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    own, there = f"{path}/.{name}-{uuid.uuid4().hex}", lambda: store.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound
    with store.open_output_stream(own, compression=None) as out:
        for x in parts:
            out.write(x)
    if there():
        store.delete_file(own)
        return
    try:
        store.move(own, f"{path}/{name}")
    except OSError:
        if not there():
            raise
        store.delete_file(own)


@dataclass
class Block:
    number: int
    ids: list
    texts: list[bytes]


def runs(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """Cuts a task's rows (id, text) into runs of about ``max_bytes`` of text. Null text is empty."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if ids and held >= max_bytes:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t or b"")
            held += len(texts[-1])
    if ids:
        yield ids, texts


def as_blocks(df: DataFrame, id_col: str, text_col: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """block, ids, texts, bytes: the rows in numbered blocks, staged.  The caller frees them with drop_staged() once nothing reads them any more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(runs(batches, max_bytes)):
            columns = [pa.array([task << 32 | k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary())), pa.array([sum(map(len, texts))], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "texts", "bytes"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stage(rows.mapInArrow(cut, "block long, ids array<long>, texts array<binary>, bytes long"), "blocks", compression="zstd")


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of a task, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py())


def parts_for(total_bytes: int, bytes_a_part: int = 8_000_000, least: int = 64) -> int:
    """Number of parts, a power of two: each owns the hashes of about so much text."""
    n = least
    while n * bytes_a_part < total_bytes:
        n *= 2
    return n


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("bytes")).first()[0] or 0


def _pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers: differences of 4 bytes where they fit."""
    gaps = np.diff(values, prepend=values[:1])
    if len(values) and int(gaps.max()) < 2**32:
        return b"\x01" + values[:1].tobytes() + gaps.astype(np.uint32).tobytes()
    return b"\x00" + values.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"\x00":
        return np.frombuffer(data, np.uint64, offset=1)
    return np.frombuffer(data, np.uint64, 1, 1) + np.cumsum(np.frombuffer(data, np.uint32, offset=9), dtype=np.uint64)


def distinct(keys: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Distinct keys in order, what belongs to them, counts, and the place of each input key among them."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    first = np.flatnonzero(new)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[first], None if more is None else m[first], np.diff(first, append=len(k)), place


def routed(keys: np.ndarray, lead: np.uint64) -> list[tuple[int, int, int]]:
    """part, begin, end of the parts that sorted keys go to.  Parts without keys cost nothing, however many there are."""
    part = keys >> lead
    begins = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1))) if len(part) else np.zeros(0, np.int64)
    return list(zip(part[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(part)], strict=True)) if len(part) else []


_REQUEST = "part int, block long, keys binary, more binary, counts binary"


def ask(blocks: DataFrame, keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray | None]], parts: int, name: str, bits: int = 64) -> str:
    """Counts the keys of all blocks; returns the folder of the replies.

    keys_of gives a block's keys (uint64, ``bits`` leading bits are kept) and perhaps 32
    bits more that belong to each.  Counts are exact to 65,535, and that above.
    """
    spark, folder = blocks.sparkSession, new_path(blocks.sparkSession, name)
    drop, lead = np.uint64(64 - bits), np.uint64(bits - parts.bit_length() + 1)

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            keys, more = keys_of(block)
            keys, more, counts, _ = distinct(keys >> drop, more)
            counts = np.minimum(counts, 65535).astype(np.uint16)
            rows = [(p, block.number, _pack(keys[a:b]), b"" if more is None else more[a:b].tobytes(), zlib.compress(counts[a:b].tobytes(), 1)) for p, a, b in routed(keys, lead)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "keys", "more", "counts"])

    def reply(table: pa.Table) -> pa.Table:
        numbers = table.column("block").to_pylist()
        keys = [_unpack(x) for x in table.column("keys").to_pylist()]
        more = [np.frombuffer(x, np.uint32) for x in table.column("more").to_pylist()]
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint16) for x in table.column("counts").to_pylist()])
        sizes, keys = np.array([len(k) for k in keys]), np.concatenate(keys)
        _, _, _, place = distinct(keys, np.concatenate(more) if sum(map(len, more)) else None)
        total = np.minimum(np.bincount(place, counts), 65535).astype(np.uint16)[place]
        out = [zlib.compress(x.tobytes(), 1) for x in np.split(total, np.cumsum(sizes)[:-1])]
        return pa.table({"block": pa.array(numbers, pa.int64()), "part": table.column("part"), "reply": pa.array(out, pa.binary())})

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, data = None, []

        def put() -> None:
            if data:
                write_file(folder, str(held), iter([x for d in data for x in (len(d).to_bytes(4, "little"), d)]))

        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if number != held:
                    put()
                    held, data = number, []
                data.append(blob)
        put()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], names=["n"])

    replies = blocks.mapInArrow(request, _REQUEST).groupBy("part").applyInArrow(reply, "block long, part int, reply binary")
    replies = replies.repartition("block").sortWithinPartitions("block", "part")
    replies.mapInArrow(keep, "n int").agg(F.sum("n")).collect()
    return folder


def answer(folder: str, block: Block, keys: np.ndarray, more: np.ndarray | None, bits: int = 64) -> np.ndarray:
    """Counts in all blocks of a block's keys, in their own order."""
    keys, _, _, place = distinct(keys >> np.uint64(64 - bits), more)
    if not len(keys):
        return np.zeros(0, np.uint16)
    store, path = open_store(folder)
    with store.open_input_stream(f"{path}/{block.number}", compression=None) as f:
        data = f.read()
    at, found = 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        found.append(np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + n]), np.uint16))
        at += 4 + n
    counts = np.concatenate(found)
    if len(counts) != len(keys):
        raise RuntimeError("a block differs from the one that asked: the input changed between two scans")
    return counts[place]


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads sums of products over all bits (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
