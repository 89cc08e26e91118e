"""Vector code compression: product codes from codebooks that are fitted on all vectors, in exact whole numbers.

Vectors are cut into ``parts`` equal consecutive parts; each part position has a codebook of at
most 256 entries.  Rows are dealt to *blocks*: a block holds its vectors column by column (all first
components, then all second ones, ..) in one binary value, and is written to the shared folder once.

A round is one ``treeAggregate`` over the blocks.  A block's distances to a codebook grow dimension by
dimension, so no array is larger than rows of a step x entries; ``np.add.at`` adds the assigned parts to a tensor of sums
and one of counts, (parts x entries x components) and (parts x entries) whole numbers whatever the table
holds, and the tensors merge pairwise through a reduction tree, so that neither a task nor the
driver meets all of them.  The driver divides: floor(sum / count), unused entries stay.  Sums of whole numbers don't depend on
order, so reruns, lost executors and other partitionings give the same codebooks.

Numbers: a component becomes floor(scale x), from x as double.  Where distances and sums can't leave 64 bits
(found from the largest component) NumPy's int64 is used, else Python's unbounded integers by
the same code; a row's error that doesn't fit in 64 bits raises an error.

Defined cases: rows whose vector is null or holds null or non-finite components take no part, as have
vectors without components.  Ties go to the lower index.  The start is the parts of the ``entries`` smallest identifiers,
rows with equal ones in order of their vectors, null ones last; with fewer rows codebooks are smaller, without any
they are empty and so is the result.  Repeated rows count each.  Null labels are one label.  Vectors of several lengths, or
of one that ``parts`` doesn't divide, raise ValueError.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import drop_staged, stage

_SAFE = 2**62


@dataclass
class Codebooks:
    """books[p] is the codebook of part position p: entries x components, whole numbers."""

    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256, in lower-case hex, of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()


def whole_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v (array<double> of whole numbers) of the rows that take part."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: c.cast("double") * F.lit(float(scale)))
    # floor() of Spark gives a long, which large doubles leave; from 2^53 on a double is whole already.
    v = F.transform(v, lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c))
    return rows.filter(x.isNotNull() & (F.size(x) > 0) & sound).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))


def _in_blocks(vectors: DataFrame, rows_a_block: int) -> DataFrame:
    """ids, labels, data (float64, column by column): the vectors of a stretch of a task's rows."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(vectors.schema["label"].dataType)), T.StructField("data", T.BinaryType())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, rows_a_block) for a in range(0, batch.num_rows, rows_a_block)):
                n, flat = part.num_rows, np.asarray(part.column(2).flatten())
                ends = pa.array([0, n], pa.int32())
                columns = [pa.ListArray.from_arrays(ends, part.column(0)), pa.ListArray.from_arrays(ends, part.column(1)), pa.array([np.ascontiguousarray(flat.reshape(n, -1).T).tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "data"])

    return vectors.mapInArrow(block, schema)


def columns_of(data: bytes, dims: int, kind: type) -> np.ndarray:
    """The block's vectors, components x rows."""
    x = np.frombuffer(data, np.float64).reshape(dims, -1)
    return x.astype(np.int64) if kind is np.int64 else np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)


def nearest(x: np.ndarray, book: np.ndarray, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, ties to the lower, and the squared distance, for parts in columns (components x rows)."""
    n = x.shape[1]
    at, far = np.empty(n, np.int64), np.empty(n, x.dtype)
    for a in range(0, n, step):
        own = x[:, a : a + step]
        total = np.zeros((own.shape[1], len(book)), x.dtype)
        for j in range(len(x)):
            off = np.subtract.outer(own[j], book[:, j])
            off *= off
            total += off
        at[a : a + step] = best = total.argmin(1)
        far[a : a + step] = total[np.arange(len(best)), best]
    return at, far


def _round(blocks: DataFrame, codebooks: Codebooks, kind: type, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts x entries x components) and counts (parts x entries) of the parts assigned to each entry."""
    books = codebooks.books
    parts, (entries, size) = len(books), books[0].shape

    def add(total: tuple[np.ndarray, np.ndarray], row) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        sums, counts = total
        x = columns_of(bytes(row.data), parts * size, kind)
        for p, book in enumerate(books):
            own = x[p * size : (p + 1) * size]
            at, _ = nearest(own, book)
            np.add.at(sums[p], at, own.T)
            np.add.at(counts[p], at, 1)
        return sums, counts

    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    zero = (np.zeros((parts, entries, size), kind), np.zeros((parts, entries), np.int64))
    return blocks.select("data").rdd.treeAggregate(zero, add, merge, depth)


@dataclass
class Fitted:
    codebooks: Codebooks
    blocks: DataFrame
    dims: int
    kind: type


def fit(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rows_a_block: int = 4096, depth: int = 2) -> Fitted:
    """Codebooks after ``rounds`` rounds over all vectors, and the blocks they were fitted on."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits tells at most 256 entries apart")
    vectors = stage(whole_vectors(rows, scale, id_col, vector_col, label_col), "vectors")
    facts = vectors.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("far")).first()
    if not facts["n"]:
        return Fitted(Codebooks([]), _in_blocks(vectors, rows_a_block), 0, np.int64)
    dims = facts["most"]
    if facts["least"] != dims or dims % parts:
        raise ValueError(f"vectors have {facts['least']} to {dims} components: all must have one length that {parts} divides")
    if facts["far"] == float("inf"):
        raise ValueError("a scaled component leaves the range of doubles")
    far = int(facts["far"]) + 1
    kind = np.int64 if dims * (2 * far) ** 2 < _SAFE and facts["n"] * far < _SAFE else object
    first = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    start = columns_of(np.array([r["v"] for r in first], np.float64).T.tobytes(), dims, kind).T
    books = [np.ascontiguousarray(p) for p in np.split(start, parts, 1)]
    blocks = stage(_in_blocks(vectors, rows_a_block), "vector-blocks")
    drop_staged(vectors)
    for _ in range(rounds):
        sums, counts = _round(blocks, Codebooks(books), kind, depth)
        used = counts > 0
        for p, book in enumerate(books):
            fresh = book.copy()
            fresh[used[p]] = sums[p][used[p]] // counts[p][used[p]][:, None]
            books[p] = fresh
    return Fitted(Codebooks(books), blocks, dims, kind)


def encode(fitted: Fitted) -> DataFrame:
    """id, label, code (two hex digits a part), error (squared distance over all parts) of every vector."""
    blocks, books, dims, kind = fitted.blocks, fitted.codebooks.books, fitted.dims, fitted.kind
    label = blocks.schema["labels"].dataType.elementType
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    hexes = np.array([f"{k:02x}" for k in range(256)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(k, 1).flatten() for c in (0, 1))
                x = columns_of(batch.column(2)[k].as_buffer().to_pybytes(), dims, kind)
                code, error = np.full(len(ids), ""), np.zeros(len(ids), kind)
                for own, book in zip(np.split(x, len(books)), books, strict=True):
                    at, far = nearest(own, book)
                    code, error = np.char.add(code, hexes[at]), error + far
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code.tolist(), pa.string()), pa.array(error.tolist(), pa.int64())], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(assign, schema)


def compress(rows: DataFrame, label_salts: int = 64, **options) -> DataFrame:
    """One row a vector: id, code, error, label_error, codebooks_sha256.

    Errors of a label are partial sums; they go back to rows over (label, salt), so that a label that a third of all rows have is no one task's.
    """
    fitted = fit(rows, **options)
    coded = stage(encode(fitted), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(label_salts - 1)))).withColumnRenamed("label", "__label")
    salted = coded.withColumn("__salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(label_salts)).cast("int")).withColumnRenamed("label", "__own")
    both = salted.join(sums, salted["__own"].eqNullSafe(sums["__label"]) & (salted["__salt"] == sums["__salt"]))
    return both.select("id", "code", "error", "label_error", F.lit(fitted.codebooks.digest()).alias("codebooks_sha256"))
