"""What the operators of this subpackage share: staged tables, word patterns, salted ranks.

A *staged table* is a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir``.  It cuts lineage, survives the loss of executors and
is written once, where a second read of a lazy frame would compute it again.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Fixed values of the contracts: white space is space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is set."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir isn't set: on a cluster it has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = own = tempfile.mkdtemp(prefix="tidelake-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{_own_dirs[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back with its own schema."""
    path, writer = new_path(df.sparkSession, name), df.write
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, staged, with the column __row: a number for each row, whatever its identifiers are."""
    return stage(df.withColumn("__row", F.monotonically_increasing_id()), name)


def remove_path(spark: SparkSession, path: str) -> None:
    """Frees a staged table that no lazy frame reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_staged(df: DataFrame) -> None:
    """Frees a frame that stage() returned."""
    for path in {f.split("/part-")[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, path)


def word_count(text: Column) -> Column:
    """Number of words as long; null has none.

    Only \\z is the end of a text and nothing else: in Java $ also holds before a last line end, U+0085, U+2028 and U+2029 among them.
    """
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\A{SPACE}|{SPACE}\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def salt_count(rows: int, least: int = 256, per_salt: int = 8192) -> int:
    """Salts that keep a group with all the rows at about per_salt rows a salt."""
    return max(least, -(-rows // per_salt))


def salted_rank(df: DataFrame, keys: list[str], order: list[str], salt: str, tie: list[str], out: str, attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``out``, each row's rank (long, from 0) in its group of ``keys``, in the order (``order``, ``salt``, ``tie``).

    No task sorts a whole group.  Rows are ranked in cells (keys, order, salt); a cell's
    start is the number of rows in the cells before it: those of earlier (keys, order), found over totals of
    these, and those of smaller salts.  So rows meet by cell, cells by (keys, order), and only totals by keys.
    ``df`` should be a staged table, as it is read twice.  ``attach`` can join columns to the
    totals (keys are named __c0, __c1, ..) before the cells meet them.
    """
    cell, group = [*keys, *order, salt], [*keys, *order]
    marks = {c: f"__c{i}" for i, c in enumerate(cell)}
    counts = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(c).alias(m) for c, m in marks.items()], "__n")
    inner = Window.partitionBy(*[marks[c] for c in group]).orderBy(marks[salt]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(inner), F.lit(0))).drop("__n")
    if order:
        outer = Window.partitionBy(*[marks[k] for k in keys]).orderBy(*[F.asc_nulls_last(marks[c]) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
        totals = counts.groupBy(*[marks[c] for c in group]).agg(F.sum("__n").alias("__n"))
        totals = totals.withColumn("__before", F.coalesce(F.sum("__n").over(outer), F.lit(0))).drop("__n")
        totals = attach(totals) if attach else totals
        totals = totals.withColumnsRenamed({marks[c]: f"__t{i}" for i, c in enumerate(group)})
        starts = starts.join(totals, [starts[marks[c]].eqNullSafe(totals[f"__t{i}"]) for i, c in enumerate(group)])
        starts = starts.withColumn("__start", F.col("__start") + F.col("__before")).drop("__before", *[f"__t{i}" for i in range(len(group))])
    local = F.row_number().over(Window.partitionBy(*cell).orderBy(*[F.asc_nulls_last(c) for c in tie])) - 1
    ranked = df.withColumn("__local", local)
    both = ranked.join(starts, [ranked[c].eqNullSafe(starts[m]) for c, m in marks.items()])
    return both.withColumn(out, F.col("__start") + F.col("__local")).drop(*marks.values(), "__start", "__local")


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def worker_state(key: tuple, make: Callable):
    """What a Python worker keeps from task to task: functions are new in each task, modules aren't.  It holds one thing: the last that was asked for."""
    import sys
    import types

    held = sys.modules.setdefault("_tidelake_worker", types.ModuleType("_tidelake_worker")).__dict__
    if held.get("key") != key:
        held.clear()
        held.update(key=key, value=make())
    return held["value"]


@contextmanager
def batches_of(spark: SparkSession, rows: int, most_bytes: int = 8_000_000) -> Iterator[None]:
    """Rows, and bytes, in an Arrow batch of the jobs within; the session's own limits hold again afterwards."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": most_bytes}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def text_batches(spark: SparkSession, rows: int = 500):  # noqa: ANN201
    """Batches of at most ``rows`` rows for the jobs within: rows are whole texts."""
    before = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    return batches_of(spark, min(rows, before) if before > 0 else rows)
