"""Sinks: bucketed shards, append-only stores with unique keys, logs, Markdown."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.scalars import md5_bucket
from tidelake.sources.store import KeyedStore


HEADER = "_columns"


def csv_append(df: DataFrame, path: str, columns: list[str]) -> None:
    """Appends the named columns, in order; others are left out.

    The header is written once, as a file of its own beside the rows' files, whose names make scans of the folder
    pass over it; read_appended() puts both together.
    """
    spark = df.sparkSession
    if not exists(df, f"{path}/{HEADER}"):
        spark.createDataFrame([(",".join(columns),)], "value string").coalesce(1).write.text(f"{path}/{HEADER}")
    elif (before := spark.read.text(f"{path}/{HEADER}").first()["value"].split(",")) != columns:
        raise ValueError(f"{path} holds the columns {before}")
    df.select(*columns).write.mode("append").option("header", False).csv(f"{path}/rows")


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What csv_append() wrote: columns by the header, kinds by the schema."""
    kinds = T.StructType.fromDDL(schema)
    names = spark.read.text(f"{path}/{HEADER}").first()["value"].split(",")
    return spark.read.csv(f"{path}/rows", schema=T.StructType([kinds[n] for n in names])).select(*kinds.names)


def chunked_parquet(df: DataFrame, path: str, metadata: dict[str, str], rows_a_file: int = 2000) -> None:
    """Appends files of at most so many rows, each row with what is known of the run."""
    df.withColumns({k: F.lit(v) for k, v in metadata.items()}).write.mode("append").option("maxRecordsPerFile", rows_a_file).parquet(path)


def checkpointed(df: DataFrame, path: str, key: str, units: int = 200) -> int:
    """Writes what the output lacks, ``units`` keys at a time; returns the number of writes.  After a stop it goes on behind the last one."""
    done = 0
    while True:
        rest = df.join(df.sparkSession.read.parquet(path).select(key).distinct(), key, "left_anti") if exists(df, path) else df
        some = rest.select(key).distinct().orderBy(key).limit(units)
        if some.isEmpty():
            return done
        rest.join(F.broadcast(some), key, "left_semi").write.mode("append").parquet(path)  # a bounded number of keys
        done += 1


def merged_log(df: DataFrame, path: str, key: str) -> DataFrame:
    """The log with its rows replaced by key: the last that was written of each."""
    df.withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").json(path)
    rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("written", T.TimestampType())])).json(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*df.columns), "written").alias("x")).select("x.*")


def figure_series(df: DataFrame, x: str, y: str, se: str | None = None, by: str | None = None) -> DataFrame:
    """What a figure draws: series, x, y, and the ends of the error bar."""
    bar = 1.959963984540054 * F.col(se) if se else F.lit(0.0)
    return df.select((F.col(by).cast("string") if by else F.lit("all")).alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(y) - bar).alias("low"), (F.col(y) + bar).alias("high"))


def bucketed_shards(df: DataFrame, path: str, key: str, rows_a_file: int = 2_000_000) -> None:
    """Appends to bucket=NN folders, NN the key's md5 modulo 16.  One shuffle by bucket and salt keeps files few and buckets parallel."""
    out = df.withColumn("bucket", md5_bucket(F.col(key).cast("string")))
    out.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).write.mode("append").option("maxRecordsPerFile", rows_a_file).partitionBy("bucket").parquet(path)


def store_once(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends rows whose key the store (store.KeyedStore) doesn't hold, one a key; returns how many."""
    return KeyedStore(df.sparkSession, path, keys).append(df).rows


def stored(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What store_once() wrote."""
    return KeyedStore(spark, path, keys).read()


def write_draw(df: DataFrame, path: str, draw: int) -> bool:
    """One draw of a resampling as a folder of its own, there whole or not at all: written aside, then renamed.  False if it was there."""
    if exists(df, f"{path}/draw={draw}"):
        return False
    aside = f"{path}/_{draw}-{uuid.uuid4().hex}"  # scans pass over such names
    df.write.parquet(aside)
    jvm = df.sparkSession.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(f"{path}/draw={draw}")
    files = new.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if files.exists(new) or not files.rename(old, new):
        files.delete(old, True)
        return False
    return True


def exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_new(df: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").parquet(path)


def run_log(df: DataFrame, path: str) -> None:
    """One JSON row appended."""
    df.coalesce(1).write.mode("append").json(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table; refuses more rows than a report has."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows don't make a report table")
    text = [[str(v) if v is not None else "" for v in r] for r in rows]
    width = [max([len(c), *(len(r[i]) for r in text)]) for i, c in enumerate(df.columns)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)) + " |"
    return "\n".join([line(df.columns), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, text)])


def replace_section(report: str, title: str, body: str) -> str:
    """The report with the section under a heading replaced, or added at the end; doing it twice changes nothing."""
    lines, out, skip, done = report.rstrip("\n").split("\n") if report.strip() else [], [], False, False
    for x in lines:
        if x.startswith("#"):
            skip = x.lstrip("# ").strip() == title
            if skip and not done:
                out += [f"## {title}", "", body.strip(), ""]
                done = True
        if not skip:
            out.append(x)
    if not done:
        out += ["", f"## {title}", "", body.strip()] if out else [f"## {title}", "", body.strip()]
    return "\n".join(out).rstrip("\n") + "\n"
