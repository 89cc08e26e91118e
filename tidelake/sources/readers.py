"""Scans: text formats with rules of their own, resumable stores, games, Markdown, external services as tables.

Services (rosters, archives, search, engines) are *sources whose outputs are tables*: a reader takes the table that
a collector has written; nothing here makes a request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def csv_typed(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, drop_bad: bool = False) -> DataFrame:
    """CSV with a pinned schema; only the asked columns are parsed.  drop_bad: every value is tried as its type and rows with one that fails go."""
    kinds = T.StructType.fromDDL(schema)
    if not drop_bad:
        df = spark.read.csv(path, header=True, schema=kinds)
        return df.select(*columns) if columns else df
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in kinds])
    df = spark.read.csv(path, header=True, schema=text).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds if not columns or f.name in columns])
    return df.dropna()


def resolved_columns(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Renames columns found by any of several names, whatever their case; the first that is there wins."""
    there = {c.lower(): c for c in df.columns}
    found = {}
    for name, options in wanted.items():
        hit = next((there[o.lower()] for o in options if o.lower() in there), None)
        if hit is None:
            raise ValueError(f"none of {options} is a column")
        found[name] = hit
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items()])


def parquet_shards(spark: SparkSession, path: str, keys: list[str], order: list[str], tolerant: bool = False) -> DataFrame:
    """All shards below a folder, one row a key: the first in the order.  tolerant: files that can't be read are passed over."""
    df = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", tolerant).option("mergeSchema", tolerant).parquet(path)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def json_lines(spark: SparkSession, path: str, schema: str, key: str, last: bool = False) -> DataFrame:
    """JSON lines without those that don't parse; of equal keys the first (or last) in file and line order stays."""
    rows = _lines(spark, path).select("value", F.col("file").alias("__f"), F.col("at").alias("__n"))
    parsed = rows.withColumn("__x", F.from_json("value", schema, {"mode": "PERMISSIVE"})).filter(F.col(f"__x.{key}").isNotNull())
    pick = (F.max_by if last else F.min_by)("__x", F.struct("__f", "__n"))
    return parsed.groupBy(F.col(f"__x.{key}").alias("__k")).agg(pick.alias("x")).select("x.*")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at, value: lines with their place.  Within a file numbers rise with the line; files are told apart by name, not by number."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.struct(F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("line")).alias("at"), "value")


def log_tail(spark: SparkSession, path: str, pattern: str, n: int = 3) -> DataFrame:
    """The last n lines that match, files in order of name: at, line."""
    rows = _lines(spark, path).select("file", "at", F.col("value").alias("line")).filter(F.rlike("line", F.lit(pattern)))
    return rows.orderBy(F.desc("file"), F.desc("at")).limit(n).select("at", "line")


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """title, row, cells of every table row of Markdown files: the title is the last heading above; separator rows are left out."""
    rows = _lines(spark, path)
    order = Window.partitionBy("file").orderBy("at")
    titled = rows.withColumn("title", F.last(F.when(F.rlike("value", F.lit("^#+ ")), F.regexp_replace("value", "^#+ +", "")), True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    table = titled.filter(F.rlike("value", F.lit(r"^\s*\|")) & ~F.rlike("value", F.lit(r"^[\s|:-]+$")))
    return table.select("file", "title", F.row_number().over(Window.partitionBy("file", "title").orderBy("at")).alias("row"), cells.alias("cells"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files; for tools and engines named in results."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def back_filled(df: DataFrame, schema: str) -> DataFrame:
    """A table of an older layout in today's: columns that it lacks are null."""
    kinds = T.StructType.fromDDL(schema)
    return df.unionByName(df.sparkSession.createDataFrame([], kinds), allowMissingColumns=True).select(*kinds.names)


def newest_games(archive: DataFrame, user: str, month: str, seq: str, months: int, most: int, valid: Column | None = None) -> DataFrame:
    """By user, the last ``months`` months, newest first, up to ``most`` valid games."""
    ranked = archive.withColumn("__m", F.dense_rank().over(Window.partitionBy(user).orderBy(F.desc(month)))).filter(F.col("__m") <= months)
    if valid is not None:
        ranked = ranked.filter(valid)
    w = Window.partitionBy(user).orderBy(F.desc(month), F.desc(seq))
    return ranked.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__m", "__r")


#: Variations within variations that are taken out.
VARIATIONS = 6


def keys_of(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Distinct keys of a Parquet store; nothing else is read."""
    return spark.read.parquet(path).select(*keys).distinct()


def csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose columns' types are found by a pass over all rows."""
    return spark.read.csv(path, header=True, inferSchema=True)


def rows_by_month(archive: DataFrame, user: str, month: str, seq: str, months: int, most: int) -> DataFrame:
    """newest_games() with the number of months looked into, by user."""
    some = newest_games(archive, user, month, seq, months, most)
    return some.groupBy(user).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(month).alias("months"), F.max(month).alias("newest"))


def pgn_headers(pgn: Column) -> Column:
    """Map of a game text's tags."""
    pairs = lambda k: F.regexp_extract_all(pgn, F.lit(r'\[(\w+) "([^"]*)"\]'), F.lit(k))
    return F.map_from_entries(F.array_distinct(F.arrays_zip(pairs(1), pairs(2))))


def pgn_moves(pgn: Column) -> Column:
    """array<struct<ply, san, clk>> of a game text; clk in seconds where a move has a clock comment."""
    body = F.regexp_replace(pgn, r'(?m)^\[[^\]]*\]\s*$', "")
    flat = F.regexp_replace(body, r"\$\d+", " ")
    for _ in range(VARIATIONS):  # the innermost go first
        flat = F.regexp_replace(flat, r"\([^()]*\)", " ")
    token = r"((?:[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?|O-O-O|O-O)[+#]?)[!?]*\s*(?:\{([^}]*)\})?"
    sans, comments = (F.regexp_extract_all(flat, F.lit(token), F.lit(k)) for k in (1, 2))
    clock = lambda c: F.regexp_extract(c, r"%clk (\d+):(\d+):([\d.]+)", 1).try_cast("double") * 3600 + F.regexp_extract(c, r"%clk (\d+):(\d+):([\d.]+)", 2).try_cast("double") * 60 + F.regexp_extract(c, r"%clk (\d+):(\d+):([\d.]+)", 3).try_cast("double")
    zipped = F.arrays_zip(sans.alias("san"), comments.alias("comment"))
    return F.transform(zipped, lambda x, i: F.struct(i.alias("ply"), x["san"].alias("san"), clock(x["comment"]).alias("clk")))
