"""Queries of scans and sinks: a table is written in the format, read back by its reader, and has to be what it was.

Files go to the shared folder of the session (spark.checkpoint.dir; a temporary one in local mode).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.plans.catalog import query
from tidelake.plans.tables import r6, table
from tidelake.sources import readers as R
from tidelake.sources import writers as W
from tidelake.sources.staging import new_path


_new = new_path


@query("a1_csv_inferred", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM customer")
def a1(spark, sf):
    path = _new(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("header", True).csv(path)
    return R.csv_inferred(spark, path).select("c_custkey", "c_name", "c_nationkey", r6(F.col("c_acctbal")).alias("c_acctbal"))


@query("a2_csv_drop_bad_rows", "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer WHERE c_custkey % 4 <> 0")
def a2(spark, sf):
    path = _new(spark, "csv")
    balance = F.when(F.col("c_custkey") % 4 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    table(spark, sf, "customer").select("c_custkey", balance.alias("c_acctbal")).write.option("header", True).csv(path)
    return R.csv_typed(spark, path, "c_custkey long, c_acctbal double", drop_bad=True).select("c_custkey", r6(F.col("c_acctbal")).alias("c_acctbal"))


@query("a3_a4_csv_projected", "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment FROM customer")
def a3(spark, sf):
    path = _new(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    return R.csv_typed(spark, path, "c_custkey string, c_name string, c_mktsegment string", ["c_custkey", "c_mktsegment"])


@query("a5_resolved_columns", "SELECT s_name AS name, s_nationkey AS nation FROM supplier")
def a5(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("PLAYER"), F.col("s_nationkey").alias("Fed"))
    return R.resolved_columns(rows, {"name": ("name", "player"), "nation": ("country", "fed")})


@query("a6_a8_parquet_shards", "SELECT o_orderkey, o_custkey, 0 AS run FROM orders")
def a6(spark, sf):
    path = _new(spark, "shards")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    for run in (0, 1):  # the second run repeats every other key
        W.bucketed_shards(rows.filter(F.lit(run == 0) | (F.col("o_orderkey") % 2 == 0)).withColumn("run", F.lit(run)), f"{path}/run={run}", "o_orderkey")
    jvm = spark.sparkContext._jvm
    bad = jvm.org.apache.hadoop.fs.Path(f"{path}/bad.parquet")
    out = bad.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(bad)
    out.writeBytes("not a table")
    out.close()
    return R.parquet_shards(spark, path, ["o_orderkey"], ["run"], tolerant=True).select("o_orderkey", "o_custkey", "run")


@query("a7_stored_keys", "SELECT DISTINCT l_orderkey FROM lineitem")
def a7(spark, sf):
    return R.keys_of(spark, f"{sf}/lineitem.parquet", ["l_orderkey"])


@query("a9_json_lines", "SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0")
def a9(spark, sf):
    path = _new(spark, "lines")
    good = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken"), F.col("event_id").cast("string"))).otherwise(good)
    rows = table(spark, sf, "events").select(line.alias("value"))
    rows.unionAll(rows.filter("value like '%click%'")).write.text(path)  # some lines come twice
    return R.json_lines(spark, path, "event_id long, event_type string", "event_id")


@query("a10_json_document", "SELECT n_nationkey, n_name FROM nation")
def a10(spark, sf):
    path = _new(spark, "document")
    whole = table(spark, sf, "nation").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))).alias("value"))  # 25 rows
    whole.write.text(path)
    return R.json_document(spark, path, "nations array<struct<n_nationkey:long,n_name:string>>").select(F.explode("nations").alias("x")).select("x.*")


@query("a11_game_text", "SELECT o_orderkey, 'C' || o_custkey AS white, o_orderkey % 60 AS clk, 5 AS plies, 'e4 e5 Nf3 Nc6 O-O' AS sans FROM orders")
def a11(spark, sf):
    head = F.concat(F.lit('[White "C'), F.col("o_custkey").cast("string"), F.lit('"]\n[Result "1-0"]\n\n'))
    clock = F.format_string("{[%%clk 0:00:%02d]}", F.col("o_orderkey") % 60)
    game = F.concat(head, F.lit("1. e4 "), clock, F.lit(" e5 $1 (1... c5 2. Nf3 (2. c3 d5) d6) 2. Nf3 Nc6 {best} 3. O-O 1-0\n"))
    read = table(spark, sf, "orders").select("o_orderkey", R.pgn_headers(game).alias("tags"), R.pgn_moves(game).alias("moves"))
    return read.select("o_orderkey", F.col("tags")["White"].alias("white"), F.col("moves")[0]["clk"].cast("long").alias("clk"), F.size("moves").alias("plies"), F.array_join(F.col("moves.san"), " ").alias("sans"))


@query("a24_file_digests", "SELECT r_regionkey, sha256('engine ' || r_regionkey) AS sha256 FROM region")
def a24(spark, sf):
    path = _new(spark, "files")
    jvm = spark.sparkContext._jvm
    for r in table(spark, sf, "region").select("r_regionkey").collect():  # five rows
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{r[0]}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.writeBytes(f"engine {r[0]}")
        out.close()
    return R.file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).cast("int").alias("r_regionkey"), "sha256")


@query("a25_b10_markdown", "SELECT row_number() OVER (ORDER BY n_nationkey) + 1 AS row, 'Nations' AS title, n_nationkey::VARCHAR AS a, n_name AS b FROM nation UNION ALL SELECT 1, 'Nations', 'n_nationkey', 'n_name'")
def a25(spark, sf):
    path = _new(spark, "report")
    text = W.replace_section("# Report\n\n## Nations\n\nold\n", "Nations", W.markdown_table(table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return R.markdown_tables(spark, path).select("row", "title", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("a26_log_tail", "SELECT 'done ' || n_nationkey AS line FROM nation ORDER BY n_nationkey DESC LIMIT 3")
def a26(spark, sf):
    path = _new(spark, "log")
    table(spark, sf, "nation").orderBy("n_nationkey").coalesce(1).select(F.explode(F.array(F.concat(F.lit("done "), F.col("n_nationkey").cast("string")), F.lit("noise"))).alias("value")).write.text(path)
    return R.log_tail(spark, path, "^done ").select("line")


@query("b2_csv_append", "SELECT s_suppkey, s_name FROM supplier")
def b2(spark, sf):
    path, rows = _new(spark, "appended"), table(spark, sf, "supplier")
    for k in (0, 1):
        W.csv_append(rows.filter(F.col("s_suppkey") % 2 == k), path, ["s_suppkey", "s_name"])
    return W.read_appended(spark, path, "s_suppkey long, s_name string")


@query("b3_checkpoints", "SELECT s_suppkey, s_nationkey FROM supplier")
def b3(spark, sf):
    path = _new(spark, "units")
    W.checkpointed(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), path, "s_nationkey", units=9)
    return spark.read.parquet(path)


@query("b5_chunked_parquet", "SELECT p_partkey, 'r1' AS run, 'x' AS engine FROM part")
def b5(spark, sf):
    path = _new(spark, "chunks")
    W.chunked_parquet(table(spark, sf, "part").select("p_partkey"), path, {"run": "r1", "engine": "x"})
    return spark.read.parquet(path)


@query("b8_merged_log", "SELECT n_nationkey, n_name, n_regionkey + 1 AS state FROM nation")
def b8(spark, sf):
    path, rows = _new(spark, "log"), table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    W.merged_log(rows.select("n_nationkey", "n_name", F.col("n_regionkey").alias("state")), path, "n_nationkey")
    return W.merged_log(rows.select("n_nationkey", "n_name", (F.col("n_regionkey") + 1).alias("state")), path, "n_nationkey")


@query("b12_figure_series", "SELECT l_returnflag AS series, l_linenumber::DOUBLE AS x, round(avg(l_quantity), 6) AS y, round(avg(l_quantity) - 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS low, round(avg(l_quantity) + 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS high FROM lineitem GROUP BY l_returnflag, l_linenumber")
def b12(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("m"), (F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return W.figure_series(g, "l_linenumber", "m", "se", "l_returnflag").select("series", "x", *[r6(F.col(c)).alias(c) for c in ("y", "low", "high")])


@query("b13_store_once", "SELECT c_custkey, c_name FROM customer")
def b13(spark, sf):
    path, rows = _new(spark, "store"), table(spark, sf, "customer").select("c_custkey", "c_name")
    W.store_once(rows.filter("c_custkey % 3 <> 0"), path, ["c_custkey"])
    W.store_once(rows.unionAll(rows), path, ["c_custkey"])
    return W.stored(spark, path, ["c_custkey"])
