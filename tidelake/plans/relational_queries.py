"""Queries of projections, filters and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidelake.operators.relational import complete_cases, row_spec
from tidelake.plans.catalog import query
from tidelake.plans.tables import r6, table


@query("f1_record_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 1000 AND o_custkey % 4 IN (0, 1)")
def f1(spark, sf):
    return table(spark, sf, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 1000) & (F.col("o_custkey") % 4).isin(0, 1)).select("o_orderkey")


@query("f2_side_resolution", "SELECT s_suppkey, CASE WHEN lower(s_name) = lower('SUPPLIER#' || s_suppkey) THEN 'white' WHEN s_suppkey % 2 = 0 THEN 'black' END AS side FROM supplier WHERE lower(s_name) = lower('SUPPLIER#' || s_suppkey) OR s_suppkey % 2 = 0")
def f2(spark, sf):
    own = F.lower("s_name") == F.lower(F.concat(F.lit("SUPPLIER#"), F.col("s_suppkey").cast("string")))
    return table(spark, sf, "supplier").select("s_suppkey", F.when(own, "white").when(F.col("s_suppkey") % 2 == 0, "black").alias("side")).filter("side is not null")


@query("f3_closed_range", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 4000")
def f3(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_acctbal").between(1000, 4000)).select("c_custkey", "c_acctbal")


@query("f4_half_open_band", "SELECT event_id FROM events WHERE value > 0 AND value <= 5")
def f4(spark, sf):
    return table(spark, sf, "events").filter("value > 0 and value <= 5").select("event_id")


@query("f5_ply_window", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 5 AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 4)")
def f5(spark, sf):
    rows = table(spark, sf, "lineitem")
    long = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    return rows.filter("l_linenumber >= 2 and l_linenumber < 5").join(long, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("f6_in_filter", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#7') AND p_type = 'PROMO'")
def f6(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_brand").isin("Brand#1", "Brand#7") & (F.col("p_type") == "PROMO")).select("p_partkey")


@query("f7_column_inequality", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 10 IS DISTINCT FROM l_suppkey % 10")
def f7(spark, sf):
    return _unequal(table(spark, sf, "lineitem"))


def _unequal(lines):
    return lines.filter(~(F.col("l_partkey") % 10).eqNullSafe(F.col("l_suppkey") % 10)).select("l_orderkey", "l_partkey", "l_suppkey")


@query("f8_complete_cases", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND event_type IS NOT NULL")
def f8(spark, sf):
    return complete_cases(table(spark, sf, "events"), "value ~ event_type + user_id:event_type").select("event_id", "value")


@query("f9_finite_rows", "SELECT event_id FROM events WHERE value IS NOT NULL AND isfinite(value) AND isfinite(ln(value))")
def f9(spark, sf):
    from tidelake.operators.aggregates import finite

    return table(spark, sf, "events").withColumn("l", F.ln("value")).filter(finite("value", "l")).select("event_id")


@query("f10_row_spec", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 AND o_custkey % 2 = 0")
def f10(spark, sf):
    names = {"all": F.lit(True), "done": F.col("o_orderstatus") == "F", "dear": F.col("o_totalprice") > 300000, "even": F.col("o_custkey") % 2 == 0}
    return table(spark, sf, "orders").filter(row_spec("done&dear&even", names)).select("o_orderkey")


@query("f11_any_exclusion", "SELECT count(*) FILTER (WHERE l_returnflag = 'A' OR l_linestatus = 'O') AS excluded, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS overlap, count(*) FILTER (WHERE NOT (l_returnflag = 'A' OR l_linestatus = 'O')) AS kept FROM lineitem")
def f11(spark, sf):
    flags = [F.col("l_returnflag") == "A", F.col("l_linestatus") == "O"]
    any_, both = reduce(lambda a, b: a | b, flags), reduce(lambda a, b: a & b, flags)
    return table(spark, sf, "lineitem").agg(F.count_if(any_).alias("excluded"), F.count_if(both).alias("overlap"), F.count_if(~any_).alias("kept"))


@query("f12_discard_reason", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'no_reply' WHEN o_totalprice < 5000 THEN 'no_lines' WHEN o_orderpriority = '5-LOW' THEN 'draw' END AS discard FROM orders")
def f12(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "no_reply").when(F.col("o_totalprice") < 5000, "no_lines").when(F.col("o_orderpriority") == "5-LOW", "draw").alias("discard"))


@query("f13_project_rename", "SELECT s_suppkey AS row_id, s_nationkey AS nation_of, s_acctbal * 2 AS twice FROM supplier")
def f13(spark, sf):
    return table(spark, sf, "supplier").drop("s_name").withColumnsRenamed({"s_suppkey": "row_id", "s_nationkey": "nation_of"}).withColumn("twice", F.col("s_acctbal") * 2).drop("s_acctbal")


@query("f14_case_clip", "SELECT c_custkey, round(greatest(0, least(coalesce(c_acctbal, 0), 5000)), 6) AS clipped, round(abs(c_acctbal), 6) AS size, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS sign FROM customer")
def f14(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", r6(F.greatest(F.lit(0.0), F.least(F.coalesce(b, F.lit(0.0)), F.lit(5000.0)))).alias("clipped"), r6(F.abs(b)).alias("size"), F.when(b < 0, -1).otherwise(1).alias("sign"))


@query("f15_conditional_assignment", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = l_suppkey % 7 THEN 0 ELSE l_quantity - l_linenumber END AS delta FROM lineitem")
def f15(spark, sf):
    return _assigned(table(spark, sf, "lineitem"))


def _assigned(lines):
    same = F.col("l_partkey") % 7 == F.col("l_suppkey") % 7
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.when(same, 0).otherwise(F.col("l_quantity") - F.col("l_linenumber")).alias("delta"))


@query("f16_union_all", "SELECT 'c' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier")
def f16(spark, sf):
    return table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation")).unionByName(table(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation")))


@query("f17_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def f17(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))).dropDuplicates(["nation"])


@query("f18_set_operations", "SELECT 'except' AS op, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'intersect', k FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def f18(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return c.exceptAll(o.distinct()).distinct().select(F.lit("except").alias("op"), "k").unionByName(c.filter("k % 3 = 0").intersect(o).select(F.lit("intersect").alias("op"), "k"))


@query("f19_symmetric_difference", "SELECT count(*) AS n FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def f19(spark, sf):
    from tidelake.operators.joins import compare_outer

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return compare_outer(c.filter("k % 3 <> 0"), c.filter("k % 5 <> 0"), ["k"], []).filter("_merge <> 'both'").agg(F.count(F.lit(1)).alias("n"))


@query("f20_unpivot_tasks", "SELECT s_suppkey, 'a' AS item, s_nationkey AS target FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, 'b', s_nationkey + 100 FROM supplier UNION ALL SELECT s_suppkey, 'c', s_suppkey::INT FROM supplier WHERE s_acctbal < 5000")
def f20(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("int").alias("a"), (F.col("s_nationkey") + 100).cast("int").alias("b"), F.col("s_suppkey").cast("int").alias("c"))
    long = s.unpivot(["s_suppkey", "s_acctbal"], ["a", "b", "c"], "item", "target")
    wanted = F.when(F.col("item") == "a", F.col("s_acctbal") > 0).when(F.col("item") == "c", F.col("s_acctbal") < 5000).otherwise(F.lit(True))
    return long.filter(wanted).select("s_suppkey", "item", "target")


@query("f21_config_grid", "SELECT r_name, d.d AS depth, p.p AS model FROM region, (SELECT unnest([2, 4, 8]) AS d) d, (SELECT unnest(['lmm', 'ols']) AS p) p")
def f21(spark, sf):
    # A grid of settings: explodes of short literals, not a join of tables.
    return table(spark, sf, "region").select("r_name", F.explode(F.array(*[F.lit(d) for d in (2, 4, 8)])).alias("depth")).select("r_name", "depth", F.explode(F.array(F.lit("lmm"), F.lit("ols"))).alias("model"))
