"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.operators import aggregates as A
from tidelake.plans.catalog import query
from tidelake.plans.tables import MOVES, moves, r6, table

_SUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("d1_group_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n_games, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _SUMS) + " FROM lineitem GROUP BY l_returnflag, l_linestatus")
def d1(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_games"), *[r6(F.avg(c)).alias(c) for c in _SUMS])


@query("d2_many_keys", "SELECT l_returnflag, l_linestatus, l_linenumber, l_discount, l_tax, count(*) AS n, round(avg(l_quantity), 6) AS qty FROM lineitem WHERE l_tax IS NOT NULL GROUP BY 1, 2, 3, 4, 5")
def d2(spark, sf):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"]
    return table(spark, sf, "lineitem").dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity")).alias("qty"))


@query("d3_two_stage_mean", """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT o_custkey, sum(n)::BIGINT AS n, round(sum(v * n) / sum(n), 4) AS o_totalprice FROM c GROUP BY o_custkey""")
def d3(spark, sf):
    out = A.two_stage_mean(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], ["o_custkey"], ["o_totalprice"])
    return out.select("o_custkey", "n", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("d4_count_distinct", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(DISTINCT o_orderpriority) AS priorities FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def d4(spark, sf):
    both = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return both.groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("d5_value_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def d5(spark, sf):
    return A.value_counts(table(spark, sf, "events"), "event_type").withColumn("share", r6(F.col("share")))


@query("d6_conditional_shares", "SELECT o_orderstatus, round(avg((o_totalprice > 100000)::INT), 6) AS dear, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def d6(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(r6(A.share(F.col("o_totalprice") > 100000)).alias("dear"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("d7_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS a, round(quantile_cont(l_extendedprice, 0.5), 6) AS b, round(quantile_cont(l_extendedprice, 0.99), 6) AS c FROM lineitem GROUP BY 1")
def d7(spark, sf):
    q = A.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.99])
    return q.select("l_returnflag", *[r6(F.col("q")[i]).alias(c) for i, c in enumerate("abc")])


@query("d8_winsorised", "WITH w AS (SELECT quantile_cont(o_totalprice, 0.99) AS cut FROM orders) SELECT o_orderkey, round(least(o_totalprice, cut), 6) AS clipped, round(cut, 6) AS winsor_cut FROM orders, w")
def d8(spark, sf):
    return A.winsorised(table(spark, sf, "orders"), "o_totalprice", 0.99, "clipped").select("o_orderkey", r6(F.col("clipped")).alias("clipped"), r6(F.col("winsor_cut")).alias("winsor_cut"))


@query("d9_distribution", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", max(value) AS max FROM events GROUP BY 1")
def d9(spark, sf):
    out = A.distribution(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", "n", "min", "max", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "p10", "p25", "p50", "p75", "p90")])


@query("d10_deviations", "SELECT l_linenumber, round(stddev_samp(l_quantity), 6) AS s1, round(stddev_pop(l_quantity), 6) AS s0, round(var_samp(l_quantity), 6) AS v1, round(var_pop(l_quantity), 6) AS v0 FROM lineitem GROUP BY 1")
def d10(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(*[r6(f("l_quantity")).alias(c) for f, c in ((F.stddev_samp, "s1"), (F.stddev_pop, "s0"), (F.var_samp, "v1"), (F.var_pop, "v0"))])


@query("d11_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_SUMS) for b in _SUMS[i + 1 :]))
def d11(spark, sf):
    return A.correlation_matrix(table(spark, sf, "lineitem"), _SUMS).withColumn("r", r6(F.col("r")))


@query("d12_correlation_interval", "WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS hi FROM c")
def d12(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count(F.lit(1)).alias("n"))
    half = F.lit(1.959963984540054) / F.sqrt(F.col("n") - 3)
    return c.select("l_returnflag", r6(F.col("r")).alias("r"), r6(F.tanh(F.atanh("r") - half)).alias("lo"), r6(F.tanh(F.atanh("r") + half)).alias("hi"))


@query("d13_spearman_ordinal", f"WITH {MOVES}, r AS (SELECT type, row_number() OVER (PARTITION BY type ORDER BY value, event_id) AS a, row_number() OVER (PARTITION BY type ORDER BY ply, event_id) AS b FROM m) SELECT type, round(corr(a, b), 6) AS rho FROM r GROUP BY type")
def d13(spark, sf):
    return A.rank_correlation(moves(spark, sf), "value", "ply", ["type"], ["event_id"], average=False).withColumn("rho", r6(F.col("rho")))


@query("d14_spearman_average", f"WITH {MOVES}, r AS (SELECT type, rank() OVER (PARTITION BY type ORDER BY value) + (count(*) OVER (PARTITION BY type, value) - 1) / 2 AS a, rank() OVER (PARTITION BY type ORDER BY ply) + (count(*) OVER (PARTITION BY type, ply) - 1) / 2 AS b FROM m) SELECT type, round(corr(a, b), 6) AS rho FROM r GROUP BY type")
def d14(spark, sf):
    return A.rank_correlation(moves(spark, sf), "value", "ply", ["type"], [], average=True).withColumn("rho", r6(F.col("rho")))


@query("d15_slopes", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(covar_samp(l_extendedprice, l_quantity) / var_samp(l_quantity), 6) AS ratio FROM lineitem GROUP BY 1")
def d15(spark, sf):
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(F.regr_slope(y, x)).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), r6(F.covar_samp(y, x) / F.var_samp(x)).alias("ratio"))


@query("d16_pivot", "SELECT l_linenumber, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS q_A, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS q_N, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS q_R FROM lineitem GROUP BY 1")
def d16(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(r6(F.sum("l_quantity")).alias("q"))
    return A.long_to_wide(sums, ["l_linenumber"], "l_returnflag", ["A", "N", "R"], ["q"])


@query("d17_pivot_values", "SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (WHERE event_type = '{t}'), 6) AS s_{t}, count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in ("click", "view")) + " FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def d17(spark, sf):
    sums = table(spark, sf, "events").filter("event_type in ('click', 'view')").groupBy("user_id", "event_type").agg(r6(F.sum("value")).alias("s"), F.count(F.lit(1)).alias("n"))
    return A.long_to_wide(sums, ["user_id"], "event_type", ["click", "view"], ["s", "n"]).fillna(0, ["n_click", "n_view"])


@query("d18_crosstab_chi2", """WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS observed FROM lineitem GROUP BY 1, 2), f AS (SELECT x.a, y.b, coalesce(observed, 0) AS observed FROM (SELECT DISTINCT l_returnflag AS a FROM lineitem) x CROSS JOIN (SELECT DISTINCT l_linestatus AS b FROM lineitem) y LEFT JOIN o ON o.a = x.a AND o.b = y.b),
e AS (SELECT *, sum(observed) OVER (PARTITION BY a)::DOUBLE * sum(observed) OVER (PARTITION BY b)::DOUBLE / sum(observed) OVER ()::DOUBLE AS expected FROM f)
SELECT a AS l_returnflag, b AS l_linestatus, observed, round(expected, 6) AS expected, round(sum(pow(observed - expected, 2) / expected) OVER (), 6) AS chi2 FROM e""")
def d18(spark, sf):
    return A.crosstab_chi2(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", "observed", r6(F.col("expected")).alias("expected"), r6(F.col("chi2")).alias("chi2"))


@query("d19_first_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def d19(spark, sf):
    # The smallest struct, not a sort: partial aggregates keep one row a key and task.
    first = F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(first).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


@query("d20_distinct_ids", "SELECT DISTINCT l_partkey FROM lineitem ORDER BY 1")
def d20(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey").distinct().orderBy("l_partkey")


@query("d21_min_max_curve", "SELECT o_orderdate::DATE::VARCHAR AS day, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1")
def d21(spark, sf):
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("d22_external_weights", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def d22(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(A.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("mean"))


@query("d23_pooled_variance", "WITH u AS (SELECT event_type, user_id, count(value) AS n, var_samp(value) AS s2 FROM events GROUP BY 1, 2) SELECT event_type, round(sum((n - 1) * s2) / sum(n - 1), 6) AS pooled FROM u WHERE n >= 2 GROUP BY 1")
def d23(spark, sf):
    return A.pooled_variance(table(spark, sf, "events"), ["event_type"], ["user_id"], "value").withColumn("pooled", r6(F.col("pooled")))


@query("d24_group_sums", "SELECT user_id, round(sum(value), 6) AS s, count(*) AS n, round(sum(value * value), 4) AS s2 FROM events GROUP BY 1")
def d24(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(r6(F.sum("value")).alias("s"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") ** 2), 4).alias("s2"))


@query("d25_mad", "WITH d AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1) SELECT e.event_type, round(any_value(med), 6) AS median, round(1.4826 * median(abs(value - med)), 6) AS scale FROM events e JOIN d ON e.event_type = d.event_type GROUP BY 1")
def d25(spark, sf):
    out = A.mad_scale(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", r6(F.col("median")).alias("median"), r6(F.col("scale")).alias("scale"))


@query("d26_sign_counts", f"WITH {MOVES}, d AS (SELECT type, value - lag(value) OVER (PARTITION BY game ORDER BY ply) AS d FROM m) SELECT type, count(*) FILTER (WHERE d < 0) AS neg, count(*) FILTER (WHERE d > 0) AS pos, count(*) FILTER (WHERE d = 0) AS zero FROM d GROUP BY 1")
def d26(spark, sf):
    d = moves(spark, sf).withColumn("d", F.col("value") - F.lag("value").over(Window.partitionBy("game").orderBy("ply")))
    return d.groupBy("type").agg(*[F.count_if(p).alias(n) for n, p in (("neg", F.col("d") < 0), ("pos", F.col("d") > 0), ("zero", F.col("d") == 0))])


_LINES = "l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity DESC)[1:5] AS w FROM lineitem GROUP BY 1)"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.slice(F.sort_array(F.collect_list("l_quantity"), False), 1, 5).alias("w"))


@query("d27_near_best_lines", f"WITH {_LINES} SELECT l_orderkey, len(list_filter(w, lambda x: w[1] - x <= 5)) AS n_reasonable FROM l")
def d27(spark, sf):
    return _lines(spark, sf).select("l_orderkey", F.size(F.filter("w", lambda x: F.col("w")[0] - x <= 5)).alias("n_reasonable"))


@query("d28_last_not_null", f"WITH {_LINES} SELECT l_orderkey, coalesce(w[5], w[4], w[3], w[2], w[1]) AS last FROM l")
def d28(spark, sf):
    return _lines(spark, sf).select("l_orderkey", F.coalesce(*[F.get("w", F.lit(i)) for i in (4, 3, 2, 1, 0)]).alias("last"))


@query("d29_decile_table", "SELECT least(floor(l_discount * 100), 9)::INT AS bin, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS se FROM lineitem GROUP BY 1")
def d29(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("bin", F.least(F.floor(F.col("l_discount") * 100), F.lit(9)).cast("int"))
    return A.decile_table(rows, "bin", "l_quantity").select("bin", "n", r6(F.col("mean")).alias("mean"), r6(F.col("se")).alias("se"))


@query("d30_with_total", "SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'ALL' ELSE c_mktsegment END AS c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS bal FROM customer GROUP BY ROLLUP (c_mktsegment)")
def d30(spark, sf):
    return A.with_total(table(spark, sf, "customer"), "c_mktsegment", [F.count(F.lit(1)).alias("n"), r6(F.avg("c_acctbal")).alias("bal")])


_BANDS = ["low", "mid", "high", "top"]


@query("d31_all_labels", "WITH b AS (SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' WHEN o_totalprice < 10000000 THEN 'high' ELSE 'top' END AS band FROM orders), d AS (SELECT 0 AS place, 'low' AS band UNION ALL SELECT 1, 'mid' UNION ALL SELECT 2, 'high' UNION ALL SELECT 3, 'top') SELECT place, d.band, count(b.band) AS n FROM d LEFT JOIN b ON b.band = d.band GROUP BY 1, 2")
def d31(spark, sf):
    p = F.col("o_totalprice")
    band = F.when(p < 100000, "low").when(p < 300000, "mid").when(p < 10000000, "high").otherwise("top")
    return A.counts_of_all(table(spark, sf, "orders").select(band.alias("band")), "band", _BANDS)


@query("d32_variance_parts", "WITH u AS (SELECT event_type, user_id, avg(value) AS m, var_samp(value) / count(*) AS e FROM events GROUP BY 1, 2 HAVING count(*) >= 2) SELECT event_type, round(var_samp(m), 6) AS observed, round(avg(e), 6) AS noise, round(var_samp(m) - avg(e), 6) AS true_var, round(100 * avg(e) / var_samp(m), 6) AS noise_pct FROM u GROUP BY 1")
def d32(spark, sf):
    u = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), (F.var_samp("value") / F.count(F.lit(1))).alias("e"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return u.groupBy("event_type").agg(r6(F.var_samp("m")).alias("observed"), r6(F.avg("e")).alias("noise"), r6(F.var_samp("m") - F.avg("e")).alias("true_var"), r6(100 * F.avg("e") / F.var_samp("m")).alias("noise_pct"))


@query("d33_funnel", "SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'late' ELSE 'other' END AS outcome, count(*) AS n FROM orders GROUP BY 1, 2")
def d33(spark, sf):
    steps = [("done", F.col("o_orderstatus") == "F"), ("large", F.col("o_totalprice") > 200000), ("late", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))]
    return A.funnel(table(spark, sf, "orders"), ["o_orderpriority"], steps, "other")


@query("d34_having", "SELECT user_id, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 60")
def d34(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(r6(F.avg("value")).alias("mean"), F.count(F.lit(1)).alias("n")).filter("n >= 60")


@query("d36_tolerance_ladder", f"WITH {MOVES}, d AS (SELECT abs(value - lag(value) OVER (PARTITION BY game ORDER BY ply)) AS d FROM m) SELECT round(max(d), 6) AS max_diff, count(*) FILTER (WHERE d > 1) AS above_0, count(*) FILTER (WHERE d > 10) AS above_1 FROM d")
def d36(spark, sf):
    m = moves(spark, sf).withColumn("before", F.lag("value").over(Window.partitionBy("game").orderBy("ply")))
    return m.agg(*A.tolerance_ladder("value", "before", [1.0, 10.0])).withColumn("max_diff", r6(F.col("max_diff")))


@query("d37_share_surviving", "WITH a AS (SELECT stddev_samp(o_totalprice) AS s FROM orders), b AS (SELECT stddev_samp(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F') SELECT round(b.s / a.s, 6) AS surviving, round(1 - b.s / a.s, 6) AS lost FROM a, b")
def d37(spark, sf):
    s = table(spark, sf, "orders").agg(F.stddev_samp("o_totalprice").alias("a"), F.stddev_samp(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("b"))
    return s.select(r6(F.col("b") / F.col("a")).alias("surviving"), r6(1 - F.col("b") / F.col("a")).alias("lost"))


@query("d38_histogram", "SELECT CASE WHEN value < 0 THEN -1 WHEN floor(value / 5) >= 10 THEN 10 ELSE floor(value / 5)::INT END AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def d38(spark, sf):
    return A.histogram(table(spark, sf, "events"), "value", 0.0, 5.0, 10)


@query("d_cube", "SELECT coalesce(l_returnflag, '*') AS f, coalesce(l_linestatus, '*') AS s, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def d_cube(spark, sf):
    c = table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce("l_returnflag", F.lit("*")).alias("f"), F.coalesce("l_linestatus", F.lit("*")).alias("s"), "n")
