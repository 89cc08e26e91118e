"""Queries of the ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.operators import windows as O
from tidelake.operators.ranks import global_rank
from tidelake.plans.catalog import query
from tidelake.plans.tables import MOVES, moves, r6, table


@query("e1_lag_difference", f"WITH {MOVES} SELECT game, ply, round(abs(value - lag(value, 2) OVER (PARTITION BY game ORDER BY ply)), 6) AS volatility FROM m QUALIFY ply >= 14 AND ply < 40")
def e1(spark, sf):
    # The context plies before 14 are seen by the lag and dropped after it.
    out = moves(spark, sf).withColumn("volatility", r6(F.abs(F.col("value") - O.adjacent_lag("value", "ply", ["game"], 2))))
    return out.filter("ply >= 14 and ply < 40").select("game", "ply", "volatility")


@query("e2_lead_pairing", f"WITH {MOVES}, k AS (SELECT * FROM m WHERE type <> 'error') SELECT a.game, a.ply, round(b.value, 6) AS opponent FROM k a LEFT JOIN k b ON a.game = b.game AND b.ply = a.ply + 1")
def e2(spark, sf):
    k = moves(spark, sf).filter("type <> 'error'")
    return k.select("game", "ply", r6(O.adjacent_lag("value", "ply", ["game"], -1)).alias("opponent"))


@query("e3_previous_flag", f"WITH {MOVES}, k AS (SELECT * FROM m WHERE type <> 'error') SELECT a.game, a.ply, b.game IS NOT NULL AS prev_evaluated, coalesce(b.type = 'click', false) AS prev_was_best FROM k a LEFT JOIN k b ON a.game = b.game AND b.ply = a.ply - 1")
def e3(spark, sf):
    k = moves(spark, sf).filter("type <> 'error'")
    before = O.adjacent_lag("type", "ply", ["game"], 1)
    return k.select("game", "ply", before.isNotNull().alias("prev_evaluated"), F.coalesce(before == "click", F.lit(False)).alias("prev_was_best"))


@query("e4_run_lengths", f"WITH {MOVES}, f AS (SELECT game, ply, type IN ('click', 'view') AS flag FROM m), i AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY game ORDER BY ply) AS island FROM f), r AS (SELECT game, island, count(*) FILTER (WHERE flag) AS len FROM i GROUP BY 1, 2) SELECT game, round(coalesce(avg(len) FILTER (WHERE len > 0), 0), 6) AS mean_run, coalesce(max(len) FILTER (WHERE len > 0), 0)::BIGINT AS max_run, count(*) FILTER (WHERE len > 0) AS runs FROM r GROUP BY 1")
def e4(spark, sf):
    rows = moves(spark, sf).withColumn("flag", F.col("type").isin("click", "view"))
    return O.run_lengths(rows, ["game"], "ply", "flag").withColumn("mean_run", r6(F.col("mean_run")))


@query("e5_reactive_flag", f"WITH {MOVES}, p AS (SELECT game, ply, lag(value) OVER (PARTITION BY game ORDER BY ply) > 15 AS reactive FROM m) SELECT game, count(*) FILTER (WHERE reactive) AS reactive, count(*) AS n FROM p WHERE ply % 2 = 1 AND ply >= 14 AND ply < 40 GROUP BY 1")
def e5(spark, sf):
    m = moves(spark, sf).withColumn("reactive", O.adjacent_lag("value", "ply", ["game"], 1) > 15)
    return m.filter("ply % 2 = 1 and ply >= 14 and ply < 40").groupBy("game").agg(F.count_if("reactive").alias("reactive"), F.count(F.lit(1)).alias("n"))


@query("e6_resetting_events", f"""WITH RECURSIVE {MOVES}, h AS (SELECT game, ply, row_number() OVER (PARTITION BY game ORDER BY ply) AS i FROM m WHERE type = 'purchase'),
w(game, i, held, n) AS (SELECT game, 1::BIGINT, ply, 0 FROM h WHERE i = 1
UNION ALL SELECT h.game, h.i, CASE WHEN w.held IS NOT NULL AND h.ply - w.held <= 5 THEN NULL ELSE h.ply END, w.n + CASE WHEN w.held IS NOT NULL AND h.ply - w.held <= 5 THEN 1 ELSE 0 END FROM w JOIN h ON h.game = w.game AND h.i = w.i + 1)
SELECT game, max(n)::INT AS events FROM w GROUP BY 1""")
def e6(spark, sf):
    return O.resetting_events(moves(spark, sf), ["game"], "ply", F.col("type") == "purchase", 5)


@query("e7_first_place", f"WITH {MOVES} SELECT game, min(CASE WHEN value > 20 THEN ply + 1 END) AS first_large FROM m GROUP BY 1")
def e7(spark, sf):
    return moves(spark, sf).groupBy("game").agg(O.first_place(F.col("value") > 20, "ply").alias("first_large"))


@query("e8_snapshot", f"WITH {MOVES} SELECT game, round(coalesce(max(CASE WHEN ply = 39 THEN value END), arg_max(value, ply)), 6) AS value FROM m GROUP BY 1")
def e8(spark, sf):
    return moves(spark, sf).groupBy("game").agg(r6(O.snapshot("value", "ply", 39)).alias("value"))


_QCUT = "q AS (SELECT list_distinct(list(e)) AS es FROM (SELECT unnest(quantile_cont({v}, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM {t}))"


@query("e9_quantile_bins", f"WITH {_QCUT.format(v='l_discount', t='lineitem')}, s AS (SELECT list_sort(es) AS es FROM q), b AS (SELECT l_quantity, len(list_filter(es[2:len(es) - 1], lambda e: e < l_discount)) AS bin FROM lineitem, s) SELECT bin, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM b GROUP BY 1")
def e9(spark, sf):
    binned = O.quantile_bins(table(spark, sf, "lineitem"), "l_discount", 5, "bin")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity")).alias("mean"))


@query("e10_digitize_shared_cuts", "WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM events) SELECT event_id, len(list_filter(e, lambda x: x <= value)) AS bin FROM events, q")
def e10(spark, sf):
    return O.digitized(table(spark, sf, "events"), "value", [0.25, 0.5, 0.75], "bin").select("event_id", "bin")


@query("e11_bands", "SELECT c_custkey, least(floor(c_acctbal / 500) * 500, 8000)::INT AS band, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'normal' ELSE 'rich' END AS label FROM customer")
def e11(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.least(F.floor(b / 500) * 500, F.lit(8000)).cast("int").alias("band"), F.when(b < 0, "debt").when(b < 5000, "normal").otherwise("rich").alias("label"))


@query("e12_standardised", "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders, s")
def e12(spark, sf):
    return O.standardised(table(spark, sf, "orders"), ["o_totalprice"]).select("o_orderkey", r6(F.col("o_totalprice_z")).alias("z"))


@query("e13_train_standardised", "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z, round(pow((o_totalprice - m) / s, 2), 6) AS z2 FROM orders, s")
def e13(spark, sf):
    o = table(spark, sf, "orders")
    out = O.standardised_by(o, o.filter("o_orderstatus = 'F'"), ["o_totalprice"])
    return out.select("o_orderkey", r6(F.col("o_totalprice_z")).alias("z"), r6(F.col("o_totalprice_z2")).alias("z2"))


@query("e14_restandardised_subset", "WITH k AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM k GROUP BY 1) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM k JOIN s ON o_orderpriority = p")
def e14(spark, sf):
    k = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return O.standardised(k, ["o_totalprice"], ["o_orderpriority"]).select("o_orderkey", r6(F.col("o_totalprice_z")).alias("z"))


@query("e15_mean_centred", "WITH s AS (SELECT avg(value) AS m FROM events) SELECT event_id, round(value - m, 6) AS centred FROM events, s")
def e15(spark, sf):
    ev = table(spark, sf, "events")
    return ev.join(F.broadcast(ev.agg(F.avg("value").alias("m")))).select("event_id", r6(F.col("value") - F.col("m")).alias("centred"))


@query("e16_group_mean_back", "WITH s AS (SELECT event_type AS t, avg(value) AS m FROM events GROUP BY 1) SELECT event_id, round(abs(value - m), 6) AS deviation FROM events JOIN s ON event_type = t")
def e16(spark, sf):
    ev = table(spark, sf, "events")
    return ev.join(ev.groupBy("event_type").agg(F.avg("value").alias("m")), "event_type").select("event_id", r6(F.abs(F.col("value") - F.col("m"))).alias("deviation"))


@query("e17_surrogate_key", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_id FROM orders")
def e17(spark, sf):
    return global_rank(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), [], ["o_custkey", "o_orderkey"], "r").select("o_orderkey", (F.col("r") - 1).alias("row_id"))


@query("e18_top_share_by_fold", "WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, o_orderpriority FROM r WHERE r <= round_even(n * 0.05, 0)")
def e18(spark, sf):
    return O.top_share(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", 0.05, "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("e19_top_share_oracle", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 150")
def e19(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(150)


@query("e20_first_valid_rows", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_totalprice BETWEEN 50000 AND 400000) WHERE r <= 3")
def e20(spark, sf):
    return O.first_valid(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, F.col("o_totalprice").between(50000, 400000)).select("o_orderkey", "o_custkey")


@query("e21_first_in_draw_order", "SELECT p_partkey FROM part WHERE p_size > 10 ORDER BY md5(p_partkey || ':5'), p_partkey LIMIT 40")
def e21(spark, sf):
    return O.seeded_sample(table(spark, sf, "part").filter("p_size > 10"), "p_partkey", 40, 5).select("p_partkey")


@query("e22_first_occurrence", f"WITH {MOVES}, r AS (SELECT *, row_number() OVER (PARTITION BY game, type ORDER BY ply) AS r FROM m) SELECT game, type, ply FROM r WHERE r = 1")
def e22(spark, sf):
    return moves(spark, sf).groupBy("game", "type").agg(F.min("ply").alias("ply"))


@query("e23_largest_rows", "SELECT event_id, value FROM events ORDER BY abs(value) DESC, event_id LIMIT 25")
def e23(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc(F.abs("value")), "event_id").limit(25)


@query("e24_stable_sort", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def e24(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy("c_nationkey", F.desc("c_acctbal"), "c_custkey")


@query("e25_even_sample", f"WITH {MOVES}, n AS (SELECT *, count(*) OVER (PARTITION BY game) AS n FROM m), p AS (SELECT DISTINCT game, round_even(i * (n - 1) / 29, 0)::BIGINT AS ply FROM n, (SELECT unnest(range(30)) AS i)) SELECT n.game, n.ply FROM n LEFT JOIN p ON n.game = p.game AND n.ply = p.ply WHERE n.n <= 30 OR p.ply IS NOT NULL")
def e25(spark, sf):
    return O.even_sample(moves(spark, sf).select("game", "ply"), ["game"], "ply", 30)


@query("e26_seeded_choice", "SELECT s AS l_suppkey FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem) ORDER BY md5(s || ':11'), s LIMIT 20")
def e26(spark, sf):
    return O.seeded_sample(table(spark, sf, "lineitem").select("l_suppkey").distinct(), "l_suppkey", 20, 11)


@query("e27_seeded_rows", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':3'), o_orderkey LIMIT 200")
def e27(spark, sf):
    return O.seeded_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 200, 3)


@query("e28_sample_by_group", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':8'), c_custkey) AS r FROM customer) WHERE r <= 10")
def e28(spark, sf):
    return O.seeded_sample(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 10, 8, ["c_mktsegment"])


@query("e29_folds", "WITH u AS (SELECT DISTINCT user_id FROM events), f AS (SELECT user_id, (row_number() OVER (ORDER BY md5(user_id || ':17'), user_id) - 1) % 5 AS fold FROM u) SELECT fold::INT AS fold, count(*) AS n, round(avg(value), 6) AS mean FROM events JOIN f USING (user_id) GROUP BY 1")
def e29(spark, sf):
    return O.folds(table(spark, sf, "events"), "user_id", 5, 17).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


@query("e30_selection_probability", "WITH c AS (SELECT c_custkey, c_mktsegment, rep FROM customer, (SELECT unnest(range(200)) AS rep)), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, rep ORDER BY ('0x' || substr(md5(c_custkey || ':' || rep || ':2'), 1, 13))::BIGINT, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment, rep) AS n FROM c) SELECT c_custkey, c_mktsegment, round(avg((r <= round_even(n * 0.1, 0))::INT), 6) AS p FROM r GROUP BY 1, 2")
def e30(spark, sf):
    return O.repeated_selection(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", 0.1, 200, 2).withColumn("p", r6(F.col("p")))


@query("e31_quota", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r <= CASE c_mktsegment WHEN 'BUILDING' THEN 7 WHEN 'MACHINERY' THEN 12 ELSE 0 END")
def e31(spark, sf):
    return O.quota(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": 7, "MACHINERY": 12}, ["c_custkey"])


@query("a14_newest_first", "WITH m AS (SELECT *, strftime(o_orderdate, '%Y/%m') AS month FROM orders), d AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY month DESC) AS dr FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY month DESC, o_orderkey DESC) AS r FROM d WHERE dr <= 3 AND o_orderstatus <> 'P') SELECT o_custkey, o_orderkey FROM r WHERE r <= 2")
def a14(spark, sf):
    from tidelake.sources.readers import newest_games

    rows = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy/MM"))
    return newest_games(rows, "o_custkey", "month", "o_orderkey", 3, 2, F.col("o_orderstatus") != "P").select("o_custkey", "o_orderkey")


@query("a28_back_filled", "SELECT s_suppkey, s_name, NULL::VARCHAR AS sex FROM supplier")
def a28(spark, sf):
    from tidelake.sources.readers import back_filled

    return back_filled(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey long, s_name string, sex string")


@query("e7_band_means_to_rows", f"WITH {MOVES}, b AS (SELECT game, ply, value, avg(value) OVER (PARTITION BY game) AS mean FROM m) SELECT game, count(*) FILTER (WHERE value > mean) AS above FROM b GROUP BY 1")
def e7b(spark, sf):
    return O.above_mean(moves(spark, sf), ["game"], "value", "above")
