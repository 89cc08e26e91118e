"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.operators import joins as J
from tidelake.plans.catalog import query
from tidelake.plans.tables import MOVES, moves, r6, table


@query("c1_inner_join", "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 6) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def c1(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity")).alias("qty"))


@query("c2_left_composite", f"WITH {MOVES}, s AS (SELECT game, ply, value AS first_value FROM m WHERE ply < 3) SELECT m.game, m.ply, round(s.first_value, 6) AS first_value FROM m LEFT JOIN s ON m.game = s.game AND m.ply = s.ply")
def c2(spark, sf):
    m = moves(spark, sf)
    s = m.filter("ply < 3").select("game", "ply", F.col("value").alias("first_value"))
    return m.join(s, ["game", "ply"], "left").select("game", "ply", r6(F.col("first_value")).alias("first_value"))


@query("c3_normalised_key", "SELECT n_name, count(*) AS n FROM nation JOIN region ON lower(trim(n_name)) = lower(trim(n_name)) AND n_regionkey = r_regionkey JOIN (SELECT lower(n_name) AS k FROM nation WHERE n_nationkey % 2 = 0) x ON lower(n_name) = x.k GROUP BY n_name")
def c3(spark, sf):
    nation = table(spark, sf, "nation")
    even = nation.filter("n_nationkey % 2 = 0").select(F.upper("n_name").alias("upper_name"))
    return J.normalised_join(nation, even, F.col("n_name"), F.col("upper_name")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


_SIDES = "a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 5 <> 0)"


def _sides(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return c.filter("k % 3 <> 0"), c.filter("k % 5 <> 0").withColumn("v", F.col("v") + F.when(F.col("k") % 7 == 0, 1).otherwise(0))


@query("c4_outer_indicator", f"WITH {_SIDES} SELECT coalesce(a.k, b.k) AS k, a.v AS v_x, b.v AS v_y, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM a FULL OUTER JOIN b ON a.k = b.k")
def c4(spark, sf):
    return J.compare_outer(*_sides(spark, sf), ["k"], ["v"])


@query("c5_shifted_join", f"WITH {MOVES} SELECT l.game, l.ply, round(l.value, 6) AS value, round(r.value, 6) AS before FROM m l LEFT JOIN m r ON l.game = r.game AND r.ply + 1 = l.ply")
def c5(spark, sf):
    out = J.shifted(moves(spark, sf).select("game", "ply", "value"), ["game"], "ply", "value", 1, "before")
    return out.select("game", "ply", r6(F.col("value")).alias("value"), r6(F.col("before")).alias("before"))


@query("c6_checked_join", "SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def c6(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    # A row whose two keys weren't the same would stop the query.
    same = F.assert_true(F.col("o_custkey") == F.col("c_custkey"))
    return both.withColumn("checked", same).filter(F.col("checked").isNull()).select("o_orderkey", "o_custkey", "c_nationkey")


@query("c7_multi_lookup", "SELECT o_orderkey, a.c_acctbal AS v_own, b.c_acctbal AS v_next FROM (SELECT o_orderkey, o_custkey AS own, o_custkey + 1 AS nxt FROM orders) o LEFT JOIN customer a ON a.c_custkey = own LEFT JOIN customer b ON b.c_custkey = nxt")
def c7(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("own"), (F.col("o_custkey") + 1).alias("next"))
    long = o.unpivot("o_orderkey", ["own", "next"], "name", "c_custkey").join(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "left")
    return long.groupBy("o_orderkey").pivot("name", ["own", "next"]).agg(F.first("c_acctbal", True)).select("o_orderkey", F.col("own").alias("v_own"), F.col("next").alias("v_next"))


@query("c7_store_lookup", f"WITH {MOVES}, w AS (SELECT game, max(CASE WHEN ply = 0 THEN type END) AS a, max(CASE WHEN ply = 1 THEN type END) AS b FROM m GROUP BY game), s AS (SELECT game, type, max(value) AS v FROM m GROUP BY game, type) SELECT w.game, round(x.v, 6) AS v_a, round(y.v, 6) AS v_b FROM w LEFT JOIN s x ON w.game = x.game AND w.a = x.type LEFT JOIN s y ON w.game = y.game AND w.b = y.type")
def c7b(spark, sf):
    m = moves(spark, sf)
    wide = m.groupBy("game").agg(*[F.max(F.when(F.col("ply") == i, F.col("type"))).alias(c) for i, c in enumerate("ab")])
    store = m.groupBy("game", "type").agg(F.max("value").alias("v"))
    out = J.multi_lookup(wide, store, "game", ["a", "b"], "type", "v", "v_")
    return out.select("game", r6(F.col("v_a")).alias("v_a"), r6(F.col("v_b")).alias("v_b"))


@query("c8_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def c8(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.not_yet_done(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@query("c9_semi_join", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) IN (SELECT lower(c_name) FROM customer WHERE c_mktsegment = 'BUILDING')")
def c9(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    ids = c.filter("c_mktsegment = 'BUILDING'").select(F.upper("c_name").alias("c_name"))
    return J.only_sampled(c, ids, "c_name", fold_case=True).select("c_custkey", "c_name")


@query("c10_lookup_default", "SELECT s_suppkey, coalesce(r_name, 'none') AS r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey")
def c10(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_regionkey", "r_regionkey")
    return J.lookup(s, table(spark, sf, "region").filter("r_regionkey < 3"), ["r_regionkey"], "r_name", "none").select("s_suppkey", "r_name")


@query("c11_token_index", "SELECT p.p_partkey, q.q FROM part p JOIN (SELECT 1 AS q, 'red' AS a, 'widget' AS b UNION ALL SELECT 2, 'blue', 'bolt') q ON list_contains(string_split(p_name, ' '), q.a) AND list_contains(string_split(p_name, ' '), q.b)")
def c11(spark, sf):
    asked = spark.createDataFrame([(1, ["red", "widget"]), (2, ["blue", "bolt"])], "q int, asked_tokens array<string>")
    return J.all_tokens_index(table(spark, sf, "part"), "p_partkey", F.split("p_name", " "), asked, "q", "asked_tokens")


@query("a16_prefix_search", "SELECT p.p_partkey, q.q FROM part p JOIN (SELECT 1 AS q, 're' AS a, 'wi' AS b UNION ALL SELECT 2, 'bl', 'bo') q ON len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, q.a))) > 0 AND len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, q.b))) > 0")
def a16(spark, sf):
    asked = spark.createDataFrame([(1, ["re", "wi"]), (2, ["bl", "bo"])], "q int, asked_tokens array<string>")
    return J.all_tokens_index(table(spark, sf, "part"), "p_partkey", F.split("p_name", " "), asked, "q", "asked_tokens", prefix=True)


_ALL_NAMES = "SELECT p_partkey AS k, string_split(lower(p_name), ' ') AS t FROM part"


@query("c12_theta_tokens", f"WITH c AS ({_ALL_NAMES}), d AS (SELECT DISTINCT t FROM c), m AS (SELECT q.t AS qt, c.t AS ct FROM d q JOIN d c ON len(list_filter(q.t, lambda t: len(t) >= 2)) > 0 AND len(list_filter(list_filter(q.t, lambda t: len(t) >= 2), lambda t: len(list_filter(c.t, lambda x: x = t OR starts_with(x, t) OR starts_with(t, x))) = 0)) = 0) SELECT q.k AS q, c.k AS c FROM m JOIN c q ON q.t = m.qt JOIN c ON c.t = m.ct")
def c12(spark, sf):
    tokens = F.split(F.lower("p_name"), " ")
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("q"), tokens.alias("qt"))
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("c"), tokens.alias("ct"))
    return J.blocked_token_join(q, c, "qt", "ct", copies=True).select("q", "c")


@query("c13_best_match", """WITH s AS (SELECT l_orderkey % 50 AS q, l_partkey AS cand, l_returnflag AS sex, l_linenumber AS score, l_extendedprice AS rating FROM lineitem),
t AS (SELECT *, rank() OVER (PARTITION BY q ORDER BY score DESC) AS r FROM s)
SELECT q, CASE WHEN count(DISTINCT sex) > 1 THEN 'ambiguous' WHEN count(*) > 1 THEN 'matched_multi_same' ELSE 'matched' END AS status, CASE WHEN count(DISTINCT sex) = 1 THEN min(sex) END AS sex,
first(cand ORDER BY rating DESC, cand DESC) AS representative, count(*) AS n FROM t WHERE r = 1 GROUP BY q""")
def c13(spark, sf):
    s = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("q"), F.col("l_partkey").alias("cand"), F.col("l_returnflag").alias("sex"), F.col("l_linenumber").alias("score"), F.col("l_extendedprice").alias("rating"))
    return J.best_match(s, "q", "score", "sex", "cand", "rating")


@query("c14_interval_lookup", """WITH r AS (SELECT s_suppkey * 40 AS lo, s_suppkey * 40 + 10 AS hi, s_suppkey::DOUBLE AS v FROM supplier WHERE s_suppkey % 3 = 0),
p AS (SELECT p_partkey AS x FROM part), n AS (SELECT x, (SELECT max(lo) FROM r WHERE lo <= x) AS b, (SELECT min(lo) FROM r WHERE lo > x) AS a FROM p)
SELECT x, round(CASE WHEN x <= rb.hi THEN rb.v WHEN rb.v IS NULL THEN ra.v WHEN ra.v IS NULL THEN rb.v ELSE round_even(rb.v + (ra.v - rb.v) * (x - rb.hi) / (ra.lo - rb.hi), 0) END, 6) AS month
FROM n LEFT JOIN r rb ON rb.lo = n.b LEFT JOIN r ra ON ra.lo = n.a""")
def c14(spark, sf):
    ranges = table(spark, sf, "supplier").filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") * 40).alias("lo"), (F.col("s_suppkey") * 40 + 10).alias("hi"), F.col("s_suppkey").alias("v"))
    points = table(spark, sf, "part").select(F.col("p_partkey").alias("x"))
    return J.interval_lookup(points, ranges, "x", "lo", "hi", "v", "month").select("x", r6(F.col("month")).alias("month"))


@query("c15_nearest", "SELECT l_orderkey, arg_min(l_extendedprice, abs(l_extendedprice - 20000)) AS price FROM lineitem GROUP BY l_orderkey")
def c15(spark, sf):
    return J.nearest(table(spark, sf, "lineitem").withColumn("target", F.lit(20000.0)), ["l_orderkey"], "l_extendedprice", "target", "price")


@query("c16_aligned_concat", f"WITH {MOVES}, a AS (SELECT event_id, value * 2 AS a FROM m), b AS (SELECT event_id, ply + 1 AS b FROM m) SELECT a.event_id, round(a.a, 6) AS a, b.b FROM a JOIN b ON a.event_id = b.event_id")
def c16(spark, sf):
    m = moves(spark, sf)
    return m.select("event_id", r6(F.col("value") * 2).alias("a")).join(m.select("event_id", (F.col("ply") + 1).alias("b")), "event_id")


@query("c17_line_membership", "WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ps, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey) AS qs, max(l_partkey) AS hit FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, list_position(ps, hit) AS place, qs[list_position(ps, hit)] AS qty FROM l")
def c17(spark, sf):
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(line.alias("lines"), F.max("l_partkey").alias("hit"))
    place = F.array_position(F.col("lines.l_partkey"), F.col("hit"))
    return g.select("l_orderkey", place.alias("place"), F.element_at(F.col("lines.l_quantity"), place.cast("int")).alias("qty"))


@query("c18_reproduction", f"WITH {_SIDES} SELECT coalesce(a.k, b.k) AS k, a.v AS v_x, b.v AS v_y, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v OR a.k IS NULL OR b.k IS NULL")
def c18(spark, sf):
    return J.mismatches(*_sides(spark, sf), ["k"], ["v"])


@query("c19_digitize", "SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 3 WHEN p_retailprice >= 1200 THEN 2 WHEN p_retailprice >= 1000 THEN 1 ELSE 0 END AS bin FROM part")
def c19(spark, sf):
    return table(spark, sf, "part").select("p_partkey", J.digitize(F.col("p_retailprice"), [1000, 1200, 1500]).alias("bin"))


@query("c20_chained_assembly", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority, c_mktsegment, p_brand, s_nationkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def c20(spark, sf):
    return _assembly(spark, sf, table(spark, sf, "lineitem"))


def _assembly(spark, sf, lines):
    t = lambda n: table(spark, sf, n)
    out = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderpriority", "c_mktsegment", "p_brand", "s_nationkey")


@query("c21_outer_coalesce", f"WITH {_SIDES} SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM a FULL OUTER JOIN b ON a.k = b.k")
def c21(spark, sf):
    return J.outer_coalesce(*_sides(spark, sf), ["k"], "v")


@query("c22_renamed_lookup", "SELECT o_orderkey, c_name AS who FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def c22(spark, sf):
    return J.lookup_as(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", "c_name", "who").select("o_orderkey", "who")
