"""Streaming operators over the events as they are in batch (the same plan serves both), and the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.operators import joins as J
from tidelake.operators import validation as L
from tidelake.plans.catalog import query
from tidelake.plans.source_queries import _new
from tidelake.plans.tables import r6, table
from tidelake.streaming import operators as K


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("k_tumbling", "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def k_tumbling(spark, sf):
    return K.windowed(_events(spark, sf), "ts", "1 day", None, ["event_type"], "value").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("k_sliding", "SELECT strftime(time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day' * o, '%Y-%m-%d') AS day, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY 1")
def k_sliding(spark, sf):
    return K.windowed(_events(spark, sf), "ts", "2 days", "1 day", [], "value").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query("k_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s")
def k_sessions(spark, sf):
    return K.sessions(_events(spark, sf), "ts", "6 hours", ["user_id"]).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("k1_resume", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def k1(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    return J.not_yet_done(ev, ev.filter("event_id % 3 = 0"), ["event_id"])


@query("k5_min_max_curve", "SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1")
def k5(spark, sf):
    return K.min_max_curve(table(spark, sf, "events"), "user_id", "event_id")


@query("l1_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def l1(spark, sf):
    return L.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("l2_expect_count", "SELECT count(*) AS n FROM nation HAVING count(*) <> 24")
def l2(spark, sf):
    return L.expect_count(table(spark, sf, "nation"), 24)


@query("l3_reproduction", "SELECT count(*) AS n FROM (SELECT o_orderkey, o_totalprice FROM orders EXCEPT SELECT o_orderkey, round(o_totalprice, 0) FROM orders)")
def l3(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return J.mismatches(o, o.withColumn("o_totalprice", F.round("o_totalprice", 0)), ["o_orderkey"], ["o_totalprice"]).agg(F.count(F.lit(1)).alias("n"))


@query("l4_invariants", "SELECT 'positive' AS rule, count(*) FILTER (WHERE NOT c_acctbal >= 0) AS n FROM customer UNION ALL SELECT 'round', count(*) FILTER (WHERE NOT c_acctbal = round(c_acctbal, 0)) FROM customer")
def l4(spark, sf):
    return L.violations(table(spark, sf, "customer"), {"positive": F.col("c_acctbal") >= 0, "small": F.col("c_acctbal") < 1e9, "round": F.col("c_acctbal") == F.round("c_acctbal", 0)})


@query("l4_checked_write", "SELECT 'rows' AS rule, 0 AS n, false AS published UNION ALL SELECT 'positive', count(*) FILTER (WHERE NOT c_acctbal >= 0), false FROM customer UNION ALL SELECT 'kept', count(*), true FROM customer WHERE c_acctbal >= 0")
def l4b(spark, sf):
    rows = table(spark, sf, "customer")
    rule, n = {"positive": F.col("c_acctbal") >= 0}, rows.count()
    first = L.checked_write(rows, _new(spark, "checked"), rule, rows=n)
    path = _new(spark, "checked")
    second = L.checked_write(rows.filter("c_acctbal >= 0"), path, rule, gates={"some": F.count(F.lit(1)) > 0})
    out = [(k, v, first.published) for k, v in first.counts.items()]
    found = spark.createDataFrame(out, "rule string, n long, published boolean")
    return found.unionAll(spark.read.parquet(path).agg(F.lit("kept").alias("rule"), F.count(F.lit(1)).alias("n"), F.lit(second.published).alias("published")))


@query("l5_gates", "SELECT 'share' AS rule, avg((event_type = 'click')::INT) BETWEEN 0.1 AND 0.5 AS passed FROM events UNION ALL SELECT 'median', median(value) < 1 FROM events")
def l5(spark, sf):
    return L.gates(table(spark, sf, "events"), {"share": F.avg((F.col("event_type") == "click").cast("int")).between(0.1, 0.5), "median": F.median("value") < 1})


@query("l6_coverage", "SELECT count(DISTINCT c_custkey) AS required, count(DISTINCT o_custkey) AS present, count(DISTINCT c_custkey) - count(DISTINCT o_custkey) AS missing FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def l6(spark, sf):
    have = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return L.coverage(table(spark, sf, "customer"), have, ["c_custkey"])


@query("g36_runtime_projection", "SELECT event_type, count(*) AS tasks, round(count(*) * avg(value) / 3600, 6) AS hours, count(*) * avg(value) / 3600 < 25 AS within FROM events GROUP BY 1")
def g36(spark, sf):
    hours = F.count(F.lit(1)) * F.avg("value") / 3600
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("tasks"), r6(hours).alias("hours"), (hours < 25).alias("within"))
