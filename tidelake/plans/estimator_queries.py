"""Queries of the statistical estimators.  Closed forms have SQL; searches and resampling are held by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.operators import estimators as G
from tidelake.operators import learners as L
from tidelake.operators import mixed as X
from tidelake.operators import windows as O
from tidelake.plans.catalog import query
from tidelake.plans.tables import r6, table

_X = ["l_quantity", "l_discount", "l_tax"]


def _rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"), *_X)


def _rounded(df, *columns):
    return df.select("term", *[r6(F.col(c)).alias(c) for c in columns])


@query("g1_pca")
def g1(spark, sf):
    return G.pca(_rows(spark, sf), ["y", *_X], "y").select("component", r6(F.col("share")).alias("share"), F.transform("loadings", lambda x: F.round(x, 5)).alias("loadings"))


def _loading_sql(where):
    """First loadings of the correlation matrix of four columns: its squares, again and again, scaled to a trace of 1, become the projection on them."""
    cols = ["l_extendedprice", *_X]
    each = [(i, j) for i in range(4) for j in range(4)]
    pairs = ", ".join(f"corr({cols[i]}, {cols[j]}) AS m{i}{j}" for i, j in each)
    entry = lambda i, j: " + ".join(f"m{i}{k} * m{k}{j}" for k in range(4))
    trace = " + ".join(entry(i, i) for i in range(4))
    square = ", ".join(f"({entry(i, j)}) / ({trace})" for i, j in each)
    names = ", ".join(f"m{i}{j}" for i, j in each)
    last = ", ".join(f"m0{j} / sqrt(m00) AS v{j}" for j in range(4))
    return f"(WITH RECURSIVE c AS (SELECT {pairs} FROM lineitem {where}), p AS (SELECT 0 AS k, {names} FROM c UNION ALL SELECT k + 1, {square} FROM p WHERE k < 40) SELECT {last} FROM p WHERE k = 40)"


@query("g3_congruence", f"SELECT round(a.v0 * b.v0 + a.v1 * b.v1 + a.v2 * b.v2 + a.v3 * b.v3, 4) AS congruence FROM {_loading_sql('')} a, {_loading_sql(chr(87) + 'HERE l_returnflag = ' + chr(39) + 'A' + chr(39))} b")
def g3(spark, sf):
    rows = _rows(spark, sf)
    full = G.pca(rows, ["y", *_X], "y").filter("component = 1").select(F.col("loadings").alias("a"))
    part = G.pca(rows.filter("l_returnflag = 'A'"), ["y", *_X], "y").filter("component = 1").select(F.col("loadings").alias("b"))
    return full.join(F.broadcast(part)).select(F.round(G.congruence(F.col("a"), F.col("b")), 4).alias("congruence"))  # one row each


@query("g4_projection", "SELECT l_orderkey, l_linenumber, l_suppkey, round(0.5 * l_quantity - 2 * l_discount, 6) AS score FROM lineitem")
def g4(spark, sf):
    return _projected(table(spark, sf, "lineitem"))


def _projected(lines):
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey", r6(G.project(["l_quantity", "l_discount"], [0.5, -2.0])).alias("score"))


@query("g5_trend_table", """WITH b AS (SELECT l_quantity::INT AS band, avg(l_quantity) AS mid, avg(l_extendedprice) AS price, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
l AS (SELECT mid, unnest(['price', 'tax']) AS indicator, unnest([price, tax]) AS v FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY mid) AS ra, row_number() OVER (PARTITION BY indicator ORDER BY v, mid) AS rv FROM l),
s AS (SELECT indicator, corr(mid, v) AS r, corr(ra, rv) AS rho, regr_slope(v, mid) * 100 AS slope FROM k GROUP BY 1)
SELECT indicator, round(r, 6) AS r, round(rho, 6) AS rho, round(slope, 4) AS slope, CASE WHEN abs(round(rho, 12)) >= 0.9 THEN 'yes' WHEN abs(round(rho, 12)) >= 0.7 THEN 'partial' ELSE 'no' END AS monotone FROM s""")
def g5(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("band"), "l_quantity", F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    out = G.trend_table(rows, "l_quantity", ["price", "tax"], "band")
    return out.select("indicator", r6(F.col("r")).alias("r"), r6(F.col("rho")).alias("rho"), F.round("slope", 4).alias("slope"), "monotone")


@query("g6_segmented")
def g6(spark, sf):
    out = G.segmented(_rows(spark, sf), "y", "l_quantity")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


_FIT = """WITH r AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem), s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, var_pop(x) * count(*) AS sxx, avg(x) AS mx FROM r),
e AS (SELECT sum(pow(y - a - b * x, 2)) / (any_value(n) - 2) AS s2 FROM r, s)"""


@query("g7_ols", _FIT + " SELECT 'const' AS term, round(a, 6) AS coef, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 6) AS se FROM s, e UNION ALL SELECT 'l_quantity', round(b, 6), round(sqrt(s2 / sxx), 6) FROM s, e")
def g7(spark, sf):
    return _rounded(G.ols(_rows(spark, sf), "y", ["l_quantity"]), "coef", "se")


@query("g7_residuals", _FIT + " SELECT round(sum(y - a - b * x) + 0.0, 3) AS total, round(var_samp(y - a - b * x), 6) AS variance FROM r, s")
def g7b(spark, sf):
    u = G.residuals(_rows(spark, sf), "y", ["l_quantity"], "u")
    return u.agg(F.round(F.sum("u") + 0.0, 3).alias("total"), r6(F.var_samp("u")).alias("variance"))


@query("g9_cluster_robust", _FIT + """, u AS (SELECT l_suppkey AS g, sum(l_extendedprice / 1000 - a - b * l_quantity) AS s0, sum((l_extendedprice / 1000 - a - b * l_quantity) * (l_quantity - mx)) AS s1 FROM lineitem, s GROUP BY 1)
SELECT 'l_quantity' AS term, round(any_value(b), 6) AS coef, round(sqrt(sum(s1 * s1) / pow(any_value(sxx), 2) * (count(*)::DOUBLE / (count(*) - 1)) * ((any_value(n) - 1)::DOUBLE / (any_value(n) - 2))), 6) AS se FROM u, s""")
def g9(spark, sf):
    return _rounded(G.cluster_ols(_rows(spark, sf), "y", ["l_quantity"], ["l_suppkey"]).filter("term = 'l_quantity'"), "coef", "se")


def _meat_sql(key):
    return f"(SELECT sum(s0 * s0) * q AS m00, sum(s0 * s1) * q AS m01, sum(s1 * s1) * q AS m11 FROM (SELECT sum(u) AS s0, sum(u * x) AS s1, count(*) OVER () AS g FROM e2 GROUP BY {key}), (SELECT 1.0::DOUBLE AS one), (SELECT count(*)::DOUBLE AS gg FROM (SELECT DISTINCT {key} FROM e2)), LATERAL (SELECT gg / (gg - 1) AS q) GROUP BY q)"


@query("g10_two_way_cluster", _FIT + f""", e2 AS (SELECT l_suppkey, l_linenumber, l_quantity - mx AS x, l_extendedprice / 1000 - a - b * l_quantity AS u FROM lineitem, s),
k AS (SELECT a1.m00 + b1.m00 - c1.m00 AS m00, a1.m01 + b1.m01 - c1.m01 AS m01, a1.m11 + b1.m11 - c1.m11 AS m11 FROM {_meat_sql('l_suppkey')} a1, {_meat_sql('l_linenumber')} b1, {_meat_sql('l_suppkey, l_linenumber')} c1)
SELECT 'l_quantity' AS term, round(b, 6) AS coef, round(sqrt(greatest(0, m11 / pow(sxx, 2) * ((n - 1)::DOUBLE / (n - 2)))), 6) AS se FROM s, k
UNION ALL SELECT 'const', round(a, 6), round(sqrt(greatest(0, (m00 / pow(n, 2) - 2 * mx * m01 / (n * sxx) + mx * mx * m11 / pow(sxx, 2)) * ((n - 1)::DOUBLE / (n - 2)))), 6) FROM s, k""")
def g10(spark, sf):
    return _rounded(G.cluster_ols(_rows(spark, sf), "y", ["l_quantity"], ["l_suppkey", "l_linenumber"]), "coef", "se")


@query("g14_random_intercept")
def g14(spark, sf):
    return _rounded(X.random_intercept(table(spark, sf, "events"), "value", [], "user_id"), "coef", "se")


@query("g15_crossfit")
def g15(spark, sf):
    rows = O.folds(_rows(spark, sf), "l_suppkey", 5, 9)
    out = L.crossfit(rows, "y", _X, "fold", 5, "fit")
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(1 - F.sum((F.col("y") - F.col("fit")) ** 2) / F.sum((F.col("y") - 25) ** 2)).alias("gain"))


@query("g18_ridge", "WITH s AS (SELECT avg(l_extendedprice / 1000) AS my, corr(l_extendedprice, l_quantity) * stddev_pop(l_extendedprice / 1000) * count(*) / (count(*) + 1.0) AS b FROM lineitem) SELECT 'const' AS term, round(my, 6) AS coef FROM s UNION ALL SELECT 'l_quantity', round(b, 6) FROM s")
def g18(spark, sf):
    return _rounded(G.ridge(_rows(spark, sf), "y", ["l_quantity"], 1.0), "coef")


@query("g22_sign_test")
def g22(spark, sf):
    from tidelake.functions.tails import sign_test

    row = table(spark, sf, "events").agg(F.count_if(F.col("value") < 8).alias("k"), F.count("value").alias("n")).first()
    return spark.createDataFrame([(row["k"], row["n"], round(sign_test(row["k"], row["n"]), 9))], "k long, n long, p double")


@query("g24_vif", "SELECT 'l_quantity' AS term, round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 6) AS vif FROM lineitem UNION ALL SELECT 'y', round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 6) FROM lineitem")
def g24(spark, sf):
    return _rounded(G.vif(_rows(spark, sf), ["l_quantity", "y"]), "vif")


@query("g26_cluster_bootstrap", """WITH s AS (SELECT user_id, sum(value) AS s, count(*) AS n, row_number() OVER (ORDER BY user_id) - 1 AS rk FROM events GROUP BY 1), g AS (SELECT count(*) AS g FROM s),
p AS (SELECT id % 2000 AS draw, ('0x' || substr(md5(id || ':4'), 1, 12))::BIGINT % g AS rk FROM (SELECT unnest(range((SELECT g FROM g) * 2000)) AS id), g),
d AS (SELECT draw, sum(s) / sum(n) AS v FROM p JOIN s ON p.rk = s.rk GROUP BY 1)
SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(*) AS draws, round((SELECT sum(s) / sum(n) FROM s), 6) AS estimate FROM d""")
def g26(spark, sf):
    out = G.cluster_bootstrap(table(spark, sf, "events"), "user_id", F.col("value"), F.lit(1), 2000, 4)
    return out.select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "draws", r6(F.col("estimate")).alias("estimate"))


@query("g27_row_resample", """WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS rk FROM (SELECT DISTINCT user_id FROM events)), g AS (SELECT count(*) AS g FROM u),
p AS (SELECT id % 3 AS draw, ('0x' || substr(md5(id || ':4'), 1, 12))::BIGINT % g AS rk FROM (SELECT unnest(range((SELECT g FROM g) * 3)) AS id), g), c AS (SELECT draw, user_id, count(*) AS cnt FROM p JOIN u ON p.rk = u.rk GROUP BY 1, 2)
SELECT draw, sum(cnt * n)::BIGINT AS n, sum(cnt)::BIGINT AS units, round(sum(cnt * s) / sum(cnt * n), 6) AS mean FROM c JOIN (SELECT user_id, count(*) AS n, sum(value) AS s FROM events GROUP BY 1) e ON c.user_id = e.user_id GROUP BY 1""")
def g27(spark, sf):
    out = G.resampled_rows(table(spark, sf, "events").select("user_id", "value"), "user_id", 3, 4)
    return out.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit_copy").alias("units"), r6(F.avg("value")).alias("mean"))


@query("g30_reliability", _FIT + " SELECT round(1 - var_samp(l_tax * 10) / var_samp(l_extendedprice / 1000 - a - b * l_quantity), 6) AS reliability, round(var_samp(l_tax * 10) / var_samp(l_extendedprice / 1000 - a - b * l_quantity), 6) AS noise_share FROM lineitem, s")
def g30(spark, sf):
    out = G.reliability(_rows(spark, sf).withColumn("noise", F.col("l_tax") * 10), "y", ["l_quantity"], "noise")
    return out.select(r6(F.col("reliability")).alias("reliability"), r6(F.col("noise_share")).alias("noise_share"))


@query("g33_policy_value", """WITH r AS (SELECT o_totalprice - 200000 AS gain, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey DESC, o_orderkey) <= round_even(0.1 * count(*) OVER (PARTITION BY o_orderpriority), 0) AS c,
row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey % 1000 DESC, o_orderkey) <= round_even(0.1 * count(*) OVER (PARTITION BY o_orderpriority), 0) AS f,
row_number() OVER (ORDER BY o_totalprice - 200000 DESC, o_orderkey) <= round_even(0.1 * count(*) OVER (), 0) AS b FROM orders)
SELECT round(avg(CASE WHEN c THEN gain ELSE 0 END), 4) AS gain, round(avg(CASE WHEN b THEN gain ELSE 0 END), 4) AS oracle, round(0.1 * avg(gain), 4) AS random, round(count(*) FILTER (WHERE c AND gain > 0)::DOUBLE / count(*) FILTER (WHERE c), 6) AS precision, count(*) FILTER (WHERE c) AS selected,
round(avg(CASE WHEN f THEN gain ELSE 0 END), 4) AS reference, round(avg(CASE WHEN c THEN gain ELSE 0 END) - avg(CASE WHEN f THEN gain ELSE 0 END), 4) AS difference, round(count(*) FILTER (WHERE c AND f)::DOUBLE / count(*) FILTER (WHERE c), 6) AS coincidence FROM r""")
def g33(spark, sf):
    rows = table(spark, sf, "orders").withColumns({"gain_": F.col("o_totalprice") - 200000, "ref": F.col("o_custkey") % 1000})
    out = G.policy_value(rows, "o_custkey", "o_orderkey", "gain_", "o_orderpriority", 0.1, "ref")
    return out.select(*[F.round(c, 4).alias(c) for c in ("gain", "oracle", "random", "reference", "difference")], *[r6(F.col(c)).alias(c) for c in ("precision", "coincidence")], "selected")


@query("d35_within_between", """WITH r AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, l_returnflag AS g FROM lineitem), m AS (SELECT avg(x) AS mx FROM r), p AS (SELECT g, count(*) AS n, sum(pow(x - mx, 2)) AS uu, sum((x - mx) * y) AS uy FROM r, m GROUP BY 1)
SELECT g AS l_returnflag, n, round(uu / sum(uu) OVER (), 6) AS weight, round(uy / uu, 6) AS slope, round(sum(uy) OVER () / sum(uu) OVER (), 6) AS mixture FROM p""")
def d35(spark, sf):
    out = G.within_between(_rows(spark, sf), "y", "l_quantity", "l_returnflag", [])
    return out.select("l_returnflag", "n", *[r6(F.col(c)).alias(c) for c in ("weight", "slope", "mixture")])


@query("g34_cell_noise", """WITH c AS (SELECT user_id, event_type, user_id % 4 AS band, count(value) AS n, avg(value) AS mean, var_samp(value) AS s2 FROM events GROUP BY 1, 2, 3), p AS (SELECT band, sum((n - 1) * s2) / sum(n - 1) AS pooled FROM c WHERE n >= 2 GROUP BY 1)
SELECT user_id, event_type, c.band, n, round(mean, 6) AS mean, round(CASE WHEN n >= 2 THEN s2 ELSE pooled END / n, 6) AS noise FROM c LEFT JOIN p ON c.band = p.band""")
def g34(spark, sf):
    return _cell_noise(table(spark, sf, "events"))


def _cell_noise(events):
    out = G.cell_noise(events.withColumn("band", F.col("user_id") % 4), ["user_id", "event_type"], "value", "band")
    return out.select("user_id", "event_type", "band", "n", r6(F.col("mean")).alias("mean"), r6(F.col("noise")).alias("noise"))


@query("g35_group_difference", """WITH s AS (SELECT user_id, sum(value) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'click') AS na, sum(value) FILTER (WHERE event_type <> 'click') AS b, count(*) FILTER (WHERE event_type <> 'click') AS nb, row_number() OVER (ORDER BY user_id) - 1 AS rk FROM events GROUP BY 1), g AS (SELECT count(*) AS g FROM s),
p AS (SELECT id % 2000 AS draw, ('0x' || substr(md5(id || ':6'), 1, 12))::BIGINT % g AS rk FROM (SELECT unnest(range((SELECT g FROM g) * 2000)) AS id), g), d AS (SELECT draw, sum(a) / sum(na) - sum(b) / sum(nb) AS v FROM p JOIN s ON p.rk = s.rk GROUP BY 1)
SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM d""")
def g35(spark, sf):
    click = F.col("event_type") == "click"
    value = lambda p: F.when(p, F.col("value"))
    sums = table(spark, sf, "events").groupBy("user_id").agg(F.sum(value(click)).alias("a"), F.count_if(click).alias("na"), F.sum(value(~click)).alias("b"), F.count_if(~click).alias("nb"))
    drawn = G.draw_counts(sums, "user_id", 2000, 6)
    total = lambda c: F.sum(F.col("cnt") * F.col(c))
    v = drawn.groupBy("draw").agg((total("a") / total("na") - total("b") / total("nb")).alias("v"))
    return v.agg(r6(F.percentile("v", F.lit(0.025))).alias("lo"), r6(F.percentile("v", F.lit(0.975))).alias("hi"))


@query("g37_tercile_slopes", "WITH q AS (SELECT quantile_cont(l_tax, [1 / 3.0, 2 / 3.0]) AS e FROM lineitem), b AS (SELECT len(list_filter(list_distinct(e), lambda x: x < l_tax)) AS bin, l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem, q) SELECT bin, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2 FROM b GROUP BY 1")
def g37(spark, sf):
    return G.stratified_slopes(_rows(spark, sf), "y", "l_quantity", "l_tax", 3).select("bin", "n", r6(F.col("slope")).alias("slope"), r6(F.col("r2")).alias("r2"))


@query("g25_prediction_interval", _FIT + """ SELECT x, round(a + b * x, 6) AS fit, round(a + b * x - 1.959963984540054 * sqrt(s2 * (1.0 / n + pow(x - mx, 2) / sxx)), 6) AS lo, round(a + b * x + 1.959963984540054 * sqrt(s2 * (1.0 / n + pow(x - mx, 2) / sxx)), 6) AS hi FROM s, e, (SELECT unnest([1.0, 25.0, 50.0])::DOUBLE AS x)""")
def g25(spark, sf):
    rows = _rows(spark, sf)
    beta, inv, rss, n = G.least_squares(rows, ["l_quantity"], "y")
    cov = inv * rss / (n - 2)
    out = [(float(q), *map(float, G.prediction_interval([1.0, q], beta.tolist(), cov.tolist()))) for q in (1.0, 25.0, 50.0)]
    return spark.createDataFrame(out, "x double, fit double, lo double, hi double").select("x", *[r6(F.col(c)).alias(c) for c in ("fit", "lo", "hi")])


@query("g39_estimate_ledger")
def g39(spark, sf):
    rows = _rows(spark, sf)
    old, new = G.ols(rows.filter("l_returnflag = 'A'"), "y", _X), G.ols(rows, "y", _X)
    return G.compare_estimates(old, new, ["term"]).select("term", r6(F.col("change")).alias("change"), "same_sign", "overlap")


@query("g29_bootstrap_spearman")
def g29(spark, sf):
    rho = G.bootstrap_rank_correlation(table(spark, sf, "events"), "user_id", "event_id", "value", 10, 3)
    return rho.agg(r6(F.percentile("rho", F.lit(0.025))).alias("lo"), r6(F.percentile("rho", F.lit(0.975))).alias("hi"))


@query("g13_nested_intercepts")
def g13(spark, sf):
    rows = table(spark, sf, "events").withColumn("game", F.floor(F.col("event_id") / 500))
    return _rounded(X.nested_intercepts(rows, "value", [], "user_id", "game"), "coef", "se")


@query("g30_disattenuated", """WITH t AS (SELECT event_type AS a, avg(value) AS raw, 1 - 1 / (1 + stddev_samp(value)) AS lam FROM events GROUP BY 1), c AS (SELECT avg(raw / lam) AS common FROM t)
SELECT x.a, y.a AS b, round(x.raw / x.lam - y.raw / y.lam, 6) AS difference, round(x.raw - y.raw, 6) AS raw_difference, round((x.lam - y.lam) * common, 6) AS null_benchmark FROM t x JOIN t y ON x.a < y.a, c""")
def g30b(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("raw"), (1 - 1 / (1 + F.stddev_samp("value"))).alias("lam"))
    out = G.disattenuated(rows, "event_type", "raw", "lam")
    return out.select("a", "b", *[r6(F.col(c)).alias(c) for c in ("difference", "raw_difference", "null_benchmark")])


@query("g19_concentration", "SELECT round(max(o_totalprice) / sum(o_totalprice), 8) AS largest, round((SELECT sum(o_totalprice) FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT (SELECT greatest(1, count(*) // 100) FROM orders))) / sum(o_totalprice), 6) AS top_share FROM orders")
def g19b(spark, sf):
    out = G.concentration(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    return out.select(F.round("largest", 8).alias("largest"), r6(F.col("top_share")).alias("top_share"))


@query("g34_complete_cells", """WITH r AS (SELECT user_id, event_type, event_id, value, CASE WHEN event_id % 7 < 3 OR user_id % 10 = 0 THEN NULL ELSE event_id % 50 END AS place FROM events), c AS (SELECT user_id, event_type, avg(place) AS m FROM r GROUP BY 1, 2 HAVING count(place) > 0)
SELECT r.user_id, r.event_type, count(*) AS n, count(*) FILTER (WHERE place IS NULL) AS imputed, round(avg(coalesce(place, m)), 6) AS place FROM r JOIN c ON r.user_id = c.user_id AND r.event_type = c.event_type GROUP BY 1, 2""")
def g34b(spark, sf):
    place = F.when((F.col("event_id") % 7 >= 3) & (F.col("user_id") % 10 != 0), (F.col("event_id") % 50).cast("double"))
    out = G.complete_cells(table(spark, sf, "events").withColumn("place", place), ["user_id", "event_type"], ["value", "place"], "place")
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("imputed").alias("imputed"), r6(F.avg("place")).alias("place"))
