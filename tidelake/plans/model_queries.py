"""Queries of models and resampled fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.operators import estimators as G
from tidelake.operators import formulas as N
from tidelake.operators import learners as L
from tidelake.operators import mixed as X
from tidelake.operators import models as M
from tidelake.operators import windows as O
from tidelake.plans.catalog import query
from tidelake.plans.tables import r6, table
from tidelake.sources.staging import staged

_X = ["l_quantity", "l_discount", "l_tax"]


def _rows(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", (F.col("l_extendedprice") / 1000).alias("y"), *_X)
    return rows.withColumn("late", (F.col("l_returnflag") == "N").cast("double"))


def _folded(spark, sf, unit, seed, *more):
    """What learners read, with folds of the unit, staged: they go over it many times."""
    return staged(O.folds(_rows(spark, sf).select("l_orderkey", "l_suppkey", "l_returnflag", "y", *_X), unit, 5, seed).select("l_suppkey", "fold", "y", *_X, *more), "folded")


@query("g2_band_pca")
def g2(spark, sf):
    rows = _rows(spark, sf)
    full = list(G.pca(rows, ["y", *_X], "y").filter("component = 1").first()["loadings"])
    out = M.band_pca(rows, "l_returnflag", ["y", *_X], 50, full)
    return out.select("l_returnflag", "n", F.round("share", 4).alias("share"), F.round("congruence", 4).alias("congruence"))


@query("g11_logit_clustered")
def g11(spark, sf):
    return M.logit_clustered(_rows(spark, sf), "late", ["l_quantity", "l_discount"], "l_suppkey").select("term", F.round("coef", 4).alias("coef"), F.round("se", 4).alias("se"))


@query("g16_boosting")
def g16(spark, sf):
    rows = _folded(spark, sf, "l_suppkey", 3, "l_returnflag")
    # One lane: what isn't in fold 0 trains the model that scores fold 0.
    models = L.Boosting(rounds=100, depth=5, step=0.1).fit(rows, "y", _X, "fold", 1)
    out = L.transfer(models, rows.filter("fold = 0"), _X, "fold", "fit")
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fit"), 2).alias("fit"))


@query("g17_stopped_boosting")
def g17(spark, sf):
    rows = _folded(spark, sf, "l_suppkey", 3)
    models = L.Boosting(rounds=500, depth=4, step=0.05, unit="l_suppkey").fit(rows, "y", _X, "fold", 5)
    return spark.createDataFrame([(f, len(m.trees), len(m.scores) - 1) for f, m in enumerate(models)], "fold int, trees int, stopped int")


@query("g15_learners")
def g15(spark, sf):
    rows = _folded(spark, sf, "l_orderkey", 9)
    learners = {"ols": L.LeastSquares(), "ridge": L.Ridge(1.0), "mixed": L.Mixed("l_suppkey"), "boosting": L.Boosting(rounds=500, unit="l_suppkey")}
    parts = [L.fold_r2(L.crossfit(rows, "y", _X, "fold", 5, "fit", m), "y", "fit", "fold").select(F.lit(name).alias("learner"), "fold", "n", F.round("r2", 5).alias("r2")) for name, m in learners.items()]
    return reduce(DataFrame.unionAll, parts)


_FOLDS_SQL = "u AS (SELECT l_suppkey, (row_number() OVER (ORDER BY md5(l_suppkey || ':9'), l_suppkey) - 1) % 5 AS fold FROM (SELECT DISTINCT l_suppkey FROM lineitem)), r AS (SELECT u.fold, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem l JOIN u ON l.l_suppkey = u.l_suppkey), m AS (SELECT f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS my FROM r, (SELECT unnest(range(5)) AS f) WHERE fold <> f GROUP BY 1)"


@query("g15_fold_r2", f"WITH {_FOLDS_SQL} SELECT fold::INT AS fold, count(*) AS n, round(1 - sum(pow(y - a - b * x, 2)) / sum(pow(y - my, 2)), 6) AS r2 FROM r JOIN m ON fold = f GROUP BY 1")
def g15b(spark, sf):
    rows = L.crossfit(O.folds(_rows(spark, sf), "l_suppkey", 5, 9), "y", ["l_quantity"], "fold", 5, "fit")
    return L.fold_r2(rows, "y", "fit", "fold").withColumn("r2", r6(F.col("r2")))


@query("g15_transfer", f"WITH {_FOLDS_SQL} SELECT p_partkey, round(a + b * p_size, 6) AS fit FROM part JOIN m ON f = p_partkey % 5")
def g15c(spark, sf):
    models = L.LeastSquares().fit(O.folds(_rows(spark, sf), "l_suppkey", 5, 9), "y", ["l_quantity"], "fold", 5)
    parts = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 5).alias("fold"))
    return L.transfer(models, parts, ["p_size"], "fold", "fit").select("p_partkey", r6(F.col("fit")).alias("fit"))


@query("g19_odds_weights")
def g19(spark, sf):
    out = M.odds_weights(_rows(spark, sf), "late", ["l_quantity", "l_tax"], "w")
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 0).alias("w"))


_FOLD5 = "u AS (SELECT l_suppkey, (row_number() OVER (ORDER BY md5(l_suppkey || ':9'), l_suppkey) - 1) % 5 AS fold FROM (SELECT DISTINCT l_suppkey FROM lineitem))"


@query("g20_calibration", f"""WITH {_FOLD5}, r AS (SELECT u.fold, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem l JOIN u ON l.l_suppkey = u.l_suppkey),
m AS (SELECT f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r, (SELECT unnest(range(5)) AS f) WHERE fold <> f GROUP BY 1), s AS (SELECT y, a + b * x AS fit FROM r JOIN m ON fold = f),
q AS (SELECT list_sort(list_distinct(quantile_cont(fit, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS es FROM s), b AS (SELECT len(list_filter(es[2:len(es) - 1], lambda e: e < fit)) AS bin, y, fit FROM s, q)
SELECT bin, count(*) AS n, round(avg(y), 4) AS observed, round(avg(fit), 4) AS predicted FROM b GROUP BY 1""")
def g20(spark, sf):
    rows = L.crossfit(O.folds(_rows(spark, sf), "l_suppkey", 5, 9), "y", ["l_quantity"], "fold", 5, "fit")
    return M.calibration(rows, "y", "fit").select("bin", "n", F.round("observed", 4).alias("observed"), F.round("predicted", 4).alias("predicted"))


@query("g21_equivalence")
def g21(spark, sf):
    centred = table(spark, sf, "events").withColumn("v", F.col("value") - 50)
    return M.grouped_equivalence(centred, ["event_type"], "v", 5.0).select("event_type", "n", r6(F.col("mean")).alias("mean"), r6(F.col("p")).alias("p"))


@query("g28_bootstrap_fits")
def g28(spark, sf):
    fits = M.bootstrap_fits(_rows(spark, sf), "l_suppkey", "y", ["l_quantity"], 2000, 7)
    return fits.groupBy("term").agg(F.count(F.lit(1)).alias("draws"), r6(F.percentile("coef", F.lit(0.025))).alias("lo"), r6(F.percentile("coef", F.lit(0.975))).alias("hi"))


@query("g32_permutation_importance")
def g32(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_totalprice") / 2000 + F.col("o_custkey") % 7).alias("a"), (F.col("o_custkey") % 11).cast("double").alias("b"))
    rows = staged(O.folds(rows, "o_custkey", 5, 3), "folded")
    learners = {"ols": L.LeastSquares(), "boosting": L.Boosting(rounds=40, step=0.2, unit="o_custkey")}
    fitted = {name: m.fit(rows, "y", ["a", "b"], "fold", 5) for name, m in learners.items()}
    return L.importances(rows, "o_orderkey", "y", ["a", "b"], "fold", fitted, repeats=10).select("learner", "term", F.round("importance", 3).alias("importance"))


def _simple(model, rows, y, x, where):
    fit = f"SELECT regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a, count(*) AS n, avg({x}) AS mx, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) - pow(regr_sxy({y}, {x}), 2) / regr_sxx({y}, {x}) AS rss FROM lineitem {where}"
    name = {"l_quantity * l_discount": "l_quantity:l_discount"}.get(x, x)
    return f"SELECT '{model}' AS model, '{rows}' AS rows, '{name}' AS term, round(b, 6) AS coef, round(sqrt(rss / (n - 2) / sxx), 6) AS se FROM ({fit}) UNION ALL SELECT '{model}', '{rows}', 'const', round(a, 6), round(sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)), 6) FROM ({fit})"


_GRID_SQL = " UNION ALL ".join(_simple(m, r, "l_extendedprice / 1000", x, w) for m, x in (("product", "l_quantity * l_discount"), ("tax", "l_tax")) for r, w in (("all", ""), ("returned", "WHERE l_returnflag = 'R'")))


@query("n1_model_grid", _GRID_SQL)
def n1(spark, sf):
    models = {"product": ("y ~ l_quantity:l_discount", "ols", None), "tax": ("y ~ l_tax", "ols", None)}
    specs = {"all": F.lit(True), "returned": F.col("l_returnflag") == "R"}
    return N.model_grid(_rows(spark, sf), models, specs).select("model", "rows", "term", r6(F.col("coef")).alias("coef"), r6(F.col("se")).alias("se"))


@query("n2_interactions")
def n2(spark, sf):
    models = {"v1": ("y ~ l_quantity * l_discount + l_tax + l_quantity^2", "cluster", ["l_suppkey"]), "late": ("late ~ l_quantity * l_tax", "logit", ["l_suppkey"])}
    out = N.model_grid(_rows(spark, sf), models, {"all": F.lit(True)})
    return out.select("model", "rows", "term", F.round("coef", 3).alias("coef"), F.round("se", 3).alias("se"))


def _games(spark, sf):
    return table(spark, sf, "events").withColumn("game", F.floor(F.col("event_id") / 500))


@query("g12_inner_only")
def g12(spark, sf):
    return X.inner_only(_games(spark, sf), "value", [], "user_id", "game").select("term", r6(F.col("coef")).alias("coef"), r6(F.col("se")).alias("se"))


@query("g28_bootstrap_mixed")
def g28b(spark, sf):
    fits = X.bootstrap_nested(_games(spark, sf), "value", [], "user_id", "game", 2000, 7)
    return fits.groupBy("term").agg(F.count(F.lit(1)).alias("draws"), F.round(F.percentile("coef", F.lit(0.025)), 4).alias("lo"), F.round(F.percentile("coef", F.lit(0.975)), 4).alias("hi"))


@query("g38_search_sweep")
def g38(spark, sf):
    log, _ = X.search_sweep(_games(spark, sf), "value", [], "user_id", "game")
    return log.withColumn("llf", F.round("llf", 1))
