"""Models and estimators against brute force on small tables."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.operators import estimators as G
from tidelake.operators import formulas as N
from tidelake.operators import learners as L
from tidelake.operators import mixed as X
from tidelake.operators import models as M
from tidelake.operators import windows as O
from tidelake.plans import catalog


def test_formulas_are_taken_apart():
    assert N.parse("y ~ a * b + c") == ("y", [("a",), ("b",), ("c",), ("a", "b")])
    assert N.parse("y ~ a*b*c") == ("y", [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")])
    assert N.parse("y ~ 1") == ("y", []) and N.parse("y ~ x + x^2 + a:b") == ("y", [("x",), ("x", "x"), ("a", "b")])
    with pytest.raises(ValueError, match="not a formula"):
        N.parse("y")


def _table(n=240, seed=3):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=n), r.normal(size=n) + 1
    player, game = np.arange(n) % 8, np.arange(n) // 6
    y = 2 + a - 0.5 * b + 0.7 * a * b + r.normal(size=8)[player] + r.normal(size=n // 6 + 1)[game] / 2 + r.normal(size=n)
    return a, b, player, game, y


def _nested_table(n=160, seed=3):
    """Games of four rows, within players of twenty."""
    r = np.random.default_rng(seed)
    a, b = r.normal(size=n), r.normal(size=n) + 1
    player, game = np.arange(n) // 20, np.arange(n) // 4
    y = 2 + a - 0.5 * b + r.normal(size=n // 20)[player] + 0.7 * r.normal(size=n // 4)[game] + r.normal(size=n)
    return a, b, player, game, y


def _frame(spark, a, b, player, game, y):
    return spark.createDataFrame([(float(p), float(q), int(u), int(g), float(v)) for p, q, u, g, v in zip(a, b, player, game, y)], "a double, b double, player int, game int, y double")


def test_fitted_interactions(spark):
    a, b, player, game, y = _table()
    df = _frame(spark, a, b, player, game, y).unionAll(spark.createDataFrame([(None, 1.0, 1, 1, 2.0)], "a double, b double, player int, game int, y double"))
    x = np.column_stack([np.ones(len(a)), a, b, a * b])
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    u = y - x @ beta
    inv = np.linalg.inv(x.T @ x)
    got = {r.term: r for r in N.fitted(df, "y ~ a * b").collect()}
    for k, t in enumerate(("const", "a", "b", "a:b")):
        assert got[t].coef == pytest.approx(beta[k]) and got[t].se == pytest.approx(math.sqrt(inv[k, k] * (u @ u) / (len(a) - 4)))
    scores = np.array([(x * u[:, None])[player == p].sum(0) for p in range(8)])
    cov = inv @ scores.T @ scores @ inv * 8 / 7 * (len(a) - 1) / (len(a) - 4)
    got = {r.term: r for r in N.fitted(df, "y ~ a * b", "cluster", ["player"]).collect()}
    assert got["a:b"].se == pytest.approx(math.sqrt(cov[3, 3]))


def test_least_squares_with_large_means(spark):
    """What residuals are left doesn't cancel."""
    r = np.random.default_rng(1)
    x, u = r.normal(size=500) + 1e7, r.normal(size=500) / 100
    y = 1e8 + 3 * x + u
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y)], "x double, y double")
    got = {t.term: t for t in G.ols(df, "y", ["x"]).collect()}
    xc, yc = x - x.mean(), y - y.mean()
    slope = xc @ yc / (xc @ xc)
    assert got["x"].coef == pytest.approx(slope, rel=1e-9) and got["x"].se == pytest.approx(math.sqrt(((yc - slope * xc) ** 2).sum() / 498 / (xc @ xc)), rel=1e-5)


def _dense_reml(x, y, outer, inner, p, q):
    """Restricted log-likelihood of the nested model, profiled over coefficients and the residual variance, by the whole covariance matrix; the coefficients, their covariance, and the variance."""
    v = np.eye(len(y)) + p * (outer[:, None] == outer) + q * ((outer[:, None] == outer) & (inner[:, None] == inner))
    w = np.linalg.inv(v)
    xx = x.T @ w @ x
    beta = np.linalg.solve(xx, x.T @ w @ y)
    u, free = y - x @ beta, len(y) - x.shape[1]
    s2 = u @ w @ u / free
    return -0.5 * (free * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1]), beta, np.linalg.inv(xx) * s2, s2


def _dense_fit(x, y, outer, inner, nested=True):
    """The best ratios by a search without derivatives: ever smaller steps along both."""
    at, step = np.log([0.1 if nested else 0.0 or 1e-300, 0.1]), 1.0
    value = lambda a: _dense_reml(x, y, outer, inner, math.exp(a[0]) if nested else 0.0, math.exp(a[1]))[0]
    best = value(at)
    while step > 1e-5:
        moves = [at + step * np.array(d) for d in ([(1, 0), (-1, 0)] if nested else []) + [(0, 1), (0, -1)]]
        tried = [(value(np.maximum(m, -18.0)), k) for k, m in enumerate(moves)]
        top, k = max(tried)
        if top > best + 1e-12:
            best, at = top, np.maximum(moves[k], -18.0)
        else:
            step /= 2
    return at, best


@pytest.mark.parametrize("most", [4_000_000, 64 * 3])
def test_restricted_likelihood_and_its_derivatives_are_the_dense_ones(spark, most):
    """With blocks of three units, every outer unit is dealt to several blocks."""
    a, b, player, game, y = _table(96)
    x = np.column_stack([np.ones(96), a])
    likelihood = X.RestrictedLikelihood(_frame(spark, a, b, player, game, y).repartition(3), "y", ["a"], "game", "player", most=most)
    assert (likelihood.blocks.filter("key is not null").count() > 0) == (most < 1000)
    logs = np.log([[0.01, 0.1], [1.0, 3.0], [0.3, 1e-7]])
    h = 1e-4
    for point, at in zip(likelihood.at(np.zeros(3, int), logs), logs, strict=True):
        value = lambda du, dv, at=at: _dense_reml(x, y, player, game, math.exp(at[0] + du), math.exp(at[1] + dv))[0]
        ll, beta, cov, s2 = _dense_reml(x, y, player, game, *np.exp(at))
        assert point.ll == pytest.approx(ll) and point.beta == pytest.approx(beta) and point.s2 == pytest.approx(s2) and point.cov.ravel() == pytest.approx(cov.ravel())
        assert point.gradient == pytest.approx([(value(h, 0) - value(-h, 0)) / (2 * h), (value(0, h) - value(0, -h)) / (2 * h)], rel=1e-5, abs=1e-7)
        assert point.hessian[0, 0] == pytest.approx((value(h, 0) - 2 * ll + value(-h, 0)) / h**2, rel=1e-3, abs=1e-4)
        assert point.hessian[1, 1] == pytest.approx((value(0, h) - 2 * ll + value(0, -h)) / h**2, rel=1e-3, abs=1e-4)
        assert point.hessian[0, 1] == pytest.approx((value(h, h) - value(h, -h) - value(-h, h) + value(-h, -h)) / (4 * h**2), rel=1e-3, abs=1e-4)


def test_nested_variances_are_a_dense_solvers(spark):
    a, b, player, game, y = _nested_table()
    x = np.column_stack([np.ones(160), a, b])
    at, best = _dense_fit(x, y, player, game)
    _, beta, cov, s2 = _dense_reml(x, y, player, game, *np.exp(at))
    got = {r.term: r for r in X.nested_intercepts(_frame(spark, a, b, player, game, y), "y", ["a", "b"], "player", "game").collect()}
    assert [got[t].coef for t in ("const", "a", "b")] == pytest.approx(beta.tolist(), rel=1e-4, abs=1e-5) and [got[t].se for t in ("const", "a", "b")] == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-3)
    assert [got[t].coef for t in ("sd_outer", "sd_inner", "sd_residual")] == pytest.approx([math.sqrt(math.exp(at[0]) * s2), math.sqrt(math.exp(at[1]) * s2), math.sqrt(s2)], rel=1e-3, abs=2e-3)


def test_one_variance_is_a_dense_solvers(spark):
    a, b, player, game, y = _nested_table(100)
    x = np.column_stack([np.ones(100), a])
    for fit, outer, inner in ((lambda d: X.inner_only(d, "y", ["a"], "player", "game"), player, game), (lambda d: X.random_intercept(d, "y", ["a"], "player"), np.zeros(100, int), player)):
        at, _ = _dense_fit(x, y, outer, inner, nested=False)
        _, beta, _, s2 = _dense_reml(x, y, outer, inner, 0.0, math.exp(at[1]))
        got = {r.term: r.coef for r in fit(_frame(spark, a, b, player, game, y)).collect()}
        assert [got["const"], got["a"]] == pytest.approx(beta.tolist(), rel=1e-4) and [got["sd_unit"], got["sd_residual"]] == pytest.approx([math.sqrt(math.exp(at[1]) * s2), math.sqrt(s2)], rel=1e-3, abs=2e-3)


def test_a_variance_that_is_none(spark):
    """Outcomes that differ less between units than by chance: the ratio ends at its bound, and the deviation is 0."""
    r = np.random.default_rng(2)
    unit = np.repeat(np.arange(20), 5)
    y = r.normal(size=100)
    y -= np.array([y[unit == u].mean() for u in range(20)])[unit]
    df = spark.createDataFrame([(int(u), float(v)) for u, v in zip(unit, y, strict=True)], "u int, y double")
    got = {t.term: t.coef for t in X.random_intercept(df, "y", [], "u").collect()}
    assert got["sd_unit"] == 0.0 and got["sd_residual"] == pytest.approx(y.std(ddof=1), rel=1e-6)


def test_bootstrap_of_the_nested_model_refits_drawn_rows(spark):
    a, b, player, game, y = _table(96)
    df = _frame(spark, a, b, player, game, y)
    got = collections.defaultdict(dict)
    for r in X.bootstrap_nested(df, "y", ["a"], "player", "game", 70, 5).collect():
        got[r.draw][r.term] = r.coef
    counts = {(r.draw, r.game): r.cnt for r in G.draw_counts(df.select("game").distinct(), "game", 70, 5).collect()}
    assert len(got) == 70
    for d in (0, 1, 69):
        rows = [(i, g * 100 + k) for i, g in enumerate(game) for k in range(counts.get((d, int(g)), 0))]
        at, label = np.array([i for i, _ in rows]), np.array([k for _, k in rows])
        x = np.column_stack([np.ones(len(at)), a[at]])
        t = got[d]
        p, q = (t["sd_outer"] / t["sd_residual"]) ** 2, (t["sd_inner"] / t["sd_residual"]) ** 2
        here, beta, *_ = _dense_reml(x, y[at], player[at], label, p, q)
        assert [t["const"], t["a"]] == pytest.approx(beta.tolist(), rel=1e-5)
        for dp, dq in ((1.3, 1), (1 / 1.3, 1), (1, 1.3), (1, 1 / 1.3)):
            assert _dense_reml(x, y[at], player[at], label, p * dp, q * dq)[0] <= here + 1e-6


def test_counts_are_held_once_an_inner_unit_and_draws_go_in_portions(spark, monkeypatch):
    """Eight inner units, each within many outer ones: a block holds eight rows of counts, not one a pair."""
    df = _frame(spark, *_table(96))
    whole = X.RestrictedLikelihood(df, "y", [], "player", "game")
    counts = G.draw_counts(whole.units.select("__inner").distinct(), "__inner", 70, 5)
    assert [tuple(r) for r in whole.drawn(counts, 70).blocks.select(F.length("counts"), F.length("place")).collect()] == [(8 * 70, 96 * 4)]
    fits = lambda: sorted((r.draw, r.term, r.coef) for r in X.bootstrap_nested(df, "y", [], "player", "game", 70, 5).collect())
    one = fits()
    monkeypatch.setattr(X, "_COUNTS_A_UNIT", 0)
    assert whole.portion(70) == 64
    two = fits()
    assert [r[:2] for r in one] == [r[:2] for r in two] and [r[2] for r in one] == pytest.approx([r[2] for r in two], rel=1e-6, abs=1e-6)


def test_steps_of_draws_read_cells_not_units(spark):
    """Sums by cells, made once, give the moments that units and counts give; one outer unit lies in several blocks."""
    df = spark.range(6000).selectExpr("id % 997 as game", "if(id % 3 = 0, 0, id % 11) as player", "cast((id * 37) % 101 as double) as y")
    whole = X.RestrictedLikelihood(df, "y", [], "game", "player", most=64 * 300)
    assert whole.blocks.filter("key is not null").count() > 1 and whole.by_cells(whole.cells())
    counts = G.draw_counts(whole.units.select("__inner").distinct(), "__inner", 70, 5)
    units, cells = whole.drawn(counts, 70), whole.drawn(counts, 70, True)
    assert cells.blocks.agg(F.sum(F.length("outer"))).first()[0] < 70 * 16 * whole.units.count() / 4
    for draw in (np.arange(70), np.array([3, 65, 69])):
        p, q = np.linspace(0.01, 1, len(draw)), np.linspace(2, 0.1, len(draw))
        assert cells.moments(draw, p, q) == pytest.approx(units.moments(draw, p, q), rel=1e-9)


def test_search_sweep(spark):
    a, b, player, game, y = _table()
    log, fit = X.search_sweep(_frame(spark, a, b, player, game, y), "y", ["a"], "player", "game")
    rows = log.collect()
    assert [r.method for r in rows] == list(X.STARTS) and len(rows) == 5 and sum(r.selected for r in rows) == 1 and {r.status for r in rows} == {"ok"} and all(r.converged and 0 < r.iterations < 40 for r in rows)
    assert max(r.llf for r in rows) - min(r.llf for r in rows) < 1e-5 and {r.term for r in fit.collect()} == {"const", "a", "sd_outer", "sd_inner", "sd_residual"}
    few, none = X.search_sweep(_frame(spark, a[:20], b[:20], player[:20], game[:20], y[:20]), "y", ["a"], "player", "game")
    assert none is None and {r.status for r in few.collect()} == {"fewer than 50 rows"}


def test_logit_clustered(spark):
    a, b, player, game, y = _table()
    z = (y > 2).astype(float)
    df = spark.createDataFrame([(float(p), int(u), float(v)) for p, u, v in zip(a, player, z)], "a double, player int, z double")
    x, beta = np.column_stack([np.ones(len(a)), a]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (z - p))
    inv = np.linalg.inv(x.T @ (x * (p * (1 - p))[:, None]))
    scores = np.array([(x * (z - p)[:, None])[player == k].sum(0) for k in range(8)])
    cov = inv @ scores.T @ scores @ inv * 8 / 7
    got = {r.term: r for r in M.logit_clustered(df, "z", ["a"], "player").collect()}
    assert got["a"].coef == pytest.approx(beta[1], rel=1e-4) and got["a"].se == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-3)


def test_odds_weights_and_concentration(spark):
    a, b, player, game, y = _table()
    z = (a > 0).astype(float)
    df = spark.createDataFrame([(i, float(q), float(v)) for i, (q, v) in enumerate(zip(b, z))], "i int, b double, z double")
    out = M.odds_weights(df, "z", ["b"], "w")
    w = np.array([r.w for r in out.orderBy("i").collect()])
    assert w.sum() == pytest.approx(len(w)) and (w > 0).all()
    log_odds = np.log(w)  # linear in b, up to a constant
    fit = np.polyfit(b, log_odds, 1)
    assert np.abs(np.polyval(fit, b) - log_odds).max() < 1e-6
    row = G.concentration(out, "w", "i", 0.1).first()
    assert row.largest == pytest.approx(w.max() / w.sum()) and row.top_share == pytest.approx(np.sort(w)[::-1][: len(w) // 10].sum() / w.sum())


def test_odds_are_columns(spark):
    """No function of the model library stays in the plan: it couldn't be sent to tasks in some sessions."""
    df = spark.createDataFrame([(float(i % 7), float(i % 3 == 0)) for i in range(60)] + [(None, 1.0)], "b double, z double")
    out = M.odds_weights(df, "z", ["b"], "w")
    assert "UDF" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 60  # a row without x has no weight


def test_equivalence_importance_and_band_pca(spark):
    r = np.random.default_rng(2)
    rows = [(i, "a" if i % 2 else "b", float(r.normal() + (0 if i % 2 else 3)), float(r.normal()), float(r.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, g string, v double, x double, w double")
    from tidelake.functions import tails

    for k in M.grouped_equivalence(df, ["g"], "v", 1.0).collect():
        own = np.array([q[2] for q in rows if q[1] == k.g])
        m, se = own.mean(), own.std(ddof=1) / 10
        want = max(tails.t_tail((m + 1) / se, 99), 1 - tails.t_tail((m - 1) / se, 99))
        assert k.mean == pytest.approx(m) and k.p == pytest.approx(want, abs=1e-9)
    made = df.withColumn("y", 2 * F.col("x") + 0.01 * F.col("w"))
    folded = made.withColumn("fold", F.col("i") % 2)
    got = {t.term: t.importance for t in L.importance(folded, "i", "y", ["x", "w"], "fold", L.LeastSquares().fit(folded, "y", ["x", "w"], "fold", 2)).collect()}
    x = np.array([q[3] for q in rows])
    assert got["x"] == pytest.approx(8 * x.var(), rel=0.35) and abs(got["w"]) < 0.01
    m = np.array([[q[2], q[3], q[4]] for q in rows])
    full = np.linalg.eigh(np.corrcoef(m.T))[1][:, -1]
    for k in M.band_pca(df, "g", ["v", "x", "w"], 50, full.tolist()).collect():
        own = np.array([[q[2], q[3], q[4]] for q in rows if q[1] == k.g])
        values, vectors = np.linalg.eigh(np.corrcoef(own.T))
        v = vectors[:, -1] * (1 if vectors[:, -1] @ full >= 0 else -1)
        assert k.share == pytest.approx(values[-1] / 3) and k.loadings == pytest.approx(v.tolist()) and k.congruence == pytest.approx(float(v @ full))


def test_boosting_lowers_the_error(spark):
    r = np.random.default_rng(4)
    x = r.random(400)
    df = spark.createDataFrame([(float(a), float(a > 0.5) * 3 + float(r.normal()) / 10, int(i % 4 > 0)) for i, a in enumerate(x)], "x double, y double, fold int")
    fit = L.transfer(L.Boosting(rounds=50).fit(df, "y", ["x"], "fold", 1), df.filter("fold = 0"), ["x"], "fold", "fit").collect()
    assert np.mean([(f.fit - f.y) ** 2 for f in fit]) < 0.15 * np.var([f.y for f in fit])


def test_top_of_against_sorting(spark):
    r = np.random.default_rng(6)
    rows = [(i, int(r.integers(0, 3)), None if i % 17 == 0 else float(r.integers(0, 6)) if i % 2 else float(r.random() * 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, f int, s double")
    for fold in ("f", None):
        got = {x.i for x in O.top_of(df, "s", "i", 0.3, fold, "top").filter("top").collect()}
        want = set()
        for k in {q[1] for q in rows} if fold else {None}:
            own = sorted((q for q in rows if fold is None or q[1] == k), key=lambda q: (q[2] is None, -(q[2] or 0), q[0]))
            want |= {q[0] for q in own[: round(0.3 * len(own))]}
        assert got == want
    assert O.top_of(df.filter("false"), "s", "i", 0.3, "f", "top").count() == 0


def test_pca_of_the_query_table(spark):
    rows = catalog.queries()["g1_pca"](spark, "/root/testdata/sf0.001").collect()
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_extendedprice", "l_quantity", "l_discount", "l_tax").toPandas().astype(float)
    values, vectors = np.linalg.eigh(np.corrcoef(t.to_numpy().T))
    for r, k in zip(sorted(rows, key=lambda r: r.component), np.argsort(values)[::-1]):
        v = vectors[:, k] * (1 if vectors[0, k] >= 0 else -1)
        assert r.share == pytest.approx(values[k] / 4, abs=1e-6) and r.loadings == pytest.approx(v.tolist(), abs=1e-4)


def test_bootstrap_fits_refit_each_draw(spark):
    a, b, player, game, y = _table(120)
    df = _frame(spark, a, b, player, game, y)
    got = collections.defaultdict(dict)
    for r in M.bootstrap_fits(df, "game", "y", ["a", "b"], 40, 7).collect():
        got[r.draw][r.term] = r.coef
    counts = collections.defaultdict(dict)
    for r in G.draw_counts(df.select("game").distinct(), "game", 40, 7).collect():
        counts[r.draw][r.game] = r.cnt
    assert len(got) == 40
    for d in range(40):
        at = np.repeat(np.arange(120), [counts[d].get(int(g), 0) for g in game])
        x = np.column_stack([np.ones(len(at)), a[at], b[at]])
        assert [got[d][t] for t in ("const", "a", "b")] == pytest.approx(np.linalg.lstsq(x, y[at], rcond=None)[0].tolist())


def test_rank_correlation_of_drawn_rows(spark):
    from tidelake.operators.aggregates import rank_correlation

    a, b, player, game, y = _table(90)
    df = _frame(spark, np.round(a), b, player, game, y)
    drawn = G.resampled_rows(df.select("game", "a", "y"), "game", 5, 3)
    got = {r.draw: r.rho for r in rank_correlation(drawn, "a", "y", ["draw"], [], average=True).collect()}
    counts = collections.defaultdict(dict)
    for r in G.draw_counts(df.select("game").distinct(), "game", 5, 3).collect():
        counts[r.draw][r.game] = r.cnt
    mean_rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for d in range(5):
        at = np.repeat(np.arange(90), [counts[d].get(int(g), 0) for g in game])
        assert got[d] == pytest.approx(np.corrcoef(mean_rank(np.round(a)[at]), mean_rank(y[at]))[0, 1])


def test_bootstrap_rank_correlation_is_that_of_drawn_rows(spark):
    from tidelake.operators.aggregates import rank_correlation

    a, b, player, game, y = _table(90)
    df = _frame(spark, np.round(a), b, player, game, y).select("game", "a", "y")
    want = {r.draw: r.rho for r in rank_correlation(G.resampled_rows(df, "game", 5, 3), "a", "y", ["draw"], [], average=True).collect()}
    for lanes in (2, 25):
        got = {r.draw: r.rho for r in G.bootstrap_rank_correlation(df, "game", "a", "y", 5, 3, lanes).collect()}
        assert got == pytest.approx(want, abs=1e-12)


def test_bootstrap_of_ranks_ranks_no_row_anew_for_each_draw(spark, monkeypatch):
    """What is staged has a row a row of the table, not a row a drawn row."""
    from tidelake.operators import estimators, ranks
    from tidelake.sources import staging

    staged = []
    for module in (ranks, estimators):
        monkeypatch.setattr(module, "staged", lambda df, name: staged.append(x := staging.staged(df, name)) or sizes.append(x.count()) or x, raising=False)
    sizes = []
    got = catalog.queries()["g29_bootstrap_spearman"](spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert [tuple(r) for r in got] == [(-0.039706, 0.031728)] and max(sizes) <= n


def test_ledger_of_two_estimates(spark):
    kind = "term string, coef double, lo double, hi double"
    old = spark.createDataFrame([("a", 1.0, 0.5, 1.5), ("b", -1.0, -2.0, 0.0), ("gone", 1.0, 0.0, 2.0)], kind)
    new = spark.createDataFrame([("a", 2.0, 1.6, 2.4), ("b", 0.5, -0.5, 1.5), ("new", 3.0, 2.0, 4.0)], kind)
    got = {r.term: (r.change, r.same_sign, r.overlap) for r in G.compare_estimates(old, new, ["term"]).collect()}
    assert got == {"a": (1.0, True, False), "b": (1.5, False, True), "gone": (None, None, None), "new": (None, None, None)}


def test_picks_of_a_draw_are_dealt_to_tasks(spark):
    units = spark.createDataFrame([(i, float(i)) for i in range(300)], "u int, v double")
    few, many = (G.draw_counts(units, "u", 40, 3, n) for n in (10**6, 500))
    assert "24), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert {r.n for r in many.groupBy("draw").agg(F.sum("cnt").alias("n")).collect()} == {300} and many.filter("v <> u").isEmpty()
