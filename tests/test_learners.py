"""Learners, cross-fits, boosting and importance against NumPy."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.operators import learners as L


def _data(n=600, seed=4):
    r = np.random.default_rng(seed)
    a, b = np.round(r.normal(size=n), 2), r.integers(0, 12, n).astype(float)
    unit = np.arange(n) % 30
    y = np.where(a > 0.3, 2.0, -1.0) + 0.3 * b + r.normal(size=30)[unit] / 2 + r.normal(size=n)
    return a, b, unit, y, unit % 5


def _frame(spark, a, b, unit, y, fold):
    rows = [(i, float(p), float(q), int(u), float(v), int(f)) for i, (p, q, u, v, f) in enumerate(zip(a, b, unit, y, fold, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, unit int, y double, fold int").repartition(4)


def _linear(x, y, alpha=None):
    mean, m = x.mean(0), x - x.mean(0)
    sd = np.ones(x.shape[1]) if alpha is None else m.std(0)
    z = m / sd
    beta = np.linalg.solve(z.T @ z + (alpha or 0) * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return lambda new: y.mean() + (new - mean) @ beta


def _mixed(x, y, unit):
    one = np.column_stack([np.ones(len(y)), x])

    def at(u):
        v = np.linalg.inv(np.eye(len(y)) + math.exp(u) * (unit[:, None] == unit))
        xx = one.T @ v @ one
        beta = np.linalg.solve(xx, one.T @ v @ y)
        e, free = y - one @ beta, len(y) - one.shape[1]
        return -0.5 * (free * math.log(e @ v @ e / free) - np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1]), beta

    lo, hi, g = -12.0, 5.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        p, q = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, q) if at(p)[0] >= at(q)[0] else (p, hi)
    beta = at((lo + hi) / 2)[1]
    return lambda new: beta[0] + new @ beta[1:]


def _boosted(x, y, held_x, held_y, how):
    """The same trees, grown row by row in NumPy: fit on (x, y), ended by the held-out rows' scores; returns staged predictions and scores."""
    edges = [(u[1:] + u[:-1]) / 2 if len(u) <= how.bins else np.unique(np.percentile(v, [100 * i / how.bins for i in range(1, how.bins)])) for v in x.all.T for u in [np.unique(v)]]
    x = x.train
    fit, held = np.full(len(y), y.mean()), np.full(len(held_y), y.mean())
    trees, scores = [], [-0.5 * np.mean((held_y - held) ** 2)] if len(held_y) else []

    def grow(rows, depth):
        r = (y - fit)[rows]
        best = None
        if depth < how.depth:
            for f, cuts in enumerate(edges):
                for c in cuts:
                    left = x[rows, f] <= c
                    m, n = left.sum(), len(rows)
                    if m >= how.least and n - m >= how.least:
                        gain = r[left].sum() ** 2 / m + r[~left].sum() ** 2 / (n - m) - r.sum() ** 2 / n
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                            best = (gain, f, c)
        if best is None:
            return how.step * r.mean()
        _, f, c = best
        left = x[rows, f] <= c
        return f, c, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    while len(trees) < how.rounds:
        trees.append(grow(np.arange(len(y)), 0))
        fit = fit + np.array([value(trees[-1], row) for row in x])
        if len(held_y):
            held = held + np.array([value(trees[-1], row) for row in held_x])
            scores.append(-0.5 * np.mean((held_y - held) ** 2))
            if len(scores) > how.patience and not any(s > scores[-how.patience - 1] + how.gain for s in scores[-how.patience :]):
                break
    return lambda new: y.mean() + np.array([sum(value(t, row) for t in trees) for row in new]), scores


def _brute(kind, a, b, unit, y, fold):
    x, out = np.column_stack([a, b]), np.empty(len(y))
    for f in range(5):
        train = fold != f
        fit = {"ols": lambda: _linear(x[train], y[train]), "ridge": lambda: _linear(x[train], y[train], 1.0), "mixed": lambda: _mixed(x[train], y[train], unit[train]),
               "boosting": lambda: _boosted(collections.namedtuple("X", "all train")(x, x[train]), y[train], x[:0], y[:0], BOOST)[0]}[kind]()
        out[~train] = fit(x[~train])
    return out


BOOST = L.Boosting(rounds=6, depth=3, step=0.3, least=10, bins=40, refresh=4, rows_a_block=70)


@pytest.mark.parametrize(("kind", "learner"), [("ols", L.LeastSquares()), ("ridge", L.Ridge(1.0)), ("mixed", L.Mixed("unit")), ("boosting", BOOST)])
def test_crossfit(spark, kind, learner):
    data = _data(150 if kind == "mixed" else 400)
    a, b, unit, y, fold = data
    df = _frame(spark, *data)
    got = L.crossfit(df, "y", ["a", "b"], "fold", 5, "fit", learner)
    rows = {r.id: r.fit for r in got.collect()}
    want = _brute(kind, *data)
    assert [rows[i] for i in range(len(y))] == pytest.approx(want.tolist(), rel=1e-5, abs=1e-6)
    r2 = {r.fold: r.r2 for r in L.fold_r2(got, "y", "fit", "fold").collect()}
    for f in range(5):
        own = fold == f
        assert r2[f] == pytest.approx(1 - ((y - want)[own] ** 2).sum() / ((y[own] - y[~own].mean()) ** 2).sum(), rel=1e-4)


def test_transfer_uses_the_model_that_has_not_seen_the_fold(spark):
    data = _data()
    df = _frame(spark, *data)
    models = L.LeastSquares().fit(df, "y", ["a", "b"], "fold", 5)
    other = spark.createDataFrame([(f, 0.5, 3.0) for f in range(5)] + [(9, 0.5, 3.0), (1, None, 3.0)], "fold int, a double, b double")
    got = L.transfer(models, other, ["a", "b"], "fold", "p").collect()
    for r in got:
        assert r.p == (pytest.approx(models[r.fold].const + 0.5 * models[r.fold].coef[0] + 3 * models[r.fold].coef[1]) if r.fold < 5 and r.a is not None else None)


def test_boosting_stops_as_a_replay_does(spark):
    """One fit, no tree behind the stop; scores and the stop are those of the trees grown in NumPy."""
    a, b, unit, y, fold = _data(500, 8)
    df = _frame(spark, a, b, unit, y, fold)
    how = L.Boosting(rounds=200, depth=2, step=0.5, least=10, bins=30, unit="unit", held=0.3, patience=4, refresh=3, rows_a_block=64)
    models = how.fit(df, "y", ["a", "b"], "fold", 5)
    x = np.column_stack([a, b])
    for f in range(5):
        units = sorted({int(u) for u in unit[fold != f]}, key=lambda u: (int(hashlib.md5(f"{u}:{f}:1".encode()).hexdigest()[:13], 16), u))
        held = np.isin(unit, units[: round(0.3 * len(units))]) & (fold != f)
        train = (fold != f) & ~held
        predict, scores = _boosted(collections.namedtuple("X", "all train")(x, x[train]), y[train], x[held], y[held], how)
        assert models[f].scores == pytest.approx(scores) and len(models[f].trees) == len(scores) - 1 < 200
        assert models[f].scored(x.T[:, :50]) == pytest.approx(predict(x[:50]))


def test_boosting_takes_missing_values_and_constant_columns(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 7), 1.0, 5.0 if i % 3 == 0 else 0.0, i % 2) for i in range(200)] + [(999, 1.0, 1.0, None, 0)]
    df = spark.createDataFrame(rows, "id int, a double, c double, y double, fold int")
    got = L.crossfit(df, "y", ["a", "c"], "fold", 2, "fit", L.Boosting(rounds=40, depth=2, step=0.3))
    assert all(abs(r.fit - r.y) < 0.1 for r in got.filter("y is not null").collect()) and got.filter("id = 999").first().fit == pytest.approx(0.0, abs=0.1)


def test_importance(spark):
    data = _data(300)
    a, b, unit, y, fold = data
    df = _frame(spark, *data)
    x = np.column_stack([a, b])
    for models in (L.LeastSquares().fit(df, "y", ["a", "b"], "fold", 5), BOOST.fit(df, "y", ["a", "b"], "fold", 5)):
        got = {r.term: r.importance for r in L.importance(df, "id", "y", ["a", "b"], "fold", models, repeats=3, seed=5).collect()}
        score = (lambda f, z, models=models: models[f].scored(z.T)) if isinstance(models[0], L.Boosted) else (lambda f, z, models=models: models[f].const + z @ np.array(models[f].coef))
        for j, c in enumerate(("a", "b")):
            rises = []
            for f in range(5):
                own = np.flatnonzero(fold == f)
                base = ((y[own] - score(f, x[own])) ** 2).mean()
                errors = []
                for rep in range(3):
                    order = sorted(own, key=lambda i: (hashlib.md5(f"{i}:{c}:{rep}:5".encode()).hexdigest(), i))
                    z = x[own].copy()
                    z[:, j] = x[order, j]
                    errors.append(((y[own] - score(f, z)) ** 2).mean())
                rises.append(np.mean(errors) - base)
            assert got[c] == pytest.approx(np.mean(rises))


def test_a_permutation_keeps_a_folds_values(spark):
    df = _frame(spark, *_data(100))
    moved = L.permuted_rows(df, "id", "fold", ["a", "b"], 2, 1)
    assert moved.count() == 400
    for c in ("a", "b"):
        for fold in range(5):
            own = sorted(r[0] for r in df.filter(F.col("fold") == fold).select(c).collect())
            for rep in range(2):
                assert sorted(r[0] for r in moved.filter(f"fold = {fold} and __column = '{c}' and __repeat = {rep}").select("__value").collect()) == own


def test_rows_with_the_same_bins_are_one_cell(spark):
    """However many rows there are, what boosting keeps is bounded by the combinations of bins."""
    a, b, unit, y, fold = _data(2000)
    df = _frame(spark, np.sign(a), b, unit, y, fold)
    how = L.Boosting()
    cells = how._cells(df, "y", ["a", "b"], "fold", F.lit(0).cast("long"), how._edges(df, ["a", "b"]), 0.5, 5).collect()
    assert len(cells) == len({(p, q) for p, q in zip(np.sign(a), b)})
    sums = np.array([r.sums for r in cells]).sum(0).reshape(5, 5)
    assert sums[0].tolist() == [(fold != f).sum() for f in range(5)] and sums[1] == pytest.approx([(y - 0.5)[fold != f].sum() for f in range(5)]) and not sums[2:].any()


def test_a_table_scores_as_the_trees_do(spark):
    a, b, unit, y, fold = _data()
    a[::17] = np.nan
    models = L.Boosting(rounds=12, depth=3).fit(_frame(spark, a, b, unit, y, fold), "y", ["a", "b"], "fold", 5)
    x = np.array([np.append(a, [np.inf, -np.inf, np.nan]), np.append(b, [np.nan, 4.5, np.inf])])
    for m in models:
        assert m.tabled(2, 0)(x).tolist() == m.scored(x).tolist() == m.tabled(2)(x).tolist() and m.tabled(2) != m.scored
