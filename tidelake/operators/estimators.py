"""Statistical estimators on Spark aggregates.

Least squares needs the Gram matrix of a few columns: one aggregation with partial sums; what comes to
the driver is p x p numbers, whatever the rows.  Tests and intervals are scalar arithmetic (functions.tails).
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.functions import tails
from tidelake.operators.ranks import attach, exact_quantiles, global_rank, weighted_rank_correlations
from tidelake.operators.windows import top_of
from tidelake.sources.staging import discarded, staged


def gram(df: DataFrame, x: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n, with a leading constant."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{k}") for k, (i, j) in enumerate(pairs)]).first()
    m = np.zeros((len(cols), len(cols)))
    for k, (i, j) in enumerate(pairs):
        m[i, j] = m[j, i] = row[k] or 0.0
    return m[:-1, :-1], m[:-1, -1], m[-1, -1], int(m[0, 0])


def centred(df: DataFrame, x: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int, np.ndarray]:
    """Covariances of x, of x with y, the variance of y (all times n), n, and the means of x and y.

    Covariance aggregates update centred moments, so large means don't cancel what is left of the residuals.
    """
    names = [*x, y]
    cols = [F.col(c).cast("double") for c in names]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    row = df.agg(F.count(F.lit(1)), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)], *[F.covar_pop(cols[i], cols[j]).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
    n, m = int(row[0]), np.zeros((len(cols), len(cols)))
    for k, (i, j) in enumerate(pairs):
        m[i, j] = m[j, i] = (row[1 + len(cols) + k] or 0.0) * n
    return m[:-1, :-1], m[:-1, -1], m[-1, -1], n, np.array([v or 0.0 for v in row[1 : 1 + len(cols)]])


def least_squares(df: DataFrame, x: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Coefficients with a leading constant, the inverse of X'X, the residual sum of squares and n, from centred moments."""
    xx, xy, yy, n, mean = centred(df, x, y)
    inv = np.linalg.inv(xx) if x else np.zeros((0, 0))
    slopes = inv @ xy
    beta = np.concatenate([[mean[-1] - mean[:-1] @ slopes], slopes])
    whole = np.zeros((len(beta), len(beta)))
    whole[1:, 1:] = inv
    whole[0, 1:] = whole[1:, 0] = -inv @ mean[:-1]
    whole[0, 0] = 1 / max(1, n) + mean[:-1] @ inv @ mean[:-1]
    return beta, whole, max(0.0, float(yy - slopes @ xy)), n


def _frame(df: DataFrame, names: list[str], beta: np.ndarray, cov: np.ndarray, dof: float | None) -> DataFrame:
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    rows = []
    for n, b, s in zip(names, beta, se, strict=True):
        t = b / s if s > 0 else math.nan
        q = tails.t_quantile(0.975, dof) if dof else 1.959963984540054
        p = (2 * tails.t_tail(abs(t), dof) if dof else 2 * tails.normal_tail(abs(t))) if s > 0 else math.nan
        rows.append((n, *map(float, (b, s, b - q * s, b + q * s, p))))
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, lo double, hi double, p double")


def ols(df: DataFrame, y: str, x: list[str]) -> DataFrame:
    """term, coef, se, lo, hi, p of least squares with a constant."""
    df = df.dropna(subset=[y, *x])
    beta, inv, rss, n = least_squares(df, x, y)
    return _frame(df, ["const", *x], beta, rss / (n - len(beta)) * inv, n - len(beta))


def residuals(df: DataFrame, y: str, x: list[str], name: str) -> DataFrame:
    """Adds what least squares of y on x leaves."""
    beta = least_squares(df.dropna(subset=[y, *x]), x, y)[0]
    fit = F.lit(float(beta[0]))
    for c, b in zip(x, beta[1:], strict=True):
        fit = fit + F.col(c) * F.lit(float(b))
    return df.withColumn(name, F.col(y) - fit)


def _meat(df: DataFrame, x: list[str], cluster: list[str]) -> tuple[np.ndarray, int]:
    """Sum over clusters of (X'u)(X'u)', and their number; u is the column __u."""
    cols = ["const", *x]
    scores = df.withColumn("const", F.lit(1.0)).groupBy(*cluster).agg(*[F.sum(F.col(c) * F.col("__u")).alias(f"__s{i}") for i, c in enumerate(cols)])
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    row = scores.agg(F.count(F.lit(1)), *[F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")).alias(f"m{k}") for k, (i, j) in enumerate(pairs)]).first()
    m = np.zeros((len(cols), len(cols)))
    for k, (i, j) in enumerate(pairs):
        m[i, j] = m[j, i] = row[k + 1]
    return m, row[0]


def cluster_ols(df: DataFrame, y: str, x: list[str], clusters: list[str]) -> DataFrame:
    """Least squares with standard errors clustered one way, or two ways (sum of both less that of their intersection)."""
    df = df.dropna(subset=[y, *x, *clusters])
    beta, inv, _, n = least_squares(df, x, y)
    with_u = residuals(df, y, x, "__u")
    k = len(beta)

    def cov(keys: list[str]) -> np.ndarray:
        m, g = _meat(with_u, x, keys)
        return inv @ m @ inv * (g / (g - 1)) * ((n - 1) / (n - k))

    total = cov(clusters[:1]) if len(clusters) == 1 else cov(clusters[:1]) + cov(clusters[1:2]) - cov(clusters[:2])
    return _frame(df, ["const", *x], beta, total, None)


def pca(df: DataFrame, columns: list[str], positive: str) -> DataFrame:
    """Correlation-matrix PCA: component, share, loadings; signs so that ``positive`` loads positively."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    m = np.eye(len(columns))
    for (a, b), r in zip(pairs, row, strict=True):
        m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = r
    values, vectors = np.linalg.eigh(m)
    at = columns.index(positive)
    rows = []
    for k, j in enumerate(np.argsort(values)[::-1]):
        v = vectors[:, j] * (1 if vectors[at, j] >= 0 else -1)
        rows.append((k + 1, float(values[j] / len(columns)), [float(z) for z in v]))
    return df.sparkSession.createDataFrame(rows, "component int, share double, loadings array<double>")


def congruence(a: Column, b: Column) -> Column:
    """Tucker's coefficient of two loading arrays."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def project(columns: list[str], loadings: list[float]) -> Column:
    """Linear combination of columns."""
    out = F.lit(0.0)
    for c, w in zip(columns, loadings, strict=True):
        out = out + F.col(c) * F.lit(float(w))
    return out


def hinge_grid(df: DataFrame, y: str, x: str, cuts: list[float]) -> DataFrame:
    """For each cut the residual sum of squares of y on (1, x, max(0, x - cut)), all cuts in one pass over the rows, by centred moments: large means don't cancel what residuals are left."""
    df = df.dropna(subset=[x, y])
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    hinges = [F.greatest(xc - F.lit(float(c)), F.lit(0.0)) for c in cuts]
    moments = [F.avg(h) for h in hinges] + [f(h, z) for h in hinges for f, z in ((F.covar_pop, xc), (F.covar_pop, h), (F.covar_pop, yc))]
    row = df.agg(F.count(F.lit(1)), F.avg(xc), F.avg(yc), F.var_pop(xc), F.var_pop(yc), F.covar_pop(xc, yc), *moments).first()
    n, mx, my, vx, vy, cxy = row[:6]
    out = []
    for i, c in enumerate(cuts):
        mh, (hx, hh, hy) = row[6 + i], row[6 + len(cuts) + 3 * i : 9 + len(cuts) + 3 * i]
        g, b = np.array([[vx, hx], [hx, hh]]), np.array([cxy, hy])
        slopes = np.linalg.lstsq(g, b, rcond=None)[0]
        out.append((float(c), float(max(0.0, n * (vy - slopes @ b))), float(my - slopes @ [mx, mh]), *map(float, slopes), n))
    return df.sparkSession.createDataFrame(out, "cut double, rss double, b0 double, b1 double, b2 double, n long")


def segmented(df: DataFrame, y: str, x: str, points: int = 81) -> DataFrame:
    """Breakpoint of least residual sum over a grid from the 10th to the 90th percentile, the F test against a line, and the profile interval."""
    lo, hi = exact_quantiles(df, [], x, [0.1, 0.9]).first()["q"]
    grid = hinge_grid(df, y, x, np.linspace(lo, hi, points).tolist())
    rows = sorted(((r["rss"], r["cut"], r["b1"], r["b2"], r["n"]) for r in grid.collect()))  # one row a grid point
    _, _, line, n = least_squares(df.dropna(subset=[x, y]), [x], y)
    rss, cut, b1, b2, _ = rows[0]
    f = (line - rss) / (rss / (n - 4)) / 2
    inside = [c for r, c, *_ in rows if r <= rss * (1 + tails.f_quantile(0.95, 1, n - 4) / (n - 4))]
    return df.sparkSession.createDataFrame([tuple(map(float, (cut, min(inside), max(inside), b1, b1 + b2, f, tails.f_tail(f, 2, n - 4), 1 - rss / line)))], "cut double, lo double, hi double, slope_below double, slope_above double, f double, p double, gain double")


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    m = np.eye(len(columns))
    for (a, b), r in zip(pairs, row, strict=True):
        m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = r
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, np.diag(np.linalg.inv(m)), strict=True)], "term string, vif double")


def ridge(df: DataFrame, y: str, x: list[str], alpha: float) -> DataFrame:
    """Coefficients on columns standardised with the population deviation."""
    df = df.dropna(subset=[y, *x])
    xx, xy, _, n = gram(df, x, y)
    mean, my = xx[0, 1:] / n, xy[0] / n
    sd = np.sqrt(np.diag(xx)[1:] / n - mean**2)
    g = (xx[1:, 1:] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    beta = np.linalg.solve(g + alpha * np.eye(len(x)), (xy[1:] - n * mean * my) / sd)
    return df.sparkSession.createDataFrame([("const", float(my)), *[(c, float(b)) for c, b in zip(x, beta, strict=True)]], "term string, coef double")


def draw_counts(units: DataFrame, unit: str, draws: int, seed: int, picks_a_task: int = 1_000_000) -> DataFrame:
    """The units, with draw and cnt: how often each unit is drawn in each bootstrap draw.

    Draw j of a round takes the unit whose rank is a hash of (draw, j), so counts are the same on every engine and run, and are
    made by an aggregation, not on the driver.  Picks are dealt by rank to as many tasks as their number asks for, so no task's table of counts grows with
    units times draws; they are counted and meet their unit, with its columns, where they lie.
    """
    spark, n = units.sparkSession, units.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * draws // picks_a_task))
    ranked = global_rank(units, [], [unit], "__r").withColumn("__rank", F.col("__r") - 1).drop("__r")
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("long")
    picks = spark.range(0, n * draws, 1, tasks).select((F.col("id") % draws).alias("draw"), (hashed % n).alias("__rank")).repartition(tasks, "__rank")
    return picks.groupBy("draw", "__rank").agg(F.count(F.lit(1)).alias("cnt")).join(ranked, "__rank").select(*units.columns, "draw", "cnt")


def cluster_bootstrap(df: DataFrame, unit: str, numerator: Column, denominator: Column, draws: int, seed: int) -> DataFrame:
    """Ratio of sums with a percentile interval: counts times per-unit sums, rows are never drawn again."""
    sums = df.groupBy(unit).agg(F.sum(numerator).alias("__s"), F.sum(denominator).alias("__n"))
    drawn = draw_counts(sums, unit, draws, seed)
    stats = drawn.groupBy("draw").agg((F.sum(F.col("cnt") * F.col("__s")) / F.sum(F.col("cnt") * F.col("__n"))).alias("v"))
    point = sums.agg((F.sum("__s") / F.sum("__n")).alias("estimate"))
    return stats.agg(F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"), F.count(F.lit(1)).alias("draws")).join(F.broadcast(point))


def resampled_rows(df: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """Rows drawn with their units; each copy of a unit gets a name of its own, unit#k."""
    counts = draw_counts(df.select(unit).distinct(), unit, draws, seed)
    many = df.join(counts, unit).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int"))))
    return many.withColumn("unit_copy", F.concat_ws("#", F.col(unit).cast("string"), F.col("__k").cast("string"))).drop("__k", "cnt")


def bootstrap_rank_correlation(df: DataFrame, unit: str, a: str, b: str, draws: int, seed: int, lanes: int = 25) -> DataFrame:
    """Spearman (average ranks) of each draw's rows: draw, rho.  A row weighs as often as its unit is drawn, so rows are sorted twice for each ``lanes`` draws, not drawn and ranked anew in each."""
    df = df.select(*dict.fromkeys([unit, a, b])).dropna(subset=[unit])
    counts = staged(draw_counts(df.select(unit).distinct(), unit, draws, seed), "draws")
    out = []
    for first in range(0, draws, lanes):
        own = range(first, min(draws, first + lanes))
        weights = F.array(*[F.coalesce(F.sum(F.when(F.col("draw") == d, F.col("cnt"))), F.lit(0)) for d in own])
        some = counts.filter(F.col("draw").between(own[0], own[-1])).groupBy(unit).agg(weights.alias("__counts"))
        out += zip(own, weighted_rank_correlations(attach(df, some, [unit]), a, b, "__counts", len(own)), strict=True)
    discarded(counts)
    return df.sparkSession.createDataFrame(out, "draw long, rho double")


def policy_value(df: DataFrame, score: str, tie: str, gain: str, fold: str, q: float, reference: str | None = None, reference_gain: str | None = None) -> DataFrame:
    """Gain of the top share by fold, of the best possible share, of a random one, precision, all over all rows; with a reference
    selector its own gain, the difference, and how often both select the same row."""
    marked = top_of(top_of(df, score, tie, q, fold, "__c"), gain, tie, q, None, "__b")
    value = lambda p, g: F.avg(F.when(F.col(p), F.col(g)).otherwise(0.0))
    out = [value("__c", gain).alias("gain"), value("__b", gain).alias("oracle"), (F.lit(q) * F.avg(gain)).alias("random"), (value("__c", gain) - F.lit(q) * F.avg(gain)).alias("over_random"), (F.count_if(F.col("__c") & (F.col(gain) > 0)) / F.count_if("__c")).alias("precision"), F.count_if("__c").alias("selected")]
    if reference:
        marked, g = top_of(marked, reference, tie, q, fold, "__r"), reference_gain or gain
        out += [value("__r", g).alias("reference"), (value("__c", gain) - value("__r", g)).alias("difference"), (F.count_if(F.col("__c") & F.col("__r")) / F.count_if("__c")).alias("coincidence")]
    return marked.agg(*out)


def reliability(df: DataFrame, value: str, x: list[str], noise: str) -> DataFrame:
    """Reliability 1 - Var(noise) / Var(residual of value on x), and the noise share."""
    u = residuals(df.dropna(subset=[value, noise, *x]), value, x, "__u")
    lam = 1 - F.var_samp(noise) / F.var_samp("__u")
    return u.agg(lam.alias("reliability"), (1 - lam).alias("noise_share"))


def disattenuated(estimates: DataFrame, name: str, coef: str, reliability: str) -> DataFrame:
    """Each coefficient over its reliability, all of their differences, and what raw coefficients would differ by if the true ones were equal (their mean, attenuated by each reliability)."""
    true = estimates.select(F.col(name).alias("a"), F.col(coef).alias("raw"), F.col(reliability).alias("lam"), F.try_divide(F.col(coef), F.col(reliability)).alias("true"))
    mean = true.agg(F.avg("true").alias("common"))  # one row
    other = true.select(F.col("a").alias("b"), F.col("raw").alias("raw_b"), F.col("lam").alias("lam_b"), F.col("true").alias("true_b"))
    pairs = true.join(other, F.col("a") < F.col("b")).join(F.broadcast(mean))  # estimates, not rows
    return pairs.select("a", "b", (F.col("true") - F.col("true_b")).alias("difference"), (F.col("raw") - F.col("raw_b")).alias("raw_difference"), ((F.col("lam") - F.col("lam_b")) * F.col("common")).alias("null_benchmark"))


def trend_table(df: DataFrame, at: str, indicators: list[str], band: str, per: float = 100.0) -> DataFrame:
    """By indicator: Pearson and rank correlation of its band means with the bands' places, the slope per ``per``, and whether it is monotone (|rank correlation| at least 0.9: yes, 0.7: partial, else no)."""
    from tidelake.operators.aggregates import rank_correlation

    means = df.groupBy(band).agg(F.avg(at).alias("__at"), *[F.avg(c).alias(c) for c in indicators])
    long = means.unpivot("__at", indicators, "indicator", "__v")
    rho = rank_correlation(long, "__at", "__v", ["indicator"], ["__at"], average=False)
    stats = long.groupBy("indicator").agg(F.corr("__at", "__v").alias("r"), (F.regr_slope("__v", "__at") * per).alias("slope"))
    size = F.abs(F.round("rho", 12))
    return stats.join(rho, "indicator").withColumn("monotone", F.when(size >= 0.9, "yes").when(size >= 0.7, "partial").otherwise("no"))


def concentration(df: DataFrame, weight: str, tie: str, share: float = 0.01) -> DataFrame:
    """How much of the total weight the largest row and the largest ``share`` of rows carry."""
    n = df.count()
    marked = top_of(df, weight, tie, max(1, int(n * share)) / max(1, n), None, "__c")
    return marked.agg((F.max(weight) / F.sum(weight)).alias("largest"), (F.sum(F.when(F.col("__c"), F.col(weight))) / F.sum(weight)).alias("top_share"))


def complete_cells(df: DataFrame, cell: list[str], columns: list[str], imputed: str) -> DataFrame:
    """Rows whose other columns are all finite, with the one column filled by its own cell's mean; cells that have it nowhere go."""
    from tidelake.operators.aggregates import finite

    mean = F.avg(F.when(finite(imputed), F.col(imputed)))
    rows = df.filter(finite(*[c for c in columns if c != imputed]))
    cells = rows.groupBy(*cell).agg(mean.alias("__mean")).filter("__mean is not null")
    return rows.join(cells, cell).withColumn("imputed", ~finite(imputed)).withColumn(imputed, F.when(finite(imputed), F.col(imputed)).otherwise(F.col("__mean"))).drop("__mean")


def within_between(df: DataFrame, y: str, x: str, group: str, controls: list[str]) -> DataFrame:
    """Slope of y on x with controls, split by group of rows: each group's weight (its share of the squared residual of x), its own slope, and their mixture.

    Frisch-Waugh: x is residualised once; slope = sum u y / sum u u, and both sums are sums over groups.
    """
    u = residuals(df.dropna(subset=[y, x, group, *controls]), x, controls, "__u")
    parts = u.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__u") ** 2).alias("uu"), F.sum(F.col("__u") * F.col(y)).alias("uy"))
    all_ = Window.partitionBy(F.lit(0))
    return parts.select(group, "n", (F.col("uu") / F.sum("uu").over(all_)).alias("weight"), (F.col("uy") / F.col("uu")).alias("slope"), (F.sum("uy").over(all_) / F.sum("uu").over(all_)).alias("mixture"))


def prediction_interval(terms: list[float], coef: list[float], cov: list[list[float]], z: float = 1.959963984540054) -> tuple[float, float, float]:
    """Prediction at some terms with its delta-method interval."""
    t, c = np.array(terms), np.array(coef)
    fit, se = float(t @ c), math.sqrt(float(t @ np.array(cov) @ t))
    return fit, fit - z * se, fit + z * se


def stratified_slopes(df: DataFrame, y: str, x: str, by: str, bins: int) -> DataFrame:
    """Slope of y on x in each equal-frequency bin of a column."""
    from tidelake.operators.windows import quantile_bins

    return quantile_bins(df, by, bins, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))


def compare_estimates(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Ledger of two coefficient tables: change, whether the sign holds and whether intervals overlap."""
    a = old.select(*keys, *[F.col(c).alias(f"{c}_old") for c in ("coef", "lo", "hi")])
    b = new.select(*keys, *[F.col(c).alias(f"{c}_new") for c in ("coef", "lo", "hi")])
    return a.join(b, keys, "full_outer").withColumns({
        "change": F.col("coef_new") - F.col("coef_old"), "same_sign": F.signum("coef_new") == F.signum("coef_old"),
        "overlap": (F.col("lo_new") <= F.col("hi_old")) & (F.col("lo_old") <= F.col("hi_new")),
    })


def cell_noise(df: DataFrame, cell: list[str], score: str, band: str) -> DataFrame:
    """By cell the mean score and its sampling variance s^2 / n; cells of one row take their band's pooled variance."""
    cells = df.groupBy(*cell, band).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.var_samp(score).alias("s2"))
    pooled = cells.filter("n >= 2").groupBy(band).agg((F.sum(F.expr("(n - 1) * s2")) / F.sum(F.expr("n - 1"))).alias("pooled"))
    return cells.join(pooled, band, "left").select(*cell, band, "n", "mean", (F.coalesce(F.when(F.col("n") >= 2, F.col("s2")), F.col("pooled")) / F.col("n")).alias("noise"))
