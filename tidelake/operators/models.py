"""Models on pyspark.ml, and estimators by group: logistic regression, propensity weights, per-band PCA, resampled fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators import estimators as G
from tidelake.operators.windows import quantile_bins


def _assembled(df: DataFrame, x: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=x, outputCol="__x", handleInvalid="skip").transform(df)


def logit_clustered(df: DataFrame, y: str, x: list[str], cluster: str) -> DataFrame:
    """Logistic regression with clustered errors: the fit is the library's, the sandwich two aggregations."""
    df = df.dropna(subset=[y, *x, cluster])
    m = LogisticRegression(featuresCol="__x", labelCol=y, regParam=0.0, standardization=True, tol=1e-12, maxIter=200).fit(_assembled(df, x))
    beta = np.array([m.intercept, *m.coefficients])
    z = F.lit(float(beta[0]))
    for c, b in zip(x, beta[1:], strict=True):
        z = z + F.col(c) * F.lit(float(b))
    p = 1 / (1 + F.exp(-z))
    scored = df.withColumn("__p", p).withColumn("__u", F.col(y) - F.col("__p")).withColumn("__w", F.col("__p") * (1 - F.col("__p")))
    cols = ["1", *x]
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    k = len(cols)
    row = scored.agg(*[F.sum(col(a) * col(b) * F.col("__w")).alias(f"h{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]).first()
    inv = np.linalg.inv(np.array(row).reshape(k, k))
    meat, g = G._meat(scored, x, [cluster])
    return G._frame(df, ["const", *x], beta, inv @ meat @ inv * g / (g - 1), None)


def odds_weights(df: DataFrame, target: str, x: list[str], name: str) -> DataFrame:
    """p / (1 - p) of a lightly penalised propensity model, scaled to sum to the number of rows."""
    n = df.count()
    m = LogisticRegression(featuresCol="__x", labelCol=target, regParam=1.0 / n, maxIter=100).fit(_assembled(df, x))
    # The odds are exp(z): written as a Column they take along none of the library's functions of vectors.
    z = F.lit(float(m.intercept))
    for c, b in zip(x, m.coefficients, strict=True):
        z = z + F.col(c) * F.lit(float(b))
    scored = df.dropna(subset=x).withColumn("__o", F.exp(z))
    total = scored.agg(F.sum("__o").alias("__t"))  # one row
    return scored.join(F.broadcast(total)).withColumn(name, F.col("__o") / F.col("__t") * n).select(*df.columns, name)  # G.concentration() tells how few rows carry them


def band_pca(df: DataFrame, band: str, columns: list[str], least: int, full: list[float]) -> DataFrame:
    """First component by band with ``least`` rows or more, turned to the full table's, and their congruence.  Correlations are aggregates; each band's small matrix is solved in a task."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    stats = df.groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.corr(a, b) for a, b in pairs]).alias("r")).filter(F.col("n") >= least)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, n, r in zip(pdf[band], pdf["n"], pdf["r"], strict=True):
                m = np.eye(len(columns))
                for (a, b), v in zip(pairs, r, strict=True):
                    m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = v
                values, vectors = np.linalg.eigh(m)
                v = vectors[:, -1]
                v = v * (1 if v @ np.array(full) >= 0 else -1)
                out.append((key, n, values[-1] / len(columns), v.tolist(), float(v @ np.array(full) / np.linalg.norm(full))))
            yield pd.DataFrame(out, columns=[band, "n", "share", "loadings", "congruence"])

    return stats.mapInPandas(solve, f"{band} {dict(df.dtypes)[band]}, n long, share double, loadings array<double>, congruence double")


def calibration(df: DataFrame, y: str, fit: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    """Means of outcome and prediction in equal-frequency bins of the prediction."""
    w = F.col(weight) if weight else F.lit(1.0)
    binned = quantile_bins(df, fit, bins, "bin")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.col(y)) / F.sum(w)).alias("observed"), (F.sum(w * F.col(fit)) / F.sum(w)).alias("predicted"))


def grouped_equivalence(df: DataFrame, keys: list[str], value: str, margin: float) -> DataFrame:
    """Mean, standard error and the p of two one-sided tests by group; groups' moments are aggregates."""
    from tidelake.functions.tails import tost

    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p=[tost(m, s, n - 1, margin) if n > 1 and s > 0 else math.nan for m, s, n in zip(pdf["mean"], pdf["se"], pdf["n"], strict=True)])

    return stats.mapInPandas(test, T.StructType([*stats.schema.fields, T.StructField("p", T.DoubleType())]))


def bootstrap_fits(df: DataFrame, unit: str, y: str, x: list[str], draws: int, seed: int) -> DataFrame:
    """Least squares refit in each cluster-bootstrap draw: draw, term, coef.  A draw's Gram matrix is the counts' sum of unit Gram matrices, so rows are read once, whatever the draws."""
    from itertools import combinations_with_replacement

    df = df.dropna(subset=[unit, y, *x])
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    units = df.groupBy(unit).agg(*[F.sum(cols[i] * cols[j]).alias(f"g{k}") for k, (i, j) in enumerate(pairs)])
    drawn = G.draw_counts(units, unit, draws, seed)
    grams = drawn.groupBy("draw").agg(F.array(*[F.sum(F.col("cnt") * F.col(f"g{k}")) for k in range(len(pairs))]).alias("g"))
    names, size = ["const", *x], len(cols)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, g in zip(pdf["draw"], pdf["g"], strict=True):
                m = np.zeros((size, size))
                for (i, j), v in zip(pairs, g, strict=True):
                    m[i, j] = m[j, i] = v
                out += [(d, t, float(b)) for t, b in zip(names, np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0], strict=True)]
            yield pd.DataFrame(out, columns=["draw", "term", "coef"])

    return grams.mapInPandas(solve, "draw long, term string, coef double")
