"""Aggregations: weighted, two-stage, quantile, winsorised, tabulated.  Partial aggregation does the work; nothing is collected.  Quantiles and ranks are those of operators.ranks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.operators.ranks import attach, exact_quantiles, global_rank


def finite(*columns: str) -> Column:
    """All columns hold a number that is neither null nor NaN nor infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return out


def share(p: Column) -> Column:
    return F.avg(p.cast("int"))


def weighted_mean(value: str, weight: str) -> Column:
    """Null where the weights are 0."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def two_stage_mean(df: DataFrame, cell: list[str], unit: list[str], values: list[str]) -> DataFrame:
    """Means by cell, then by unit weighted with the cells' rows; cells with a value that isn't finite are left out."""
    cells = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values]).filter(finite(*values))
    return cells.groupBy(*unit).agg(F.sum("n").alias("n"), *[weighted_mean(v, "n").alias(v) for v in values])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """column, n, share of all rows."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], name: str = "q") -> DataFrame:
    """Exact quantiles with linear interpolation, by group: keys, n, and an array in the order of ``at``."""
    return exact_quantiles(df, keys, value, at, name)


def winsorised(df: DataFrame, value: str, p: float, name: str) -> DataFrame:
    """Adds the cut (quantile p of all rows) and the value clipped at it; the raw value stays."""
    cut = exact_quantiles(df, [], value, [p], "__q").select(F.col("__q")[0].alias("winsor_cut"))  # one row
    return df.join(F.broadcast(cut)).withColumn(name, F.when(F.col(value).isNotNull(), F.least(value, "winsor_cut")))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, sd, min, p10, p25, p50, p75, p90, max.  Null and NaN values don't count."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    moments = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    at = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    both = attach(moments, exact_quantiles(rows, keys, value, [*at.values()], "__q").drop("n"), keys)
    return both.select(*keys, "n", "mean", "sd", "min", *[F.col("__q")[i].alias(k) for i, k in enumerate(at)], "max")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of every pair, in one pass."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def rank_correlation(df: DataFrame, a: str, b: str, keys: list[str], tie: list[str], average: bool) -> DataFrame:
    """Spearman by group: average ranks of ties, or ordinal ones by ``tie``.  Groups are ranked over ranges, whatever their size."""
    out = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*dict.fromkeys([*keys, a, b, *tie]))
    for c, name in ((a, "__ra"), (b, "__rb")):
        out = global_rank(out, keys, [c], name, "average" if average else "ordinal", then=[t for t in tie if t != c])
    return out.groupBy(*keys).agg(F.corr(F.col("__ra").cast("double"), F.col("__rb").cast("double")).alias("rho"))


def crosstab_chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts of each cell, its part of chi-square, and the degrees of freedom."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))
    rows, columns = df.select(a).distinct(), df.select(b).distinct()
    full = rows.crossJoin(columns).join(cells, [a, b], "left").fillna(0, ["observed"])  # labels x labels, not rows
    total = Window.partitionBy(F.lit(0))
    expected = F.sum("observed").over(Window.partitionBy(a)) * F.sum("observed").over(Window.partitionBy(b)) / F.sum("observed").over(total)
    out = full.withColumn("expected", expected).withColumn("part", (F.col("observed") - F.col("expected")) ** 2 / F.col("expected"))
    df_ = (F.size(F.collect_set(a).over(total)) - 1) * (F.size(F.collect_set(b).over(total)) - 1)
    return out.withColumn("chi2", F.sum("part").over(total)).withColumn("df", df_)


def pooled_variance(df: DataFrame, group: list[str], within: list[str], value: str) -> DataFrame:
    """Sum of (n - 1) s^2 over sum of (n - 1), of the groups' units with two rows or more."""
    units = df.groupBy(*group, *within).agg(F.count(value).alias("n"), F.var_samp(value).alias("s2")).filter("n >= 2")
    return units.groupBy(*group).agg((F.sum(F.expr("(n - 1) * s2")) / F.sum(F.expr("n - 1"))).alias("pooled"))


def mad_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1.4826 times the median absolute deviation from the group's median."""
    mid = exact_quantiles(df, keys, value, [0.5], "__q").select(*keys, F.col("__q")[0].alias("median"))
    off = attach(df.select(*keys, value), mid, keys).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    spread = exact_quantiles(off, keys, "__d", [0.5], "__q").select(*keys, (F.col("__q")[0] * 1.4826).alias("scale"))
    return attach(mid, spread, keys).select(*keys, "median", "scale")


def with_total(df: DataFrame, band: str, aggregates: list[Column], label: str = "ALL") -> DataFrame:
    """By band, and a row for all."""
    return df.rollup(band).agg(F.grouping(band).alias("__g"), *aggregates).withColumn(band, F.when(F.col("__g") == 1, label).otherwise(F.col(band))).drop("__g")


def counts_of_all(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Counts in the order of the labels, zeros kept."""
    dim = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], f"place int, {column} string")
    return dim.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select("place", column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def funnel(df: DataFrame, keys: list[str], outcomes: list[tuple[str, Column]], rest: str) -> DataFrame:
    """Counts of mutually exclusive outcomes: the first that holds."""
    case = F.lit(rest)
    for name, p in reversed(outcomes):
        case = F.when(p, name).otherwise(case)
    return df.groupBy(*keys, case.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def tolerance_ladder(a: str, b: str, steps: list[float]) -> list[Column]:
    """Largest absolute difference, and how many pairs are further apart than each step."""
    d = F.abs(F.col(a) - F.col(b))
    return [F.max(d).alias("max_diff"), *[F.count_if(d > s).cast("long").alias(f"above_{i}") for i, s in enumerate(steps)]]


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """bin, n; values beyond the last edge are counted in bin ``bins``, those below the first in -1."""
    at = F.floor((F.col(value) - low) / width)
    return df.filter(finite(value)).groupBy(F.when(at < 0, -1).when(at >= bins, bins).otherwise(at).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def decile_table(df: DataFrame, bin_: str, value: str) -> DataFrame:
    """n, mean and standard error by bin."""
    return df.groupBy(bin_).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))


def long_to_wide(df: DataFrame, keys: list[str], name: str, names: list[str], values: list[str]) -> DataFrame:
    """Pivot with named levels: <value>_<level>."""
    wide = df.groupBy(*keys).pivot(name, names).agg(*[F.first(v).alias(v) for v in values])
    if len(values) > 1:
        return wide.select(*keys, *[F.col(f"{n}_{v}").alias(f"{v}_{n}") for n in names for v in values])
    return wide.select(*keys, *[F.col(n).alias(f"{values[0]}_{n}") for n in names])
