"""Models named by formulas: ``y ~ a * b + c + a:c + d^2``, run on rows named by a specification, over a grid of both.

A formula's columns are products of columns, made as Column expressions; rows with a null in any column that the
formula names are left out, and only those.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators import estimators as G
from tidelake.operators import mixed as X
from tidelake.operators import models as M


def parse(formula: str) -> tuple[str, list[tuple[str, ...]]]:
    """The outcome, and each term as the columns it multiplies; ``a * b`` is a, b and their product, ``a^2`` is a twice, ``1`` is the constant, which is always there."""
    y, _, right = (x.strip() for x in formula.partition("~"))
    if not y or not right:
        raise ValueError(f"not a formula: {formula}")
    terms: list[tuple[str, ...]] = []

    def factors(text: str) -> tuple[str, ...]:
        out: list[str] = []
        for part in text.split(":"):
            name, _, power = part.strip().partition("^")
            out += [name.strip()] * int(power or 1)
        return tuple(out)

    for part in right.split("+"):
        crossed = [factors(x) for x in part.split("*")]
        for size in range(1, len(crossed) + 1):
            for some in combinations(crossed, size):
                term = tuple(c for f in some for c in f if c != "1")
                if term and term not in terms:
                    terms.append(term)
    return y, sorted(terms, key=len)


def name_of(term: tuple[str, ...]) -> str:
    return ":".join(term)


def design(df: DataFrame, formula: str) -> tuple[DataFrame, str, list[str]]:
    """Complete rows with a column for each term, the outcome and the terms' names."""
    y, terms = parse(formula)
    rows = df.dropna(subset=sorted({y, *(c for t in terms for c in t)}))
    product = lambda t: reduce(lambda a, b: a * b, [F.col(c).cast("double") for c in t])
    made = {name_of(t): product(t) for t in terms if len(t) > 1}
    return rows.withColumns(made) if made else rows, y, [name_of(t) for t in terms]


def fitted(df: DataFrame, formula: str, kind: str = "ols", units: list[str] | None = None) -> DataFrame:
    """term, coef, se of a formula by one of: ols; cluster (one or two columns of units); logit (clustered); intercept (one unit); nested (outer and inner unit); inner (of both, one variance)."""
    rows, y, x = design(df, formula)
    # Products are columns whose names hold a colon; estimators see plain names.
    plain = {c: f"__x{i}" for i, c in enumerate(x)}
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in x], *[F.col(f"`{c}`").alias(p) for c, p in plain.items()])
    by: dict[str, Callable[[], DataFrame]] = {
        "ols": lambda: G.ols(rows, y, [*plain.values()]),
        "cluster": lambda: G.cluster_ols(rows, y, [*plain.values()], units),
        "logit": lambda: M.logit_clustered(rows, y, [*plain.values()], units[0]),
        "intercept": lambda: X.random_intercept(rows, y, [*plain.values()], units[0]),
        "nested": lambda: X.nested_intercepts(rows, y, [*plain.values()], *units),
        "inner": lambda: X.inner_only(rows, y, [*plain.values()], *units),
    }
    out = by[kind]().select("term", "coef", "se")
    back = F.create_map(*[F.lit(z) for c, p in plain.items() for z in (p, c)]) if plain else None
    return out.withColumn("term", F.coalesce(back[F.col("term")], F.col("term"))) if back is not None else out


def model_grid(df: DataFrame, models: dict[str, tuple[str, str, list[str] | None]], row_specs: dict[str, Column]) -> DataFrame:
    """Every model (name: formula, kind, units) on the rows of every specification: model, rows, term, coef, se."""
    parts = [
        fitted(df.filter(p), formula, kind, units).select(F.lit(m).alias("model"), F.lit(r).alias("rows"), "term", "coef", "se")
        for m, (formula, kind, units) in models.items() for r, p in row_specs.items()
    ]
    return reduce(DataFrame.unionAll, parts)
