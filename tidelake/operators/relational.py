"""Small relational languages: formulas that name columns, row specifications."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def formula_columns(formula: str, columns: list[str]) -> list[str]:
    """The columns that a formula names, in order."""
    return [c for c in dict.fromkeys(re.findall(r"\w+", formula)) if c in columns]


def complete_cases(df: DataFrame, formula: str) -> DataFrame:
    """Rows without null or NaN in any column that the formula names."""
    kinds = dict(df.dtypes)
    ok = lambda c: F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True))
    return df.filter(reduce(lambda a, b: a & b, [ok(c) for c in formula_columns(formula, df.columns)], F.lit(True)))


def row_spec(spec: str, names: dict[str, Column]) -> Column:
    """Named conditions joined by ``&``."""
    return reduce(lambda a, b: a & b, [names[n.strip()] for n in spec.split("&")])
