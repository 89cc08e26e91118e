"""Checks as queries, where rows mean that something was found, and checks in flight, made by the write itself."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def expect_count(df: DataFrame, n: int) -> DataFrame:
    """One row if the count isn't n."""
    return df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != n)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n of the invariants that some row breaks; nulls break nothing."""
    counts = df.agg(*[F.count_if(~p).alias(k) for k, p in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n").filter("n > 0")


def gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, passed: conditions on aggregates, in one pass."""
    row = df.agg(*[p.alias(k) for k, p in rules.items()])
    return row.unpivot([], list(rules), "rule", "passed")


def coverage(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """required, present, missing counts."""
    want, have = required.select(*keys).distinct(), present.select(*keys).distinct().withColumn("__p", F.lit(1))
    both = want.join(have, keys, "left")
    return both.agg(F.count(F.lit(1)).alias("required"), F.count("__p").alias("present"), F.count_if(F.col("__p").isNull()).alias("missing"))


@dataclass
class Checked:
    """What a checked write found: rule, n of every rule, the number of rows, and whether the table stands."""

    counts: dict[str, int]
    rows: int
    published: bool

    def violated(self) -> dict[str, int]:
        return {k: n for k, n in self.counts.items() if n}


def checked_write(df: DataFrame, path: str, rules: dict[str, Column], rows: int | None = None, gates: dict[str, Column] | None = None) -> Checked:
    """Writes a table and checks it on the way: one scan, and a failed check leaves no table.

    ``rules`` hold for every row (nulls break nothing), ``rows`` is the number that there has to be, ``gates`` are conditions on aggregates (null fails). All
    are observed by the write itself; the table is written aside and renamed only if they hold.  A path that exists is refused.
    """
    jvm = df.sparkSession.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        raise ValueError(f"{path} is there already")
    seen, base = Observation(f"checks-{uuid.uuid4().hex}"), path.rstrip("/")
    aside = f"{base.rpartition('/')[0]}/_{base.rpartition('/')[2]}-{uuid.uuid4().hex}"
    marks = {f"__r{i}": F.count_if(~p) for i, p in enumerate(rules.values())} | {f"__g{i}": p for i, p in enumerate((gates or {}).values())}
    df.observe(seen, F.count(F.lit(1)).alias("__n"), *[p.alias(k) for k, p in marks.items()]).write.parquet(aside)
    found = seen.get
    counts = {k: found[f"__r{i}"] for i, k in enumerate(rules)} | {k: int(found[f"__g{i}"] is not True) for i, k in enumerate(gates or {})}
    if rows is not None:
        counts["rows"] = abs(found["__n"] - rows)
    good = not any(counts.values()) and files.rename(at(aside), at(base))
    if not good:
        files.delete(at(aside), True)
    return Checked(counts, found["__n"], bool(good))
