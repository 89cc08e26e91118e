"""Checks in flight: one scan, and no table where a rule fails."""

import pytest
from pyspark.sql import functions as F

from tidelake.operators import validation as V


def test_checked_write(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    df = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, F.col("id") - 3).alias("v"))
    seen = df.mapInArrow(counted, df.schema)
    rules = {"not negative": F.col("v") >= 0, "small": F.col("v") < 1000}
    path = f"file://{tmp_path}/out"
    bad = V.checked_write(seen, path, rules, rows=90, gates={"mean": F.avg("v") < 10, "none": F.max("v") == F.lit(None)})
    assert not bad.published and bad.violated() == {"not negative": 2, "rows": 10, "mean": 1, "none": 1} and bad.rows == 100 and scans.value == 100
    assert not list(tmp_path.iterdir())
    good = V.checked_write(seen.filter("v >= 0"), path, rules, rows=88, gates={"some": F.count(F.lit(1)) > 0})
    assert good.published and not good.violated() and spark.read.parquet(path).count() == 88
    with pytest.raises(ValueError):
        V.checked_write(df, path, rules)
    empty = V.checked_write(df.filter("false"), f"file://{tmp_path}/none", rules, rows=0)
    assert empty.published and empty.rows == 0 and spark.read.parquet(f"file://{tmp_path}/none").count() == 0
