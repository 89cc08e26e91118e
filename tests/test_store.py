"""The keyed store: unique keys, files read by an append, versions, and two writers at once."""

import numpy as np
from pyspark.sql import functions as F

from tidelake.sources.store import KeyedStore, bloom_of, may_hold


def _rows(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name"), (F.col("id") * 2).alias("v"))


def test_filters_admit_what_they_hold():
    r = np.random.default_rng(1)
    own, other = (r.integers(-(2**63), 2**63, 5000, dtype=np.int64) for _ in range(2))
    bloom = bloom_of(own)
    assert may_hold(bloom, own).all() and may_hold(bloom, other).mean() < 0.02


def test_appends_read_what_may_hold_their_keys(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/store", ["k", "name"], buckets=8)
    for i in range(6):
        done = store.append(_rows(spark, 200 * i, 200 * (i + 1)))
        assert done.rows == 200 and done.version == i
    assert store.index().count() == 48 and store.read().count() == 1200
    one = store.append(_rows(spark, 5000, 5001))
    assert one.rows == 1 and one.files_read <= 2  # a new key: at most errors of the filters
    again = store.append(_rows(spark, 300, 301))
    assert again.rows == 0 and again.version is None and 1 <= again.files_read <= 3
    some = store.append(_rows(spark, 1100, 1300))
    assert some.rows == 100 and some.files_read < 20
    rows = [tuple(r) for r in store.read().orderBy("k").collect()]
    assert rows == [(i, f"n{i}", 2 * i) for i in [*range(1300), 5000]]


def test_null_and_repeated_keys(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/store", ["k"])
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (None, 4)], "k long, v int")
    assert store.append(df).rows == 2 and store.append(df).rows == 0 and store.read().count() == 2
    assert store.append(df.filter("false")).version is None


def test_the_second_of_two_writers_checks_the_firsts_rows(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, f"file://{tmp_path}/store", ["k"])
    store.append(_rows(spark, 0, 50))
    other, calls = KeyedStore(spark, store.path, ["k"]), []
    whole = KeyedStore._candidates

    def meanwhile(self, fresh, entries):
        if self is store and not calls:
            calls.append(other.append(_rows(spark, 40, 80)).rows)
        return whole(self, fresh, entries)

    monkeypatch.setattr(KeyedStore, "_candidates", meanwhile)
    done = store.append(_rows(spark, 60, 100))
    assert calls == [30] and done.rows == 20 and store.versions() == [0, 1, 2]
    assert store.read().count() == 100 == store.read().select("k").distinct().count()
