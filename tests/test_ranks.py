"""Ranks, order statistics and what stands on them, against NumPy and brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.operators import aggregates as A
from tidelake.operators import ranks as R
from tidelake.operators import windows as O


def _values(spark, n=4000, seed=1):
    """Groups of very different sizes, one null; ties, nulls and NaN."""
    r = np.random.default_rng(seed)
    rows = [(i, str(k) if k < 4 else None, float(v)) for i, (k, v) in enumerate(zip(np.minimum(r.geometric(0.5, n), 5), np.where(r.random(n) < 0.3, 2.5, r.normal(size=n)), strict=True))]
    rows += [(n + i, "1", v) for i, v in enumerate((None, float("nan"), None, 1e300, -1e300))] + [(n + 9, "alone", 7.0), (n + 10, "none", None)]
    return rows, spark.createDataFrame(rows, "id long, k string, v double").repartition(5)


@pytest.mark.parametrize("most", [1, 20, 200_000])
def test_exact_quantiles(spark, most):
    rows, df = _values(spark)
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    by = collections.defaultdict(list)
    for _, k, v in rows:
        if v is not None and not np.isnan(v):
            by[k].append(v)
    got = {r.k: (r.n, r.q) for r in R.exact_quantiles(df, ["k"], "v", at, most=most, accuracy=100).collect()}
    assert set(got) == set(by)
    for k, values in by.items():
        assert got[k][0] == len(values) and got[k][1] == pytest.approx(np.percentile(values, [100 * p for p in at]).tolist(), rel=1e-12)


def test_quantiles_of_millions_of_distinct_values(spark):
    """No interval of more than a thousand rows is ranked, a third of the rows are tied."""
    n = 3_000_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.pmod(F.xxhash64("id"), F.lit(2**40)) / F.lit(2.0**40)).alias("v"))
    values = np.sort(np.array(df.toPandas()["v"]))
    got = R.exact_quantiles(df, [], "v", [0.001, 0.3, 0.5, 0.9999], most=1000).first()
    assert got.n == n and got.q == pytest.approx(np.percentile(values, [0.1, 30, 50, 99.99]).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    _, df = _values(spark)
    assert R.exact_quantiles(df.filter("id < 0"), ["k"], "v", [0.5]).collect() == []
    assert [tuple(r) for r in R.exact_quantiles(df.filter("id < 0"), [], "v", [0.5]).collect()] == [(None, None)]
    with pytest.raises(ValueError):
        R.exact_quantiles(df, [], "v", [1.5])


def _ranked(rows, descending=False):
    by = collections.defaultdict(list)
    for i, k, v in rows:
        by[k].append((v, i))
    out = {}
    for k, own in by.items():
        place = lambda x: (x[0] is not None, (np.inf if x[0] is None else np.nan_to_num(x[0], nan=1e308)) * (1 if x[0] is not None else 0))
        order = sorted(own, key=lambda x: (place(x), x[1]))
        if descending:
            order = sorted(own, key=lambda x: (x[0] is None, -(np.nan_to_num(x[0], nan=1e308) if x[0] is not None else 0), x[1]))
        ordinal = {i: n + 1 for n, (_, i) in enumerate(order)}
        ties = collections.defaultdict(list)
        for v, i in own:
            ties[str(v)].append(ordinal[i])
        for v, i in own:
            out[i] = (ordinal[i], sum(ties[str(v)]) / len(ties[str(v)]))
    return out


@pytest.mark.parametrize(("ranges", "small"), [(1, 100_000), (7, 100_000), (40, 0)])
def test_global_rank(spark, monkeypatch, ranges, small):
    monkeypatch.setattr(R, "SMALL", small)
    rows, df = _values(spark, 1500)
    want = _ranked(rows)
    assert {r.id: r.r for r in R.global_rank(df, ["k"], ["v"], "r", then=["id"], ranges=ranges).collect()} == {i: o for i, (o, _) in want.items()}
    assert {r.id: r.r for r in R.global_rank(df, ["k"], ["v"], "r", ties="average", ranges=ranges).collect()} == {i: a for i, (_, a) in want.items()}
    down = _ranked(rows, descending=True)
    assert {r.id: r.r for r in R.global_rank(df, ["k"], ["v"], "r", then=["id"], descending=True, ranges=ranges).collect()} == {i: o for i, (o, _) in down.items()}
    with pytest.raises(ValueError):
        R.global_rank(df, [], ["v"], "r", ties="dense")


def test_a_hot_group_and_tied_rows_lie_in_many_ranges(spark):
    n = 60_000
    for value in (F.lit(1.0), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double")):
        df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("k"), value.alias("v"))
        ranked = R.global_rank(df, ["k"], ["v"], "r", ties="average", ranges=12)
        sizes = [r["count"] for r in spark.read.parquet(*ranked.inputFiles()).groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) >= 10 and max(sizes) < 3 * n / 12
        assert ranked.count() == n
        size = ranked.filter("k = 0").count()
        assert ranked.filter("k = 0").agg(F.sum("r")).first()[0] == size * (size + 1) / 2


def test_rank_correlation_counts_each_group(spark):
    r = np.random.default_rng(4)
    rows = [(int(k), float(a), float(b)) for k, a, b in zip(r.integers(0, 3, 500), r.integers(0, 9, 500), r.integers(0, 30, 500), strict=True)]
    got = {x.k: x.rho for x in A.rank_correlation(spark.createDataFrame(rows, "k int, a double, b double"), "a", "b", ["k"], [], average=True).collect()}
    mean_rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for k in range(3):
        a, b = (np.array([x[j] for x in rows if x[0] == k]) for j in (1, 2))
        assert got[k] == pytest.approx(np.corrcoef(mean_rank(a), mean_rank(b))[0, 1])


def _top(rows, q, by_fold):
    out = set()
    for f in {x[1] for x in rows} if by_fold else {None}:
        own = [x for x in rows if not by_fold or x[1] == f]
        k = round(q * len(own))
        out |= {i for i, _, _ in sorted(own, key=lambda x: (-(x[2] if x[2] is not None and not np.isnan(x[2]) else -np.inf), x[0]))[:k]}
    return out


@pytest.mark.parametrize("score", ["outlier", "constant", "nulls", "few"])
def test_top_of(spark, score):
    """One value far from all others, all rows tied at the cut, hardly any scores."""
    r = np.random.default_rng(7)
    make = {"outlier": lambda i: 1e9 if i == 17 else float(r.random()), "constant": lambda i: 1.0, "nulls": lambda i: None if i % 10 else float(r.integers(0, 3)), "few": lambda i: float(r.integers(0, 4))}[score]
    rows = [(i, f"f{i % 3}" if i % 7 else None, make(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, fold string, s double")
    for q in (0.0, 0.05, 0.3, 1.0):
        assert {x.id for x in O.top_share(df, "s", "id", q, "fold").collect()} == _top(rows, q, True)
    assert {x.id for x in O.top_share(df, "s", "id", 0.1, None).collect()} == _top(rows, 0.1, False)


def test_folds_are_even(spark):
    out = O.folds(spark.range(1003).select((F.col("id") * 7).alias("u")), "u", 5, 3)
    assert sorted(r["count"] for r in out.groupBy("fold").count().collect()) == [200, 200, 201, 201, 201]


def test_repeated_selection_is_a_share_of_repeats(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("fold"))
    out = O.repeated_selection(df, "id", "fold", 0.1, 50, 2)
    assert out.count() == 200 and out.agg(F.sum("p")).first()[0] == pytest.approx(20.0)


def test_quotas_limit_rows_before_the_shuffle(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("band"))
    out = O.quota(df, "band", {"a": 7, "b": 3, "c": 2}, ["id"])
    assert sorted((r.band, r.id) for r in out.collect()) == [("a", i) for i in range(0, 21, 3)] + [("b", i) for i in range(1, 10, 3)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_a_quantile_between_equal_values_is_that_value(spark):
    """Weights of 0.2 of 5,999 rows add up to one less a bit, and 0.02 would come out as 0.019999999999999997."""
    df = spark.range(0, 60_000).select(F.lit(0.02).alias("v"))
    assert R.exact_quantiles(df, [], "v", [0.2, 0.7, 0.8]).first().q == [0.02, 0.02, 0.02]
    other = spark.range(0, 6_000).select(F.lit(0.08).alias("v"))
    assert R.exact_quantiles(other, [], "v", [0.1, 0.8]).first().q == [0.08, 0.08]


@pytest.mark.parametrize("deviations", [6.0, 0.0])
def test_repeated_selection_against_sorting(spark, monkeypatch, deviations):
    """Most rows are dropped when they are hashed; without any room around the expected place the order statistics decide."""
    general, used = O.top_of, []
    monkeypatch.setattr(O, "top_of", lambda *a: used.append(1) or general(*a))
    rows = [(i, "ab"[i % 3 == 0] if i % 50 else None) for i in range(1500)]
    got = {(r.i, r.k): r.p for r in O.repeated_selection(spark.createDataFrame(rows, "i int, k string"), "i", "k", 0.1, 20, 2, deviations).collect()}
    want = dict.fromkeys(rows, 0)
    for rep in range(20):
        for k in ("a", "b", None):
            own = sorted((int(hashlib.md5(f"{i}:{rep}:2".encode()).hexdigest()[:13], 16), i) for i, f in rows if f == k)
            for _, i in own[: round(len(own) * 0.1)]:
                want[i, k] += 1
    assert got == pytest.approx({x: n / 20 for x, n in want.items()}) and bool(used) == (deviations == 0)


@pytest.mark.parametrize("values", ["tied", "constant", "nan", "text", "distinct"])
def test_weighted_rank_correlations_are_those_of_the_copies(spark, values):
    """Runs of equal rows end in the range, go on in the next, or fill several; copies are counted, not made."""
    r = np.random.default_rng(11)
    n, lanes = 900, 4
    b = {"tied": r.choice([-1.0, -0.0, 0.0, 5.0], n, p=[0.1, 0.4, 0.4, 0.1]), "constant": np.ones(n), "nan": r.choice([1.0, 2.0, np.nan], n), "text": r.integers(0, 9, n), "distinct": r.permutation(n) * 1.0}[values]
    a, w = r.integers(0, 40, n) + np.nan_to_num(b) // 2, r.poisson(1, (n, lanes))
    w[:, 3] = 0
    w[:, 2] = np.where(np.arange(n) == 7, 3, 0)  # copies of a single row
    held = [(float(x), f"v{y}" if values == "text" else float(y), z) for x, y, z in zip(a, b, w.tolist(), strict=True)]
    kind = "string" if values == "text" else "double"
    df = spark.createDataFrame([*held, (None, held[0][1], [9] * lanes), (1.0, None, [9] * lanes)], f"a double, b {kind}, w array<int>")
    mean_rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    whole = np.nan_to_num(b, nan=99.0)
    for size in (45, 5000):
        got = R.weighted_rank_correlations(df, "a", "b", "w", lanes, rows_a_range=size)
        assert got[2:] == [None, None]
        for lane in range(2):
            x, y = np.repeat(a, w[:, lane]), np.repeat(whole, w[:, lane])
            assert got[lane] is None if values == "constant" else got[lane] == pytest.approx(np.corrcoef(mean_rank(x), mean_rank(y))[0, 1], abs=1e-12)
    assert R.weighted_rank_correlations(df.filter("a is null"), "a", "b", "w", lanes) == [None] * lanes
