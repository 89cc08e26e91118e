"""Operators against brute-force versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.functions import scalars as H
from tidelake.functions import tails
from tidelake.operators import estimators as G
from tidelake.operators import joins as J
from tidelake.operators import learners as L
from tidelake.operators import mixed as X
from tidelake.operators import windows as O
from tidelake.sources import readers as R
from tidelake.sources import writers as B
from tidelake.streaming import operators as K


def test_rows_of_one_list_meet_in_several_tasks(spark):
    rows = [(i, ["red", "bolt"]) for i in range(300)] + [(300, ["red", ""]), (301, ["ring"]), (302, []), (303, None), (304, ["r"]), (5, ["red", "bolt"])]
    q = spark.createDataFrame(rows, "q int, qt array<string>")
    c = q.select(F.col("q").alias("c"), F.col("qt").alias("ct"))
    made = J.blocked_token_join(q, c, "qt", "ct", rows_a_chunk=30, pairs_a_task=5000).select("q", "c", F.spark_partition_id().alias("task")).collect()
    # Every token continues an empty one.
    asked = {i: [t for t in ts or [] if len(t) >= 2] for i, ts in rows}
    want = {(i, j) for i in asked if asked[i] for j, ts in rows if ts and all(any(x.startswith(t) or t.startswith(x) for x in ts) for t in asked[i])}
    assert sorted((r.q, r.c) for r in made) == sorted(want) and (0, 300) in want and (301, 304) in want
    tasks = [sum(r.task == t for r in made) for t in {r.task for r in made}]
    assert len(tasks) > 4 and max(tasks) < len(made) / 3


def test_rows_above_the_mean_of_any_doubles(spark):
    """Rows on the mean, a null key, null values, and values that ten places below 10^12 don't express."""
    groups = {1: [0.1, 0.2, 0.3], None: [1.0, 2.0, 6.0, None], 2: [1e13, 2e13, 9e13], 3: [1e-12, 2e-12, 6e-12], 4: [None], 5: [1.0, float("nan")], 6: [0.7, 0.7, 0.7]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double")
    got = {r.k: r.n for r in O.above_mean(df, ["k"], "v", "n").collect()}
    assert got == {1: 1, None: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}


def test_run_lengths(spark):
    bits = {"empty": "000", "all": "1111", "tail": "0110111", "one": "0100"}
    rows = [(k, i, c == "1") for k, s in bits.items() for i, c in enumerate(s)]
    got = {r.k: (r.mean_run, r.max_run, r.runs) for r in O.run_lengths(spark.createDataFrame(rows, "k string, at int, flag boolean"), ["k"], "at", "flag").collect()}
    assert got == {"empty": (0.0, 0, 0), "all": (4.0, 4, 1), "tail": (2.5, 3, 2), "one": (1.0, 1, 1)}


def test_resetting_events(spark):
    r = random.Random(1)
    cases = {k: sorted(r.sample(range(60), r.randint(1, 25))) for k in range(30)} | {100: [0, 5], 101: [0, 6], 102: [1, 2, 3, 4, 5]}
    df = spark.createDataFrame([(k, x) for k, xs in cases.items() for x in xs], "k int, at int")
    got = {x.k: x.events for x in O.resetting_events(df, ["k"], "at", F.lit(True), 5).collect()}
    for k, xs in cases.items():
        held, n = [], 0
        for x in xs:
            held = [p for p in held if p >= x - 5] + [x]
            if len(held) >= 2:
                held, n = [], n + 1
        assert got[k] == n


def test_quantile_bins_drop_equal_edges(spark):
    values = [1.0] * 10 + [2.0, 3.0, 4.0, 5.0, 9.0]
    got = [r.bin for r in O.quantile_bins(spark.createDataFrame([(v,) for v in values], "v double"), "v", 4, "bin").orderBy("v").collect()]
    edges = sorted(set(np.percentile(values, [0, 25, 50, 75, 100]).tolist()))
    assert got == [max(0, sum(e < v for e in edges[1:-1])) for v in values]


def test_top_share_rounds_half_to_even(spark):
    df = spark.createDataFrame([(i, i % 2, 1.0) for i in range(10)], "row_id int, fold int, s double")
    assert sorted(r.row_id for r in O.top_share(df, "s", "row_id", 0.5, "fold").collect()) == [0, 1, 2, 3]


def test_tails():
    assert tails.t_tail(2.0, 10) == pytest.approx(0.03669401738537018, rel=1e-10)
    assert tails.f_tail(3.0, 2, 20) == pytest.approx(0.07253815028640571, rel=1e-9)
    assert tails.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-9)
    assert tails.t_quantile(0.975, 5) == pytest.approx(2.570581835636314, rel=1e-9)
    assert tails.sign_test(2, 10) == pytest.approx(0.109375) and tails.sign_test(0, 0) == 1.0
    assert tails.normal_tail(1.959963984540054) == pytest.approx(0.025, rel=1e-9)


def _regression(spark, n=400):
    r = np.random.default_rng(2)
    x, g = r.normal(size=(n, 2)), r.integers(0, 25, n)
    y = 1 + x @ [2.0, -1.0] + r.normal(size=25)[g] + r.normal(size=n)
    return x, y, g, spark.createDataFrame([(float(a), float(b), float(c), int(k)) for (a, b), c, k in zip(x, y, g, strict=True)], "a double, b double, y double, g int")


def test_least_squares(spark):
    x, y, g, df = _regression(spark)
    m = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    u, inv = y - m @ beta, np.linalg.inv(m.T @ m)
    got = G.ols(df, "y", ["a", "b"]).collect()
    assert np.allclose([r.coef for r in got], beta) and np.allclose([r.se for r in got], np.sqrt(np.diag(inv) * (u @ u) / (len(y) - 3)))
    meat = sum(np.outer(s, s) for k in range(25) for s in [(m[g == k] * u[g == k, None]).sum(0)])
    want = np.sqrt(np.diag(inv @ meat @ inv) * 25 / 24 * (len(y) - 1) / (len(y) - 3))
    assert np.allclose([r.se for r in G.cluster_ols(df, "y", ["a", "b"], ["g"]).collect()], want)


def test_random_intercept_finds_its_variances(spark):
    x, y, g, df = _regression(spark, 4000)
    got = {r.term: r for r in X.random_intercept(df, "y", ["a", "b"], "g").collect()}
    assert abs(got["a"].coef - 2) < 0.1 and abs(got["sd_residual"].coef - 1) < 0.05 and 0.6 < got["sd_unit"].coef < 1.5


def test_nested_intercepts_reach_the_likelihood_of_the_truth(spark):
    r = np.random.default_rng(9)
    players, games = np.repeat(np.arange(30), 24), np.repeat(np.arange(30 * 4), 6)
    x = r.normal(size=720)
    y = 2 + 0.5 * x + r.normal(size=30)[players] * 1.5 + r.normal(size=120)[games] * 0.7 + r.normal(size=720)
    df = spark.createDataFrame([(float(a), float(b), int(p), int(g)) for a, b, p, g in zip(x, y, players, games, strict=True)], "x double, y double, p int, g int")
    got = {t.term: t for t in X.nested_intercepts(df, "y", ["x"], "p", "g").collect()}

    def likelihood(a, b, c):
        """Block by block: players are independent."""
        xvx, xvy, parts = np.zeros((2, 2)), np.zeros(2), []
        for k in range(30):
            own = players == k
            v = c * np.eye(own.sum()) + a + b * (games[own][:, None] == games[own])
            m, inv = np.column_stack([np.ones(own.sum()), x[own]]), np.linalg.inv(v)
            xvx, xvy = xvx + m.T @ inv @ m, xvy + m.T @ inv @ y[own]
            parts.append((m, inv, y[own], np.linalg.slogdet(v)[1]))
        beta = np.linalg.solve(xvx, xvy)
        return -0.5 * sum(d + (w - m @ beta) @ inv @ (w - m @ beta) for m, inv, w, d in parts), beta

    a, b, c = (got[t].coef ** 2 for t in ("sd_outer", "sd_inner", "sd_residual"))
    at, beta = likelihood(a, b, c)
    assert got["const"].coef == pytest.approx(beta[0], abs=1e-6) and got["x"].coef == pytest.approx(beta[1], abs=1e-6)
    assert all(at >= likelihood(a * f, b * g, c)[0] - 1e-4 for f, g in ((1.2, 1), (0.8, 1), (1, 1.2), (1, 0.8))) and at >= likelihood(2.25, 0.49, 1.0)[0]


def test_segmented(spark):
    r = np.random.default_rng(4)
    x = r.uniform(0, 10, 800)
    df = spark.createDataFrame([(float(a), float(a + 3 * max(0, a - 6) + e)) for a, e in zip(x, r.normal(size=800), strict=True)], "x double, y double")
    out = G.segmented(df, "y", "x").first()
    assert out.lo <= 6 <= out.hi and abs(out.slope_above - 4) < 0.4 and out.p < 1e-10


def test_crossfit_uses_other_folds(spark):
    x, y, g, df = _regression(spark)
    df = df.withColumn("fold", F.col("g") % 5)
    got = L.crossfit(df, "y", ["a", "b"], "fold", 5, "fit").collect()
    m = np.column_stack([np.ones(len(y)), x])
    for k in range(5):
        beta = np.linalg.lstsq(m[g % 5 != k], y[g % 5 != k], rcond=None)[0]
        for r in [r for r in got if r.fold == k][:20]:
            assert r.fit == pytest.approx(beta @ [1, r.a, r.b])


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"game_id": "1", "v": 1}\nbroken\n{"game_id": "1", "v": 2}\n{"game_id": "02", "v": 3}\n')
    get = lambda last: sorted((r.game_id, r.v) for r in R.json_lines(spark, str(tmp_path / "a.jsonl"), "game_id string, v int", "game_id", last).collect())
    assert get(False) == [("02", 3), ("1", 1)] and get(True) == [("02", 3), ("1", 2)]
    (tmp_path / "b.csv").write_text("Player,SEX,Elo\nann,F,2000\nbob,M,bad\n")
    good = R.csv_typed(spark, str(tmp_path / "b.csv"), "Player string, SEX string, Elo int", drop_bad=True)
    assert [tuple(r) for r in R.resolved_columns(good, {"name": ("name", "player"), "sex": ("gender", "sex")}).collect()] == [("ann", "F")]
    (tmp_path / "c.md").write_text("# One\n| a | b |\n|---|---|\n| 1 | 2 |\ntext\n## Two\n| x |\n| --- |\n")
    assert [(r.title, r.row, list(r.cells)) for r in R.markdown_tables(spark, str(tmp_path / "c.md")).orderBy("title", "row").collect()] == [("One", 1, ["a", "b"]), ("One", 2, ["1", "2"]), ("Two", 1, ["x"])]
    assert [r.line for r in R.log_tail(spark, str(tmp_path / "c.md"), r"^\|", 2).collect()] == ["| --- |", "| x |"]
    pgn = '[White "A b"]\n[Result "1-0"]\n\n1. e4 {[%clk 0:03:00]} e5 {[%clk 0:02:58.5]} 2. Nf3 $1 (2. f4 exf4) Nc6 3. O-O?! 1-0'
    row = spark.createDataFrame([(pgn,)], "p string").select(R.pgn_headers(F.col("p")).alias("h"), R.pgn_moves(F.col("p")).alias("m")).first()
    assert row.h == {"White": "A b", "Result": "1-0"}
    assert [(m.ply, m.san, m.clk) for m in row.m] == [(0, "e4", 180.0), (1, "e5", 178.5), (2, "Nf3", None), (3, "Nc6", None), (4, "O-O", None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "k int, v int")
    store = str(tmp_path / "store")
    assert B.store_once(df.filter("k < 30"), store, ["k"]) == 30 and B.store_once(df, store, ["k"]) == 20 and B.store_once(df, store, ["k"]) == 0
    B.bucketed_shards(df, str(tmp_path / "shards"), "k")
    import hashlib

    got = {r.k: r.bucket for r in spark.read.option("basePath", str(tmp_path / "shards")).parquet(str(tmp_path / "shards")).collect()}
    assert all(int(b) == int(hashlib.md5(str(k).encode()).hexdigest(), 16) % 16 for k, b in got.items())
    with pytest.raises(Exception, match="exist"):
        B.write_new(df, store)
    once = B.replace_section("# R\n\n## A\nold\n\n## B\nkeep\n", "A", "new")
    assert once == B.replace_section(once, "A", "new") and "old" not in once and "keep" in once
    assert B.markdown_table(spark.createDataFrame([(1, None)], "a int, b string")).splitlines()[2] == "| 1 |   |"


def test_streams_equal_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    r = random.Random(5)
    rows = [(i, None, i % 7, r.choice("ab"), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("event_id") * 600 + 1_700_000_000))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = K.events_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = K.windowed(stream, "ts", "1 hour", None, ["event_type"], "value").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert key(spark.table("w")) == key(K.windowed(df, "ts", "1 hour", None, ["event_type"], "value"))
    out = str(tmp_path / "out")
    K.run_available(stream.select("event_id", "value"), str(tmp_path / "cp"), K.append_new(out, ["event_id"]))
    K.run_available(stream.select("event_id", "value"), str(tmp_path / "cp2"), K.append_new(out, ["event_id"]))
    assert B.stored(spark, out, ["event_id"]).count() == 200
    quota = K.with_quota(stream.select("event_type", "event_id"), "event_type", {"a": 5, "b": 9}).writeStream.format("memory").queryName("q").outputMode("append").trigger(availableNow=True).start()
    quota.awaitTermination()
    assert {r.event_type: r["count"] for r in spark.table("q").groupBy("event_type").count().collect()} == {"a": 5, "b": 9}


def test_bootstrap_counts(spark):
    counts = G.draw_counts(spark.createDataFrame([(i,) for i in range(40)], "u int"), "u", 5, 1).groupBy("draw").agg(F.sum("cnt").alias("n")).collect()
    assert [r.n for r in counts] == [40] * 5 and not math.isnan(1.0)


def test_formats_round_the_binary_number(spark):
    df = spark.createDataFrame([(2.675, 1.05e-19, 0.125), (-0.005, 3.5e20, 100.0), (None, None, None)], "a double, b double, c double")
    got = df.select(H.signed(F.col("a"), 2), H.scientific(F.col("b"), 2), H.p_text(F.col("c")), H.percent(F.col("c") / 100, 2)).collect()
    assert [tuple(r) for r in got] == [("+2.67", "1.0 \u00d7 10\u207b\u00b9\u2079", ".12", "0.12%"), ("\u22120.01", "3.5 \u00d7 10\u00b2\u2070", "1e+02", "100.00%"), (None, None, None, None)]


def test_a_row_on_the_mean_is_not_above_it(spark):
    values = [0.1] * 10 + [0.3] * 7  # of either key alone the sum of doubles isn't n times the value
    df = spark.createDataFrame([(i // 10, v) for i, v in enumerate(values)], "k int, v double").coalesce(1)
    assert {r.k: r.above for r in O.above_mean(df, ["k"], "v", "above").collect()} == {0: 0, 1: 0}
