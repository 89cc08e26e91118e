"""Queries take whole tables, and fits all their rounds."""

import itertools
import statistics
import unicodedata

from compare import SF
from pyspark.sql import functions as F

from tidelake.functions import scalars as H
from tidelake.operators import estimators as G
from tidelake.operators import learners as L
from tidelake.operators import mixed as X
from tidelake.operators import joins as J
from tidelake.plans import catalog
from tidelake.plans import estimator_queries as E
from tidelake.plans.tables import table

QUERIES = catalog.queries()


def test_c12_every_part_is_query_and_candidate(spark):
    got, parts = QUERIES["c12_theta_tokens"](spark, SF), table(spark, SF, "part")
    assert got.select("q").distinct().count() == got.select("c").distinct().count() == parts.count()
    # One name held by many rows: tried once, returned for every pair.
    names = {i: ["red", "bolt"] for i in range(120)} | {120: ["re", "x"], 121: ["bolted", "reddish"], 122: ["y"], 123: []}
    q = spark.createDataFrame(list(names.items()), "q int, qt array<string>")
    c = q.select(F.col("q").alias("c"), F.col("qt").alias("ct"))
    found = J.blocked_token_join(q, c, "qt", "ct").select("q", "c").collect()
    asked = lambda a: [t for t in a if len(t) >= 2]
    match = lambda a, b: asked(a) and all(any(x.startswith(t) or t.startswith(x) for x in b) for t in asked(a))
    assert sorted(map(tuple, found)) == sorted((i, j) for i, j in itertools.product(names, names) if match(names[i], names[j]))


def test_h5_folds_whole_texts(spark):
    """Marks by their Unicode decomposition; other characters stay."""
    plain = lambda t: "".join(unicodedata.normalize("NFD", c)[0] if c in H._FOLD_FROM else c for c in t)
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: r.folded for r in QUERIES["h5_fold_marks"](spark, SF).collect()}
    assert got == {i: plain(t) for i, t in texts.items()} and max(map(len, got.values())) > 80


def test_g34_counts_every_event_and_pools_cells_of_one_row(spark):
    assert QUERIES["g34_cell_noise"](spark, SF).agg(F.sum("n")).first()[0] == table(spark, SF, "events").count()
    # Two cells of a band with 2 and 3 rows, and one of a single row.
    rows = [(4, "a", 1.0), (4, "a", 3.0), (8, "a", 0.0), (8, "a", 4.0), (8, "a", 5.0), (12, "a", 7.0)]
    got = {r.user_id: (r.n, r.noise) for r in E._cell_noise(spark.createDataFrame(rows, "user_id long, event_type string, value double")).collect()}
    s2 = statistics.variance([0.0, 4.0, 5.0])
    assert got[4] == (2, 1.0) and got[8] == (3, round(s2 / 3, 6)) and got[12] == (1, round((2 + 2 * s2) / 3, 6))


def test_rowwise_queries_take_every_line(spark):
    lines = table(spark, SF, "lineitem")
    for name in ("c20_chained_assembly", "g4_projection", "f15_conditional_assignment", "h17_h18_results"):
        assert QUERIES[f"{name}"](spark, SF).count() == lines.count(), name
    assert QUERIES["f7_column_inequality"](spark, SF).count() == lines.filter("l_partkey % 10 <> l_suppkey % 10").count()


def test_fits_are_registered_with_their_rounds_and_draws(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(L.Boosting, "fit", lambda self, df, y, x, fold, k: asked.append((self.rounds, self.depth, self.unit, k)) or [L.Boosted(0.0)] * k)
    monkeypatch.setattr(L, "importance", lambda df, *_, repeats, **__: asked.append(repeats) or df.sparkSession.createDataFrame([("a", 0.0)], "term string, importance double"))
    monkeypatch.setattr(G, "draw_counts", lambda units, unit, draws, seed: asked.append(draws) or units.select(unit, F.lit(0).cast("long").alias("draw"), F.lit(1).cast("long").alias("cnt")))
    monkeypatch.setattr(X, "bootstrap_nested", lambda df, *a: asked.append(a[-2]) or df.sparkSession.createDataFrame([(0, "const", 0.0)], "draw long, term string, coef double"))
    for name in ("g16_boosting", "g17_stopped_boosting", "g32_permutation_importance", "g26_cluster_bootstrap", "g35_group_difference", "g28_bootstrap_fits", "g28_bootstrap_mixed"):
        QUERIES[name](spark, SF)
    assert asked == [(100, 5, None, 1), (500, 4, "l_suppkey", 5), 10, (40, 4, "o_custkey", 5), 10, 2000, 2000, 2000, 2000]


def test_c12_shuffles_chunks_without_tokens_and_writes_short_repeats(spark, tmp_path):
    """Parts as the table has them, copies of a row too: as many pairs as SQL makes, a shuffled row a chunk, and few bytes a pair."""
    names = ["red bolt", "old ring"]
    spark.range(3000).select(F.col("id").alias("p_partkey"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 2 + 1).cast("int")).alias("p_name")).unionAll(spark.createDataFrame([(0, "red bolt")], "a long, b string")).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["c12_theta_tokens"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "collect_list" in plan
    got.write.parquet(f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 1501**2 + 1500**2 and back.filter("q = 0 and c = 0").count() == 4 and back.distinct().count() == 2 * 1500**2
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < back.count() / 2
