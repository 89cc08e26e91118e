"""Services, evaluators and stateful streams against plain Python."""

import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidelake.functions import board as B
from tidelake.operators import windows as O
from tidelake.sources import services as V
from tidelake.sources import writers as W
from tidelake.streaming import operators as K

MATED = "rnbqkbnr/pppp1ppp/8/4p3/6P1/5P2/PPPPP2P/RNBQKBNR b KQkq - 0 2"


def test_waits_grow_and_stop_after_the_last_try():
    waits = []

    def of(*outcomes):
        left = list(outcomes)

        def call():
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return call

    assert V.with_backoff(of(V.Refused(), OSError(), 7), sleep=waits.append) == (7, 3) and waits == [5.0, 4.0]
    waits.clear()
    assert V.with_backoff(of(V.Refused(), V.Refused(), V.Refused()), sleep=waits.append) == (None, 3) and waits == [5.0, 10.0]


def test_ask_takes_nulls_repeats_and_missing_fields(spark):
    def client():
        def answer(k):
            if k == "bad":
                raise OSError
            return {"a": len(k)} if k else {}

        return answer

    df = spark.createDataFrame([("xy",), ("xy",), (None,), ("",), ("bad",)], "k string")
    got = {r.k: (r.a, r.b, r.tried) for r in V.ask(df, "k", client, "a int, b string", {"a": -1, "b": "none"}, tries=2, failed=0.0).collect()}
    assert got == {"xy": (2, "none", 1), "": (-1, "none", 1), "bad": (-1, "none", 2)}
    assert V.ask(df.limit(0), "k", client, "a int, b string", {}).count() == 0


def test_search_finds_mate_and_checks_history(spark):
    df = spark.createDataFrame([(1, MATED), (2, None), (3, "8/8/8/8/8/5k2/5q2/5K2 w - - 0 1")], "id int, fen string")
    got = {r.id: r.lines for r in V.searched(df, "fen", V.material_engine).collect()}
    assert (got[1][0].move, got[1][0].cp, got[1][0].mate) == ("d8h4", None, 1) and len(got[1]) == 5 and got[2] == [] and got[3] == []
    played = spark.createDataFrame([(["e4"], B.START)], "played array<string>, fen string")
    with pytest.raises(PythonException, match="not to"):
        V.searched(played, "fen", V.material_engine, 1, "played").collect()


def test_values_of_lines(spark):
    rows = [(1, [("a", 100, None), ("b", -100, None)], ""), (2, [], "checkmate"), (3, [], "draw"), (4, [], ""), (5, [("a", None, 2)], "")]
    df = spark.createDataFrame(rows, "id int, lines " + V.LINES + ", ends string")
    lines, ends = F.col("lines"), F.col("ends")
    got = {r.id: r for r in df.select("id", V.child_value(lines, ends).alias("child"), V.reply_value(lines, ends).alias("reply"), *V.successor_summary(lines, ends), *V.successor_lines(lines, ends, 2)).collect()}
    assert got[1].lo == got[1].child == got[1].wp_self_1 < 50 < got[1].hi == got[1].wp_self_2 and got[1].child + got[1].reply == pytest.approx(100)
    assert got[1].spread == pytest.approx((got[1].hi - got[1].lo) / 2) and (got[1].mv_2, got[1].n_pv) == ("b", 2)
    assert (got[2].lo, got[2].hi, got[2].steep, got[2].terminal) == (100, 100, 0, "checkmate") and got[2].reply < 1e-9
    assert (got[3].child, got[3].reply, got[3].mv_1) == (50, 50, None)
    assert (got[4].child, got[4].reply, got[4].steep, got[4].terminal) == (None, None, None, "no_pv")
    assert got[5].child < 1e-9 and got[5].reply > 100 - 1e-9


def test_exact_search_keeps_the_smallest_of_many_hits(spark):
    docs = spark.range(5000).select("id", F.lit("a b").alias("t"))
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "q int, asked array<string>")
    assert sorted(map(tuple, V.exact_search(docs, "id", F.split("t", " "), asked, "q", "asked", 3).collect())) == [(1, 0), (1, 1), (1, 2)]


def test_collector_stops_at_a_stall(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 9, 10, 30, 31)], "at int")
    assert [r.at for r in O.until_stalled(df, "at", 8).orderBy("at").collect()] == [1, 2, 9, 10]
    assert O.until_stalled(df, "at", 100).count() == 6 and O.until_stalled(df.limit(0), "at", 1).count() == 0


def test_a_draw_is_written_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "draws")
    assert W.write_draw(spark.range(3), path, 4) and not W.write_draw(spark.range(9), path, 4)
    spark.range(5).write.parquet(f"{path}/_5-left-by-a-stop")
    assert {(r.id, r.draw) for r in spark.read.parquet(path).collect()} == {(0, 4), (1, 4), (2, 4)}


def test_state_is_kept_between_batches(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, r.randrange(4), r.choice("xyz")) for i in range(300)]
    source = str(tmp_path / "in")
    hit = lambda row: row["kind"] == "x"
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], "at long, game int, kind string").coalesce(1).write.mode("append").parquet(source)
        for name, (start, step, state) in (("storm", K.resetting(hit, "at", 9)), ("runs", K.run_state(hit))):
            stream = spark.readStream.schema("at long, game int, kind string").parquet(source)
            K.run_available(K.folded_by_key(stream, "game", "at", start, step, state), str(tmp_path / f"{name}-c"), K.last_states(str(tmp_path / name)), "update")
    for name, (start, step, _) in (("storm", K.resetting(hit, "at", 9)), ("runs", K.run_state(hit))):
        wanted = {}
        for at, game, kind in rows:
            wanted[game] = step(wanted.get(game, start), {"at": at, "kind": kind})
        got = {r.game: tuple(r)[1:] for r in K.read_last(spark, str(tmp_path / name), "game").collect()}
        assert got == wanted
    whole = spark.createDataFrame(rows, "at long, game int, kind string")
    storms = {r.game: r.events for r in O.resetting_events(whole, ["game"], "at", F.col("kind") == "x", 9).collect()}
    assert {r.game: r.events for r in K.read_last(spark, str(tmp_path / "storm"), "game").collect()} == storms
