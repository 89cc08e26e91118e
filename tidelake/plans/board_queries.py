"""Queries of the board functions over positions that are given as literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import boards as C
from tidelake.plans.catalog import query
from tidelake.plans.tables import r6

#: Positions: the start, an open one, a closed one, an ending, a promotion, a mate.
FENS = [
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    "r1bqkb1r/ppp2ppp/2n2n2/4p3/2B5/5N2/PPPP1PPP/RNBQ1RK1 b kq - 1 6",
    "r1bq1rk1/pp2ppb1/3p1npp/2pP4/2P1P3/2N2N2/PP2BPPP/R1BQ1RK1 w - - 0 10",
    "8/5pk1/6p1/7p/5P1P/6P1/6K1/8 w - - 0 40",
    "8/P5k1/8/8/8/8/6K1/8 w - - 0 50",
    "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3",
]
_VALUES = "p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FENS)) + ") AS t(id, fen)), b AS (SELECT id, fen, split_part(fen, ' ', 1) AS b FROM p)"
_COUNT = "(length(b) - length(replace(b, '{}', '')))"
_MATERIAL = " + ".join(f"{v} * ({_COUNT.format(c)} - {_COUNT.format(c.lower())})" for c, v in (("P", 1), ("N", 3), ("B", 3), ("R", 5), ("Q", 9)))
_GAMES = [
    "e4 e5 Nf3 Nc6 Bb5 a6 Ba4 Nf6 O-O Be7 Re1 b5 Bb3 d6 c3 O-O h3 Nb8 d4 Nbd7 c4 c6 Nc3 Bb7 Bg5 h6 Bh4 Re8 dxe5 dxe5 a3 bxc4 Bxc4 Nb6 Ba2 Nbd7 Qb3 Rf8 Rad1 Qe8",
    "d4 Nf6 c4 g6 Nc3 Bg7 e4 d6 Nf3 O-O Be2 e5 O-O Nc6 d5 Ne7 Ne1 Nd7 f3 f5 Be3 f4 Bf2 g5 c5 Nf6 cxd6 cxd6 Nb5 Rf7 Rc1 Ng6 a4 h5 h3 Bf8",
    "e4 e5 f3",
]


def _positions(spark):
    df = spark.createDataFrame(list(enumerate(FENS)), "id int, fen string")
    return df.withColumn("b", C.cells(F.col("fen")))


@query("i10_material", f"WITH {_VALUES} SELECT id, ({_MATERIAL})::INT AS material, len(regexp_extract_all(b, '[A-Za-z]'))::INT AS pieces FROM b")
def i10(spark, sf):
    return _positions(spark).select("id", C.material(F.col("b")).alias("material"), C.pieces(F.col("b")).alias("pieces"))


@query("i14_mirror", f"WITH {_VALUES} SELECT id, translate(list_aggregate(list_reverse(string_split(b, '/')), 'string_agg', '/'), 'PNBRQKpnbrqk', 'pnbrqkPNBRQK') AS mirror FROM b")
def i14(spark, sf):
    return _positions(spark).select("id", C.mirrored_board(F.col("fen")).alias("mirror"))


_CELLS = "g AS (SELECT id, replace(replace(replace(replace(replace(replace(replace(replace(replace(b, '/', ''), '1', '.'), '2', '..'), '3', '...'), '4', '....'), '5', '.....'), '6', '......'), '7', '.......'), '8', '........') AS c FROM b)"
_SQ = "c[8 * (8 - {r}) + {f} + 1]"
_OPEN = " + ".join("(" + " AND ".join(f"{_SQ.format(r=r, f=f)} NOT IN ('P', 'p')" for r in range(1, 9)) + ")::INT" for f in range(8))
_LOCKED = " + ".join(f"({_SQ.format(r=r, f=f)} = 'P' AND {_SQ.format(r=r + 1, f=f)} = 'p')::INT" for f in range(8) for r in range(2, 7))
_CENTRAL = " + ".join(f"({_SQ.format(r=r, f=f)} IN ('P', 'p'))::INT" for f in (3, 4) for r in range(3, 7))


@query("i1_i2_position_type", f"WITH {_VALUES}, {_CELLS}, n AS (SELECT id, {_OPEN} AS open, {_LOCKED} AS locked, {_CENTRAL} AS central FROM g) SELECT id, open, locked, central, CASE WHEN open >= 2 AND central <= 2 THEN 'open' WHEN locked >= 3 AND open = 0 THEN 'closed' WHEN locked >= 1 AND open >= 1 THEN 'dynamic' ELSE 'static' END AS type FROM n")
def i1(spark, sf):
    b = F.col("b")
    out = _positions(spark).select("id", C.open_files(b).alias("open"), C.locked_pawns(b).alias("locked"), C.central_pawns(b).alias("central"))
    return out.withColumn("type", C.position_type(F.col("open"), F.col("locked"), F.col("central")))


@query("i3_i8_position_facts")
def i3(spark, sf):
    return _positions(spark).select("id", C.position_facts("fen").alias("x")).select("id", "x.*")


@query("i5_i6_move_facts")
def i5(spark, sf):
    moves = spark.createDataFrame([(0, "e2e4"), (1, "f6e4"), (2, "d1b3"), (3, "f4f5"), (4, "a7a8q")], "id int, uci string")
    out = _positions(spark).join(moves, "id")
    return out.select("id", "uci", C.advanced_push(F.col("b"), F.col("uci")).alias("advanced"), C.move_facts("fen", "uci").alias("x")).select("id", "uci", "advanced", "x.*")


@query("i9_san_to_uci")
def i9(spark, sf):
    moves = spark.createDataFrame([(0, "Nf3"), (1, "Nxe4"), (2, "Qb3"), (3, "f5"), (4, "a8=Q"), (5, "a4")], "id int, san string")
    return _positions(spark).join(moves, "id").select("id", "san", C.san_to_uci("fen", "san").alias("uci"))


@query("i12_liquidation")
def i12(spark, sf):
    moves = spark.createDataFrame([(1, "Nxe4", "Bc5"), (2, "Qb3", "h3"), (5, "a4", "a4")], "id int, played string, best string")
    return _positions(spark).join(moves, "id").select("id", C.liquidation("fen", "played", "best").alias("x")).select("id", "x.*")


@query("i13_horizon")
def i13(spark, sf):
    lines = spark.createDataFrame([(0, "e2e4 d7d5 e4d5 d8d5 b1c3"), (1, "f6e4 d2d3"), (3, None)], "id int, pv string")
    return _positions(spark).join(lines, "id").select("id", C.horizon(3)("fen", "pv").alias("x")).select("id", "x.*")


@query("w2_game_indicators")
def w2(spark, sf):
    games = spark.createDataFrame(list(enumerate(_GAMES)), "game int, sans string").select("game", F.split("sans", " ").alias("sans"), F.explode(F.array(F.lit(True), F.lit(False))).alias("white"))
    x = games.select("game", "white", C.indicators("sans", "white").alias("x")).select("game", "white", "x.*").filter("total_moves is not null")
    return x.select("game", "white", "position_type", "middlegame_moves_analyzed", "total_moves", *[r6(F.col(c)).alias(c) for c in C.INDICATORS])


@query("i11_fen_features", f"WITH {_VALUES} SELECT id, (CASE WHEN split_part(fen, ' ', 2) = 'w' THEN 1 ELSE -1 END * ({_MATERIAL}))::INT AS mat, len(regexp_extract_all(b, '[A-Za-z]'))::INT AS n_pieces, (id = 5)::INT AS in_check FROM b")
def i11(spark, sf):
    return _positions(spark).select("id", *C.fen_features(F.col("fen")))
