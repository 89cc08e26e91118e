"""Board functions as Columns: string arithmetic where a FEN is enough, Arrow functions where rules are needed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions import board as B

_KINDS = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _fields(text: str) -> T.StructType:
    """A struct type, without a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(","))])

#: Fixed values of the game window: first ply, end, least plies, the ply of the position type, the span of pawn storms.
FIRST, END, LEAST, TYPE_PLY, SPAN = 14, 40, 19, 39, 5
INDICATORS = ("exchange_rate", "tension_duration", "avg_mobility", "center_control_score", "advanced_pawn_push_rate", "pawn_storm_indicator", "castling_ply", "king_shelter_score", "forcing_move_rate", "reactive_move_rate")


def cells(fen: Column) -> Column:
    """64 signs, rank 8 first, file a first."""
    out = F.replace(F.split_part(fen, F.lit(" "), F.lit(1)), F.lit("/"), F.lit(""))
    for n in range(8, 0, -1):
        out = F.replace(out, F.lit(str(n)), F.lit("." * n))
    return out


def _at(board: Column, file: int, rank: int) -> Column:
    return F.substring(board, (7 - rank) * 8 + file + 1, 1)


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + p.cast("int")
    return out


def open_files(board: Column) -> Column:
    return _sum([~F.rlike(F.concat(*[_at(board, f, r) for r in range(8)]), F.lit("[Pp]")) for f in range(8)])


def locked_pawns(board: Column) -> Column:
    return _sum([(_at(board, f, r) == "P") & (_at(board, f, r + 1) == "p") for f in range(8) for r in range(1, 7)])


def central_pawns(board: Column) -> Column:
    return _sum([_at(board, f, r).isin("P", "p") for f in (3, 4) for r in range(2, 6)])


def position_type(open_: Column, locked: Column, central: Column) -> Column:
    return F.when((open_ >= 2) & (central <= 2), "open").when((locked >= 3) & (open_ == 0), "closed").when((locked >= 1) & (open_ >= 1), "dynamic").otherwise("static")


def material(board: Column) -> Column:
    """White less black."""
    count = lambda c: F.length(board) - F.length(F.replace(board, F.lit(c), F.lit("")))
    out = F.lit(0)
    for c, v in B.VALUES.items():
        out = out + v * (count(c) - count(c.lower()))
    return out


def pieces(board: Column) -> Column:
    return 64 - (F.length(board) - F.length(F.replace(board, F.lit("."), F.lit(""))))


def fen_features(fen: Column) -> list[Column]:
    """mat (material, from the side to move), n_pieces, in_check (of the side to move)."""
    board = cells(fen)
    return [F.when(white_to_move(fen), material(board)).otherwise(-material(board)).alias("mat"), pieces(board).alias("n_pieces"), position_facts(fen)["in_check"].cast("int").alias("in_check")]


def white_to_move(fen: Column) -> Column:
    return F.split_part(fen, F.lit(" "), F.lit(2)) == "w"


def mirrored_board(fen: Column) -> Column:
    """The board field with colours swapped and upside down."""
    field = F.split_part(fen, F.lit(" "), F.lit(1))
    upside = F.array_join(F.reverse(F.split(field, "/")), "/")
    return F.translate(upside, "PNBRQKpnbrqk", "pnbrqkPNBRQK")


def advanced_push(board: Column, uci: Column) -> Column:
    """A pawn that arrives on its fifth rank or beyond."""
    at = F.substr(board, (8 - F.substring(uci, 2, 1).cast("int")) * 8 + F.instr(F.lit("abcdefgh"), F.substring(uci, 1, 1)), F.lit(1))
    to = F.substring(uci, 4, 1).cast("int")
    return ((at == "P") & (to >= 5)) | ((at == "p") & (to <= 4))


@F.pandas_udf(_fields("mobility int, centre int, shelter int, n_legal int, has_capture boolean, in_check boolean, terminal string"))
def position_facts(fens: pd.Series) -> pd.DataFrame:
    """Of the side to move."""
    out = []
    for f in fens:
        if f is None:
            out.append((None,) * 7)
            continue
        p = B.read(f)
        moves = B.legal(p)
        out.append((B.mobility(p, p.white), B.centre_control(p, p.white), B.king_shelter(p, p.white), len(moves), any(B.captures(p, m) for m in moves), B.checked(p, p.white), B.terminal(p)))
    return pd.DataFrame(out, columns=["mobility", "centre", "shelter", "n_legal", "has_capture", "in_check", "terminal"]).astype(object)


@F.pandas_udf(_fields("san string, capture boolean, check boolean, forcing boolean, after string"))
def move_facts(fens: pd.Series, ucis: pd.Series) -> pd.DataFrame:
    out = []
    for f, u in zip(fens, ucis, strict=True):
        p, m = B.read(f), B.from_uci(u)
        out.append((B.san(p, m), B.captures(p, m), B.checks(p, m), B.forcing(p, m), B.fen(B.push(p, m))))
    return pd.DataFrame(out, columns=["san", "capture", "check", "forcing", "after"])


@F.pandas_udf(T.StringType())
def san_to_uci(fens: pd.Series, sans: pd.Series) -> pd.Series:
    """Null where the text names no legal move, or several."""

    def one(f: str, s: str) -> str | None:
        try:
            return str(B.from_san(B.read(f), s))
        except ValueError:
            return None

    return pd.Series([one(f, s) for f, s in zip(fens, sans, strict=True)], dtype=object)


@F.pandas_udf(_fields("played_is_capture double, best_is_capture double, dmat double, dbal double"))
def liquidation(fens: pd.Series, played: pd.Series, best: pd.Series) -> pd.DataFrame:
    """What the played move takes off the board against the best one; nulls where a move can't be read."""
    out = []
    for f, a, b in zip(fens, played, best, strict=True):
        try:
            p = B.read(f)
            ma, mb = B.from_san(p, a), B.from_san(p, b)
            pa, pb = B.push(p, ma), B.push(p, mb)
            out.append((float(B.captures(p, ma)), float(B.captures(p, mb)), float(B.total(pa) - B.total(pb)), float(B.balance(pa, p.white) - B.balance(pb, p.white))))
        except ValueError:
            out.append((None,) * 4)
    return pd.DataFrame(out, columns=["played_is_capture", "best_is_capture", "dmat", "dbal"])


def horizon(k: int):
    @F.pandas_udf(_fields("horizon int, flag string"))
    def of(fens: pd.Series, lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([B.horizon(f, x, k) for f, x in zip(fens, lines, strict=True)], columns=["horizon", "flag"]).astype({"horizon": "Int32"})

    return of


def game_indicators(sans: list[str], white: bool) -> dict | None:
    """The ten indicators of one side's game, its position type and its counts; none for games that are too short, have no own move in the window, or can't be read."""
    if len(sans) < LEAST:
        return None
    p, marks, states = B.read(B.START), [], []
    try:
        for text in sans:
            m = B.from_san(p, text)
            marks.append((p, m, B.push(p, m)))
            p = marks[-1][2]
            states.append(p)
    except ValueError:
        return None
    own = [i for i in range(len(marks)) if marks[i][0].white == white]
    inside = [i for i in own if FIRST <= i < END]
    if not inside:
        return None
    capture = {i: B.captures(*marks[i][:2]) for i in own}
    force = {i: B.forcing(*marks[i][:2]) for i in {*inside, *(i - 1 for i in inside)}}
    runs, held = [], 0
    for i in own:
        if not capture[i] and any(B.captures(marks[i][0], m) for m in B.legal(marks[i][0])):
            held += 1
        elif held:
            runs, held = [*runs, held], 0
    runs = [*runs, held] if held else runs
    storms, wings = 0, {}
    for i in inside:
        q, m, _ = marks[i]
        file = m.end % 8
        if q.board[m.start] in "Pp" and (m.end // 8 - m.start // 8) * (1 if white else -1) > 0 and (file >= 5 or file <= 2):
            seen = [x for x in wings.get(file >= 5, []) if x >= i - SPAN] + [i]
            storms, wings[file >= 5] = (storms + 1, []) if len(seen) >= 2 else (storms, seen)
    n = len(inside)
    mean = lambda f: sum(f(i) for i in inside) / n
    pushes = lambda i: marks[i][0].board[marks[i][1].start] in "Pp" and ((white and marks[i][1].end // 8 >= 4) or (not white and marks[i][1].end // 8 <= 3))
    castle = [i + 1 for i in own if marks[i][0].board[marks[i][1].start] in "Kk" and abs(marks[i][1].end - marks[i][1].start) == 2]
    values = (mean(lambda i: capture[i]), sum(runs) / len(runs) if runs else 0.0, mean(lambda i: B.mobility(marks[i][2], white)), mean(lambda i: B.centre_control(marks[i][2], white)), mean(pushes), float(storms), float(castle[0]) if castle else None, mean(lambda i: B.king_shelter(marks[i][2], white)), mean(lambda i: force[i]), mean(lambda i: force[i - 1]))
    return dict(zip(INDICATORS, values, strict=True)) | {"position_type": B.position_type(states[min(TYPE_PLY, len(states) - 1)]), "middlegame_moves_analyzed": n, "total_moves": len(sans)}


_GAME = ", ".join(f"{c} double" for c in INDICATORS) + ", position_type string, middlegame_moves_analyzed int, total_moves int"


@F.pandas_udf(_fields(_GAME))
def indicators(games: pd.Series, white: pd.Series) -> pd.DataFrame:
    """game_indicators() of an array of SAN moves; null fields where there are none."""
    names = [*INDICATORS, "position_type", "middlegame_moves_analyzed", "total_moves"]
    rows = [game_indicators(list(g), bool(w)) or {} for g, w in zip(games, white, strict=True)]
    out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)
    return out.astype({n: "float64" for n in INDICATORS} | {n: "Int32" for n in names[-2:]})
