"""Services and evaluators as sources: workers ask a client, and what it says becomes a table.

A client is made on the worker by a function without arguments, once a task, and answers one key at a time; transports, caches and
test doubles are clients alike.  A task that is run again asks again, so an answer that has to stay what it was is written to a store
first (writers.store_once()).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tidelake.functions import board as B
from tidelake.functions.scalars import MATE, pov_cp, wp_from_cp
from tidelake.operators.joins import all_tokens_index, interval_lookup
from tidelake.streaming.operators import min_max_curve


class Refused(Exception):
    """The service asks to come back later."""


def with_backoff(call: Callable[[], object], tries: int = 3, refused: float = 5.0, failed: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """What call() gives and the tries it took; None if none of them gave anything.  The k-th wait is k times the first: longer after a refusal than after another failure."""
    for k in range(1, tries + 1):
        try:
            return call(), k
        except Refused:
            wait = refused
        except Exception:  # whatever a transport raises
            wait = failed
        if k < tries:
            sleep(wait * k)
    return None, tries


def ask(df: DataFrame, key: str, client: Callable[[], Callable[[object], dict]], schema: str, default: dict, askers: int = 4, tries: int = 3, refused: float = 5.0, failed: float = 2.0, pause: float = 0.0) -> DataFrame:
    """key, the answer's columns, tried: one row a distinct key, null keys left out.

    ``askers`` bounds how many tasks ask at a time, ``pause`` is the wait after each request.  A key that
    no try had an answer for, and a field that an answer lacks, get the defaults.
    """
    fields = T.StructType.fromDDL(schema)
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *fields, T.StructField("tried", T.IntegerType())])
    arrow = to_arrow_schema(out)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = client()
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                found, tried = with_backoff(lambda k=k: answer(k), tries, refused, failed)
                rows.append({**default, **(found or {}), key: k, "tried": tried})
                time.sleep(pause)
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in out.names} for r in rows], schema=arrow)

    return df.select(key).filter(F.col(key).isNotNull()).distinct().repartition(askers, key).mapInArrow(asked, out)


def exact_search(docs: DataFrame, doc_id: str, tokens: Column, queries: DataFrame, query_id: str, query_tokens: str, most: int) -> DataFrame:
    """Documents that hold every token of a query; the ``most`` smallest identifiers a query, as a search's size cap does."""
    found = all_tokens_index(docs, doc_id, tokens, queries, query_id, query_tokens)
    # Ranked in cells first, so a query that very many documents answer is no one task's.
    cells = Window.partitionBy(query_id, F.pmod(F.xxhash64(doc_id), F.lit(64))).orderBy(doc_id)
    some = found.select(query_id, doc_id).distinct().withColumn("__r", F.row_number().over(cells)).filter(F.col("__r") <= most)
    return some.withColumn("__r", F.row_number().over(Window.partitionBy(query_id).orderBy(doc_id))).filter(F.col("__r") <= most).drop("__r")


def targeted_fetch(wanted: DataFrame, known: DataFrame, archive: DataFrame, user: str, month: str, id_: str, most: int = 8) -> DataFrame:
    """wanted (user, id) with the month whose archive holds it and the number of archives opened; null where ``most`` don't hold it.

    The range of identifiers by month is learnt from ``known`` and says where a wanted one should lie; a user's months are
    opened nearest first, ties to the earlier.  A user has as many months as the calendar, so they travel as one array.
    """
    predicted = interval_lookup(wanted.select(user, id_), min_max_curve(known, month, id_), id_, "lo", "hi", month, "__at")
    months = archive.groupBy(user).agg(F.collect_set(month).alias("__months"))
    by_distance = F.array_sort(F.transform("__months", lambda m: F.struct(F.abs(m - F.col("__at")).alias("d"), m.alias("m"))))
    tried = predicted.join(months, user).select(user, id_, F.posexplode(F.slice(by_distance, 1, most)).alias("__n", "__x"))
    opened = tried.select(user, id_, F.col("__x.m").alias(month), (F.col("__n") + 1).alias("tries"))
    hits = opened.join(archive.select(user, month, id_).distinct(), [user, month, id_]).groupBy(user, id_).agg(F.min_by(month, "tries").alias(month), F.min("tries").alias("tries"))
    return wanted.select(user, id_).join(hits, [user, id_], "left")


LINES = "array<struct<move:string,cp:int,mate:int>>"


def material_engine() -> Callable[[str, int], list[tuple[str, int | None, int | None]]]:
    """An evaluator that counts material one move deep: moves best first, ties by their text.  For tests and dry runs."""

    def search(fen: str, lines: int) -> list[tuple[str, int | None, int | None]]:
        p = B.read(fen)
        scored = []
        for m in B.legal(p):
            after = B.push(p, m)
            end = B.terminal(after)
            cp = 0 if end == "draw" else 100 * B.balance(after, p.white)
            scored.append((end != "checkmate", -cp, str(m)))
        return [(m, -loss, None) if not_mate else (m, None, 1) for not_mate, loss, m in sorted(scored)[:lines]]

    return search


def searched(df: DataFrame, fen: str, engine: Callable[[], Callable[[str, int], list]], lines: int = 5, played: str | None = None) -> DataFrame:
    """df with ``lines``: the evaluator's first moves of the position, best first, scores as the side to move sees them.

    Each position is a search of its own; nothing is carried from one to the next.  played: a column with the
    moves from the game's start; a position that they don't lead to stops the query.
    """
    out = T.StructType([*df.schema.fields, T.StructField("lines", T.StructType.fromDDL(f"x {LINES}")["x"].dataType)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = engine()
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if played is not None:
                    p = B.read(B.START)
                    for move in r[played]:
                        p = B.push(p, B.from_san(p, move))
                    if B.fen(p) != r[fen]:
                        raise ValueError(f"the moves lead to {B.fen(p)}, not to {r[fen]}")
                r["lines"] = [] if r[fen] is None else [{"move": m, "cp": cp, "mate": mate} for m, cp, mate in search(r[fen], lines)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, out)


def _own(line: Column) -> Column:
    """Win probability of a line for the side to move."""
    return wp_from_cp(pov_cp(line["cp"], line["mate"]))


def _others(line: Column) -> Column:
    """Win probability of a line for the side that has just moved."""
    return wp_from_cp(-pov_cp(line["cp"], line["mate"]))


def child_value(lines: Column, terminal: Column) -> Column:
    """Value of a move for its mover, from the position that it leads to: mate and draws by rule, else the first line with its sign turned."""
    ruled = F.when(terminal == "checkmate", wp_from_cp(F.lit(MATE))).when(terminal == "draw", F.lit(50.0))
    return ruled.when(F.size(lines) > 0, _others(lines[0]))


def reply_value(lines: Column, terminal: Column) -> Column:
    """Value of the position after a reply for the side to move there, which is the one asked about: no sign is turned."""
    ruled = F.when(terminal == "checkmate", wp_from_cp(F.lit(-MATE))).when(terminal == "draw", F.lit(50.0))
    return ruled.when(F.size(lines) > 0, _own(lines[0]))


def successor_summary(lines: Column, terminal: Column) -> list[Column]:
    """lo, hi, steep, spread, n_pv, terminal of what a move leads to, as its mover sees it: the opponent's first line, the last, their difference, the
    deviation (of the population).  Terminal positions have no lines and the rule's value; others without lines are ``no_pv`` and null."""
    ended, seen = terminal.isin("checkmate", "draw"), F.transform(lines, _others)
    ruled = F.when(terminal == "checkmate", 100.0).when(terminal == "draw", 50.0)
    mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(lines)
    spread = F.sqrt(F.aggregate(seen, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(lines))
    some = F.size(lines) > 0
    return [
        ruled.when(some, seen[0]).alias("lo"),
        ruled.when(some, F.element_at(seen, -1)).alias("hi"),
        F.when(ended, 0.0).when(some, F.element_at(seen, -1) - seen[0]).alias("steep"),
        F.when(ended, 0.0).when(some, spread).alias("spread"),
        F.when(ended, 0).otherwise(F.size(lines)).alias("n_pv"),
        F.when(ended, terminal).when(some, "").otherwise("no_pv").alias("terminal"),
    ]


def successor_lines(lines: Column, terminal: Column, most: int = 5) -> list[Column]:
    """mv_1, wp_self_1, ...: every line of what a move leads to, as its mover sees it; null beyond the last and at terminal positions."""
    out = []
    for k in range(1, most + 1):
        there = ~F.coalesce(terminal.isin("checkmate", "draw"), F.lit(False)) & (F.size(lines) >= k)
        out += [F.when(there, F.get(lines, F.lit(k - 1))["move"]).alias(f"mv_{k}"), F.when(there, _others(F.get(lines, F.lit(k - 1)))).alias(f"wp_self_{k}")]
    return out
