"""Ranks and order statistics of groups of any size: no task sorts a group, and no buffer holds its distinct values.

*Ranks*: rows are dealt to ranges by sampled splitters of (keys, order), so that a group with a third of all rows
lies in as many ranges as its share asks for; each range is sorted by its own task and staged with the
place of each row.  A group's rows in the ranges before it, a prefix sum over one count a range and group, turn places into ranks.

*Order statistics*: a bounded sketch a group names two splitters around each wanted rank; one pass counts
rows in the open intervals between splitters and at the splitters themselves.  A rank that falls on a splitter
is found, however many rows are tied there; else only the rows of its interval are left, and the next round narrows that down.  Sketches only
propose splitters: what is returned follows from exact counts.  The last rows, ``most`` of an interval at most, are ranked.

*Weighted ranks*: where a row stands for several copies, another number of them in each of several lanes (the draws of a bootstrap), rows are sorted once for all lanes and
never copied.  A range's task sums the weights along its rows; the sums of ranges, and of the runs of equal rows at their two ends, make places in a range into ranks among all copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.sources.staging import discarded, staged

#: Rows of a small table that may be broadcast.  Beyond it, it is dealt to salts.
SMALL = 100_000
_IN_RANGE = 33  # bits that monotonically_increasing_id() counts rows of a partition with


def attach(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Joins a table with one row a key, nulls equal: sent to all tasks if it has SMALL rows at most, else to ``salts`` places, so that rows of a hot key meet it in several tasks."""
    named = small.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(named[f"__k{i}"])
    if not keys or small.limit(SMALL + 1).count() <= SMALL:
        return df.join(F.broadcast(named), same, how).drop(*[f"__k{i}" for i in range(len(keys))])
    left = df.withColumn("__salt_a", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = named.withColumn("__salt_b", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = left["__salt_a"] == right["__salt_b"]
    for i, k in enumerate(keys):
        same = same & left[k].eqNullSafe(right[f"__k{i}"])
    return left.join(right, same, how).drop("__salt_a", "__salt_b", *[f"__k{i}" for i in range(len(keys))])


def global_rank(df: DataFrame, keys: list[str], order: list[str], name: str, ties: str = "ordinal", then: list[str] | None = None, descending: bool = False, ranges: int | None = None, without: list[str] | None = None) -> DataFrame:
    """Adds ``name``, each row's rank from 1 in its group.

    ``ties`` is "ordinal" (rows equal in ``order`` go by ``then``, those equal in that too in any order) or "average" (a double: equal rows share the mean of their ranks).  Nulls
    are a group of their own as keys, and come first as values (last, if descending).  The rows are returned staged, without the columns ``without`` (of ordinal ranks, the order may be among them).
    """
    if ties not in ("ordinal", "average"):
        raise ValueError(f"no such ties: {ties}")
    spark = df.sparkSession
    way = F.desc_nulls_last if descending else F.asc_nulls_first
    # The last column spreads rows that are equal in all others over ranges, too.
    by = [*[F.asc_nulls_first(k) for k in keys], *[way(c) for c in order], *[F.asc_nulls_first(c) for c in (then or [])], F.asc("__in")]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__in", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = staged(dealt.drop("__in", *(without or [])).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("__range", F.shiftright("__at", _IN_RANGE))
    cells = rows.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = cells.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = attach(rows, starts, [*keys, "__range"]).withColumn(name, F.col("__start") + F.col("__at") - F.col("__first") + 1).drop("__start", "__first")
    if ties == "ordinal":
        return ranked.drop("__at", "__range")
    # Equal rows stand side by side: within a range a window finds the run's ends; only the last run of a range goes on in the next.
    run = Window.partitionBy("__range", *keys, *order)
    cells = ranked.groupBy("__range", *keys, *order).agg(F.min(name).alias("__low"), F.max(name).alias("__high"))
    spread = cells.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("__c"), F.min("__low").alias("__lowest"), F.max("__high").alias("__highest")).filter("__c > 1").drop("__c")
    local = ranked.withColumns({"__low": F.min(name).over(run), "__high": F.max(name).over(run)})
    both = attach(local, spread, [*keys, *order], "left")
    mean = (F.coalesce("__lowest", "__low") + F.coalesce("__highest", "__high")) / 2
    return both.withColumn(name, mean).drop("__at", "__range", "__low", "__high", "__lowest", "__highest")


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: Callable[[Column], Column], near: list[float], most: int = 200_000, accuracy: int = 10_000) -> DataFrame:
    """keys, n, rank, value, below, equal: the values at some ranks (from 0, ascending) of each group, with the rows below and at the value.

    ``wanted`` makes the array of ranks of a group from its size; ``near`` says about where they lie, as shares, for the first round.
    Null and NaN values don't count.  Values are doubles.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    step = 2 / accuracy
    shares = sorted({min(1.0, max(0.0, p + d)) for p in near for d in (-step, step)})
    targets, group, found = None, list(keys), []
    while True:
        sketch = rows.groupBy(*group).agg(F.percentile_approx("__v", F.array(*[F.lit(p) for p in shares]), accuracy).alias("__s"), F.count(F.lit(1)).alias("__n"))
        sketch = staged(sketch.withColumn("__s", F.array_sort(F.array_distinct("__s"))), "splitters")
        if targets is None:
            targets = sketch.select(*keys, F.col("__n").alias("n"), F.explode(F.array_distinct(wanted(F.col("__n")))).alias("rank")).filter("rank >= 0 and rank < n")
            targets = targets.withColumns({"__left": F.col("rank"), "__low": F.lit(0).cast("long")})
        # Odd places are splitters, even ones the intervals before, between and behind them.
        split = attach(rows, sketch.drop("__n"), group)
        inside = F.size(F.filter("__s", lambda s: s < F.col("__v")))
        place = split.withColumn("__p", 2 * inside + F.array_contains("__s", F.col("__v")).cast("int"))
        counts = place.groupBy(*group, "__p").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__v"))
        before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a splitter and interval
        counts = counts.withColumn("__b", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        asked, others = targets.alias("t"), counts.withColumnsRenamed({k: f"__g{i}" for i, k in enumerate(group)})
        same = F.lit(True)
        for i, k in enumerate(group):
            same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"__g{i}"))
        hit = asked.join(others, same & (F.col("__left") >= F.col("__b")) & (F.col("__left") < F.col("__b") + F.col("__c"))).drop(*[f"__g{i}" for i in range(len(group))])
        hit = staged(hit, "found")
        exact = (F.pmod("__p", F.lit(2)) == 1) | (F.col("__c") == 1)
        found.append(hit.filter(exact).select(*keys, "n", "rank", F.col("__v").alias("value"), (F.col("__low") + F.col("__b")).alias("below"), F.col("__c").alias("equal")))
        open_ = hit.filter(~exact)
        largest = open_.agg(F.max("__c")).first()[0]
        if largest is None:
            break
        # What is left: the rows of the intervals that still hold a wanted rank.
        left = open_.select(*group, "__p").distinct()
        level = f"__p{len(group)}"
        rows = attach(place.drop("__s"), left.withColumn("__hit", F.lit(True)), [*group, "__p"]).drop("__hit").withColumnRenamed("__p", level)
        targets = open_.select(*keys, *[g for g in group if g not in keys], F.col("__p").alias(level), "n", "rank", (F.col("__left") - F.col("__b")).alias("__left"), (F.col("__low") + F.col("__b")).alias("__low"))
        group = [*group, level]
        if largest <= most:
            w = Window.partitionBy(*group)  # at most `most` rows
            last = rows.withColumns({"__i": F.row_number().over(w.orderBy("__v")) - 1, "__b": F.rank().over(w.orderBy("__v")) - 1, "__c": F.count(F.lit(1)).over(Window.partitionBy(*group, "__v"))})
            others = last.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__v", "__i", "__b", "__c")
            same = F.col("t.__left") == F.col("__i")
            for i, g in enumerate(group):
                same = same & F.col(f"t.{g}").eqNullSafe(F.col(f"__g{i}"))
            found.append(targets.alias("t").join(others, same).select(*[F.col(f"t.{k}") for k in keys], "n", "rank", F.col("__v").alias("value"), (F.col("__low") + F.col("__b")).alias("below"), F.col("__c").alias("equal")))
            break
        rows = staged(rows, "intervals")
        shares = [i / 64 for i in range(65)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], name: str = "q", **options) -> DataFrame:
    """keys, n, ``name``: exact quantiles with linear interpolation, all of a list in the same rounds.  Groups without a value are left out; of no keys, there is one row, with nulls if there are no values."""
    if not all(0 <= p <= 1 for p in at):
        raise ValueError("quantiles lie between 0 and 1")
    shares = F.array(*[F.lit(float(p)) for p in at])
    wanted = lambda n: F.flatten(F.transform(shares, lambda p: F.array(F.floor((n - 1) * p).cast("long"), F.ceil((n - 1) * p).cast("long"))))
    found = order_statistics(df, keys, value, wanted, at, **options)
    values = found.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__m"))  # two ranks a quantile
    n, m = F.col("n"), F.col("__m")

    def between(p: Column) -> Column:
        at = (n - 1) * p
        low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
        # Between equal values weights that don't add up to 1 would miss the value by its last bit.
        return F.when((low == high) | (m[low] == m[high]), m[low]).otherwise((high - at) * m[low] + (at - low) * m[high])

    return values.select(*keys, "n", F.when(n > 0, F.transform(F.array(*[F.lit(float(p)) for p in at]), between)).alias(name))


def _in_ranges(df: DataFrame, by: str, ranges: int) -> DataFrame:
    """Rows dealt to ranges by a column and sorted there; equal rows are spread over ranges, too."""
    order = [F.asc_nulls_first(by), F.asc("__in")]
    return df.withColumn("__in", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("__in")


def _matrix(column: pa.Array, lanes: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, lanes)


def _places(values: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a range's sorted rows: the copies before each row's run of equal rows plus those up to its end, by lane, and the edge: 1 in the first run, 2 in the last, else 0."""
    n = len(values)
    differs = pc.not_equal(values[1:], values[:-1])
    if pa.types.is_floating(values.type):
        differs = pc.and_not(differs, pc.and_(pc.is_nan(values[1:]), pc.is_nan(values[:-1])))
    starts = np.concatenate([[0], np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1])
    lengths = np.diff(np.append(starts, n))
    upto = np.cumsum(weights, axis=0, dtype=np.int64)[starts + lengths - 1]
    before = np.vstack([np.zeros((1, weights.shape[1]), np.int64), upto[:-1]])
    edge = np.zeros(len(starts), np.int8)
    edge[-1], edge[0] = 2, 1
    return np.repeat(before + upto, lengths, axis=0), np.repeat(edge, lengths)


def _shifts(cells: list[tuple], lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """All copies by lane, and what makes the places of a range's edge into places among all rows, at 3 x range + edge.

    A cell is (range, edge, value, copies by lane): three a range at most.  A run of equal rows may go on through many ranges.
    """
    cells = sorted(cells, key=lambda c: (c[0], (1, 0, 2).index(c[1])))
    out = np.zeros((3 * (max((c[0] for c in cells), default=0) + 1), lanes), np.int64)
    total, start, run = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), []
    same = lambda x, y: x == y or (x != x and y != y)  # noqa: E731 - NaN equals NaN

    def close() -> None:
        """Rows of a run have the copies before its first cell and those up to the end of its last."""
        for at, own, _ in run:
            out[at] = run[0][2] + total - own

    for i, (range_, edge, value, copies) in enumerate(cells):
        copies = np.array(copies, np.int64)
        if i == 0 or cells[i - 1][0] != range_:
            start = total
        if run and not (edge and same(value, last)):
            close()
            run = []
        if edge:
            run.append((3 * range_ + edge, 2 * (total - start) + copies, total))
            last = value
        else:
            out[3 * range_] = 2 * start
        total = total + copies
    close()
    return total, out


def weighted_rank_correlations(df: DataFrame, a: str, b: str, weights: str, lanes: int, rows_a_range: int = 100_000) -> list[float | None]:
    """Spearman with average ranks in each lane, where lane i has ``weights``[i] copies of each row; None where a lane has no copies, or no two different values.

    Two sorts of the rows whatever the lanes: by a (staged, with the places), then by b, whose ranges return only sums.  Ranges are as many as the rows ask for, so that a task's
    arrays are bounded; the driver gets three cells a range.
    """
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("__a"), F.col(b).alias("__b"), F.col(weights).cast("array<long>").alias("__w"))
    ranges = max(1, -(-rows.count() // rows_a_range))
    kind = rows.schema["__b"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        column = lambda name: t[name].combine_chunks()
        places, edge = _places(column("__a"), _matrix(column("__w"), lanes))
        ids = pa.array(3 * TaskContext.get().partitionId() + edge.astype(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, places.size + 1, lanes, dtype=np.int32)), pa.array(places.ravel()))
        yield from pa.table({"__a": t["__a"], "__b": t["__b"], "__w": t["__w"], "__cell": ids, "__place": lists}).to_batches(10_000)

    first = rows.schema["__a"].dataType.simpleString()
    placed = staged(_in_ranges(rows, "__a", ranges).mapInArrow(place, f"__a {first}, __b {kind}, __w array<long>, __cell long, __place array<long>"), "places")
    sums = placed.groupBy("__cell").agg(F.first("__a").alias("value"), F.array(*[F.sum(F.col("__w")[i]) for i in range(lanes)]).alias("copies"))
    total, shifts = _shifts([(r["__cell"] // 3, r["__cell"] % 3, r["value"], r["copies"]) for r in sums.collect()], lanes)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        column = lambda name: t[name].combine_chunks()
        w = _matrix(column("__w"), lanes)
        y, edge = _places(column("__b"), w)
        # Twice the rank less twice the mean rank; of b, what its cell adds is known only when all ranges are through.
        x = (_matrix(column("__place"), lanes) + shifts[column("__cell").to_numpy()] - total).astype(float)
        out = []
        for e in np.unique(edge):
            i = edge == e
            ww, xx, yy = w[i], x[i], y[i].astype(float)
            ends = {"low": np.where(ww > 0, y[i], np.iinfo(np.int64).max).min(0), "high": np.where(ww > 0, y[i], -1).max(0), "copies": ww.sum(0)}
            out.append({"range": TaskContext.get().partitionId(), "edge": int(e), "value": t["__b"][int(np.argmax(i))].as_py()} | {k: v.tolist() for k, v in ends.items()} | {k: v.sum(0).tolist() for k, v in (("x", ww * xx), ("y", ww * yy), ("xx", ww * xx * xx), ("yy", ww * yy * yy), ("xy", ww * xx * yy))})
        yield from pa.Table.from_pylist(out, pa.schema([("range", pa.int64()), ("edge", pa.int64()), ("value", t["__b"].type), *[(k, pa.list_(pa.int64())) for k in ("low", "high", "copies")], *[(k, pa.list_(pa.float64())) for k in ("x", "y", "xx", "yy", "xy")]])).to_batches()

    found = _in_ranges(placed.drop("__a"), "__b", ranges).mapInArrow(moments, f"range long, edge long, value {kind}, low array<long>, high array<long>, copies array<long>, x array<double>, y array<double>, xx array<double>, yy array<double>, xy array<double>").collect()
    discarded(placed)
    _, shifts_b = _shifts([(r["range"], r["edge"], r["value"], r["copies"]) for r in found], lanes)
    sxx, syy, sxy = (np.zeros(lanes) for _ in range(3))
    varied = np.zeros(lanes, bool)  # some copy isn't at the mean rank; by whole numbers, as sums of squares are rounded
    for r in found:
        s = shifts_b[3 * r["range"] + r["edge"]] - total
        varied |= (np.array(r["copies"]) > 0) & ((np.array(r["low"]) != -s) | (np.array(r["high"]) != -s))
        s = s.astype(float)
        n, x, y, xx, yy, xy = (np.array(r[k], float) for k in ("copies", "x", "y", "xx", "yy", "xy"))
        sxx, syy, sxy = sxx + xx, syy + yy + 2 * s * y + s * s * n, sxy + xy + s * x
    return [float(c / np.sqrt(p * q)) if p > 0 and v else None for p, q, c, v in zip(sxx, syy, sxy, varied, strict=True)]
