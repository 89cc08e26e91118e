"""Mixed models by restricted maximum likelihood: intercepts of ``inner`` units, and of ``outer`` units around them.

With ratios p (outer) and q (inner) of the variances to the residual's, the inverse of an outer unit's block needs
sums only.  An inner unit of n rows with column sums s (of the constant, the columns and the outcome) gives s e and n e, e = 1 / (1 + q n), to
its outer unit; the outer unit's totals t and w take p t t' / (1 + p w) off.  So the moments

    M(p, q) = Z' V^-1 Z, Z = [1 X y], and log |V|,

are sums over units, and so are their first and second derivatives.  The restricted likelihood with coefficients and
residual variance profiled out, its gradient and its information follow from them by arithmetic on a few numbers: a Newton step is one job over unit
sums, whatever the rows.

*Lanes* go side by side: a bootstrap draw is a lane that counts each inner unit as often as it is drawn (copies are units of
their own), a start of a search is a lane, and one job serves all of them by matrix products (lanes x units).

Unit sums are staged in blocks, whole outer units where they fit.  An outer unit that is larger than a block, even one with a third of all
rows, is dealt to several; its totals meet by its key in a second step.  The driver gets lanes x k x k numbers.

A block holds an inner unit's counts, a byte a draw, once, however many outer units that inner one lies in.  Where all blocks' counts would still take more than _COUNTS_A_UNIT
bytes a unit, draws are taken in portions, one after the other, so that what is staged grows with the units.  Weights depend on an inner unit's number of rows only: units of an outer
one with equal numbers are a cell, whose sums are made first.  A cell's sums in a draw don't depend on the ratios: where cells are far fewer than units, a bootstrap stages them once, by block and
_LANES_A_ROW draws, and its steps read cells, and of these only the draws that go on.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidelake.operators.estimators import draw_counts
from tidelake.sources.staging import discarded, new_path, staged

#: Logarithms of ratios stay between these; a variance that wants to be 0 stays at the lower one.
LOW, HIGH = math.log(1e-8), math.log(1e4)
#: Where searches start: ratios of the outer and the inner variance.
STARTS = {"even": (0.1, 0.1), "outer": (1.0, 0.01), "inner": (0.01, 1.0), "large": (5.0, 5.0), "small": (1e-3, 1e-3)}
_BLOCK = "block long, key string, starts binary, sums binary, place binary"
_WEIGHED = f"{_BLOCK}, counts binary"
_SUMMED = "key string, n binary, inner binary, m binary, at binary, outer binary, first int"
_PART = "kind int, key string, lane int, data array<double>"
_LANES_A_ROW = 64
#: Bytes of staged counts a unit that a portion of draws may take; units that are weighed at a time; units a cell from which cells are staged.
_COUNTS_A_UNIT, _PIECE, _UNITS_A_CELL = 128, 1024, 8
#: Bytes of cells' sums that a portion may take in any case: few units go in one portion.
_CELLS_AT_LEAST = 200_000_000


@dataclass
class Point:
    """A lane's moments at its ratios, and what follows."""

    ll: float
    gradient: np.ndarray
    hessian: np.ndarray
    beta: np.ndarray
    cov: np.ndarray
    s2: float


@dataclass
class Lane:
    """Where a search stands."""

    at: np.ndarray
    point: Point
    iterations: int
    converged: bool


def _cell_sums(counts: np.ndarray, place: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lanes x cells x columns: sums of ``values`` (entries x columns), weighed by ``counts`` (inner units x lanes) of the inner unit in ``place``, over the cells that begin at ``starts``."""
    cuts = np.union1d(starts, np.arange(0, len(place), _PIECE))
    parts = np.empty((len(cuts), values.shape[1], counts.shape[1]))
    edges = [*np.searchsorted(cuts, np.arange(0, len(place), _PIECE)), len(cuts)]
    for a, b in pairwise(edges):
        low, high = cuts[a], cuts[b] if b < len(cuts) else len(place)
        own, at = counts.take(place[low:high], axis=0), cuts[a:b] - low
        if len(own) >= 8 * len(at):
            for j, (i, k) in enumerate(pairwise([*at, len(own)])):
                np.dot(values[low + i : low + k].T, own[i:k], out=parts[a + j])
        else:
            for c in range(values.shape[1]):
                np.add.reduceat(own * values[low:high, c, None], at, axis=0, out=parts[a:b, c])
    return (parts if len(cuts) == len(starts) else np.add.reduceat(parts, np.searchsorted(cuts, starts), axis=0)).transpose(2, 0, 1)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


class _InnerCells:
    """Inner units of a block by number of rows and inner unit: what M and log |V| need of them."""

    def __init__(self, sums: np.ndarray, place: np.ndarray) -> None:
        k = sums.shape[1]
        self.at = np.triu_indices(k)
        order = np.lexsort((place, sums[:, 0]))
        s, n = sums[order], sums[order, 0]
        own = _changes(n, place[order])
        values = np.concatenate([np.ones((len(s), 1)), s[:, self.at[0]] * s[:, self.at[1]]], 1)
        self.values, self.place = np.add.reduceat(values, own, axis=0), place[order][own]
        self.starts = _changes(n[own])
        self.n, self.k = n[own][self.starts], k

    def moments(self, counts: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By lane: their part of M and of log |V|, with two derivatives by q."""
        return _inner_moments(_cell_sums(counts, self.place, self.values, self.starts), self.n, q, self.k)


def _inner_moments(found: np.ndarray, n: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """_InnerCells.moments() from the cells' sums."""
    at, units, pairs = np.triu_indices(k), found[:, :, 0], found[:, :, 1:]
    d = 1 + np.outer(q, n)
    e = 1 / d
    full = np.empty((len(q), 3, k, k))
    for j, w in enumerate((q[:, None] * e, e**2, -2 * n * e**3)):
        full[:, j, at[0], at[1]] = full[:, j, at[1], at[0]] = np.einsum("lc,lcp->lp", w, pairs)
    logs = np.stack([(units * np.log(d)).sum(1), (units * e * n).sum(1), -(units * n**2 * e**2).sum(1)], 1)
    return full.reshape(len(q), -1), logs


def _outer_cells(counts: np.ndarray, sums: np.ndarray, place: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums (lanes x cells x k) of the units of each outer one by number of rows, these numbers, and the first cell of each outer unit."""
    outer = np.zeros(len(sums), np.int64)
    outer[starts] = 1
    cells = _changes(np.cumsum(outer), sums[:, 0])
    n = sums[cells, 0]
    found = _cell_sums(counts, place, np.concatenate([np.ones((len(sums), 1)), sums[:, 1:]], 1), cells)
    found[:, :, 0] *= n  # the first column is the number of rows
    return found, n, np.searchsorted(cells, starts)


def _cell_totals(found: np.ndarray, n: np.ndarray, at: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """t, t' and t'' (lanes x outer x k) from the cells."""
    e = 1 / (1 + np.outer(q, n))
    return [np.add.reduceat(w[:, :, None] * found, at, axis=1) for w in (e, -n * e**2, 2 * n**2 * e**3)]


def _outer_totals(counts: np.ndarray, q: np.ndarray, sums: np.ndarray, place: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """t, t' and t'' (lanes x outer x k) of the outer units that begin at ``starts``; the units of each are in order of their number of rows."""
    return _cell_totals(*_outer_cells(counts, sums, place, starts), q)


def _outer_sums(t: np.ndarray, t1: np.ndarray, t2: np.ndarray, p: np.ndarray) -> np.ndarray:
    """By lane: what outer units (lanes x outer x k totals and their derivatives by q) take off M, and add to log |V|, with derivatives: O, O_p, O_q, O_pp, O_pq, O_qq, then six logs."""
    lanes, _, k = t.shape
    w, w1, w2, p = t[:, :, 0], t1[:, :, 0], t2[:, :, 0], p[:, None]
    d = 1 + p * w
    cross = lambda c, a, b: np.matmul((c[:, :, None] * a).transpose(0, 2, 1), b)
    both = lambda c, a, b: cross(c, a, b) + cross(c, b, a)
    b, bp, bw = p / d, 1 / d**2, -(p**2) / d**2
    bpp, bpw, bww = -2 * w / d**3, -2 * p / d**3, 2 * p**3 / d**3
    out = [
        cross(b, t, t), cross(bp, t, t), cross(bw * w1, t, t) + both(b, t1, t), cross(bpp, t, t), cross(bpw * w1, t, t) + both(bp, t1, t),
        cross(bww * w1**2 + bw * w2, t, t) + 2 * both(bw * w1, t1, t) + both(b, t2, t) + 2 * cross(b, t1, t1),
    ]
    logs = [np.log(d), w / d, p * w1 / d, -(w**2) / d**2, w1 / d**2, p * w2 / d - p**2 * w1**2 / d**2]
    return np.concatenate([x.reshape(lanes, k * k) for x in out] + [np.stack([x.sum(1) for x in logs], 1)], 1)


class RestrictedLikelihood:
    """Unit sums of a table, and the restricted likelihood of any number of lanes at once."""

    def __init__(self, df: DataFrame, y: str, x: list[str], inner: str, outer: str | None = None, most: int = 8_000_000) -> None:
        """``most`` bounds a block's units times lanes of a step (or numbers of a unit's own matrix)."""
        df = df.dropna(subset=[y, *x, inner, *([outer] if outer else [])])
        self.spark, self.terms, self.nested, self.draws = df.sparkSession, ["const", *x], outer is not None, 1
        cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
        self.k, self.pairs = len(cols), list(combinations_with_replacement(range(len(cols)), 2))
        # An inner unit within two outer ones is two units.
        keys = [F.col(inner).alias("__inner"), *([F.col(outer).alias("__outer")] if outer else [])]
        units = df.groupBy(*keys).agg(F.array(*[F.sum(c) for c in cols]).alias("s"), F.array(*[F.sum(cols[i] * cols[j]) for i, j in self.pairs]).alias("g"))
        self.units = staged(units, "unit-sums")
        self.whole, self.rows = self._totals(self.units.withColumns({"draw": F.lit(0), "cnt": F.lit(1)}))
        self.blocks = staged(self._in_blocks(max(1, most // max(_LANES_A_ROW, self.k**2))), "unit-blocks")

    def _totals(self, weighed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """By draw: Z'Z, and the number of rows."""
        found = weighed.groupBy("draw").agg(*[F.sum(F.col("cnt") * F.col("g")[i]).alias(f"g{i}") for i in range(len(self.pairs))]).collect()  # a row a draw
        whole = np.zeros((self.draws, self.k, self.k))
        for r in found:
            for a, (i, j) in enumerate(self.pairs):
                whole[r["draw"], i, j] = whole[r["draw"], j, i] = r[f"g{a}"]
        return whole, whole[:, 0, 0].copy()

    def _in_blocks(self, most: int) -> DataFrame:
        """Outer units in their order, about ``most`` inner ones a block; one that alone has more is dealt to several, with its key."""
        k, nested, units, n = self.k, self.nested, self.units.drop("g"), self.units.count()
        if nested:
            units = units.withColumn("__key", F.to_json(F.struct("__outer")))
            # Outer units of more than `most` inner units: fewer than units / most.
            large = units.groupBy("__key").agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") > most).withColumn("__salts", F.ceil(F.col("__c") / most).cast("long")).drop("__c")
            units = units.join(F.broadcast(large), "__key", "left")
            salt = F.pmod(F.xxhash64("__inner"), F.coalesce("__salts", F.lit(1).cast("long")))
        else:
            units = units.withColumns({"__key": F.lit(None).cast("string"), "__salts": F.lit(None).cast("long")})
            salt = F.pmod(F.xxhash64("__inner"), F.lit(1 << 20).cast("long"))
        parts = max(1, -(-n // most), min(self.spark.sparkContext.defaultParallelism, n // 2000))
        dealt = units.withColumn("__salt", salt).repartitionByRange(parts, *(["__outer"] if nested else []), "__salt")

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A partition, about ``most`` units, is a block; the parts of outer units that are dealt to several are blocks of their own."""
            table = pa.Table.from_batches(batches, arrow)
            if not table.num_rows:
                return
            code = lambda c: table.column(c).combine_chunks().fill_null(-1 if c != "__key" else "").dictionary_encode().indices.to_numpy()
            keys, salts, apart = code("__key"), code("__salt"), table.column("__salts").is_valid().to_numpy()
            sums, inners = table.column("s").combine_chunks().flatten().to_numpy().reshape(-1, k), table.column("__inner").combine_chunks()
            groups, own = [np.flatnonzero(~apart)], np.flatnonzero(apart)
            if len(own):
                own = own[np.lexsort((salts[own], keys[own]))]
                groups += np.split(own, _changes(keys[own], salts[own])[1:])
            first = TaskContext.get().partitionId() << 33
            for i, at in enumerate(groups):
                if len(at):
                    at = at[np.lexsort((sums[at, 0], keys[at]))]
                    names = inners.take(pa.array(at)).dictionary_encode()
                    key = table.column("__key")[at[0]].as_py() if i else None
                    row = [[first + i], [key], [_changes(keys[at]).astype(np.int32).tobytes()], [sums[at].tobytes()], [names.indices.to_numpy().astype(np.int32).tobytes()]]
                    columns = [pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
                    listed = pa.ListArray.from_arrays(pa.array([0, len(names.dictionary)], pa.int32()), names.dictionary)
                    yield pa.RecordBatch.from_arrays([*columns, listed], names=["block", "key", "starts", "sums", "place", "inners"])

        dealt = dealt.select("__key", "__salt", "__salts", "s", "__inner")
        arrow = to_arrow_schema(dealt.schema)
        return dealt.mapInArrow(block, f"{_BLOCK}, inners array<{dict(dealt.dtypes)['__inner']}>")

    def portion(self, draws: int, cells: int = 0) -> int:
        """How many draws may be weighed at a time."""
        size = self.blocks.agg(F.sum(F.size("inners")).alias("entries"), F.sum(F.length("place") / 4).alias("units")).first()
        by_cells, units = self.by_cells(cells), size["units"] or 0
        most = max(_COUNTS_A_UNIT * units, _CELLS_AT_LEAST if by_cells else 0)
        return max(1, min(draws, max(_LANES_A_ROW, int(most // max(1, size["entries"] or 0, 8 * self.k * cells if by_cells else 0)))))

    def cells(self) -> int:
        """Outer units by number of rows of their inner ones."""
        return self.units.select("__outer", F.col("s")[0]).distinct().count() if self.nested else 0

    def by_cells(self, cells: int) -> bool:
        return 0 < cells * _UNITS_A_CELL <= self.units.count()

    def drawn(self, counts: DataFrame, draws: int, by_cells: bool = False) -> RestrictedLikelihood:
        """The likelihood that counts inner units (``__inner``, ``draw`` from 0, ``cnt``) in ``draws`` draws; ``by_cells``, its blocks hold the cells' sums in each draw, not units and counts."""
        new = copy.copy(self)
        new.draws = draws
        grams = self.units.groupBy("__inner").agg(F.array(*[F.sum(F.col("g")[i]) for i in range(len(self.pairs))]).alias("g"))
        new.whole, new.rows = new._totals(counts.join(grams, "__inner"))

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d, c = batch.column(1), batch.column(2)
                ends, d, c = np.cumsum([0, *np.asarray(d.value_lengths())]), np.asarray(d.flatten()), np.asarray(c.flatten())
                rows = []
                for a, b in pairwise(ends):
                    row = np.zeros(draws, np.uint8 if c[a:b].max() < 256 else np.uint32)
                    row[d[a:b]] = c[a:b]
                    rows.append(row.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["__inner", "counts"])

        listed = counts.groupBy("__inner").agg(F.collect_list(F.col("draw").cast("int")).alias("d"), F.collect_list(F.col("cnt").cast("int")).alias("c"))  # an entry a draw at most
        rows = listed.mapInArrow(dense, f"__inner {dict(counts.dtypes)['__inner']}, counts binary")
        asked = self.blocks.select("block", F.posexplode("inners").alias("pos", "__inner")).join(rows, "__inner").select(F.col("block").alias("of"), "pos", "counts")

        k, summed = self.k, pa.schema([("key", pa.string()), *[(c, pa.binary()) for c in ("n", "inner", "m", "at", "outer")], ("first", pa.int32())])

        def weigh(block: pa.Table, found: pa.Table) -> pa.Table:
            m = len(block.column("inners")[0])
            each = [np.frombuffer(x.as_buffer(), np.uint8 if len(x.as_buffer()) == draws else np.uint32) for x in found.column("counts")]
            full = np.zeros((m, draws), np.uint32 if any(x.dtype != np.uint8 for x in each) else np.uint8)
            for p, x in zip(found.column("pos").to_pylist(), each, strict=True):
                full[p] = x
            if by_cells:
                starts, place, sums = (np.frombuffer(block.column(c)[0].as_py(), t) for c, t in (("starts", np.int32), ("place", np.int32), ("sums", np.float64)))
                sums, key, rows = sums.reshape(-1, k), block.column("key")[0].as_py(), []
                inner = _InnerCells(sums, place)
                for first in range(0, draws, _LANES_A_ROW):
                    weights = np.ascontiguousarray(full[:, first : first + _LANES_A_ROW], np.float64)
                    outer, n, at = _outer_cells(weights, sums, place, starts)
                    data = (inner.n, _cell_sums(weights, inner.place, inner.values, inner.starts), n, at.astype(np.int32), outer)
                    rows.append((key, *[np.ascontiguousarray(x).tobytes() for x in data], first))
                return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), summed.types, strict=True)], schema=summed)
            return block.drop_columns(["inners"]).append_column("counts", pa.array([np.ascontiguousarray(full.T).tobytes()], pa.binary()))

        tasks = 2 * max(self.blocks.count(), 1)
        left, right = self.blocks.repartition(tasks, "block"), asked.repartition(tasks, "of")
        weighed = left.groupBy("block").cogroup(right.groupBy("of")).applyInArrow(weigh, _SUMMED if by_cells else _WEIGHED)
        if by_cells:
            path = new_path(self.spark, "weighed-cells")
            weighed.write.partitionBy("first").parquet(path)
            new.blocks = self.spark.read.schema(weighed.schema).parquet(path)
        else:
            new.blocks = staged(weighed, "weighed-blocks")
        return new

    def moments(self, draw: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """By lane: the derivatives' sums; a lane counts units as draw ``draw`` does."""
        k, draws, nested = self.k, self.draws, self.nested
        lanes, wide = len(draw), 3 * k * k + 3 + 6 * k * k + 6

        def rows(kind: int, key: str | None, data: np.ndarray) -> Iterator[dict]:
            for a in range(0, len(data), _LANES_A_ROW):
                yield {"kind": kind, "key": key, "lane": a, "data": data[a : a + _LANES_A_ROW].ravel()}

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, open_ = np.zeros((lanes, wide)), []
            for batch in batches:
                for b in range(batch.num_rows):
                    key, starts, sums, place, counts = (batch.column(c)[b].as_py() for c in ("key", "starts", "sums", "place", "counts"))
                    starts, place, sums = np.frombuffer(starts, np.int32), np.frombuffer(place, np.int32), np.frombuffer(sums, np.float64).reshape(-1, k)
                    m = int(place.max()) + 1
                    if counts is not None:
                        counts = np.frombuffer(counts, np.uint8 if len(counts) == draws * m else np.uint32).reshape(draws, m)
                    inner = _InnerCells(sums, place)
                    # Outer units that begin within the same pieces are summed together.
                    runs = [*starts[_changes(starts // (8 * _PIECE))], len(sums)]
                    for c in range(0, lanes, _LANES_A_ROW):
                        own = slice(c, c + _LANES_A_ROW)
                        weights = np.ones((m, len(q[own]))) if counts is None else np.ascontiguousarray(counts[draw[own]].T, np.float64)
                        total[own, : 3 * k * k + 3] += np.concatenate(inner.moments(weights, q[own]), 1)
                        if not nested:
                            continue
                        for low, high in pairwise(runs):
                            t = _outer_totals(weights, q[own], sums[low:high], place[low:high], starts[(starts >= low) & (starts < high)] - low)
                            if key is None:
                                total[own, 3 * k * k + 3 :] += _outer_sums(*t, p[own])
                            else:
                                open_.append({"kind": 1, "key": key, "lane": c, "data": np.concatenate([x.sum(1) for x in t], 1).ravel()})
            yield pa.RecordBatch.from_pylist([*rows(0, None, total), *open_], schema=schema)

        def add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, open_ = np.zeros((lanes, wide)), []
            for batch in batches:
                for b in range(batch.num_rows):
                    first, key = batch.column(6)[b].as_py(), batch.column(0)[b].as_py()
                    n, inner, m, at, outer = (np.frombuffer(batch.column(c)[b].as_buffer(), t) for c, t in zip(range(1, 6), (np.float64, np.float64, np.float64, np.int32, np.float64), strict=True))
                    # Lanes are in order of their draws, so a row's are neighbours.
                    low, high = np.searchsorted(draw, [first, first + _LANES_A_ROW])
                    if low == high:
                        continue
                    own, each = slice(low, high), draw[low:high] - first
                    total[own, : 3 * k * k + 3] += np.concatenate(_inner_moments(inner.reshape(-1, len(n), 1 + k * (k + 1) // 2)[each], n, q[own], k), 1)
                    outer, runs = outer.reshape(-1, len(m), k), [*range(0, len(at), _PIECE), len(at)]
                    for u, v in pairwise(runs):  # some outer units at a time
                        low_cell, high_cell = at[u], at[v] if v < len(at) else len(m)
                        t = _cell_totals(outer[each, low_cell:high_cell], m[low_cell:high_cell], at[u:v] - low_cell, q[own])
                        if key is None:
                            total[own, 3 * k * k + 3 :] += _outer_sums(*t, p[own])
                        else:
                            open_.append({"kind": 1, "key": key, "lane": int(low), "data": np.concatenate([x.sum(1) for x in t], 1).ravel()})
            yield pa.RecordBatch.from_pylist([*rows(0, None, total), *open_], schema=schema)

        schema = pa.schema([("kind", pa.int32()), ("key", pa.string()), ("lane", pa.int32()), ("data", pa.list_(pa.float64()))])

        def merge(table: pa.Table) -> pa.Table:
            kind, key, lane = (table.column(c)[0].as_py() for c in ("kind", "key", "lane"))
            data = np.sum([np.asarray(x.values) for x in table.column("data")], 0)
            if kind == 1:  # an outer unit whose parts are now together
                own = p[lane : lane + len(data) // (3 * k)]
                t = data.reshape(len(own), 3, 1, k)
                full = np.zeros((len(own), wide))
                full[:, 3 * k * k + 3 :] = _outer_sums(t[:, 0], t[:, 1], t[:, 2], own)
                kind, key, data = 2, None, full.ravel()
            return pa.Table.from_pylist([{"kind": kind, "key": key, "lane": lane, "data": data}], schema=schema)

        if "outer" in self.blocks.columns:
            asked = sorted({int(d) // _LANES_A_ROW * _LANES_A_ROW for d in draw})
            parts = self.blocks.filter(F.col("first").isin(asked)).select("key", "n", "inner", "m", "at", "outer", "first").mapInArrow(add_cells, _PART)
        else:
            blocks = self.blocks if "counts" in self.blocks.columns else self.blocks.withColumn("counts", F.lit(None).cast("binary"))
            parts = blocks.select("key", "starts", "sums", "place", "counts").mapInArrow(add, _PART)
        if nested:
            parts = parts.groupBy("kind", "key", "lane").applyInArrow(merge, _PART)
        out = np.zeros((lanes, wide))
        for r in parts.groupBy("kind", "key", "lane").applyInArrow(merge, _PART).collect():  # lanes x wide numbers
            own = np.array(r["data"]).reshape(-1, wide)
            out[r["lane"] : r["lane"] + len(own)] += own
        return out

    def at(self, draw: np.ndarray, logs: np.ndarray) -> list[Point]:
        """The restricted likelihood of each lane at its logarithms of ratios (columns: outer, inner), with gradient and second derivatives by them."""
        p, q = (np.exp(logs[:, 0]) if self.nested else np.zeros(len(logs))), np.exp(logs[:, 1])
        found, k2, out = self.moments(draw, p, q), self.k * self.k, []
        for lane, row in enumerate(found):
            mats = lambda a, n, row=row: row[a : a + n * k2].reshape(n, self.k, self.k)
            a, a1, a2 = mats(0, 3)
            la, la1, la2 = row[3 * k2 : 3 * k2 + 3]
            o, op, oq, opp, opq, oqq = mats(3 * k2 + 3, 6)
            lo, lop, loq, lopp, lopq, loqq = row[-6:]
            m = self.whole[draw[lane]] - a - o
            first, second = [-op, -(a1 + oq)], [[-opp, -opq], [-opq, -(a2 + oqq)]]
            out.append(_point(m, first, second, la + lo, [lop, la1 + loq], [[lopp, lopq], [lopq, la2 + loqq]], self.rows[draw[lane]], (p[lane], q[lane])))
        return out


def _point(m: np.ndarray, first: list, second: list, log: float, log1: list, log2: list, n: float, ratios: tuple[float, float]) -> Point:
    """Profiles coefficients and residual variance out; derivatives by the ratios' logarithms."""
    inv = np.linalg.pinv(m[:-1, :-1])
    beta = inv @ m[:-1, -1]
    v, free = np.append(-beta, 1.0), max(1.0, n - len(beta))
    rss = max(1e-300, float(v @ m @ v))
    ll = -0.5 * (free * (math.log(2 * math.pi * rss / free) + 1) + log + np.linalg.slogdet(m[:-1, :-1])[1])
    dr, dv = [float(v @ d @ v) for d in first], [(d @ v)[:-1] for d in first]
    dm = [inv @ d[:-1, :-1] for d in first]
    g = np.array([-0.5 * (free * dr[i] / rss + log1[i] + np.trace(dm[i])) for i in (0, 1)])
    h = np.empty((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            d2r = float(v @ second[i][j] @ v) - 2 * float(dv[i] @ inv @ dv[j])
            d2m = np.trace(inv @ second[i][j][:-1, :-1]) - np.trace(dm[i] @ dm[j])
            h[i, j] = -0.5 * (free * (d2r / rss - dr[i] * dr[j] / rss**2) + log2[i][j] + d2m)
    r = np.array(ratios)
    return Point(ll, g * r, h * np.outer(r, r) + np.diag(g * r), beta, inv * rss / free, rss / free)


def _step(at: np.ndarray, point: Point, free: np.ndarray) -> np.ndarray:
    """A Newton step uphill within the bounds: along directions in which the surface isn't concave, by the size of its curvature."""
    free = free & ~((at <= LOW) & (point.gradient <= 0)) & ~((at >= HIGH) & (point.gradient >= 0))
    step = np.zeros(2)
    if free.any():
        own = np.flatnonzero(free)
        values, vectors = np.linalg.eigh(point.hessian[np.ix_(own, own)])
        step[own] = vectors @ ((vectors.T @ point.gradient[own]) / np.maximum(np.abs(values), 1e-8))
        step *= min(1.0, 3.0 / max(1e-300, np.abs(step).max()))
    return np.clip(at + step, LOW, HIGH) - at


def maximised(likelihood: RestrictedLikelihood, draw: np.ndarray, starts: np.ndarray, most: int = 60, close: float = 1e-7) -> list[Lane]:
    """Newton's method in all lanes at once, a job a step; a step that doesn't gain is halved.  A lane has converged when its next step is smaller than ``close`` or the gain expected of it than that."""
    free = np.array([likelihood.nested, True])
    lanes = [Lane(a.copy(), b, 0, False) for a, b in zip(np.clip(starts, LOW, HIGH), likelihood.at(draw, np.clip(starts, LOW, HIGH)), strict=True)]
    steps = [_step(x.at, x.point, free) for x in lanes]
    for _ in range(most):
        for x, s in zip(lanes, steps, strict=True):
            x.converged = x.converged or bool(np.abs(s).max() < close or abs(float(x.point.gradient @ s)) < close * 1e-3)
        going = [i for i, x in enumerate(lanes) if not x.converged]
        if not going:
            break
        trial = np.array([lanes[i].at + steps[i] for i in going])
        for i, a, b in zip(going, trial, likelihood.at(draw[going], trial), strict=True):
            x = lanes[i]
            x.iterations += 1
            if b.ll >= x.point.ll - 1e-12 * abs(x.point.ll):
                x.at, x.point = a, b
                steps[i] = _step(a, b, free)
            else:
                steps[i] = steps[i] / 2
    return lanes


def _rows(likelihood: RestrictedLikelihood, lane: Lane) -> list[tuple]:
    """term, coef, se, and the rows of the deviations; a variance at the lower bound is 0."""
    point = lane.point
    rows = [(t, float(b), float(s)) for t, b, s in zip(likelihood.terms, point.beta, np.sqrt(np.maximum(np.diag(point.cov), 0)), strict=True)]
    sd = lambda k: math.sqrt(math.exp(lane.at[k]) * point.s2) if lane.at[k] > LOW else 0.0
    return rows + ([("sd_outer", sd(0), math.nan), ("sd_inner", sd(1), math.nan)] if likelihood.nested else [("sd_unit", sd(1), math.nan)]) + [("sd_residual", math.sqrt(point.s2), math.nan)]


_FIT = "term string, coef double, se double"


def _best(lanes: list[Lane]) -> Lane:
    return max(lanes, key=lambda x: (x.converged, round(x.point.ll, 6)))


def _starts(names: list[str]) -> np.ndarray:
    return np.log(np.array([STARTS[n] for n in names]))


def random_intercept(df: DataFrame, y: str, x: list[str], unit: str) -> DataFrame:
    """Random-intercept model by restricted likelihood: term, coef, se, and the rows sd_unit, sd_residual."""
    likelihood = RestrictedLikelihood(df, y, x, unit)
    names = ["inner", "small"]
    return df.sparkSession.createDataFrame(_rows(likelihood, _best(maximised(likelihood, np.zeros(len(names), int), _starts(names)))), _FIT)


def inner_only(df: DataFrame, y: str, x: list[str], outer: str, inner: str) -> DataFrame:
    """The older model with one variance only, that of the inner units within outer ones: term, coef, se, sd_unit, sd_residual."""
    return random_intercept(df.dropna(subset=[outer, inner]).withColumn("__unit", F.to_json(F.struct(outer, inner))), y, x, "__unit")


def nested_intercepts(df: DataFrame, y: str, x: list[str], outer: str, inner: str) -> DataFrame:
    """Model with intercepts of ``outer`` units and of ``inner`` units within them, by restricted likelihood from all starts: term, coef, se, and the rows sd_outer, sd_inner, sd_residual."""
    likelihood = RestrictedLikelihood(df, y, x, inner, outer)
    return df.sparkSession.createDataFrame(_rows(likelihood, _best(maximised(likelihood, np.zeros(len(STARTS), int), _starts([*STARTS])))), _FIT)


def search_sweep(df: DataFrame, y: str, x: list[str], outer: str, inner: str, least_rows: int = 50) -> tuple[DataFrame, DataFrame | None]:
    """Searches from every start, side by side: (method, converged, iterations, llf, degenerate, selected, status), and the selected one's term, coef, se.

    Degenerate is a fit without any variance between units whose constant is exactly 0.  Of those that converged and aren't, the largest likelihood
    is selected, the first of equal ones; where there is none, the status says why and there is no fit.
    """
    spark = df.sparkSession
    kind = "method string, converged boolean, iterations int, llf double, degenerate boolean, selected boolean, status string"
    likelihood = RestrictedLikelihood(df, y, x, inner, outer)
    if likelihood.rows[0] < least_rows:
        return spark.createDataFrame([(m, None, None, None, None, False, f"fewer than {least_rows} rows") for m in STARTS], kind), None
    lanes = dict(zip(STARTS, maximised(likelihood, np.zeros(len(STARTS), int), _starts([*STARTS])), strict=True))
    degenerate = {m: bool(x.at.max() <= LOW and x.point.beta[0] == 0.0) for m, x in lanes.items()}
    ok = [m for m, x in lanes.items() if x.converged and not degenerate[m] and math.isfinite(x.point.ll)]
    status = "ok" if ok else "only degenerate converged fit" if any(x.converged for x in lanes.values()) else "no converged fit"
    chosen = max(ok, key=lambda m: round(lanes[m].point.ll, 6)) if ok else None
    rows = [(m, x.converged, x.iterations, float(x.point.ll), degenerate[m], m == chosen, status) for m, x in lanes.items()]
    return spark.createDataFrame(rows, kind), spark.createDataFrame(_rows(likelihood, lanes[chosen]), _FIT) if chosen else None


def bootstrap_nested(df: DataFrame, y: str, x: list[str], outer: str, inner: str, draws: int, seed: int) -> DataFrame:
    """draw, term, coef of the nested model refit in every draw of inner units.  The draws of a portion go side by side from the whole table's ratios: a step of all of them is one job."""
    df = df.dropna(subset=[y, *x, outer, inner])
    whole = RestrictedLikelihood(df, y, x, inner, outer)
    start = _best(maximised(whole, np.zeros(len(STARTS), int), _starts([*STARTS]))).at
    counts = staged(draw_counts(whole.units.select("__inner").distinct(), "__inner", draws, seed), "draw-counts")
    cells = whole.cells()
    rows, portion, by_cells = [], whole.portion(draws, cells), whole.by_cells(cells)
    for first in range(0, draws, portion):
        n = min(portion, draws - first)
        likelihood = whole.drawn(counts.filter(F.col("draw").between(first, first + n - 1)).withColumn("draw", F.col("draw") - first), n, by_cells)
        # From the bound no step leads back, so searches start a little above it.
        lanes = maximised(likelihood, np.arange(n), np.repeat(np.maximum(start, math.log(1e-4))[None], n, 0))
        rows += [(first + d, t, c) for d, lane in enumerate(lanes) for t, c, _ in _rows(likelihood, lane)]
        discarded(likelihood.blocks)
    for table in (counts, whole.blocks, whole.units):
        discarded(table)
    return df.sparkSession.createDataFrame(rows, "draw long, term string, coef double")
