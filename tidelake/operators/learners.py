"""Learners that predict an outcome out of fold: one interface, four learners, and what is done with any of them.

A learner's ``fit(df, y, x, fold, k)`` returns one model a fold, fitted on the rows of all other folds; a model's
``predict(columns)`` is a Column of x.  Least squares and ridge take all folds from one scan (sums by fold, a fold's
own taken off the total); the mixed model is fitted by restricted likelihood for each fold; boosting
grows the trees of all folds side by side, a job a level.

Boosting: features become bins once, by exact quantiles.  Rows that have all bins in common can't be told apart by a tree, so they are summed once: a cell holds, by lane,
how many rows train it and are held out of it, and their sums.  A job sums gradients and counts by (lane, node, feature, bin) over blocks of cells in a
reduction tree, the driver picks splits from lanes x nodes x features x bins numbers, and the next level begins.  With a held-out share of
units the loss on it is looked at after every tree, and a lane ends at the first tree where none of the last ``patience`` scores beats the one before
them: nothing is fitted again, later trees don't exist.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations_with_replacement
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators import mixed
from tidelake.operators.ranks import attach, exact_quantiles, global_rank
from tidelake.operators.windows import hash_score, top_share
from tidelake.sources.staging import staged


class Model(Protocol):
    def predict(self, columns: list[Column]) -> Column: ...


class Learner(Protocol):
    def fit(self, df: DataFrame, y: str, x: list[str], fold: str, k: int) -> list[Model]: ...


@dataclass
class Linear:
    """const + sum of coefficients times columns."""

    const: float
    coef: list[float]

    def predict(self, columns: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [c.cast("double") * F.lit(float(w)) for c, w in zip(columns, self.coef, strict=True)], F.lit(float(self.const)))


def _fold_moments(df: DataFrame, y: str, x: list[str], fold: str, k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Without each fold: n, means and centred cross products of (x, y).  All folds in one scan, as sums around the columns' overall means."""
    names = [*x, y]
    middle = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    cols = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(float(middle[c] or 0.0)) for c in names]]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    whole = np.zeros((k, len(cols), len(cols)))
    for r in df.groupBy(fold).agg(*[F.sum(cols[i] * cols[j]).alias(f"g{a}") for a, (i, j) in enumerate(pairs)]).collect():  # a row a fold
        for a, (i, j) in enumerate(pairs):
            whole[r[fold], i, j] = whole[r[fold], j, i] = r[f"g{a}"]
    out = []
    for f in range(k):
        m = whole.sum(0) - whole[f]
        n = max(1.0, m[0, 0])
        out.append((n, m[0, 1:] / n + np.array([middle[c] or 0.0 for c in names]), m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n))
    return out


@dataclass
class LeastSquares:
    def fit(self, df: DataFrame, y: str, x: list[str], fold: str, k: int) -> list[Linear]:
        out = []
        for _, mean, m in _fold_moments(df.dropna(subset=[y, *x]), y, x, fold, k):
            beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
            out.append(Linear(float(mean[-1] - mean[:-1] @ beta), beta.tolist()))
        return out


@dataclass
class Ridge:
    """Columns are standardised with the training rows' population deviation; one of none counts as 1."""

    alpha: float = 1.0

    def fit(self, df: DataFrame, y: str, x: list[str], fold: str, k: int) -> list[Linear]:
        out = []
        for n, mean, m in _fold_moments(df.dropna(subset=[y, *x]), y, x, fold, k):
            sd = np.sqrt(np.maximum(np.diag(m)[:-1], 0) / n)
            sd[sd == 0] = 1
            beta = np.linalg.solve(m[:-1, :-1] / np.outer(sd, sd) + self.alpha * np.eye(len(x)), m[:-1, -1] / sd) / sd
            out.append(Linear(float(mean[-1] - mean[:-1] @ beta), beta.tolist()))
        return out


@dataclass
class Mixed:
    """Random intercepts of a unit; predictions are by the fixed part alone."""

    unit: str

    def fit(self, df: DataFrame, y: str, x: list[str], fold: str, k: int) -> list[Linear]:
        out = []
        for f in range(k):
            got = {r["term"]: r["coef"] for r in mixed.random_intercept(df.filter(F.col(fold) != f), y, x, self.unit).collect()}
            out.append(Linear(got["const"], [got[c] for c in x]))
        return out


@dataclass
class Tree:
    """A full binary tree by places: node i has the children 2 i + 1 and 2 i + 2.  Values up to a node's threshold (bins up to its edge) and all of a node that isn't split go left."""

    feature: np.ndarray
    edge: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def of(self, goes_right: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, levels: int | None = None) -> np.ndarray:
        """The node of each of n rows after some levels."""
        node = np.zeros(n, np.int64)
        for _ in range(int(np.log2(len(self.leaf))) if levels is None else levels):
            node = 2 * node + 1 + goes_right(self.feature[node], node)
        return node


@dataclass
class Boosted:
    """A model of trees."""

    base: float
    trees: list[Tree] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)

    def scored(self, x: np.ndarray) -> np.ndarray:
        """Predictions for columns x (features x rows); missing values go right where a node is split."""
        out, at = np.full(x.shape[1], self.base), np.arange(x.shape[1])
        for t in self.trees:
            node = t.of(lambda f, n, t=t: ~(x[f, at] <= t.threshold[n]) & (t.threshold[n] < np.inf), x.shape[1])
            out += t.leaf[node - (len(t.leaf) - 1)]
        return out

    def tabled(self, features: int, most: int = 100_000) -> Callable[[np.ndarray], np.ndarray]:
        """scored(), by a table of all cells between the trees' thresholds if there are ``most`` at most: a row then costs a search a feature, however many trees there are."""
        used = [np.unique(np.concatenate([np.empty(0), *[t.threshold[(t.feature == f) & (t.threshold < np.inf)] for t in self.trees]])) for f in range(features)]
        shape = [len(e) + 1 for e in used]
        if math.prod(shape) > most:
            return self.scored
        # A cell's values go like its upper threshold; those beyond the last one, and missing ones, like infinity.
        table = self.scored(np.array([g.ravel() for g in np.meshgrid(*[np.append(e, np.inf) for e in used], indexing="ij")]))
        return lambda x: table[np.ravel_multi_index([np.searchsorted(e, v, "left") for e, v in zip(used, x, strict=True)], shape)]

    def predict(self, columns: list[Column]) -> Column:
        score = self.tabled(len(columns))

        @F.arrow_udf("double")
        def apply(*values: pa.Array) -> pa.Array:
            return pa.array(score(np.array([v.to_numpy(zero_copy_only=False) for v in values], np.float64)))

        return apply(*[c.cast("double") for c in columns])


@dataclass
class Boosting:
    """Least-squares boosting of trees of one depth on binned features.

    ``held`` (share) of the training units of each fold, chosen by hash, stop the fit if ``unit`` is given; else, or where that share is no unit, all ``rounds`` are grown.
    """

    rounds: int = 100
    depth: int = 4
    step: float = 0.05
    least: int = 20
    bins: int = 255
    unit: str | None = None
    held: float = 0.1
    patience: int = 10
    gain: float = 1e-7
    seed: int = 1
    refresh: int = 20
    rows_a_block: int = 20_000

    def _held(self, df: DataFrame, fold: str, k: int) -> DataFrame:
        """Adds __bits: the lanes that a row's unit is held out of.  Of the units of a fold's training rows that is a share, rounded, those of smallest hash."""
        units = df.filter(F.col(self.unit).isNotNull()).select(F.col(self.unit).alias("__unit"), F.col(fold).alias("__fold")).distinct()
        lanes = units.withColumn("__lane", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("__fold <> __lane").select("__unit", "__lane").distinct()
        scored = lanes.withColumn("__h", -hash_score(F.col("__unit"), F.col("__lane"), self.seed).cast("double"))
        chosen = top_share(scored, "__h", "__unit", self.held, "__lane").groupBy("__unit").agg(F.bit_or(F.expr("shiftleft(1L, __lane)")).alias("__bits"))
        return df.join(chosen, df[self.unit] == chosen["__unit"], "left").drop("__unit").fillna(0, ["__bits"])

    def _edges(self, df: DataFrame, x: list[str]) -> list[np.ndarray]:
        """Upper edges of all bins but the last, by column: the distinct values if they are few, else quantiles."""
        out = []
        for c in x:
            some = [r[0] for r in df.filter(F.col(c).isNotNull()).select(F.col(c).cast("double")).distinct().limit(self.bins + 1).collect()]  # bins + 1 values at most
            if len(some) > self.bins:
                some = exact_quantiles(df, [], c, [i / self.bins for i in range(1, self.bins)]).first()["q"]
                out.append(np.unique(some))
            else:
                found = np.sort([v for v in some if not np.isnan(v)])
                out.append((found[1:] + found[:-1]) / 2)
        return out

    def _cells(self, df: DataFrame, y: str, x: list[str], fold: str, held: Column, edges: list[np.ndarray], middle: float, k: int) -> DataFrame:
        """A row for all rows with the same bins (int16 a feature): by lane the rows that train it and their sum of y, and the rows held out of it, their sum and their squares; y as distance from ``middle``."""

        def binned(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                values = [batch.column(i + 3).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(x))]
                # A bin holds what lies above the edge before it, up to its own; missing values have the last one.
                bins = np.array([np.where(np.isnan(v), len(e) + 1, np.searchsorted(e, v, "left")) for v, e in zip(values, edges, strict=True)], np.int16).T.copy()
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (2 * len(x))
                keys = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(bins)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), keys], names=["y", "fold", "held", "bins"])

        rows = df.select((F.col(y).cast("double") - F.lit(middle)).alias("__y"), F.col(fold).cast("int"), held.alias("__held"), *[F.col(c).cast("double") for c in x])
        cells = rows.mapInArrow(binned, "y double, fold int, held long, bins binary").groupBy("bins", "fold", "held").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
        out = [F.getbit("held", F.lit(lane)) == 1 for lane in range(k)]
        sums = lambda p, c: F.sum(F.when(p, F.col(c)).otherwise(0.0))
        train = [sums((F.col("fold") != lane) & ~out[lane], c) for c in "ns" for lane in range(k)]
        return cells.groupBy("bins").agg(F.array(*train, *[sums((F.col("fold") != lane) & out[lane], c) for c in "nsq" for lane in range(k)]).alias("sums"))

    def fit(self, df: DataFrame, y: str, x: list[str], fold: str, k: int) -> list[Boosted]:
        df = df.dropna(subset=[y])
        if k > 62:
            raise ValueError("more folds than bits")
        edges, middle = self._edges(df, x), df.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
        held = F.lit(0).cast("long")
        if self.unit:
            df, held = self._held(df, fold, k), F.col("__bits")
        cells = staged(self._cells(df, y, x, fold, held, edges, middle, k), "boosting")
        # A task holds rows_a_block cells at least, and each core has three tasks at most.
        tasks = max(1, min(-(-cells.count() // self.rows_a_block), 3 * df.sparkSession.sparkContext.defaultParallelism))

        def block(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                if batch.num_rows:
                    bins = b"".join(batch.column(0).to_pylist())
                    sums = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, 5 * k).T
                    yield pa.RecordBatch.from_arrays([pa.array([bins]), pa.array([sums.tobytes()])], names=["bins", "sums"])

        base = cells.repartition(tasks, "bins").mapInArrow(block, "bins binary, sums binary").rdd.map(lambda r: _Cells(bytes(r["bins"]), bytes(r["sums"]), len(x), k))
        return _grow(self, base, edges, k, middle)


class _Cells:
    """A block's cells, and where a lane's predictions stand."""

    def __init__(self, bins: bytes, sums: bytes, features: int, k: int) -> None:
        self.bins = np.frombuffer(bins, np.int16).reshape(-1, features).T
        self.n, self.s, self.out_n, self.out_s, self.out_q = np.frombuffer(sums, np.float64).reshape(5, k, -1)
        self.fits: dict[int, np.ndarray] = {}

    def node(self, tree: Tree, levels: int | None = None) -> np.ndarray:
        at = np.arange(self.bins.shape[1])
        return tree.of(lambda f, n: self.bins[f, at] > tree.edge[n], self.bins.shape[1], levels)

    def fitted(self, lane: int, base: float, trees: list[Tree]) -> np.ndarray:
        out = self.fits.get(lane, np.full(self.bins.shape[1], base)).copy()
        for t in trees:
            out += t.leaf[self.node(t) - (len(t.leaf) - 1)]
        return out

    def advanced(self, models: dict[int, tuple[float, list[Tree]]]) -> _Cells:
        """The same cells with predictions by the trees so far."""
        self.fits = {lane: self.fitted(lane, base, trees) for lane, (base, trees) in models.items()}
        return self


def _reduced(rdd, add, merge):  # noqa: ANN001, ANN202
    return rdd.treeAggregate(None, add, lambda a, b: b if a is None else a if b is None else merge(a, b), 1 if rdd.getNumPartitions() <= 16 else 2)


def _grow(how: Boosting, base, edges: list[np.ndarray], k: int, middle: float) -> list[Boosted]:  # noqa: ANN001
    wide, depth = max(map(len, edges), default=0) + 2, how.depth
    features = len(edges)

    def start(total, cells):  # noqa: ANN001, ANN202
        own = np.stack([cells.n.sum(1), cells.s.sum(1)], 1)
        return own if total is None else total + own

    sums = _reduced(base, start, lambda a, b: a + b)
    sums = np.zeros((k, 2)) if sums is None else sums
    models = [Boosted(middle + float(s / n) if n else 0.0) for n, s in sums]
    going = {lane for lane in range(k) if sums[lane, 0]}
    cached, kept, seen = base.persist(StorageLevel.MEMORY_AND_DISK), base, 0

    def job(level: int, growing: dict[int, Tree], watch: bool) -> tuple[dict, dict]:
        """By lane: gradients and counts by (node, feature, bin) at a level, and the held-out squared error."""
        state = {lane: (models[lane].base, models[lane].trees[seen:]) for lane in growing}

        def add(total, cells):  # noqa: ANN001, ANN202
            total = total if total is not None else ({}, {})
            for lane, tree in growing.items():
                fit = cells.fitted(lane, *state[lane]) - middle
                if watch and cells.out_n[lane].any():
                    e = np.array([(cells.out_q[lane] - 2 * fit * cells.out_s[lane] + cells.out_n[lane] * fit**2).sum(), cells.out_n[lane].sum()])
                    total[1][lane] = total[1].get(lane, 0) + e
                n = cells.n[lane]
                train = n > 0
                node = cells.node(tree, level)[train] - (2**level - 1)
                rest = (cells.s[lane] - n * fit)[train]
                places = ((node * features)[None, :] + np.arange(features)[:, None]) * wide + cells.bins[:, train]
                size = 2**level * features * wide
                hist = np.stack([np.bincount(places.ravel(), np.tile(w, features), size) for w in (rest, n[train])])
                total[0][lane] = total[0].get(lane, 0) + hist
            return total

        def merge(a, b):  # noqa: ANN001, ANN202
            return tuple({lane: x.get(lane, 0) + z.get(lane, 0) for lane in x.keys() | z.keys()} for x, z in zip(a, b, strict=True))

        found = _reduced(cached, add, merge) or ({}, {})
        return {lane: h.reshape(2, 2**level, features, wide) for lane, h in found[0].items()}, found[1]

    for round_ in range(how.rounds + 1):
        growing = {lane: Tree(np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 1 << 14), np.full(2**depth - 1, np.inf), np.zeros(2**depth)) for lane in going}
        if not growing:
            break
        for level in range(depth):
            hists, losses = job(level, growing, level == 0 and how.unit is not None)
            for lane, (error, n) in losses.items():
                models[lane].scores.append(-0.5 * error / n)
                if _stops(models[lane].scores, how):
                    going.discard(lane)
            if round_ == how.rounds:  # the last trees' scores were still to be seen
                going.clear()
            for lane in [lane for lane in growing if lane not in going]:
                del growing[lane]
            for lane in growing:
                _split(growing[lane], level, hists[lane], edges, how)
            if not growing:
                break
        for lane, tree in growing.items():
            models[lane].trees.append(tree)
        if (round_ + 1) % how.refresh == 0 and going:
            sofar = {lane: (models[lane].base, models[lane].trees) for lane in going}
            fresh = base.map(lambda cells, sofar=sofar: cells.advanced(sofar)).persist(StorageLevel.MEMORY_AND_DISK)
            kept, cached, seen = cached, fresh, round_ + 1
            if kept is not base:
                kept.unpersist()
    cached.unpersist()
    base.unpersist()
    return models


def _stops(scores: list[float], how: Boosting) -> bool:
    """None of the last ``patience`` scores beats the one before them."""
    before = len(scores) - how.patience - 1
    return before >= 0 and not any(s > scores[before] + how.gain for s in scores[before + 1 :])


def _split(tree: Tree, level: int, hist: np.ndarray, edges: list[np.ndarray], how: Boosting) -> None:
    """Best split of every node of a level, the first of equal ones; on the last level the leaves' steps, too."""
    last = level == how.depth - 1
    for j in range(2**level):
        node = 2**level - 1 + j
        sums, counts = np.cumsum(hist[:, j], 2)
        total, n = sums[0, -1], counts[0, -1]
        best = None
        if n >= 2 * how.least:
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sums**2 / counts + (total - sums) ** 2 / (n - counts) - total**2 / n
            gain = np.where((counts >= how.least) & (n - counts >= how.least), gain, -np.inf)
            for f, e in enumerate(edges):
                gain[f, len(e) + 1 :] = -np.inf  # behind the last bin there is no split; the bin before that parts missing values from all others
            f, e = np.unravel_index(int(np.argmax(np.round(gain, 9 - int(np.log10(max(1.0, np.abs(total**2 / n) + 1)))))), gain.shape)
            if np.isfinite(gain[f, e]) and gain[f, e] > 1e-12 * max(1.0, total**2 / n):
                best = (f, e)
        if best:
            f, e = best
            tree.feature[node], tree.edge[node] = f, e
            tree.threshold[node] = edges[f][e] if e < len(edges[f]) else np.finfo(np.float64).max
        if last:
            at = 2 * j
            if best:
                f, e = best
                left, m = sums[f, e], counts[f, e]
                tree.leaf[at], tree.leaf[at + 1] = how.step * left / m, how.step * (total - left) / (n - m)
            elif n:
                tree.leaf[at] = how.step * total / n


def by_fold(models: list[Model], columns: list[Column], fold: Column) -> Column:
    """The prediction by the model that hasn't seen the row's fold."""
    if models and all(isinstance(m, Boosted) for m in models):
        scores = [m.tabled(len(columns)) for m in models]

        @F.arrow_udf("double")
        def apply(own: pa.Array, *values: pa.Array) -> pa.Array:
            of, x = own.to_numpy(zero_copy_only=False), np.array([v.to_numpy(zero_copy_only=False) for v in values], np.float64)
            out, hit = np.zeros(len(of)), np.zeros(len(of), bool)
            for f, score in enumerate(scores):
                mine = of == f
                if mine.any():
                    out[mine], hit = score(x[:, mine]), hit | mine
            return pa.array(out, mask=~hit)

        return apply(fold.cast("int"), *[c.cast("double") for c in columns])
    out = F.lit(None).cast("double")
    for f, m in enumerate(models):
        out = F.when(fold == f, m.predict(columns)).otherwise(out)
    return out


def transfer(models: list[Model], df: DataFrame, x: list[str], fold: str, name: str) -> DataFrame:
    """Predictions for another table's rows, each by the model that hasn't seen its fold."""
    return df.withColumn(name, by_fold(models, [F.col(c) for c in x], F.col(fold)))


def crossfit(df: DataFrame, y: str, x: list[str], fold: str, k: int, name: str, learner: Learner | None = None) -> DataFrame:
    """Out-of-fold predictions: each fold's rows by a fit on the other folds."""
    return transfer((learner or LeastSquares()).fit(df, y, x, fold, k), df, x, fold, name)


def fold_r2(df: DataFrame, y: str, fit: str, fold: str) -> DataFrame:
    """fold, n, r2: one less squared errors over squared distances from the *training* rows' mean."""
    rows = df.dropna(subset=[y, fit])
    sums = rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("__m"), (F.var_pop(y) * F.count(F.lit(1))).alias("__ss"), F.sum((F.col(y) - F.col(fit)) ** 2).alias("__e"))
    total = sums.agg(F.sum("n").alias("__n"), F.sum(F.col("n") * F.col("__m")).alias("__t"))  # one row
    train = (F.col("__t") - F.col("n") * F.col("__m")) / (F.col("__n") - F.col("n"))
    return sums.join(F.broadcast(total)).select(fold, "n", (1 - F.try_divide(F.col("__e"), F.col("__ss") + F.col("n") * (F.col("__m") - train) ** 2)).alias("r2"))


def permuted_rows(df: DataFrame, id_: str, fold: str, x: list[str], repeats: int, seed: int) -> DataFrame:
    """Every row once for each column and repeat, with __column, __repeat and __value: that column's value of another row of its fold.

    The row of rank i by identifier takes the value of the row of rank i in a hash order of its own for each column and repeat, so each is one permutation of the whole fold.
    """
    marks = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r"), F.col(c).cast("double").alias("v")) for c in x for r in range(repeats)])).alias("m")
    dealt = df.select(id_, fold, marks).select(id_, fold, F.col("m.c").alias("__column"), F.col("m.r").alias("__repeat"), F.col("m.v").alias("__value"))
    mark = F.unhex(F.md5(F.concat_ws(":", F.col(id_).cast("string"), "__column", F.col("__repeat").cast("string"), F.lit(str(seed)))))
    dealt = global_rank(dealt.withColumn("__h", mark), [fold, "__column", "__repeat"], ["__h", id_], "__place", without=["__h", id_])
    rows = global_rank(df, [fold], [id_], "__place")
    # Each value goes to the row of its place: rows aren't repeated before they meet.
    return rows.join(dealt, [fold, "__place"]).drop("__place")


def importances(df: DataFrame, id_: str, y: str, x: list[str], fold: str, learners: dict[str, list[Model]], repeats: int = 10, seed: int = 5) -> DataFrame:
    """learner, term, importance: the rise of a fold's mean squared error when one column is permuted within it, averaged over repeats, then over folds.  All learners, columns and repeats are scored in one job."""
    rows = df.dropna(subset=[y]).select(id_, fold, y, *x)
    errors = lambda columns, name: [F.avg((F.col(y) - by_fold(models, columns, F.col(fold))) ** 2).alias(f"{name}{i}") for i, models in enumerate(learners.values())]
    base = rows.groupBy(fold).agg(*errors([F.col(c) for c in x], "__base"))
    moved = permuted_rows(rows, id_, fold, x, repeats, seed)
    columns = [F.when(F.col("__column") == c, F.col("__value")).otherwise(F.col(c).cast("double")) for c in x]
    mse = moved.groupBy(fold, "__column").agg(*errors(columns, "__mse"))
    rises = F.explode(F.array(*[F.struct(F.lit(name).alias("learner"), (F.col(f"__mse{i}") - F.col(f"__base{i}")).alias("rise")) for i, name in enumerate(learners)])).alias("r")
    return attach(mse, base, [fold]).select(F.col("__column").alias("term"), rises).groupBy("r.learner", "term").agg(F.avg("r.rise").alias("importance"))


def importance(df: DataFrame, id_: str, y: str, x: list[str], fold: str, models: list[Model], repeats: int = 10, seed: int = 5) -> DataFrame:
    """importances() of one learner: term, importance."""
    return importances(df, id_, y, x, fold, {"": models}, repeats, seed).drop("learner")
