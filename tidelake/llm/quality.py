"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 .. K-1.  One weight vector w over hashed text features is shared by
all grades, and ordered thresholds cut the line: P(grade > k) = sigmoid(w x - t_k).  So a
document has an expected grade (the sum of these) and a tail probability of the top
grade, by which it is selected.  With ratings of quality and toxicity the grades are:
0 low quality, 1 toxic, 2 neither.

Features of a text: each distinct word (lower-cased, outer punctuation removed), and, by the root of
their share of the words, word beginnings of two to five letters, *shapes* (runs of capitals,
letters and digits become one mark each, other signs stay) and words equal to the one before.  They are hashed to ``2**BITS``
numbers.  Features are screened: those stay whose mean is higher below some threshold than above it, by
a number of standard errors, and they are scaled by the root of that number, so
the penalty weighs most on those that tell grades apart least.  Which of ``LEVELS`` is the least number that
stays is decided by cross-validation on the sample: the level with the best held-out likelihood, so few
labels are used as far as they go and many don't let chance in.  Weights can't be
positive: features are evidence against a text, and passages that many good texts
share don't make up for it.

The model is fit on a bounded sample, ``sample`` labelled rows with the smallest hash
of their id (of rows with repeated identifiers no more than that in all).  Their features are staged and screened by
partial aggregates on executors, for the whole sample and for it without each fold; the driver gets
the features that stay at the lowest level, nothing else.  It is full-batch gradient
descent with per-coordinate steps on the regularised likelihood, the same on every run.  Scoring is a
scalar function over whole texts: rows keep all their columns and nothing is
shuffled.

Defined cases: null text is empty; the empty text has the score 0 and the probabilities
that the thresholds give.  Labels that are null, or without document, don't count.  A document that is
labelled twice counts twice.  Without labels every document has the top grade.  Rows with equal identifier
are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import drop_staged, stage, text_batches, worker_state

BITS, SHARE_SCALE = 18, 6.0
#: Least standard errors a feature may need to stay, and the folds by which one of these is chosen.
LEVELS, FOLDS = (4.0, 3.0, 2.0, 1.5, 1.0), 8
#: Sums of the screen are whole numbers of this fraction; values are 6 at most, so 2**20 rows fit in 64 bits.
FIXED = 2.0**30
AGAIN = xxhash.xxh3_64_intdigest("again") >> (64 - BITS)
_SHAPES = [(re.compile(p), r) for p, r in ((r"[A-ZÀ-ÖØ-Þ]+", "X"), (r"[a-zß-öø-ÿ]+", "x"), (r"[0-9]+", "0"), (r"(.)\1+", r"\1\1"))]


def word_features(word: str) -> tuple[int, ...]:
    """Numbers of a word, of its shape and of its beginnings."""
    shape = word
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    core = word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    number = lambda s: xxhash.xxh3_64_intdigest(s) >> (64 - BITS)
    return number(f"w{core}"), number(f"s{shape}"), *(number(f"p{k}{core[:k]}") for k in range(2, 6))


class Features:
    """Features of texts; each distinct word is taken apart once."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        numbers: defaultdict[bytes, int] = defaultdict(lambda: len(numbers))
        self.numbers, self.known, self.table = numbers, 0, np.zeros((0, 6), np.int64)

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Feature numbers and values of each text."""
        if len(self.numbers) > 200_000:
            self.clear()
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        rows = [np.fromiter(map(self.numbers.__getitem__, w), np.int64, len(w)) for w in split]
        if fresh := list(self.numbers)[self.known :]:
            self.table = np.concatenate([self.table, np.array([word_features(w.decode()) for w in fresh], np.int64)])
            self.known = len(self.numbers)
        for r in rows:
            own = self.table[r]
            words, (shares, n) = np.unique(own[:, 0]), np.unique(own[:, 1:], return_counts=True)
            shares, n = np.append(shares, AGAIN), np.append(n, np.count_nonzero(r[1:] == r[:-1]))
            yield np.concatenate([words, shares]), np.concatenate([np.ones(len(words)), SHARE_SCALE * np.sqrt(n / max(1, len(r)))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return _sigmoid(z[:, None] - self.thresholds)


def spreads(sums: np.ndarray, squares: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The screen: by feature the standard errors by which its mean is lower above some threshold than below; 0 for those that are not lower.

    ``sums`` and ``squares`` have a row a grade and a column a feature, ``counts`` the documents of each grade.
    """
    spread = np.zeros(sums.shape[1])
    for cut in range(1, len(counts)):
        sides = []
        for side in (slice(cut, None), slice(0, cut)):
            count = max(1, counts[side].sum())
            mean, square = sums[side].sum(0) / count, squares[side].sum(0) / count
            sides.append((mean, (square - mean**2 + 1 / count) / count))
        spread = np.maximum(spread, (sides[1][0] - sides[0][0]) / np.sqrt(sides[0][1] + sides[1][1]))
    return spread


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, spread: np.ndarray, steps: int = 300, rate: float = 0.05, ridge: float = 2e-4) -> Model:
    """Maximum likelihood of the cumulative-link model with a ridge penalty, by Adam on all rows; rows hold features with a spread only."""
    size = 1 << BITS
    w, t = np.zeros(size), np.linspace(-1, 1, levels - 1) - 2.0
    if not rows or len(set(grades.tolist())) < 2:
        return Model(w.astype(np.float32), np.full(levels - 1, -60.0))
    n = len(rows)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f, _ in rows])
    feature, value = (np.concatenate(x) for x in zip(*rows, strict=True))
    used = np.flatnonzero(spread)
    k, spread = len(used), spread[used]
    feature = np.searchsorted(used, feature).astype(np.int32)
    value = value * spread[feature]
    v = np.zeros(k)
    params, first, second = [v, t], [np.zeros(k), np.zeros(len(t))], [np.zeros(k), np.zeros(len(t))]
    for step in range(1, steps + 1):
        z = np.bincount(doc, value * v[feature], n)
        padded = np.concatenate([np.ones((n, 1)), _sigmoid(z[:, None] - t), np.zeros((n, 1))], 1)
        at = np.arange(n)
        low, high = padded[at, grades], padded[at, grades + 1]  # P(y >= g), P(y > g)
        p = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        dz = -(d_low - d_high) / n
        dt = np.zeros(len(t))
        np.add.at(dt, np.clip(grades - 1, 0, None), np.where(grades > 0, d_low, 0) / n)
        np.add.at(dt, np.clip(grades, None, len(t) - 1), np.where(grades < len(t), -d_high, 0) / n)
        for j, g in enumerate((np.bincount(feature, dz[doc] * value, k) + ridge * v, dt)):
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.999 * second[j] + 0.001 * g * g
            params[j] -= rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
        np.minimum(v, 0, out=v)
        t[:] = np.maximum.accumulate(t + np.arange(len(t)) * 1e-9)
    w[used] = v * spread
    return Model(w.astype(np.float32), t.copy())


def grades_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, grade: 0 low quality, 1 toxic, 2 neither."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.filter("quality is not null and toxic is not null").select(F.col(id_col).cast("long").alias("id"), grade.alias("grade"))


def _own(rows: list[tuple[np.ndarray, np.ndarray]], spread: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features of rows that have a spread."""
    return [(f[stays], v[stays]) for f, v in rows for stays in [spread[f] > 0]]


def screened_fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, spread: np.ndarray, least: float, **options) -> Model:
    """fit() on the features whose spread is ``least`` or more."""
    scale = np.sqrt(np.where(spread >= least, spread, 0))
    return fit(_own(rows, scale), grades, levels, scale, **options)


def deviance(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> float:
    """Minus the log-likelihood of grades."""
    z = np.array([float(model.weights[f] @ v) for f, v in rows])
    padded = np.concatenate([np.ones((len(z), 1)), model.above(z), np.zeros((len(z), 1))], 1)
    at = np.arange(len(z))
    return float(-np.log(np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-9)).sum())


def chosen_level(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, folds: np.ndarray, levels: int, spreads_without: np.ndarray) -> float:
    """The level of LEVELS with the best likelihood of rows that the fit hasn't seen; ``spreads_without`` has a row a fold, the screen without it."""
    lost = dict.fromkeys(LEVELS, 0.0)
    for k in range(FOLDS):
        seen, held = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
        if not len(held):
            continue
        for least in LEVELS:
            model = screened_fit([rows[i] for i in seen], grades[seen], levels, spreads_without[k], least, steps=120)
            lost[least] += deviance(model, [rows[i] for i in held], grades[held])
    return min(LEVELS, key=lambda least: (round(lost[least], 6), -least))


_TAKEN = "id long, grade int, fold int, f binary, v binary"


def _packed(ids: pa.Array, grades: pa.Array, folds: pa.Array, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    binary = lambda k, t: pa.array([x[k].astype(t).tobytes() for x in pairs], pa.binary())
    return pa.RecordBatch.from_arrays([ids, grades, folds, binary(0, np.int32), binary(1, np.float32)], names=["id", "grade", "fold", "f", "v"])


def _pairs(features: list[bytes], values: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(f, np.int32), np.frombuffer(v, np.float32)) for f, v in zip(features, values, strict=True)]


def train(docs: DataFrame, grades: DataFrame, levels: int = 3, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits the model on the documents of ``sample`` rows of grades (id, grade)."""
    some = grades.filter("id is not null").orderBy(F.xxhash64("id", F.lit(3)), "id", "grade").limit(sample)
    # The sample is bounded, so it can be sent to all tasks.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id")
    fold = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLDS)).cast("int")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = worker_state(("features",), Features)
        for b in batches:
            yield _packed(b.column(0), b.column(2), b.column(3), list(features.of(b.column(1).to_pylist())))

    with text_batches(docs.sparkSession):
        taken = stage(rows.select("id", "text", F.col("grade").cast("int"), fold).mapInArrow(take, _TAKEN), "labelled")
        if taken.count() > sample:  # identifiers that several documents have
            whole, taken = taken, stage(taken.orderBy(F.xxhash64("id", F.lit(3)), "id", "grade", F.xxhash64("f", "v")).limit(sample), "labelled")
            drop_staged(whole)
        counts = np.zeros((FOLDS, levels), np.int64)
        for r in taken.groupBy("fold", "grade").count().collect():  # a row a fold and grade
            counts[r["fold"], r["grade"]] = r["count"]
        spread = np.zeros((1 + FOLDS, 1 << BITS))
        for r in _screened(taken, counts).collect():  # at most 2**BITS rows
            spread[:, r["feature"]] = r["spreads"]
        any_ = spread.max(0)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _packed(b.column(0), b.column(1), b.column(2), _own(_pairs(b.column(3).to_pylist(), b.column(4).to_pylist()), any_))

        got = taken.mapInArrow(keep, _TAKEN).collect()
    drop_staged(taken)
    got.sort(key=lambda r: (r["id"], r["grade"], bytes(r["f"]), bytes(r["v"])))
    pairs, grades_, folds = _pairs([r["f"] for r in got], [r["v"] for r in got]), np.array([r["grade"] for r in got], np.int64), np.array([r["fold"] for r in got])
    return screened_fit(pairs, grades_, levels, spread[0], chosen_level(pairs, grades_, folds, levels, spread[1:]))


def _screened(taken: DataFrame, counts: np.ndarray) -> DataFrame:
    """feature, spreads (of all rows, then without each fold) of the features that reach the lowest level in one of them.

    ``counts`` has a row a fold and a column a grade.  Tasks add up their documents, features meet by number; whole
    numbers add up to the same in any order.
    """
    folds, levels = counts.shape
    least = min(LEVELS)
    names = [f"{c}{k}_{g}" for c in "sq" for k in range(folds) for g in range(levels)]

    def added_up(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        feature = np.concatenate([f for _, f, _ in held])
        cell = np.repeat([c for c, _, _ in held], [len(f) for _, f, _ in held])
        value = np.concatenate([v for _, _, v in held]).astype(np.float64)
        there, place = np.unique(feature, return_inverse=True)
        total = np.zeros((len(names), len(there)), np.int64)
        for at, x in ((0, value), (folds * levels, value * value)):
            np.add.at(total, (cell + at, place), np.rint(x * FIXED).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (there, *total)], names=["feature", *names])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for g, k, (f, v) in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), _pairs(b.column(3).to_pylist(), b.column(4).to_pylist()), strict=True):
                held.append((k * levels + g, f, v))
                size += len(f)
                if size >= 1_000_000:
                    yield added_up(held)
                    held, size = [], 0
        if held:
            yield added_up(held)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums, squares = (np.array([b.column(c).to_numpy() for c in names]) / FIXED).reshape(2, folds, levels, -1)
            found = [spreads(sums.sum(0), squares.sum(0), counts.sum(0))]
            found += [spreads(sums.sum(0) - sums[k], squares.sum(0) - squares[k], counts.sum(0) - counts[k]) for k in range(folds)]
            found = np.where(np.array(found) >= least, found, 0)
            stays = found.any(0)
            yield pa.RecordBatch.from_arrays([b.column("feature").filter(pa.array(stays)), pa.array(found[:, stays].T.tolist(), pa.list_(pa.float64()))], names=["feature", "spreads"])

    added = taken.mapInArrow(add, ", ".join(f"{c} long" for c in ("feature", *names)))
    return added.groupBy("feature").agg(*[F.sum(c).alias(c) for c in names]).mapInArrow(screen, "feature long, spreads array<double>")


def scorer(model: Model, step: int = 500):
    """A function of a text column -> struct<expected_grade, p_top>.  A batch's texts are opened ``step`` at a time."""

    @F.arrow_udf("expected_grade double, p_top double")
    def score(texts: pa.Array) -> pa.Array:
        features = worker_state(("features",), Features)
        some = (features.of(texts.slice(a, step).to_pylist()) for a in range(0, len(texts), step))
        above = model.above(np.array([float(model.weights[f] @ v) for part in some for f, v in part]))
        return pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array(above[:, -1])], names=["expected_grade", "p_top"])

    return score


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "rating") -> DataFrame:
    """docs with the struct column ``out``: expected_grade, p_top."""
    return docs.withColumn(out, scorer(model)(F.col(text_col)))


def select_top(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose probability of the top grade is at least ``least``, staged: texts go to workers in batches bounded by rows and bytes."""
    chosen: Column = scorer(model)(F.col(text_col))["p_top"] >= F.lit(least)
    with text_batches(docs.sparkSession):
        return stage(docs.filter(chosen), "good")
