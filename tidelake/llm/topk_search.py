"""Exact top-k search by inner product with pivot-table elimination.

Vectors are whole numbers.  Every vector's row of the *pivot table* holds its distances to a
number of pivots and to the origin.  By the triangle inequality the largest
difference of two vectors' entries bounds their distance from below; with the norms that
bounds their inner product from above: (|q|^2 + |x|^2 - bound^2) / 2.

1. Pivots are chosen by farthest-first traversal of a bounded sample (``sample`` vectors with the smallest
   hash of their id); they and the sample are all that tasks hold.
2. Vectors are dealt to regions, that of the nearest of the first pivots (one for each ``group`` vectors, as the first are
   the farthest from each other), and regions to groups of about ``group`` vectors
   (a region that a third of all vectors lie in has many).  A group is one row: its vectors, and of each pivot
   the smallest and the largest distance.  Queries, a stated set, are dealt alike.  A query's k best of the sample
   give its first floor: what scores less can't be among its k best.
3. Pairs of groups are eliminated by their ranges of distances, before any vector is sent: where the
   best bound is below all of a query group's floors.  Only the others' vectors meet, pair by pair.
4. In a pair a query takes candidates in order of their own bounds, in chunks, and stops when the next bound is
   below its k-th score, or its floor.  Of all pivots those nearest the query and those nearest the candidate
   give the largest differences, so ``NEAR`` of each are looked at: what a bound costs doesn't grow with the number of
   pivots.  A task carries its queries' floors from one pair to the next.
   At most k rows leave a pair for a query; a window picks the best.

A margin covers rounding; scores are exact whole numbers: in 64 bits where all products fit, by unbounded numbers else.

How much is eliminated depends on the vectors.  Near copies and clusters go whole groups at a time.  Directions
drawn at random in many dimensions are all about equally far from each other, and no pivot can tell them
apart: then nearly every candidate is evaluated, and results stay exact.

Defined cases: vectors that are null, hold null or non-finite components, or have no id, take no part.  Vectors
meet only those of their own dimension.  Rows
with equal id aren't candidates of each other.  A query with fewer candidates gets them
all; one without any gets no row.  Ties go to the smaller id, equal rows are returned each.  A component, or a score among
the k best, that doesn't fit in 64 bits raises an error.  An
empty table gives an empty result.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import batches_of, drop_staged, stage

#: Products of components up to this, in 2**20 dimensions, add up within 64 bits.
NARROW = 1 << 21
#: Pivots nearest a vector by which its distance to another is bounded.
NEAR = 8
_VECTORS = "id long, row long, dim int, region int, v array<long>"
_GROUP = "dim int, region int, salt long, n long, ids binary, vectors binary, wide boolean, low binary, high binary, floors binary, floor double"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v: floor(scale * component) of the vectors that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.floor(c.cast("double") * scale)
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < F.lit(2.0**63))
    v = F.when(fits, F.transform(x, lambda c: whole(c).cast("long"))).otherwise(F.raise_error(F.lit("a component doesn't fit in 64 bits")).cast("array<long>"))
    return rows.filter(x.isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


class Pivots:
    """By dimension: the pivots (the origin is the first), and the sample's ids and vectors."""

    def __init__(self, some: list, pivots: int) -> None:
        self.at, self.ids, self.vectors = {}, {}, {}
        for dim in {len(r["v"]) for r in some}:
            own = [r for r in some if len(r["v"]) == dim]
            m = np.array([r["v"] for r in own], np.int64).reshape(-1, dim)
            x = m.astype(np.float64)
            chosen, near = [np.zeros(dim)], np.full(len(m), np.inf)
            for _ in range(min(pivots, len(m))):
                near = np.minimum(near, ((x - chosen[-1]) ** 2).sum(1))
                chosen.append(x[int(near.argmax())])
            self.at[dim], self.ids[dim], self.vectors[dim] = np.array(chosen), np.array([r["id"] for r in own], np.int64), m

    def table(self, m: np.ndarray) -> np.ndarray:
        """Distances of vectors to the pivots of their dimension."""
        at, x = self.at.get(m.shape[1], np.zeros((1, m.shape[1]))), m.astype(np.float64)
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (at**2).sum(1) - 2 * x @ at.T, 0))

    def floors(self, ids: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
        """A lower bound of each vector's k-th best score, from the sample; minus infinity where the sample has too few."""
        dim = m.shape[1]
        if dim not in self.ids:
            return np.full(len(ids), -np.inf)
        x, s = m.astype(np.float64), self.vectors[dim].astype(np.float64)
        scores = x @ s.T
        scores[ids[:, None] == self.ids[dim]] = -np.inf
        best = np.sort(scores, 1)[:, -k] if s.shape[0] >= k else np.full(len(ids), -np.inf)
        return best - 1e-9 * np.sqrt((x**2).sum(1) * (s**2).sum(1).max()) - 1


def choose_pivots(vectors: DataFrame, pivots: int, sample: int) -> Pivots:
    """Rows far from each other, of a bounded sample."""
    return Pivots(vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").collect(), pivots)


def _in_regions(vectors: DataFrame, pivots: Pivots, regions: int) -> DataFrame:
    """id, row, dim, region (number of the nearest of the first pivots), v."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            flat, ends = np.asarray(lists.flatten()), np.cumsum(sizes)
            region = np.zeros(len(sizes), np.int32)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                table = pivots.table(flat[(ends - sizes)[own][:, None] + np.arange(dim)].reshape(len(own), dim))
                region[own] = table[:, 1 : 1 + regions].argmin(1) if table.shape[1] > 1 else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(region), lists], names=["id", "row", "dim", "region", "v"])

    return vectors.select("id", F.monotonically_increasing_id().alias("row"), "v").mapInArrow(deal, _VECTORS)


def _grouped(vectors: DataFrame, pivots: Pivots, size: int, k: int) -> DataFrame:
    """One row a group of about ``size`` vectors of a region; ``k`` is given for queries, which get floors."""
    counts = vectors.groupBy("dim", "region").agg(F.count(F.lit(1)).alias("all"))
    salts = F.ceil(F.col("all") / F.lit(size)).cast("long")
    dealt = vectors.join(counts, ["dim", "region"]).withColumn("salt", F.pmod(F.xxhash64("row"), salts))

    def pack(table: pa.Table) -> pa.Table:
        dim, region, salt = (table.column(c)[0].as_py() for c in ("dim", "region", "salt"))
        ids = np.asarray(table.column("id"))
        m = np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(ids), dim)
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], m[order]
        at = pivots.table(m)
        wide = bool(len(m) and dim and np.abs(m.astype(np.float64)).max() > NARROW)
        floors = pivots.floors(ids, m, k) if k else np.zeros(0)
        held = (dim, region, salt, len(ids), ids.tobytes(), m.astype(np.int64 if wide else np.int32).tobytes(), wide, at.min(0).tobytes(), at.max(0).tobytes(), floors.tobytes(), float(floors.min()) if k else None)
        return pa.table([pa.array([x], t) for x, t in zip(held, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=[c.split()[0] for c in _GROUP.split(", ")])

    return dealt.groupBy("dim", "region", "salt").applyInArrow(pack, _GROUP).withColumn("name", F.monotonically_increasing_id())


def highest(low: np.ndarray, high: np.ndarray, q_low: np.ndarray, q_high: np.ndarray) -> np.ndarray:
    """Bounds from above of the scores between groups, by the ranges of their distances: a row a query group, a column a group."""
    out = np.empty((len(q_low), len(low)))
    for i in range(len(q_low)):
        far = np.maximum(np.maximum(low - q_high[i], q_low[i] - high), 0).max(1)
        near = high[:, 0] + q_high[i, 0]  # |x| + |q|
        least = np.maximum(far - 1e-6 * near, 0)
        out[i] = (high[:, 0] ** 2 + q_high[i, 0] ** 2 - least**2) / 2 + 1e-6 * near**2 + 1
    return out


def pairs_left(groups: DataFrame, asked: DataFrame, chunk: int = 256) -> DataFrame:
    """x, q: names of the pairs of a group and a query group that their ranges don't eliminate.

    Ranges are sent, vectors aren't: those of ``chunk`` groups make one row, and each row of queries meets each row of groups of its dimension.
    """
    def chunks(df: DataFrame, floor: Column) -> DataFrame:
        some = df.select("dim", "name", "low", "high", floor.alias("floor")).withColumn("chunk", F.pmod(F.col("name"), F.lit(1 + df.count() // chunk)))
        return some.groupBy("dim", "chunk").agg(F.sort_array(F.collect_list(F.struct("name", "low", "high", "floor"))).alias("rows"))

    a, b = chunks(groups, F.lit(0.0)), chunks(asked, F.col("floor"))
    both = a.select("dim", F.col("rows").alias("x")).join(b.select("dim", F.col("rows").alias("q")), "dim")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = lambda rows, c: np.stack([np.frombuffer(r[c]) for r in rows])
        for batch in batches:
            for r in batch.to_pylist():
                x, q = r["x"], r["q"]
                left = highest(matrix(x, "low"), matrix(x, "high"), matrix(q, "low"), matrix(q, "high")) >= np.array([y["floor"] for y in q])[:, None]
                at = np.argwhere(left)
                yield pa.RecordBatch.from_arrays([pa.array([x[j]["name"] for _, j in at], pa.int64()), pa.array([q[i]["name"] for i, _ in at], pa.int64())], names=["x", "q"])

    return both.select("x", "q").mapInArrow(check, "x long, q long")


class Nearest:
    """The entries of a pivot table by which vectors are bounded: all columns, and of each row its nearest pivots."""

    def __init__(self, table: np.ndarray) -> None:
        few = min(NEAR, table.shape[1])
        self.columns = np.ascontiguousarray(table.T)
        self.pivots = np.argpartition(table, few - 1, axis=1)[:, :few]
        self.distances = np.take_along_axis(table, self.pivots, 1)

    def least(self, q_table: np.ndarray) -> np.ndarray:
        """The largest difference of each row's entries and a query's, over the nearest pivots of both."""
        few = min(NEAR, len(q_table))
        own = np.argpartition(q_table, few - 1)[:few]
        return np.maximum(np.abs(self.columns[own] - q_table[own][:, None]).max(0), np.abs(q_table[self.pivots] - self.distances).max(1))


def best_of(query: np.ndarray, query_id: int, q_table: np.ndarray, ids: np.ndarray, m: np.ndarray, table: np.ndarray, k: int, floor: float | None, chunk: int = 128, nearest: Nearest | None = None) -> tuple[list[tuple[int, int]], int]:
    """The group's k best (score, id) for a query, and how many were evaluated.  Those below ``floor`` may be missing."""
    far = (nearest or Nearest(table)).least(q_table).astype(np.float64)
    near = table[:, 0].astype(np.float64) + float(q_table[0])  # |x| + |q|
    least = np.maximum(far - 1e-6 * near - 1e-6, 0)
    above = (table[:, 0].astype(np.float64) ** 2 + float(q_table[0]) ** 2 - least**2) / 2 + 1e-6 * near**2 + 1
    open_ = np.flatnonzero(above >= floor) if floor is not None else np.arange(len(ids))
    order = open_[np.lexsort((ids[open_], -above[open_]))]
    best: list[tuple[int, int]] = []
    seen = 0
    a = 0
    while a < len(order):
        part, a, chunk = order[a : a + chunk], a + chunk, 2 * chunk
        bar = max([x for x in (best[-1][0] if len(best) == k else None, floor) if x is not None], default=None)
        if bar is not None and above[part[0]] < bar:
            break
        scores, seen = m[part] @ query, seen + len(part)
        own = ids[part]
        keep = own != query_id
        if bar is not None:
            keep &= (scores >= bar).astype(bool)
        if keep.any():
            best = sorted([*best, *zip(scores[keep].tolist(), own[keep].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
    return best, seen


def _opened(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}_ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}_vectors"], np.int64 if row[f"{prefix}_wide"] else np.int32).reshape(len(ids), row["x_dim"])


def _numbers(m: np.ndarray, q: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in the fastest numbers whose sums of products are exact: doubles up to 2**53, 64 bits, or unbounded ones."""
    most = m.shape[1] * float(np.abs(m).max(initial=1)) * float(np.abs(q).max(initial=1))
    kind = object if wide else np.float64 if most < 2**53 else np.int64
    return m.astype(kind), q.astype(kind)


def search(
    rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = 1024, sample: int = 2048, group: int = 8192, query_group: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), id, score of each query's k best rows other than itself."""
    vectors = whole_vectors(rows, id_col, vector_col, scale)
    at = choose_pivots(vectors, pivots, sample)
    regions = max(1, -(-vectors.count() // group))
    dealt, some = (stage(_in_regions(v, at, regions), n) for v, n in ((vectors, "vectors"), (whole_vectors(queries, id_col, vector_col, scale), "queries")))
    groups, asked = stage(_grouped(dealt, at, group, 0), "groups"), stage(_grouped(some, at, query_group, k), "asked")
    drop_staged(dealt)
    drop_staged(some)
    left = stage(pairs_left(groups, asked), "pairs")
    side = lambda df, p, names: df.select(F.col("name").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in names])
    x, q = side(groups, "x", ("dim", "ids", "vectors", "wide")), side(asked, "q", ("ids", "vectors", "wide", "floors"))
    met = left.join(q, "q").join(x, "x").select("x", "x_dim", *[f"{p}_{c}" for p in "xq" for c in ("ids", "vectors", "wide")], "q_floors")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, list[int]] = {}  # by query, its k best scores so far in this task
        held, table, nearest = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                (ids, m), (q_ids, q_m) = _opened(row, "x"), _opened(row, "q")
                if held != row["x"]:
                    held, table = row["x"], at.table(m).astype(np.float32)
                    nearest = Nearest(table)
                m, q_m, out = *_numbers(m, q_m, row["x_wide"] or row["q_wide"]), []
                for q_id, query, q_table, floor in zip(q_ids.tolist(), q_m, at.table(q_m).astype(np.float32), np.frombuffer(row["q_floors"]).tolist(), strict=True):
                    had = floors.get(q_id, [])
                    best, _ = best_of(query, q_id, q_table, ids, m, table, k, max(floor, had[-1]) if len(had) == k else floor, nearest=nearest)
                    if len(floors) < 100_000 or had:
                        floors[q_id] = sorted([*had, *(s for s, _ in best)], reverse=True)[:k]
                    out += [(q_id, y, s) for s, y in best]
                # Scores beyond 64 bits go on as decimals: only those among the k best of all have to fit.
                yield pa.RecordBatch.from_arrays([pa.array([y[0] for y in out], pa.int64()), pa.array([y[1] for y in out], pa.int64()), pa.array([str(int(y[2])) for y in out], pa.string())], names=["query_id", "id", "score"])

    with batches_of(rows.sparkSession, 4):  # a row is a pair of groups
        best = stage(met.mapInArrow(answer, "query_id long, id long, score string").withColumn("score", F.col("score").cast("decimal(38,0)")), "best")
    for done in (groups, asked, left):
        drop_staged(done)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    fits = F.col("score").between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    score = F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score doesn't fit in 64 bits")).cast("long"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", score.alias("score"))
