"""Ordered operators: adjacency-checked lags, runs, folds, bins, top shares, seeded samples."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.operators.ranks import attach, exact_quantiles, global_rank, order_statistics
from tidelake.sources.staging import staged


def adjacent_lag(value: str, at: str, keys: list[str], by: int) -> Column:
    """value of the row ``by`` places before, if that row's place is exactly at - by; a negative ``by`` looks ahead."""
    w = Window.partitionBy(*keys).orderBy(at)
    return F.when(F.lag(at, by).over(w) == F.col(at) - by, F.lag(value, by).over(w))


def run_lengths(df: DataFrame, keys: list[str], at: str, flag: str) -> DataFrame:
    """Mean, largest and number of runs of consecutive rows with the flag, by key; 0 where there is none."""
    w = Window.partitionBy(*keys).orderBy(at)
    marked = df.withColumn("__island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, "__island").agg(F.count_if(F.col(flag)).alias("__len"))
    length = F.when(F.col("__len") > 0, F.col("__len"))
    return runs.groupBy(*keys).agg(F.coalesce(F.avg(length), F.lit(0.0)).alias("mean_run"), F.coalesce(F.max(length), F.lit(0)).cast("long").alias("max_run"), F.count(length).alias("runs"))


def resetting_events(df: DataFrame, keys: list[str], at: str, hit: Column, span: int, least: int = 2) -> DataFrame:
    """Events by key: ``least`` hits within ``span`` places; an event clears what was counted.

    The state is reset by what it finds, so it is a fold over a sequence: a higher-order function over the
    key's sorted places of hits (only those, as whole numbers).
    """
    places = df.filter(hit).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(at).cast("long"))).alias("__at"))
    empty = F.expr("cast(array() as array<bigint>)")

    def step(acc: Column, x: Column) -> Column:
        held = F.array_append(F.filter(acc["held"], lambda p: p >= x - span), x)
        full = F.size(held) >= least
        return F.struct(F.when(full, empty).otherwise(held).alias("held"), (acc["n"] + full.cast("int")).alias("n"))

    return places.select(*keys, F.aggregate("__at", F.struct(empty.alias("held"), F.lit(0).alias("n")), step, lambda a: a["n"]).alias("events"))


def snapshot(value: str, at: str, place: int) -> Column:
    """Aggregate: the value at a place, else at the last."""
    return F.coalesce(F.max(F.when(F.col(at) == place, F.col(value))), F.max_by(value, at))


def first_place(p: Column, at: str) -> Column:
    """Aggregate: the first place (from 1) where p holds."""
    return F.min(F.when(p, F.col(at) + 1))


def quantile_bins(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Equal-frequency bins, right-closed, the lowest value included, equal edges dropped; numbered from 0."""
    edges = exact_quantiles(df, [], value, [i / bins for i in range(bins + 1)], "__edges").select(F.array_distinct("__edges").alias("__edges"))  # one row
    inner = F.slice("__edges", 2, F.greatest(F.size("__edges") - 2, F.lit(0)))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(value))))).drop("__edges")


def digitized(df: DataFrame, value: str, at: list[float], name: str) -> DataFrame:
    """Left-closed bins between quantiles of all rows: how many of them the value reaches."""
    cuts = exact_quantiles(df, [], value, at, "__cuts").select("__cuts")  # one row
    return df.join(F.broadcast(cuts)).withColumn(name, F.size(F.filter("__cuts", lambda x: x <= F.col(value)))).drop("__cuts")


def above_mean(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rows of each key above the key's mean, decided without rounding: n times the value against the sum, in decimals (ten places, below 10^12).

    A mean of doubles depends on the order of additions by its last bit, and so would the side of a row that lies on the mean.  It decides only for keys, null among them, that hold a value
    which those decimals don't express.
    """
    v = F.col(value).cast("double")
    exact = v.try_cast("decimal(22,10)")
    rows = df.select(*keys, v.alias("__d"), exact.alias("__v"))
    sums = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.sum("__v").alias("__s"), F.count("__v").cast("decimal(10,0)").alias("__n"), F.avg("__d").alias("__mean"), (F.count_if(~F.col("__v").cast("double").eqNullSafe(F.col("__d"))) > 0).alias("__other")
    )
    both = rows.join(sums, reduce(and_, [rows[k].eqNullSafe(sums[f"__k{i}"]) for i, k in enumerate(keys)]))
    above = F.when(F.col("__other"), F.col("__d") > F.col("__mean")).otherwise(F.col("__v") * F.col("__n") > F.col("__s"))
    return both.groupBy(*keys).agg(F.count_if(above).alias(name))


def standardised(df: DataFrame, columns: list[str], keys: list[str] | None = None, sample_sd: bool = True) -> DataFrame:
    """<column>_z; 0 where the deviation is 0.  Statistics come by a join with their own small table, not by a sort."""
    sd = F.stddev_samp if sample_sd else F.stddev_pop
    stats = df.groupBy(*(keys or [])).agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)], *[sd(c).alias(f"__s{i}") for i, c in enumerate(columns)])
    both = df.join(stats, keys) if keys else df.join(F.broadcast(stats))
    z = lambda i, c: F.when(F.col(f"__s{i}") > 0, (F.col(c) - F.col(f"__m{i}")) / F.col(f"__s{i}")).when(F.col(c).isNotNull(), 0.0)
    return both.withColumns({f"{c}_z": z(i, c) for i, c in enumerate(columns)}).drop(*[f"__{k}{i}" for k in "ms" for i in range(len(columns))])


def standardised_by(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """<column>_z and <column>_z2 with mean and population deviation of the training rows."""
    stats = train.agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"__s{i}") for i, c in enumerate(columns)])
    both = df.join(F.broadcast(stats))
    out = {}
    for i, c in enumerate(columns):
        z = F.try_divide(F.col(c) - F.col(f"__m{i}"), F.col(f"__s{i}"))
        out |= {f"{c}_z": z, f"{c}_z2": z * z}
    return both.withColumns(out).drop(*[f"__{k}{i}" for k in "ms" for i in range(len(columns))])


def top_of(df: DataFrame, score: str, tie: str, q: float, fold: str | list[str] | None, name: str) -> DataFrame:
    """Marks the round(q n) best rows of each fold (or of all), half to even, ties by ``tie``.

    ``tie`` tells rows of a fold apart; null and NaN scores come last.  No fold is sorted: the score at the share's edge is an order statistic, and of the rows
    that have just that score the ranks by ``tie`` give the last one that is in.
    """
    keys = [fold] if isinstance(fold, str) else list(fold or [])
    value = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    rows = df.withColumn("__s", value)
    share = lambda n: F.bround(n * F.lit(q)).cast("long")
    cut = order_statistics(rows, keys, "__s", lambda n: F.array(n - share(n)), [1 - q])
    cut = staged(cut.select(*keys, F.col("value").alias("__cut"), (share(F.col("n")) - (F.col("n") - F.col("below") - F.col("equal"))).alias("__left"), F.col("equal").alias("__equal")), "cuts")
    both = attach(rows, cut, keys, "left")
    split = F.col("__left") < F.col("__equal")
    if cut.filter(split).isEmpty():
        last = F.lit(True)
        marked = both
    else:
        tied = both.filter(split & (F.col("__s") == F.col("__cut"))).select(*keys, tie, "__left")
        ends = global_rank(tied, keys, [tie], "__r").filter("__r <= __left").groupBy(*keys).agg(F.max(tie).alias("__last"))
        marked = attach(both, ends, keys, "left")
        last = ~split | (F.col(tie) <= F.col("__last"))
    return marked.withColumn(name, F.coalesce((F.col("__s") > F.col("__cut")) | ((F.col("__s") == F.col("__cut")) & last), F.lit(False))).select(*df.columns, name)


def top_share(df: DataFrame, score: str, tie: str, q: float, fold: str | list[str] | None) -> DataFrame:
    """The rows that top_of() marks."""
    return top_of(df, score, tie, q, fold, "__top").filter("__top").drop("__top")


def first_valid(df: DataFrame, keys: list[str], order: list[Column], n: int, valid: Column | None = None) -> DataFrame:
    """The first n valid rows of each key."""
    rows = df.filter(valid) if valid is not None else df
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def even_sample(df: DataFrame, keys: list[str], at: str, most: int) -> DataFrame:
    """At most ``most`` rows of a key, at even distances in its order: places round(i (n - 1) / (most - 1)), half to even."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(at)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(max(1, most - 1))).cast("long"))
    return ranked.filter((F.col("__n") <= most) | F.array_contains(places, F.col("__r").cast("long"))).drop("__r", "__n")


def seeded_key(id_: Column, seed: int) -> Column:
    """A hash order that any engine can make: the same sample on every run."""
    return F.md5(F.concat_ws(":", id_.cast("string"), F.lit(str(seed))))


def seeded_sample(df: DataFrame, id_: str, n: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """n rows (of each key) in hash order."""
    if not keys:
        return df.orderBy(seeded_key(F.col(id_), seed), id_).limit(n)
    return first_valid(df, keys, [seeded_key(F.col(id_), seed), F.col(id_)], n)


def folds(df: DataFrame, unit: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Folds of equal size over units in hash order."""
    units = df.select(unit).distinct().withColumn("__h", seeded_key(F.col(unit), seed))
    at = global_rank(units, [], ["__h", unit], "__r").select(unit, F.pmod(F.col("__r") - 1, F.lit(k)).cast("int").alias(name))
    return df.join(at, unit)


def hash_score(id_: Column, *marks: object) -> Column:
    """A whole number below 2^52 from an identifier and marks, the same in any engine: a score to choose at random by."""
    text = F.concat_ws(":", id_.cast("string"), *[m.cast("string") if isinstance(m, Column) else F.lit(str(m)) for m in marks])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def repeated_selection(df: DataFrame, id_: str, fold: str, q: float, repeats: int, seed: int, deviations: float = 6.0) -> DataFrame:
    """Share of ``repeats`` random selections of round(q n) rows a fold in which each row is selected: those of smallest hash, ties by identifier.

    Hashes are even, so the last selected row of a fold and repeat lies within some ``deviations`` of its place among them.  Rows are hashed once, those beyond are dropped at once, and
    only the few around that place are ranked.  Counts tell whether it lies there everywhere; where it doesn't, order statistics of all rows decide.
    """
    keys, n = [fold, "__rep"], F.col("__n")
    sizes = df.groupBy(fold).agg(F.count(F.lit(1)).alias("__n")).withColumn("__share", F.bround(n * F.lit(q)).cast("long"))
    slack = F.lit(deviations) * F.sqrt(n * F.lit(max(0.0, q * (1 - q)))) + F.lit(deviations)
    at = lambda rows: (rows / n * F.lit(2.0**52)).cast("double")
    sizes = staged(sizes.withColumns({"__low": at(F.col("__share") - slack), "__high": at(F.col("__share") + slack)}).drop("__n"), "shares")
    # A small file is one task to read, and each of its rows is ``repeats`` hashes: as many tasks as those ask for.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * repeats // 2_000_000))
    many = df.select(id_, fold).repartition(tasks, id_).withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    near = attach(many, sizes, [fold]).withColumn("__h", hash_score(F.col(id_), F.col("__rep"), seed)).filter("__h <= __high")
    near = staged(near.select(id_, *keys, "__h", (F.col("__h") < F.col("__low")).alias("__sure"), "__share"), "selected")
    counts = staged(near.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"), F.count_if("__sure").alias("__before"), F.max("__share").alias("__share")).filter("__share > 0"), "counts")
    if counts.filter("__before < __share and __share <= __c").count() < sizes.filter("__share > 0").count() * repeats:
        scored = many.withColumn("__h", -hash_score(F.col(id_), F.col("__rep"), seed).cast("double"))
        return top_of(scored, "__h", id_, q, keys, "__in").groupBy(id_, fold).agg(F.avg(F.col("__in").cast("int")).alias("p"))
    w = Window.partitionBy(*keys).orderBy("__h", id_)  # twice the slack: some multiple of the fold's root
    asked = attach(near.filter("not __sure").drop("__share"), counts.drop("__c"), keys).withColumn("__r", F.row_number().over(w) + F.col("__before"))
    last = asked.filter("__r = __share").select(*keys, F.col("__h").alias("__cut"), F.col(id_).alias("__last"))
    chosen = attach(near, staged(last, "cuts"), keys).filter((F.col("__h") < F.col("__cut")) | ((F.col("__h") == F.col("__cut")) & (F.col(id_) <= F.col("__last"))))
    both = df.select(id_, fold, F.lit(1).alias("__row"), F.lit(0).alias("__in")).unionAll(chosen.select(id_, fold, F.lit(0), F.lit(1)))
    return both.groupBy(id_, fold).agg((F.sum("__in") / (F.sum("__row") * F.lit(repeats))).alias("p"))


def quota(df: DataFrame, band: str, targets: dict[str, int], order: list[str]) -> DataFrame:
    """The first rows of each band, up to its target.  The largest target is a limit for every band, which tasks apply before rows are shuffled."""
    target = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))])
    some = df.filter(F.col(band).isin(list(targets)))
    ranked = some.withColumn("__r", F.row_number().over(Window.partitionBy(band).orderBy(*order))).filter(F.col("__r") <= max(targets.values(), default=0))
    return ranked.filter(F.col("__r") <= F.element_at(target, F.col(band))).drop("__r")


def until_stalled(taken: DataFrame, at: str, stall: int) -> DataFrame:
    """What a collector with a quota keeps: of the rows taken, those before the first gap of more than ``stall`` places, where it gives up.

    The rows taken are as many as the targets add up to, so one window holds them.
    """
    w = Window.orderBy(at)
    gap = F.coalesce(F.col(at) - F.lag(at).over(w) > stall, F.lit(False))
    return taken.withColumn("__gap", gap).withColumn("__off", F.max("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("__off")).drop("__gap", "__off")
